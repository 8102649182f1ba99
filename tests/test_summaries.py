"""Mergeable summaries: sketches, cohort states and heavy hitters."""

from datetime import date as D

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tiller.operators import baskets, cohorts, heavy, sketches


def zipf(spark, n=6000):
    """Item i sells about n / i times, a third of all rows are item 1, some are NULL."""
    items = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).when(F.col("id") % 500 == 1, F.lit(None))
        .otherwise((F.lit(n) / (F.pmod(F.xxhash64("id"), F.lit(n)) + 1)).cast("bigint")).alias("item"))
    return items.repartition(5, F.rand(3))


@pytest.mark.parametrize("counters", [2, 40, 60, 150, 1 << 14])
def test_heavy_hitters_are_exact(spark, counters):
    items = zipf(spark)
    assert heavy.top_products(items, 10, counters=counters).collect() == \
        baskets.top_products(items, 10).collect()


def test_count_tables_bound_every_count(spark):
    items = zipf(spark)
    true = {r["item"]: r["units"] for r in baskets.item_counts(items).collect()}
    for counters in (5, 30):
        table = heavy.count_table(items, counters=counters).collect()
        error = sum(r["error"] or 0 for r in table)
        low = {}
        for r in table:
            if r["units"] is not None:
                low[r["item"]] = low.get(r["item"], 0) + r["units"]
        assert error and len(table) <= 5 * (counters + 1)
        assert all(low.get(i, 0) <= n <= low.get(i, 0) + error for i, n in true.items())
    error, least = heavy.bounds(heavy.count_table(items, counters=30), 5)
    assert least > error  # the candidates are found by the bounds, not by a full count


def test_heavy_hitters_of_ties_strings_and_nothing(spark):
    ties = spark.createDataFrame([(x,) for x in "abcabcabcd"], "item string")
    for counters in (1, 2, 100):
        assert rows(heavy.top_items(ties, 2, counters=counters)) == [("a", 3), ("b", 3)]
    assert heavy.top_products(ties.limit(0), 3).count() == 0


def test_cohort_state(spark):
    tx = spark.createDataFrame([
        (1, D(2023, 12, 31)), (1, D(2024, 1, 1)), (1, D(2024, 1, 9)), (1, D(2031, 5, 2)),
        (2, D(2024, 2, 2)), (3, D(2019, 12, 1)), (3, D(2020, 1, 1)), (4, D(1969, 12, 31)),
        (4, D(1970, 1, 1)), (None, D(2024, 1, 1)), (5, None)], "customer_id bigint, date date")
    state = cohorts.cohort_state(tx)
    assert rows(cohorts.cohorts_of_state(state)) == rows(
        cohorts.with_cohort(tx).select("customer_id", "month", "cohort_month", "cohort_index"))
    old = cohorts.cohort_state(tx.where("date < '2024-01-05'"))
    new = cohorts.cohort_state(tx.where("date >= '2024-01-01'"))  # some rows in both
    assert rows(cohorts.merge_states(old, new)) == rows(state)
    assert cohorts.retention_of_state(cohorts.merge_states(old, new)).collect() == \
        cohorts.retention(tx).collect()
    assert cohorts.retention_of_state(cohorts.cohort_state(tx.limit(0))).count() == 0


def test_distinct_sketches(spark):
    tx = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 9000).alias("customer_id"),
        F.expr("date_add(date'2024-01-01', CAST(id % 500 AS INT))").alias("date"))
    monthly = sketches.monthly_distinct_sketches(tx.union(
        spark.createDataFrame([(None, D(2024, 1, 1)), (1, None)], tx.schema)))
    got = rows(sketches.distinct_check(tx, sketches.distinct_by_year(monthly)))
    assert [(y, ok) for y, _, ok in got] == [(2024, True), (2025, True)]
    part = tx.where("date < '2024-04-01'").select("customer_id").distinct().count()
    est = sketches.distinct_between(monthly, "2024-01-01", "2024-03-01").first()["estimate"]
    assert abs(est - part) <= sketches.distinct_error() * part
    assert sketches.distinct_between(monthly, "1990-01-01", "1990-02-01").first()["estimate"] == 0


def test_quantile_sketches(spark):
    df = spark.range(20000).select((F.col("id") % 7).alias("part"), F.when(
        F.col("id") % 3 == 0, F.lit(5)).otherwise(F.pmod(F.xxhash64("id"), F.lit(100000))).alias("size"))
    df = df.unionByName(spark.createDataFrame([(1, None)], df.schema))
    probs = (0.0, 0.25, 0.5, 0.9, 1.0)
    fine = sketches.quantile_sketches(df.withColumn("half", F.col("size") % 2), ["part", "half"], "size")
    read = sketches.read_quantiles(sketches.merge_quantiles(fine, ["part"]), ["part"], probs)
    values = {i: sorted(r["size"] for r in df.where("size is not null").where(f"part = {i}").collect())
              for i in range(7)}
    got = rows(sketches.quantile_check(df, read, ["part"], "size", sketches.quantile_error()))
    assert got == [(i, p, len(v), v[max(1, -(-int(p * 100) * len(v) // 100)) - 1], True)
                   for i, v in values.items() for p in probs]
    assert {r["rows"] for r in read.collect()} == {len(v) for v in values.values()}
    # an estimate of another rank is told apart
    wrong = read.withColumn("estimate", F.lit(90000).cast("bigint")).where("p = 0.25")
    assert {r["within_bound"] for r in sketches.quantile_check(
        df, wrong, ["part"], "size", sketches.quantile_error()).collect()} == {False}
    with pytest.raises(ValueError):
        sketches.quantile_check(df, read, [], "size", 0.1)
    assert sketches.quantile_sketches(df.limit(0), ["part"], "size").count() == 0
