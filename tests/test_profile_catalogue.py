"""Profiling, quality and catalogue operators on hand-made rows."""

import math

from pyspark.sql import functions as F

from helpers import rows

from tiller.operators import catalogue, profile

PC_SCHEMA = "code_pr int, code int"
CAT_SCHEMA = "id int, category_name string"


def test_schema_profile(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x bigint, y string")
    assert rows(profile.schema_profile(df)) == [(1, "x", "bigint", 2), (2, "y", "string", 2)]


def test_null_counts_types(spark):
    df = spark.createDataFrame([(1.0, "", None), (float("nan"), "a", 3), (None, None, 4)],
                               "d double, s string, i int")
    got = {r["column_name"]: r["nulls"] for r in profile.null_counts(df).collect()}
    assert got == {"d": 2, "s": 2, "i": 1}


def test_duplicates_and_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, None), (None, None)],
                               "k int, v string")
    r = profile.exact_duplicates(df).collect()[0]
    assert (r["num_rows"], r["distinct_rows"], r["duplicates"]) == (5, 3, 2)
    assert math.isclose(r["duplicate_pct"], 40.0)
    k = profile.duplicates_on(df, ["k"]).collect()[0]
    assert k["duplicates"] == 3


def test_distinct_counts_null_is_a_value(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (2,)], "c int")
    assert profile.distinct_count(df, "c").collect()[0][0] == 3
    assert rows(profile.repeated_keys(df, "c")) == [(4, 3, 1)]


def test_empty_inputs(spark):
    df = spark.createDataFrame([], "k int, v string")
    assert profile.exact_duplicates(df).collect()[0]["num_rows"] == 0
    assert rows(profile.null_counts(df)) == [(1, "k", 0), (2, "v", 0)]
    assert catalogue.category_distribution(spark.createDataFrame([], PC_SCHEMA),
                                           spark.createDataFrame([], CAT_SCHEMA)).count() == 0


def test_category_distribution_default_and_no_fanout(spark):
    pc = spark.createDataFrame([(10, 1), (11, 1), (12, 2), (13, 3)], PC_SCHEMA)
    cat = spark.createDataFrame([(1, "B"), (1, "A"), (2, "C")], CAT_SCHEMA)
    got = catalogue.category_distribution(pc, cat).collect()
    assert [(r["code"], r["category_name"], r["num_products"], r["pct"]) for r in got] == [
        (1, "A", 2, 50.0), (2, "C", 1, 25.0), (3, "Desconocida", 1, 25.0)]


def test_orphans_and_integrity(spark):
    pc = spark.createDataFrame([(10, 1), (11, 4), (12, 4), (13, None)], PC_SCHEMA)
    cat = spark.createDataFrame([(1, "A")], CAT_SCHEMA)
    got = sorted((tuple(r) for r in profile.orphans(pc, cat, "code").collect()), key=str)
    assert got == sorted([(4, 2), (None, 1)], key=str)
    s = profile.orphan_summary(pc, cat, "code").collect()[0]
    assert (s["total_rows"], s["orphan_rows"], s["orphan_keys"]) == (4, 3, 2)
    assert math.isclose(s["integrity_pct"], 25.0)


def test_multi_category_and_averages(spark):
    # products: 10 -> {1, 2}, 11 -> {1}, 12 -> {1} (duplicate rows ignored)
    pc = spark.createDataFrame([(10, 1), (10, 2), (10, 2), (11, 1), (12, 1), (12, 1)], PC_SCHEMA)
    m = profile_row(catalogue.multi_category_products(pc))
    assert (m["unique_products"], m["multi_category_products"]) == (3, 1)
    assert math.isclose(m["multi_category_pct"], 100 / 3)
    a = profile_row(catalogue.relation_averages(pc))
    assert math.isclose(a["avg_categories_per_product"], 4 / 3)
    assert math.isclose(a["avg_products_per_category"], 2.0)
    rel = {r["metric"]: r["value"] for r in catalogue.category_relations(pc).collect()}
    assert rel["multi_category_products"] == 1.0


def test_head_tail(spark):
    pc = spark.createDataFrame([(i, c) for c in range(6) for i in range(c + 1)], PC_SCHEMA)
    cat = spark.createDataFrame([(c, f"n{c}") for c in range(6)], CAT_SCHEMA)
    ht = catalogue.head_tail_categories(pc, cat, head=2, tail=2).collect()
    assert [(r["part"], r["code"]) for r in ht if r["part"] == "head"] == [("head", 5), ("head", 4)]
    assert sorted((r["position"], r["code"]) for r in ht if r["part"] == "tail") == [(1, 0), (2, 1)]


def test_quality_scorecard(spark):
    tx = spark.createDataFrame(
        [("2013-01-01", 1, 1, "1 2"), ("2013-01-01", 1, 1, "1 2"), (None, 1, 2, "")],
        "date string, store_id int, customer_id int, products string"
    ).selectExpr("cast(date as date) date", "store_id", "customer_id", "products")
    got = {r["metric"]: r["value"] for r in profile.quality_scorecard(tx).collect()}
    assert got["nulls"] == 2.0
    assert got["exact_duplicates"] == 1.0
    assert got["key_duplicates"] == 1.0
    assert math.isclose(got["dates_outside_pct"], 100 / 3)
    assert math.isclose(got["completeness_pct"], 100 - 2 * 100 / 12)


def profile_row(df):
    return df.collect()[0]


ODD = [("a", None, 1.0, None), (None, "a", 1.0, None), ("a", None, 1.0, [1, None]), ("", "a", 1.0, []),
       ("a", "", 0.0, None), ("a", "", -0.0, None), ("ab", "c", None, None), ("a", "bc", None, None),
       ("a", None, 1.0, None), (None, None, None, None), (None, None, None, None),
       ("a", None, float("nan"), None), ("a", None, float("nan"), None), ("x" * 100000, "y", 2.0, [3])]


def _odd(spark):
    return spark.createDataFrame(ODD + ODD[:3], "`a.b` string, c string, d double, e array<int>")


def test_fingerprints_tell_rows_apart_as_grouping_does(spark):
    df = _odd(spark)
    want = sorted(r["n"] for r in df.groupBy("`a.b`", "c", "d", "e").agg(F.count("*").alias("n")).collect())
    assert sorted(r["_n"] for r in profile.row_groups(df).collect()) == want
    row = profile.exact_duplicates(df).first()
    assert (row["num_rows"], row["distinct_rows"], row["duplicates"]) == (
        len(ODD) + 3, len(want), len(ODD) + 3 - len(want))


def test_colliding_hashes_do_not_join_rows(spark):
    """Forced collisions of the 64-bit hashes: the check part still tells the rows apart."""
    df = _odd(spark)
    *_, check = profile.row_fingerprint(df)
    same = [F.lit(1).cast("long"), F.lit(2).cast("long"), check]
    assert sorted(r["_n"] for r in profile.row_groups(df, fingerprint=same).collect()) == sorted(
        r["_n"] for r in profile.row_groups(df).collect())


def test_shuffled_rows_do_not_grow_with_the_text(spark):
    """Duplicates, scorecard and summary shuffle fingerprints, not texts."""
    def exchanged(op, width):
        df = spark.range(3).select(F.current_date().alias("date"), F.col("id").alias("customer_id"),
                                   F.lit(1).cast("long").alias("store_id"),
                                   F.repeat(F.lit("x"), width).alias("products"))
        plan = op(df)._jdf.queryExecution().executedPlan().toString()
        return [line for line in plan.splitlines() if "Exchange" in line and "products" in line]

    for op in (profile.exact_duplicates, profile.quality_scorecard,
               lambda df: profile.table_summary("t", df)):
        assert exchanged(op, 10 ** 5) == []
        plan = op(spark.createDataFrame([], "date date, customer_id long, products string"))
        plan = plan._jdf.queryExecution().executedPlan().toString()
        grouped = [x for x in plan.splitlines() if "HashAggregate(keys=[" in x and "products" in x]
        assert grouped == []
