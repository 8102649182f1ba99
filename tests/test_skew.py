"""Skew: one customer holds a third of all rows.  The customer and cohort
operators must not route that customer's rows to one task; task-level
shuffle metrics from Spark's status store show how many records each reduce
task read."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tiller.operators import cohorts, customers

N = 30000
HOT = N // 3
# Criterion: if a hot key's rows were routed to one task, that task would
# read at least HOT records; a spread plan reads about N / 8 per task
# (~3.75k here, for operators whose shuffled rows are nearly all distinct).
# HOT // 2 separates the two cases.


@pytest.fixture(scope="module", autouse=True)
def no_coalescing(spark):
    """Keep AQE from merging small reduce partitions, so per-task reads show
    where a key's rows go rather than how small partitions were packed."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, old)


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(9)
    start = dt.date(2023, 1, 1)
    rows = []
    for i in range(N):
        cust = 1 if i < HOT else rnd.randint(2, 3000)
        rows.append((start + dt.timedelta(days=rnd.randint(0, 540)), 1, cust, "1 2"))
    df = spark.createDataFrame(rows, "date date, store_id bigint, customer_id bigint, products string")
    return df.repartition(8).cache()


_PROBES = iter(range(10**6))


def _max_task_shuffle_read(spark, run) -> int:
    """Largest number of shuffle records read by one task during ``run``."""
    sc = spark.sparkContext
    group = f"skew-probe-{next(_PROBES)}"
    sc.setJobGroup(group, "skew probe", interruptOnCancel=False)
    tracker = sc.statusTracker()
    run()
    store = sc._jsc.sc().statusStore()
    most = 0
    for job_id in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job_id)
        for stage_id in (info.stageIds if info else []):
            tasks = store.taskList(stage_id, 0, 100000)
            for i in range(tasks.size()):
                m = tasks.apply(i).taskMetrics()
                if m.isDefined():
                    most = max(most, m.get().shuffleReadMetrics().recordsRead())
    sc.setJobGroup("other", "other", interruptOnCancel=False)
    return most


def _noop(df):
    return lambda: df.write.format("noop").mode("overwrite").save()


def test_previous_purchases_of_a_hot_customer_are_split(spark, skewed):
    """A third of all rows are one customer's, and half of those are of one day."""
    day = F.when((F.col("customer_id") == 1) & (F.rand(3) < 0.5), F.lit("2023-03-01").cast("date"))
    df = skewed.withColumn("date", F.coalesce(day, "date")).persist()
    df.count()
    out = customers.previous_purchase(df)
    assert _max_task_shuffle_read(spark, _noop(out)) < HOT // 2
    each = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert each < HOT // 2 + N // 8 and out.count() == N
    df.unpersist()


def test_skewed_customer_aggregates_stay_spread(spark, skewed):
    skewed.count()
    for op in (customers.customer_gaps, customers.purchases_per_customer,
               customers.inter_purchase_days, cohorts.retention):
        most = _max_task_shuffle_read(spark, _noop(op(skewed)))
        assert most < HOT // 2, (op.__name__, most)


def test_hot_customer_mean_gap(spark, skewed):
    days = sorted(r["date"] for r in skewed.where("customer_id = 1").select("date").collect())
    expected = sum((b - a).days for a, b in zip(days, days[1:])) / (len(days) - 1)
    got = customers.customer_gaps(skewed).where("customer_id = 1").collect()[0]["mean_gap_days"]
    assert abs(got - expected) < 1e-9


def test_hot_order(spark):
    """An order with a third of all lines never lands in one task."""
    from tiller.operators import baskets

    rnd = random.Random(8)
    lines = spark.createDataFrame(
        [(1 if i < HOT else rnd.randint(2, 4000), i) for i in range(N)],
        "tx_id bigint, item bigint").repartition(8).cache()
    lines.count()
    for df in (baskets.basket_statistics_from_lines(lines),
               baskets.basket_summary(lines, lines="tx_id"),
               baskets.basket_quantiles_approx(lines, lines="tx_id")):
        assert _max_task_shuffle_read(spark, _noop(df)) < HOT // 2
    assert baskets.basket_summary(lines, lines="tx_id").collect()[0]["max_size"] == HOT


def test_hot_tie(spark):
    """Most products with the same number of units: the running sum stays spread."""
    from tiller.operators import baskets

    items = spark.createDataFrame([(i, i) for i in range(N)] + [(i, 5) for i in range(9)],
                                  "tx_id bigint, item bigint").repartition(8).cache()
    items.count()
    assert _max_task_shuffle_read(spark, _noop(baskets.pareto_products(items))) < HOT
    got = {r["rank"]: r["item"] for r in baskets.pareto_products(items).collect()}
    assert [got[i] for i in (1, 2, 6, 7, N)] == [5, 0, 4, 6, N - 1] and len(got) == N


def test_hot_product_and_category(spark, skewed):
    from tiller.operators import baskets, catalogue, profile

    rnd = random.Random(4)
    items = spark.createDataFrame(
        [(i, 7 if i < HOT else rnd.randint(1, 2000)) for i in range(N)],
        "tx_id bigint, item bigint").repartition(8).cache()
    pc = spark.createDataFrame(
        [(rnd.randint(1, 5000), 3 if i < HOT else rnd.randint(0, 40)) for i in range(N)],
        "code_pr int, code int").repartition(8).cache()
    cat = spark.createDataFrame([(c, f"c{c}") for c in range(30)], "id int, category_name string")
    items.count(), pc.count()
    for df in (baskets.top_products(items), baskets.pareto_products(items),
               baskets.concentration(items), baskets.units_sold(items),
               catalogue.category_distribution(pc, cat), profile.orphans(pc, cat, "code"),
               profile.orphan_summary(pc, cat, "code"), catalogue.category_relations(pc)):
        most = _max_task_shuffle_read(spark, _noop(df))
        assert most < HOT // 2, most


def test_hot_duplicate_row(spark):
    """A single row repeated for a third of the table (exact duplicates)."""
    from tiller.operators import baskets, profile
    from tiller.plans.report import transaction_summary

    rnd = random.Random(6)
    start = dt.date(2023, 1, 1)
    rows = [(start, 1, 1, "1 2 3") if i < HOT else
            (start + dt.timedelta(days=rnd.randint(0, 400)), 2, rnd.randint(2, 5000),
             " ".join(str(rnd.randint(1, 50)) for _ in range(rnd.randint(1, 6))))
            for i in range(N)]
    tx = spark.createDataFrame(rows, "date date, store_id bigint, customer_id bigint, products string")
    tx = tx.repartition(8).cache()
    tx.count()
    items = baskets.basket_items(tx)
    for df in (profile.exact_duplicates(tx), profile.quality_scorecard(tx),
               transaction_summary(tx, items), baskets.basket_statistics(tx),
               profile.duplicates_on(tx, ["date", "customer_id"])):
        most = _max_task_shuffle_read(spark, _noop(df))
        assert most < HOT // 2, most
    r = profile.exact_duplicates(tx).collect()[0]
    assert r["duplicates"] >= HOT - 1
