"""Temporal distributions, customer behaviour and cohorts on hand-made rows,
and the per-customer gap identity against the literal window form."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from helpers import rows

from tiller.operators import cohorts, customers, temporal

TX_SCHEMA = "date date, store_id bigint, customer_id bigint, products string"


def _tx(spark, data):
    return spark.createDataFrame([(d, s, c, "1") for d, s, c in data], TX_SCHEMA)


D = dt.date


def test_weekday_labels_and_shares(spark):
    tx = _tx(spark, [(D(2024, 1, 7), 1, 1), (D(2024, 1, 8), 1, 1), (D(2024, 1, 13), 1, 2),
                     (None, 1, 3)])
    got = {r["day_of_week"]: (r["day_name"], r["transactions"])
           for r in temporal.weekday_distribution(tx).collect()}
    assert got == {1: ("Domingo", 1), 2: ("Lunes", 1), 7: ("Sábado", 1), None: ("Desconocido", 1)}
    w = temporal.weekend_share(tx).collect()[0]
    assert (w["transactions"], w["weekend_transactions"], w["weekend_pct"]) == (4, 2, 50.0)
    total = sum(r["pct"] for r in temporal.weekday_distribution(tx).collect())
    assert math.isclose(total, 100.0)


def test_store_gaps(spark):
    data = [(D(2024, 1, 1), s, 1) for s, n in [(103, 4), (102, 2), (110, 1)] for _ in range(n)]
    g = {r["store_id"]: r for r in temporal.store_gaps(_tx(spark, data)).collect()}
    assert g[103]["gap_to_leader_pct"] == 0.0 and g[103]["growth_to_next_pct"] is None
    assert math.isclose(g[110]["gap_to_leader_pct"], 75.0)
    assert math.isclose(g[102]["growth_to_next_pct"], 100.0)
    assert math.isclose(g[103]["lead_over_next_pct"], 100.0)
    assert rows(temporal.store_ranking(_tx(spark, data)), "rank", "store_id") == [
        (1, 103), (2, 102), (3, 110)]


def test_monthly_growth(spark):
    data = [(D(2024, 1, 5), 1, 1)] * 2 + [(D(2024, 2, 5), 1, 1)] * 3 + [(D(2024, 3, 5), 1, 1)]
    g = temporal.monthly_growth(_tx(spark, data)).orderBy("month").collect()
    assert [r["transactions"] for r in g] == [2, 3, 1]
    assert g[0]["growth_pct"] is None
    assert math.isclose(g[1]["growth_pct"], 50.0)
    assert math.isclose(g[2]["growth_from_first_pct"], -50.0)


def test_customer_operators(spark):
    data = [(D(2024, 1, 1), 1, 1),                                     # single purchase
            (D(2024, 1, 1), 1, 2), (D(2024, 1, 1), 1, 2),              # same day twice
            (D(2024, 1, 1), 1, 3), (D(2024, 1, 11), 1, 3), (D(2024, 1, 31), 1, 3),
            (D(2024, 2, 1), 1, None)]                                  # no customer
    tx = _tx(spark, data)
    gaps = {r["customer_id"]: r["mean_gap_days"] for r in customers.customer_gaps(tx).collect()}
    assert gaps == {1: None, 2: 0.0, 3: 15.0}
    ipd = customers.inter_purchase_days(tx).collect()[0]
    assert ipd["customers_with_gap"] == 2 and math.isclose(ipd["avg_days_between_purchases"], 7.5)
    n = customers.new_customer_share(tx).collect()[0]
    assert (n["customers"], n["new_customers"]) == (3, 1)
    assert rows(customers.top_customer(tx)) == [(3, 3)]
    seg = {r["segment"]: r["customers"] for r in customers.customer_segments(tx).collect()}
    assert seg == {"1": 1, "2-3": 2}
    freq = rows(customers.purchase_frequency(tx), "num_purchases", "num_customers")
    assert freq == [(1, 1), (2, 1), (3, 1)]
    rate = {r["segment"]: r for r in customers.segment_rate(tx).collect()}
    assert rate["2-3"]["months"] == 2
    assert math.isclose(rate["2-3"]["purchases_per_customer_month"], 5 / (2 * 2))


def test_gaps_match_plain_python(spark):
    rnd = random.Random(5)
    data = [(D(2024, 1, 1) + dt.timedelta(days=rnd.randint(0, 200)), 1, rnd.randint(1, 40))
            for _ in range(600)]
    data += [(None, 1, 7), (None, 1, 99)]
    days = {}
    for d, _, c in data:
        days.setdefault(c, []).extend([d] if d else [])
    got = {r["customer_id"]: r["mean_gap_days"] for r in customers.customer_gaps(_tx(spark, data)).collect()}
    assert got.keys() == days.keys()
    for c, own in days.items():
        own.sort()
        gaps = [(b - a).days for a, b in zip(own, own[1:])]
        assert got[c] is None if not gaps else math.isclose(got[c], sum(gaps) / len(gaps))


def test_cohorts(spark):
    data = [(D(2024, 1, 5), 1, 1), (D(2024, 3, 5), 1, 1), (D(2024, 1, 9), 1, 2),
            (D(2024, 2, 9), 1, 2), (D(2024, 2, 10), 1, 2), (D(2024, 2, 1), 1, 3),
            (None, 1, 4), (D(2024, 1, 1), 1, None)]
    tx = _tx(spark, data)
    assert rows(cohorts.cohort_sizes(tx)) == [(D(2024, 1, 1), 2), (D(2024, 2, 1), 1)]
    ret = rows(cohorts.retention(tx))
    assert ret == [(D(2024, 1, 1), 0, 2, 2, 1.0), (D(2024, 1, 1), 1, 1, 2, 0.5),
                   (D(2024, 1, 1), 2, 1, 2, 0.5), (D(2024, 2, 1), 0, 1, 1, 1.0)]
    m = cohorts.retention_matrix(tx).collect()
    assert [c for c in m[0].asDict()] == ["cohort_month", "0", "1", "2"]
    assert m[1]["1"] is None
    fixed = cohorts.retention_matrix(tx, indices=[0, 1, 2, 3])
    assert fixed.columns == ["cohort_month", "0", "1", "2", "3"]
    with pytest.raises(Exception, match="not listed"):
        cohorts.retention_matrix(tx, indices=[0, 1]).collect()


def test_previous_purchase(spark, monkeypatch):
    """As a lag over all rows gives it, with days of many purchases cut into blocks."""
    import random

    monkeypatch.setattr(customers, "DAY_BLOCK", 4)
    rnd = random.Random(1)
    start = dt.date(2024, 1, 1)
    data = [(start + dt.timedelta(days=rnd.randint(0, 20)) if rnd.random() > 0.05 else None,
             rnd.choice([1, 1, 1, 2, 3, None])) for _ in range(300)] + [(start, 9)]
    df = spark.createDataFrame(data, "date date, customer_id long")
    want = []
    for c in {c for _, c in data if c is not None}:
        last = None
        for d in sorted(d for d, x in data if x == c and d is not None):
            want.append((c, d, last, None if last is None else (d - last).days))
            last = d
    key = repr
    got = customers.previous_purchase(df)
    assert got.columns == ["customer_id", "date", "prev_date", "gap_days"]
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    days = customers.purchase_days(df).agg(F.sum("purchases")).first()[0]
    assert days == len(want)
    # the mean of the gaps is what customer_gaps telescopes
    means = {r["customer_id"]: r["m"] for r in got.groupBy("customer_id").agg(F.avg("gap_days").alias("m")).collect()}
    for r in customers.customer_gaps(df).collect():
        m = means[r["customer_id"]]
        assert (m is None) == (r["mean_gap_days"] is None) and (m is None or abs(m - r["mean_gap_days"]) < 1e-9)
    assert customers.previous_purchase(df.limit(0)).count() == 0
