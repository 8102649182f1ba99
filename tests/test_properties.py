"""Property tests: random small transaction sets against pandas brute force
written the literal way (aggregate + join back for cohorts, per-row lag for
gaps, sorted lists for quantiles)."""

import datetime as dt
import math

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tiller.operators import baskets, cohorts, customers

TX_SCHEMA = "date date, store_id bigint, customer_id bigint, products string"
SETTINGS = dict(max_examples=6, deadline=None,
                suppress_health_check=[HealthCheck.function_scoped_fixture])

row = st.tuples(
    st.one_of(st.none(), st.dates(dt.date(2023, 1, 1), dt.date(2024, 6, 30))),
    st.integers(1, 3),
    st.one_of(st.none(), st.integers(1, 12)),
    st.one_of(st.none(), st.lists(st.integers(1, 9), min_size=1, max_size=12)
              .map(lambda xs: " ".join(map(str, xs)))),
)


def _frame(spark, data):
    return spark.createDataFrame(data, TX_SCHEMA)


@settings(**SETTINGS)
@given(st.lists(row, min_size=1, max_size=60))
def test_retention_matches_literal_cohorts(spark, data):
    pdf = pd.DataFrame(data, columns=["date", "store_id", "customer_id", "products"])
    pdf = pdf.dropna(subset=["date", "customer_id"])
    expected = set()
    if len(pdf):
        pdf["month"] = pdf["date"].map(lambda d: dt.date(d.year, d.month, 1))
        first = pdf.groupby("customer_id")["month"].min().rename("first")
        j = pdf.join(first, on="customer_id")
        j["idx"] = j.apply(lambda r: (r["month"].year - r["first"].year) * 12
                           + r["month"].month - r["first"].month, axis=1)
        act = j.groupby(["first", "idx"])["customer_id"].nunique()
        size = act.xs(0, level="idx")
        expected = {(f, i, int(a), int(size[f]), a / size[f]) for (f, i), a in act.items()}
    got = {(r[0], r[1], r[2], r[3], r[4]) for r in cohorts.retention(_frame(spark, data)).collect()}
    assert {k[:4] for k in got} == {k[:4] for k in expected}
    exp = {k[:4]: k[4] for k in expected}
    assert all(math.isclose(r[4], exp[r[:4]]) for r in got)


@settings(**SETTINGS)
@given(st.lists(row, min_size=1, max_size=60))
def test_gaps_match_lag(spark, data):
    pdf = pd.DataFrame(data, columns=["date", "store_id", "customer_id", "products"])
    pdf = pdf.dropna(subset=["customer_id"])
    expected = {}
    for cid, g in pdf.groupby("customer_id"):
        dates = sorted((d for d in g["date"] if d is not None))
        nulls = sum(1 for d in g["date"] if d is None)
        seq = [None] * nulls + dates
        gaps = [(b - a).days for a, b in zip(seq, seq[1:]) if a is not None and b is not None]
        expected[int(cid)] = sum(gaps) / len(gaps) if gaps else None
    got = {r["customer_id"]: r["mean_gap_days"]
           for r in customers.customer_gaps(_frame(spark, data)).collect()}
    assert got.keys() == expected.keys()
    for k, v in expected.items():
        assert (v is None and got[k] is None) or math.isclose(got[k], v)


@settings(**SETTINGS)
@given(st.lists(row, min_size=1, max_size=60))
def test_basket_statistics_match_lists(spark, data):
    sizes = [len(p.split(" ")) for _, _, _, p in data if p is not None]
    stats = baskets.basket_statistics(_frame(spark, data)).collect()[0]
    assert stats["baskets"] == len(sizes)
    if not sizes:
        assert stats["mean_size"] is None
        return
    s = sorted(sizes)

    def q(p):
        return s[max(math.ceil(p * len(s)), 1) - 1]

    assert (stats["p25"], stats["median"], stats["p75"]) == (q(0.25), q(0.5), q(0.75))
    assert math.isclose(stats["mean_size"], sum(s) / len(s))
    if len(s) > 1:
        m = sum(s) / len(s)
        assert math.isclose(stats["stddev_size"], math.sqrt(sum((x - m) ** 2 for x in s) / (len(s) - 1)),
                            abs_tol=1e-12)
    counts = pd.Series(s).value_counts()
    assert stats["mode_size"] == min(counts[counts == counts.max()].index)


def _naive(values, horizon=6):
    """Seasonal-naive forecast of {month number: value}: months count from year 0."""
    first, last = min(values), max(values)
    held = {m: values.get(m, 0) for m in range(first, last + 1)}
    out = []
    for m in range(last + 1, last + 1 + horizon):
        alike = [v for k, v in held.items() if k % 12 == m % 12] or list(held.values())
        out.append((dt.date(m // 12, m % 12 + 1, 1), sum(alike) / len(alike)))
    return out


@settings(**SETTINGS)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 500)), min_size=1, max_size=30,
                unique_by=lambda t: t[0]))
def test_seasonal_naive_matches_pandas(spark, points):
    from tiller.operators import forecast

    base = dt.date(2020, 1, 1)
    months = [dt.date(base.year + (base.month - 1 + k) // 12, (base.month - 1 + k) % 12 + 1, 1)
              for k, _ in points]
    series = spark.createDataFrame([(m, v) for m, (_, v) in zip(months, points)],
                                   "month date, transactions bigint")
    got = sorted((r["month"], r["yhat"]) for r in forecast.seasonal_naive(series).collect())
    expected = _naive({m.year * 12 + m.month - 1: v for m, (_, v) in zip(months, points)})
    assert [g[0] for g in got] == [e[0] for e in expected]
    assert all(math.isclose(g[1], e[1], rel_tol=1e-12, abs_tol=1e-9) for g, e in zip(got, expected))


@settings(**SETTINGS)
@given(st.lists(row, min_size=1, max_size=80))
def test_customer_frequency_matches_pandas(spark, data):
    from tiller.functions.labels import CUSTOMER_SEGMENTS

    pdf = pd.DataFrame(data, columns=["date", "store_id", "customer_id", "products"])
    per = pdf.dropna(subset=["customer_id"]).groupby("customer_id").size()
    tx = _frame(spark, data)
    freq = {r["num_purchases"]: r["num_customers"] for r in customers.purchase_frequency(tx, 20).collect()}
    expected = per.value_counts().sort_index()
    assert freq == {int(k): int(v) for k, v in expected.items() if k in sorted(expected.index)[:20]}
    seg = {r["segment"]: r["customers"] for r in customers.customer_segments(tx).collect()}
    exp_seg = {}
    for n in per:
        for lab, lo, hi, _ in CUSTOMER_SEGMENTS:
            if n >= lo and (hi is None or n <= hi):
                exp_seg[lab] = exp_seg.get(lab, 0) + 1
    assert seg == exp_seg
    new = customers.new_customer_share(tx).collect()[0]
    assert (new["customers"], new["new_customers"]) == (len(per), int((per == 1).sum()))


@settings(**SETTINGS)
@given(st.lists(st.tuples(st.integers(1, 30), st.one_of(st.none(), st.integers(0, 8))),
                min_size=1, max_size=80))
def test_catalogue_matches_pandas(spark, pairs):
    from tiller.operators import catalogue

    pc = spark.createDataFrame(pairs, "code_pr int, code int")
    cat = spark.createDataFrame([(c, f"n{c}") for c in range(0, 6)] + [(2, "a-dup")],
                                "id int, category_name string")
    pdf = pd.DataFrame(pairs, columns=["code_pr", "code"])
    counts = pdf["code"].value_counts(dropna=False)
    got = {r["code"]: (r["category_name"], r["num_products"])
           for r in catalogue.category_distribution(pc, cat).collect()}
    names = {c: f"n{c}" for c in range(6)}
    names[2] = min("n2", "a-dup")
    exp = {(None if pd.isna(k) else int(k)): (names.get(None if pd.isna(k) else int(k), "Desconocida"),
                                              int(v)) for k, v in counts.items()}
    assert got == exp
    distinct = pdf.drop_duplicates()
    per_product = distinct.groupby("code_pr", dropna=False)["code"].count()
    m = catalogue.multi_category_products(pc).collect()[0]
    assert (m["unique_products"], m["multi_category_products"]) == (
        len(per_product), int((per_product > 1).sum()))
    a = catalogue.relation_averages(pc).collect()[0]
    assert math.isclose(a["avg_categories_per_product"], per_product.mean())
    per_cat = distinct.groupby("code", dropna=False)["code_pr"].count()
    assert math.isclose(a["avg_products_per_category"], per_cat.mean())
