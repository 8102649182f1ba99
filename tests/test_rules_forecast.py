"""Association rules against exhaustive enumeration; forecasts against a
plain-Python run of the same definitions."""

import datetime as dt
import itertools
import math
import random

import pytest

from helpers import rows

from tiller.operators import forecast, rules


def _brute_rules(baskets, min_support, min_conf):
    n = len(baskets)
    sets = [frozenset(b) for b in baskets]
    universe = sorted(set().union(*sets))
    freq = {}
    for k in range(1, len(universe) + 1):
        for combo in itertools.combinations(universe, k):
            c = sum(1 for s in sets if set(combo) <= s)
            if c >= min_support * n:
                freq[frozenset(combo)] = c
    out = {}
    for s, f in freq.items():
        if len(s) < 2:
            continue
        for c in s:
            a = s - {c}
            conf = f / freq[a]
            if conf >= min_conf:
                out[(",".join(sorted(a)), c)] = (conf, conf / (freq[frozenset([c])] / n), f / n)
    return freq, out


def test_rules_match_enumeration(spark):
    rnd = random.Random(1)
    items = list("abcdef")
    baskets = [rnd.sample(items, rnd.randint(1, 4)) for _ in range(400)]
    baskets[0] = ["a", "a", "b"]  # repeated item must not fail
    df = spark.createDataFrame([(i, b) for i, b in enumerate(baskets)], "tx_id long, items array<string>")
    clean = rules.clean_baskets(df)
    freq, brute = _brute_rules(baskets, 0.05, 0.3)
    fi = {r["itemset"]: r["freq"] for r in rules.frequent_itemsets(clean, 0.05).collect()}
    assert fi == {",".join(sorted(k)): v for k, v in freq.items()}
    got = rules.association_rules(clean, 0.05, 0.3, k=None).collect()
    assert len(got) == len(brute)
    for r in got:
        conf, lift, sup = brute[(r["antecedent"], r["consequent"])]
        assert math.isclose(r["confidence"], conf) and math.isclose(r["lift"], lift)
        assert math.isclose(r["support"], sup)
    top = rules.association_rules(clean, 0.05, 0.3, k=5).collect()
    assert len(top) == 5 and all(top[i]["lift"] >= top[i + 1]["lift"] for i in range(4))


def test_rules_from_products_strings(spark):
    tx = spark.createDataFrame([("1 1 2",), ("1  2",), ("3",), (None,)], "products string")
    b = rules.baskets_from_products(tx)
    assert sorted(sorted(r["items"]) for r in b.collect()) == [["1", "2"], ["1", "2"], ["3"]]


D = dt.date


def _series(spark, values, start=D(2020, 1, 1), key=None):
    months = [D(start.year + (start.month - 1 + i) // 12, (start.month - 1 + i) % 12 + 1, 1)
              for i in range(len(values))]
    data = [(key, m, v) for m, v in zip(months, values) if v is not None]
    return spark.createDataFrame(data, "store_id long, month date, transactions long")


def test_fill_months_and_naive(spark):
    s = _series(spark, [10, None, 30])  # Jan, (Feb missing), Mar
    filled = rows(forecast.fill_months(s, ("store_id",)), "month", "transactions")
    assert filled == [(D(2020, 1, 1), 10), (D(2020, 2, 1), 0), (D(2020, 3, 1), 30)]
    nv = forecast.seasonal_naive(s, ("store_id",), horizon=13).orderBy("month").collect()
    assert nv[0]["month"] == D(2020, 4, 1)
    assert math.isclose(nv[0]["yhat"], 40 / 3)  # April unseen -> overall mean incl. the gap
    jan = [r for r in nv if r["month"] == D(2021, 1, 1)][0]
    assert jan["yhat"] == 10.0 and jan["method"] == "Naive-Seasonal-Avg"
    feb = [r for r in nv if r["month"] == D(2021, 2, 1)][0]
    assert feb["yhat"] == 0.0  # the filled gap counts in its month


def _hw_python(y, a, b, g, m=12, h=6):
    first, second = y[:m], y[m:2 * m]
    lvl = sum(first) / m
    trd = (sum(second) / len(second) - sum(first[:len(second)]) / len(second)) / m if second else 0.0
    sea = [v - lvl for v in first]
    sse = 0.0
    for t, v in enumerate(y):
        s = sea[t % m]
        err = v - (lvl + trd + s)
        new_l = a * (v - s) + (1 - a) * (lvl + trd)
        trd = b * (new_l - lvl) + (1 - b) * trd
        lvl = new_l
        sea[t % m] = g * (v - lvl) + (1 - g) * s
        sse += err * err
    n = len(y)
    return sse, [lvl + k * trd + sea[(n + k - 1) % m] for k in range(1, h + 1)]


def _fit_python(y):
    """(sse, a, b, g): the best of the coarse grid, then of the neighbours of the best so far."""
    best = coarse = min((_hw_python(y, *w)[0], *w) for w in itertools.product(
        forecast.ALPHAS, forecast.BETAS, forecast.GAMMAS))
    for by, part in forecast.REFINEMENTS:
        _, a, b, g = best
        near = [(min(1.0, max(0.0, a + i * by)), min(1.0, b * (1 + j * part)), min(1.0, g * (1 + k * part)))
                for i, j, k in itertools.product((-1, 0, 1), repeat=3)]
        best = min((_hw_python(y, *w)[0], *w) for w in near)
    return coarse, best


def _wavy(seed, n):
    rnd = random.Random(seed)
    return [float(round(100 + 2 * t + 15 * math.sin(2 * math.pi * t / 12) + rnd.uniform(-9, 9)))
            for t in range(n)]


@pytest.mark.parametrize("n", [18, 23, 24, 40])
def test_holt_winters_matches_python_search(spark, n):
    y = _wavy(2, n)
    s = _series(spark, [int(v) for v in y], key=7)
    hw = forecast.holt_winters(s, ("store_id",)).orderBy("month").collect()
    coarse, best = _fit_python(y)
    for name, want in zip(("alpha", "beta", "gamma"), best[1:]):
        assert math.isclose(hw[0][name], want, rel_tol=1e-9)
    sse, fc = _hw_python(y, *best[1:])
    assert math.isclose(hw[0]["sse"], sse, rel_tol=1e-9) and sse <= coarse[0]
    assert all(math.isclose(r["yhat"], f, rel_tol=1e-9) for r, f in zip(hw, fc))
    assert hw[0]["method"] == "ExponentialSmoothing"
    assert len(hw) == 6 and hw[0]["month"] == D(2020 + n // 12, n % 12 + 1, 1)


def test_refined_weights_come_near_a_fine_grid():
    """The search ends at most a few per cent above a grid ten times as dense."""
    fine = [x / 20 for x in range(21)]
    for seed in range(4):
        y = _wavy(seed, 36)
        coarse, best = _fit_python(y)
        dense = min(_hw_python(y, *w)[0] for w in itertools.product(fine, fine, fine))
        assert best[0] <= coarse[0] and best[0] <= 1.1 * dense


def test_forecast_gate(spark):
    """17 months take the naive mean, 18 are fitted; gaps count as months; the gate is a parameter."""
    parts = [_series(spark, [int(v) for v in _wavy(n, n)], key=n) for n in (11, 17, 18, 23, 24, 30)]
    gap = [5] * 9 + [None] * 3 + [7] * 6  # 15 months with data between the first and the 18th
    every = parts[0]
    for p in [*parts[1:], _series(spark, gap, key=99)]:
        every = every.unionByName(p)
    out = forecast.forecast(every, ("store_id",))
    fitted, naive = "ExponentialSmoothing", "Naive-Seasonal-Avg"
    assert {(r["store_id"], r["method"]) for r in out.collect()} == {
        (11, naive), (17, naive), (18, fitted), (23, fitted), (24, fitted), (30, fitted), (99, fitted)}
    assert out.count() == 7 * 6
    later = forecast.forecast(every, ("store_id",), min_months=24)
    assert {r["store_id"] for r in later.where(f"method = '{fitted}'").collect()} == {24, 30}
    # a series of one season at most is never fitted, whatever the gate
    early = forecast.forecast(every, ("store_id",), min_months=1)
    assert {r["store_id"] for r in early.where(f"method = '{naive}'").collect()} == {11}
    want = _hw_python(_wavy(18, 18), *_fit_python(_wavy(18, 18))[1][1:])[1]
    got = [r["yhat"] for r in out.where("store_id = 18").orderBy("month").collect()]
    assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(got, want))
    g = forecast.forecast(_series(spark, list(range(10, 27))).drop("store_id"))
    assert {r["method"] for r in g.collect()} == {naive}


def test_empty_series(spark):
    s = spark.createDataFrame([], "store_id long, month date, transactions long")
    assert forecast.forecast(s, ("store_id",)).count() == 0
    assert forecast.seasonal_naive(s, ("store_id",)).columns == ["store_id", "month", "yhat", "method"]


def test_one_result_is_held_and_earlier_ones_stay_readable(spark):
    data = [(["a", "b"],), (["a", "b", "c"],), (["b"],), (["a", "c"],)] * 5
    clean = rules.clean_baskets(spark.createDataFrame(data, "items array<string>"))
    first = rules.frequent_itemsets(clean, 0.1)
    want = rows(first)
    for _ in range(3):
        rules.association_rules(clean, 0.1).count()
    assert len(rules._MINED) == 1
    assert rows(first) == want
    rules.release()
    assert rules._MINED == []


def test_input_is_read_once(spark):
    """Each mining query passes over its input once."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    data = [(["a", "b"],), (["a", "b", "c"],), (["b"],), (["a", "c"],)] * 5
    for mine in (rules.frequent_itemsets, rules.association_rules):
        start = seen.value
        df = spark.createDataFrame(data, "items array<string>").mapInPandas(
            counted, "items array<string>")
        assert mine(rules.clean_baskets(df), 0.1).count() > 0
        assert seen.value - start == len(data)
        rules.release()
