"""Basket statistics, items, top-k and running totals against brute force."""

import math
import random
import statistics

import numpy as np
import pandas as pd
from helpers import rows

from tiller.operators import baskets

TX_SCHEMA = "date date, store_id bigint, customer_id bigint, products string"


def _tx(spark, products):
    return spark.createDataFrame([(None, 1, 1, p) for p in products], TX_SCHEMA)


def _disc_quantile(values, p):
    s = sorted(values)
    k = math.ceil(p * len(s))
    return s[max(k, 1) - 1]


def test_statistics_match_brute_force(spark):
    rnd = random.Random(7)
    sizes = [rnd.choice([1, 1, 2, 3, 3, 4, 5, 8, 13, 30]) for _ in range(500)]
    products = [" ".join(str(rnd.randint(1, 50)) for _ in range(n)) for n in sizes] + [None]
    st = baskets.basket_statistics(_tx(spark, products)).collect()[0]
    assert st["baskets"] == len(sizes)
    assert math.isclose(st["mean_size"], statistics.fmean(sizes))
    assert math.isclose(st["stddev_size"], statistics.stdev(sizes))
    assert (st["min_size"], st["max_size"]) == (min(sizes), max(sizes))
    p25, med, p75 = (_disc_quantile(sizes, p) for p in (0.25, 0.5, 0.75))
    assert (st["p25"], st["median"], st["p75"]) == (p25, med, p75)
    iqr = p75 - p25
    assert st["outliers"] == sum(1 for s in sizes if s < p25 - 1.5 * iqr or s > p75 + 1.5 * iqr)
    counts = pd.Series(sizes).value_counts()
    assert st["mode_size"] == min(counts[counts == counts.max()].index)


def test_tied_modes_take_smallest(spark):
    tx = _tx(spark, ["1 2 3", "1 2 3", "1", "1"])
    assert rows(baskets.basket_mode(tx)) == [(1, 2)]


def test_quantiles_exact_and_approx_agree_on_small_data(spark):
    tx = _tx(spark, ["1", "1 2", "1 2 3", "1 2 3 4", "1 2 3 4 5", "1 2 3 4 5 6", "1 2 3 4 5 6 7"])
    exact = rows(baskets.basket_quantiles(tx))
    approx = rows(baskets.basket_quantiles_approx(tx))
    assert exact == approx == [(0.25, 2), (0.5, 4), (0.75, 6)]


def test_top_products_pareto_concentration(spark):
    rnd = random.Random(3)
    items = [(i, rnd.choice([1, 2, 2, 3, 3, 3, 4, 5, 6, 7, 8, 9])) for i in range(2000)]
    df = spark.createDataFrame(items, "tx_id long, item long").repartition(5)
    counts = pd.Series([i for _, i in items]).value_counts()
    ordered = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))
    total = len(items)
    top = baskets.top_products(df, k=3).orderBy("rank").collect()
    assert [(r["rank"], r["item"], r["units"]) for r in top] == [
        (i + 1, k, v) for i, (k, v) in enumerate(ordered[:3])]
    assert math.isclose(top[0]["pct"], ordered[0][1] * 100 / total)
    top_cum = np.cumsum([v for _, v in ordered[:3]])
    assert all(math.isclose(r["cum_pct"], c * 100 / total) for r, c in zip(top, top_cum))
    par = baskets.pareto_products(df).orderBy("rank").collect()
    cum = np.cumsum([v for _, v in ordered])
    assert [r["item"] for r in par] == [k for k, _ in ordered]
    assert all(math.isclose(r["cum_pct"], c * 100 / total) for r, c in zip(par, cum))
    conc = {r["top_n"]: r["units"] for r in baskets.concentration(df, [2, 5, 50]).collect()}
    assert conc == {2: int(cum[1]), 5: int(cum[4]), 50: int(cum[-1])}


def test_pareto_many_ties_and_strings(spark):
    rnd = random.Random(11)
    for kind, name in (("long", lambda k: k), ("string", lambda k: f"p{k:05d}")):
        data = [(i, name(rnd.randint(0, 300))) for i in range(2000)]
        counts = {}
        for _, k in data:
            counts[k] = counts.get(k, 0) + 1
        df = spark.createDataFrame(data, f"tx_id long, item {kind}")
        out = baskets.pareto_products(df).orderBy("rank").collect()
        ordered = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))
        assert [(r["rank"], r["item"], r["units"]) for r in out] == [
            (i + 1, k, u) for i, (k, u) in enumerate(ordered)]
        cum = np.cumsum([u for _, u in ordered]) * 100 / len(data)
        assert all(math.isclose(r["cum_pct"], c) for r, c in zip(out, cum))


def test_units_sold_and_items(spark):
    tx = _tx(spark, ["1 2", "2  x 3", None, ""])
    assert rows(baskets.units_sold(baskets.basket_items(tx))) == [(4, 3)]


def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "a  b "), (2, ""), (3, None)], "doc_id long, text string")
    assert rows(baskets.token_counts(docs)) == [(1, 4, 2), (2, 1, 0), (3, None, None)]
