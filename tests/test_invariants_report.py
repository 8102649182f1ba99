"""Invariants on the sf0.01 stand-ins (shares sum to 100, retention at index
0 is 1, cohort sizes add up to the customers, ...) and an end-to-end run of
the report job over pipe-separated files."""

import json
import math
import os

import pytest
from helpers import SF01
from pyspark.sql import functions as F

from tiller.operators import baskets, catalogue, cohorts, customers, forecast, rules, temporal
from tiller.plans.report import run_report
from tiller.sources import fixtures as fx


@pytest.fixture(scope="module")
def tx(spark):
    return fx.store_purchases(spark, SF01).cache()


def test_shares_sum_to_100(spark, tx):
    for df in (temporal.monthly_distribution(tx), temporal.weekday_distribution(tx),
               temporal.store_distribution(tx), customers.customer_segments(tx),
               catalogue.category_distribution(fx.product_category(spark, SF01),
                                               fx.categories(spark, SF01))):
        assert math.isclose(sum(r["pct"] for r in df.collect()), 100.0, rel_tol=1e-9)


def test_cohort_invariants(tx):
    ret = cohorts.retention(tx).collect()
    assert all(r["retention_rate"] == 1.0 for r in ret if r["cohort_index"] == 0)
    assert all(0 < r["retention_rate"] <= 1.0 for r in ret)
    sizes = sum(r["cohort_size"] for r in cohorts.cohort_sizes(tx).collect())
    n_customers = tx.where("customer_id IS NOT NULL").select("customer_id").distinct().count()
    assert sizes == n_customers
    seg = sum(r["customers"] for r in customers.customer_segments(tx).collect())
    assert seg == n_customers


def test_pareto_monotone_and_complete(spark):
    par = baskets.pareto_products(fx.basket_lines(spark, SF01)).orderBy("rank").collect()
    cum = [r["cum_pct"] for r in par]
    assert all(a <= b for a, b in zip(cum, cum[1:]))
    assert math.isclose(cum[-1], 100.0)
    assert [r["rank"] for r in par] == list(range(1, len(par) + 1))


def test_rules_thresholds(spark):
    b = rules.clean_baskets(fx.type_baskets(spark, SF01))
    r = rules.association_rules(b, 0.02, 0.3, k=None).collect()
    assert r and all(x["confidence"] >= 0.3 and x["support"] >= 0.02 for x in r)


def test_filled_series_has_every_month(spark, tx):
    s = forecast.fill_months(temporal.monthly_series(tx, by=("store_id",)), ("store_id",))
    per = {}
    for r in s.collect():
        per.setdefault(r["store_id"], []).append(r["month"])
    for months in per.values():
        months.sort()
        for a, b in zip(months, months[1:]):
            assert (b.year * 12 + b.month) - (a.year * 12 + a.month) == 1


def _write(path, lines):
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def test_report_job_end_to_end(spark, scratch):
    """Pipe files derived from the sf0.001 tables -> every report section."""
    tdir = os.path.join(scratch, "Transactions")
    os.makedirs(tdir)
    baskets_ = (fx.table(spark, "/root/testdata/sf0.001", "lineitem").groupBy("l_orderkey")
                .agg(F.concat_ws(" ", F.collect_list("l_partkey")).alias("products")))
    orders = fx.table(spark, "/root/testdata/sf0.001", "orders")
    tx = (orders.join(baskets_, orders.o_orderkey == baskets_.l_orderkey, "left")
          .select(F.to_date("o_orderdate").alias("date"), (F.col("o_custkey") % 25).alias("store_id"),
                  F.col("o_custkey").alias("customer_id"), "products").collect())
    by_store = {}
    for r in tx:
        line = "|".join("" if v is None else str(v) for v in (r["date"], r["store_id"],
                                                              r["customer_id"], r["products"]))
        by_store.setdefault(r["store_id"], []).append(line)
    for store, lines in by_store.items():
        _write(os.path.join(tdir, f"{store}_Tran.csv"), lines)
    cat = os.path.join(scratch, "Categories.csv")
    _write(cat, ["id|category_name"] + [f"{i}|C{i}" for i in range(20)])
    pc = os.path.join(scratch, "ProductCategory.csv")
    _write(pc, ["v.code_pr|v.code"] + [f"{i}|{i % 25}" for i in range(200)])
    out = os.path.join(scratch, "report")
    written = run_report(spark, tdir, out, cat, pc, fmt="json")
    expected = {"catalogue_summary", "category_distribution", "category_relations", "summary",
                "catalogue_schema", "catalogue_nulls", "schema", "nulls", "quality", "document",
                "product_keys",
                "basket_statistics", "top_products", "monthly", "weekday", "stores",
                "purchase_frequency", "days_between_purchases", "cohort_sizes", "retention",
                "retention_matrix", "forecast_global", "forecast_stores", "association_rules",
                "head_tail_categories", "units_sold", "concentration", "monthly_growth",
                "weekend_share", "store_gaps", "top_customer", "customer_segments",
                "new_customer_share", "segment_rate", "source_files", "forecast_settings"}
    assert set(written) == expected
    summary = spark.read.json(os.path.join(out, "summary")).collect()[0]
    assert summary["transactions"] == len(tx)
    assert summary["num_files"] == len(by_store)
    files = spark.read.json(os.path.join(out, "source_files")).collect()
    assert sorted(r["file_name"] for r in files) == sorted(f"{s}_Tran.csv" for s in by_store)
    cs = {r["table_name"]: r["source_file"]
          for r in spark.read.json(os.path.join(out, "catalogue_summary")).collect()}
    assert cs == {"categories": cat, "product_category": pc}
    pk = spark.read.json(os.path.join(out, "product_keys")).collect()[0]
    assert (pk["total_rows"], pk["unique_keys"], pk["repeated_keys"], pk["unique_categories"]) == (
        200, 200, 0, 25)
    assert spark.read.json(os.path.join(out, "top_products")).count() == 30
    for r in spark.read.json(os.path.join(out, "top_products")).collect():
        assert round(r["pct"], 2) == r["pct"]
    for r in spark.read.json(os.path.join(out, "retention")).collect():
        assert round(r["retention_rate"], 4) == r["retention_rate"]
    doc = {}
    for r in spark.read.text(os.path.join(out, "document")).collect():
        doc.setdefault(r["section"], []).append(json.loads(r["value"]))
    doc = {k: [json.loads(x["json"]) for x in v] for k, v in doc.items()}
    assert len(doc["top_products"]) == 30
    assert doc["summary"][0]["transactions"] == len(tx)
    assert doc["forecast_settings"] == [{"horizon_months": 6}]
    assert {r["column_name"] for r in doc["nulls"]} == {"date", "store_id", "customer_id", "products"}


def test_transactions_are_held_while_sections_run(spark, scratch, monkeypatch):
    """The report's sections read the persisted table; it is released after."""
    from tiller.plans import report

    tdir = os.path.join(scratch, "Transactions")
    os.makedirs(tdir)
    _write(os.path.join(tdir, "7_Tran.csv"), ["2013-01-01|7|1|1 2", "2013-02-01|7|1|2 3"])
    plans = []
    original = report.write_sections
    monkeypatch.setattr(report, "write_sections", lambda sec, *a: (plans.append(
        sec["monthly"]._jdf.queryExecution().executedPlan().toString()), original(sec, *a))[1])
    run_report(spark, tdir, os.path.join(scratch, "out"))
    assert "InMemoryTableScan" in plans[0]


def test_report_command_line(spark, scratch, capsys):
    from tiller.plans.report import main

    tdir = os.path.join(scratch, "Transactions")
    os.makedirs(tdir)
    _write(os.path.join(tdir, "7_Tran.csv"), ["2013-01-01|7|1|1 2", "2013-02-01|7|1|2 3",
                                              "2013-02-05|7|2|1"])
    out = os.path.join(scratch, "out")
    main(["--transactions", tdir, "--out", out, "--format", "parquet"])
    printed = capsys.readouterr().out.split()
    assert "summary" in printed and "document" in printed
    s = spark.read.parquet(os.path.join(out, "summary")).collect()[0]
    assert (s["transactions"], s["customers"], s["num_files"]) == (3, 2, 1)
