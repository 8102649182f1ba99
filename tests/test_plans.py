"""Plan audit of every registered query: no cartesian / nested-loop joins,
no row-at-a-time Python, Python only where documented, and column pruning
down to the parquet scans."""

import re

import pytest
from helpers import SF001

from tiller.plans import register



def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(register.SPARK))
def test_plan_shape(spark, name):
    plan = _plan(register.SPARK[name](spark, SF001))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan  # row-at-a-time Python UDF
    assert "ArrowEvalPython" not in plan and "MapInPandas" not in plan


ORDERS_ONLY = ["customer_date_duplicates", "monthly_distribution", "monthly_series",
               "monthly_growth", "weekday_distribution", "weekday_ranking", "weekend_share",
               "purchase_frequency", "customer_segments", "new_customer_share", "segment_rate",
               "top_customer", "customer_gaps", "inter_purchase_days", "forecast_naive_global",
               "schema_profile", "retention", "cohort_sizes"]


@pytest.mark.parametrize("name", ORDERS_ONLY)
def test_no_join_and_one_scan(spark, name):
    plan = _plan(register.SPARK[name](spark, SF001))
    assert "Join" not in plan and plan.count("FileScan") == 1


def test_facts_are_scanned_once(spark):
    plan = _plan(register.SPARK["referential_integrity"](spark, SF001))
    assert plan.count("FileScan") == 2  # facts and dimension
    plan = _plan(register.SPARK["forecast_auto"](spark, SF001))
    assert plan.count("FileScan") == 2  # orders and customer


@pytest.mark.parametrize("name", sorted(set(register.SPARK) - {"frequent_itemsets", "association_rules"}))
def test_no_list_for_each_order(spark, name):
    for line in _plan(register.SPARK[name](spark, SF001)).splitlines():
        assert not ("l_orderkey" in line and "collect_list" in line), line


@pytest.mark.parametrize("name", ["customer_gaps", "retention", "store_distribution",
                                  "top_products", "basket_statistics"])
def test_scans_read_only_needed_columns(spark, name):
    plan = register.SPARK[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    # no scan of orders or lineitem reads every column
    for s in schemas:
        assert "o_totalprice" not in s and "l_extendedprice" not in s, s


def test_audit_shape(spark):
    from tiller.plans import audit

    s = audit.shape(register.SPARK["retention"](spark, SF001))
    assert s["scans"] == 1 and s["max_scan_cols"] == 2
    assert s["hash_shuffles"] >= 2 and not s["python"]
