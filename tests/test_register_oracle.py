"""Every registered query against its DuckDB twin on sf0.01 (the
correctness gate), plus the driver-contract smoke checks."""

import importlib.util
import os

import pytest
from helpers import SF001, SF01

from tiller.plans import register, verify

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def con():
    return verify.duckdb_connection(SF01)


@pytest.mark.parametrize("name", sorted(register.SQL))
def test_query_matches_sql_twin(spark, con, name):
    res = verify.compare(name, spark, SF01, con)
    assert res.ok, res.problems


def test_every_query_has_a_sql_twin():
    assert set(register.SPARK) == set(register.SQL)


def _entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_contract(spark):
    mod = _entry_module()
    df = mod.entry(spark)
    assert df.count() > 0
    assert df.columns == ["cohort_month", "cohort_index", "active_customers", "cohort_size",
                          "retention_rate"]
    assert set(mod.oracle_sql()) <= set(mod.queries())
    assert os.path.isdir(SF001)
