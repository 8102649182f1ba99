"""Building blocks of the SQL twins (DuckDB dialect) of the registered
queries: the same fixture derivations as ``tiller.sources.fixtures``,
written as common table expressions over the star-schema views."""

from __future__ import annotations

# Floating outputs are rounded to this many decimals on both sides.
DECIMALS = 6


def r(expr: str) -> str:
    """Round a floating expression the way ``plans.register.rounded`` does."""
    return f"round(CAST({expr} AS DOUBLE), {DECIMALS})"


def pct(n: str, total: str) -> str:
    """``n * 100 / total`` in double precision, same operation order as
    ``tiller.functions.columns.share_pct``."""
    return f"(CAST({n} AS DOUBLE) * 100.0 / CAST({total} AS DOUBLE))"


TX = """tx AS (
  SELECT CAST(o.o_orderdate AS DATE) AS date, CAST(c.c_nationkey AS BIGINT) AS store_id,
         CAST(o.o_custkey AS BIGINT) AS customer_id, t.text AS products
  FROM orders o
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN documents t ON t.doc_id = o.o_orderkey)"""

TXL = """txl AS (
  SELECT CAST(o.o_orderdate AS DATE) AS date, CAST(c.c_nationkey AS BIGINT) AS store_id,
         CAST(o.o_custkey AS BIGINT) AS customer_id
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey)"""

TEXTS = """tx AS (SELECT text, lang, source, n_chars FROM documents)"""

ITEMS = """items AS (SELECT l_orderkey AS tx_id, l_partkey AS item FROM lineitem)"""

PC = """pc AS (
  SELECT l.l_partkey AS code_pr, s.s_nationkey AS code
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey)"""

CAT = """cat AS (SELECT n_nationkey AS id, n_name AS category_name FROM nation)"""

KEYS = """pc AS (SELECT o_orderkey AS code FROM orders),
cat AS (SELECT l_orderkey AS id FROM lineitem)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
