"""The named query register.

Each entry is a Spark plan ``(spark, sf_dir) -> DataFrame`` over the
star-schema test tables (through ``tiller.sources.fixtures``) and, where the
query is expressible in SQL, its DuckDB twin over the same tables.  Floating
outputs are rounded to ``sql.DECIMALS`` places on both sides (Spark:
``round(x * 1e6) / 1e6``, which equals DuckDB's ``round(x, 6)``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiller.functions import labels
from tiller.functions.labels import CUSTOMER_SEGMENTS, WEEKDAY_LABELS
from tiller.operators import (
    baskets,
    catalogue,
    cohorts,
    customers,
    forecast,
    heavy,
    profile,
    rules,
    sketches,
    temporal,
)
from tiller.operators._util import combine_rows
from tiller.plans.sql import CAT, ITEMS, KEYS, PC, TEXTS, TX, TXL, pct, r, with_
from tiller.sources import fixtures as fx
from tiller.sources import readers

QueryFn = Callable[[SparkSession, str], DataFrame]

SPARK: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Round every floating column (see module docstring)."""
    scale = float(10 ** 6)
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = (F.round(c.cast("double") * F.lit(scale), 0) / F.lit(scale)).alias(f.name)
        cols.append(c)
    return df.select(*cols)


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        SPARK[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------------------
# profiling and quality
# ---------------------------------------------------------------------------

def _missing_sql(col: str, kind: str) -> str:
    if kind == "string":
        return f"({col} IS NULL OR {col} = '')"
    if kind == "double":
        return f"({col} IS NULL OR isnan({col}))"
    return f"({col} IS NULL)"


TX_COLUMNS = [("date", "date", "date"), ("store_id", "bigint", "int"),
              ("customer_id", "bigint", "int"), ("products", "string", "string")]


@query("schema_profile", with_(TEXTS) + """
SELECT CAST(t.ordinal AS INTEGER) AS ordinal, t.column_name, t.data_type,
       (SELECT count(*) FROM tx) AS num_rows
FROM (SELECT row_number() OVER () AS ordinal, column_name,
             CASE column_type WHEN 'DATE' THEN 'date' WHEN 'BIGINT' THEN 'bigint'
                  WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string'
                  WHEN 'DOUBLE' THEN 'double' ELSE lower(column_type) END AS data_type
      FROM (DESCRIBE SELECT * FROM tx)) t""")
def q_schema_profile(spark, d):
    return profile.schema_profile(fx.texts(spark, d))


@query("null_counts", with_(TX) + "\nUNION ALL\n".join(
    f"SELECT {i} AS ordinal, '{c}' AS column_name, "
    f"count(*) FILTER (WHERE {_missing_sql(c, k)}) AS nulls FROM tx"
    for i, (c, _, k) in enumerate(TX_COLUMNS, start=1)))
def q_null_counts(spark, d):
    return profile.null_counts(fx.transactions(spark, d))


def _dups_sql(keys: str, src: str = "tx") -> str:
    return f"""
SELECT CAST(sum(n) AS BIGINT) AS num_rows, count(*) AS distinct_rows,
       CAST(sum(n - 1) AS BIGINT) AS duplicates,
       {r(pct('sum(n - 1)', 'sum(n)'))} AS duplicate_pct
FROM (SELECT count(*) AS n FROM {src} GROUP BY {keys}) g"""


@query("exact_duplicates", with_(TEXTS) + _dups_sql("text, lang, source, n_chars"))
def q_exact_duplicates(spark, d):
    return profile.exact_duplicates(fx.texts(spark, d))


@query("customer_date_duplicates", with_(TXL) + _dups_sql("date, customer_id", "txl"))
def q_customer_date_duplicates(spark, d):
    return profile.duplicates_on(fx.purchases(spark, d), ["date", "customer_id"])


def _distinct_sql(col: str, src: str) -> str:
    return (f"(SELECT CAST(count(DISTINCT {col}) + max(CASE WHEN {col} IS NULL THEN 1 ELSE 0 END)"
            f" AS BIGINT) FROM {src})")


@query("distinct_counts", with_(TXL, PC, ITEMS) + f"""
SELECT {_distinct_sql('code_pr', 'pc')} AS distinct_products,
       {_distinct_sql('code', 'pc')} AS distinct_categories,
       {_distinct_sql('store_id', 'txl')} AS distinct_stores,
       {_distinct_sql('customer_id', 'txl')} AS distinct_customers,
       {_distinct_sql('item', 'items')} AS distinct_sold_items""")
def q_distinct_counts(spark, d):
    pc = fx.product_category(spark, d)
    tx = fx.store_purchases(spark, d)
    items = fx.basket_lines(spark, d)
    return combine_rows([
        profile.distinct_counts(pc, ["code_pr", "code"], ["distinct_products", "distinct_categories"]),
        profile.distinct_counts(tx, ["store_id", "customer_id"], ["distinct_stores", "distinct_customers"]),
        profile.distinct_count(items, "item", "distinct_sold_items"),
    ]).select("distinct_products", "distinct_categories", "distinct_stores",
              "distinct_customers", "distinct_sold_items")


@query("repeated_keys", with_(PC) + """
SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS unique_keys,
       CAST(sum(n) - count(*) AS BIGINT) AS repeated_keys
FROM (SELECT count(*) AS n FROM pc GROUP BY code_pr) g""")
def q_repeated_keys(spark, d):
    return profile.repeated_keys(fx.product_category(spark, d), "code_pr")


def _table_summary_sql(name: str, src: str, cols: list[tuple[str, str]]) -> str:
    miss = " + ".join(f"CAST({_missing_sql(c, k)} AS BIGINT)" for c, k in cols)
    keys = ", ".join(c for c, _ in cols)
    return f"""
SELECT '{name}' AS table_name, CAST(sum(n) AS BIGINT) AS num_rows,
       CAST({len(cols)} AS BIGINT) AS num_columns,
       CAST(coalesce(sum(n * m), 0) AS BIGINT) AS total_nulls,
       CAST(sum(n - 1) AS BIGINT) AS duplicates,
       {r(f"coalesce({pct('sum(n - 1)', 'sum(n)')}, 0.0)")} AS duplicate_pct
FROM (SELECT count(*) AS n, any_value({miss}) AS m FROM {src} GROUP BY {keys}) g"""


@query("catalogue_summary", with_(PC, CAT)
       + _table_summary_sql("categories", "cat", [("id", "int"), ("category_name", "string")])
       + "\nUNION ALL"
       + _table_summary_sql("product_category", "pc", [("code_pr", "int"), ("code", "int")]))
def q_catalogue_summary(spark, d):
    return profile.catalogue_summary({"categories": fx.categories(spark, d),
                                      "product_category": fx.product_category(spark, d)})


_TX_MISS = " + ".join(f"CAST({_missing_sql(c, k)} AS BIGINT)" for c, _, k in TX_COLUMNS)


def _scorecard_sql(outside: str) -> str:
    return with_(TX, KEYS) + f""",
g AS (SELECT count(*) AS n, any_value({_TX_MISS}) AS m, any_value({outside}) AS nd
      FROM tx GROUP BY date, store_id, customer_id, products),
e AS (SELECT sum(n) AS rows_, sum(n * m) AS nulls, sum(n - 1) AS dups,
             coalesce(sum(CASE WHEN nd THEN n END), 0) AS outside FROM g),
k AS (SELECT sum(n) AS rows_, sum(n - 1) AS dups
      FROM (SELECT count(*) AS n FROM tx GROUP BY date, customer_id) x),
o AS (SELECT count(*) AS total FROM pc),
orph AS (SELECT count(*) AS orphan FROM pc WHERE NOT EXISTS (SELECT 1 FROM cat WHERE cat.id = pc.code))
SELECT 'nulls' AS metric, {r('nulls')} AS value FROM e
UNION ALL SELECT 'completeness_pct', {r(f"100.0 - {pct('nulls', 'rows_ * 4')}")} FROM e
UNION ALL SELECT 'exact_duplicates', {r('dups')} FROM e
UNION ALL SELECT 'exact_duplicates_pct', {r(pct('dups', 'rows_'))} FROM e
UNION ALL SELECT 'dates_outside_pct', {r(pct('outside', 'rows_'))} FROM e
UNION ALL SELECT 'key_duplicates', {r('dups')} FROM k
UNION ALL SELECT 'key_duplicates_pct', {r(pct('dups', 'rows_'))} FROM k
UNION ALL SELECT 'integrity_pct', {r(f"100.0 - {pct('orphan', 'total')}")} FROM o, orph"""


@query("quality_scorecard", _scorecard_sql("date IS NULL"))
def q_quality_scorecard(spark, d):
    return profile.quality_scorecard(fx.transactions(spark, d), facts=fx.order_facts(spark, d),
                                     dim=fx.line_orders(spark, d))


PERIOD = ("1996-01-01", "1999-12-31")


@query("quality_scorecard_period", _scorecard_sql(
    f"date IS NULL OR date < DATE '{PERIOD[0]}' OR date > DATE '{PERIOD[1]}'"))
def q_quality_scorecard_period(spark, d):
    return profile.quality_scorecard(fx.transactions(spark, d), facts=fx.order_facts(spark, d),
                                     dim=fx.line_orders(spark, d), period=PERIOD)


@query("orphan_categories", with_(KEYS) + """
SELECT code, count(*) AS num_rows FROM pc
WHERE NOT EXISTS (SELECT 1 FROM cat WHERE cat.id = pc.code) GROUP BY code""")
def q_orphan_categories(spark, d):
    return profile.orphans(fx.order_facts(spark, d), fx.line_orders(spark, d), "code")


@query("referential_integrity", with_(KEYS) + f""",
o AS (SELECT count(*) AS total_rows FROM pc),
x AS (SELECT count(*) AS orphan_rows, count(DISTINCT code) + max(CASE WHEN code IS NULL THEN 1 ELSE 0 END) AS orphan_keys
      FROM pc WHERE NOT EXISTS (SELECT 1 FROM cat WHERE cat.id = pc.code))
SELECT o.total_rows, CAST(x.orphan_rows AS BIGINT) AS orphan_rows,
       CAST(coalesce(x.orphan_keys, 0) AS BIGINT) AS orphan_keys,
       {r(f"coalesce(100.0 - {pct('x.orphan_rows', 'o.total_rows')}, 100.0)")} AS integrity_pct
FROM o, x""")
def q_referential_integrity(spark, d):
    return profile.orphan_summary(fx.order_facts(spark, d), fx.line_orders(spark, d), "code")


# ---------------------------------------------------------------------------
# catalogue
# ---------------------------------------------------------------------------

_DIST_SQL = with_(PC, CAT) + f""",
dist AS (SELECT code, count(*) AS num_products FROM pc GROUP BY code),
names AS (SELECT id, min(category_name) AS category_name FROM cat GROUP BY id),
cd AS (SELECT dist.code, coalesce(names.category_name, '{labels.UNKNOWN_CATEGORY}') AS category_name,
              dist.num_products,
              {r(pct('dist.num_products', 'sum(dist.num_products) OVER ()'))} AS pct
       FROM dist LEFT JOIN names ON dist.code = names.id)
"""


@query("category_distribution", _DIST_SQL + "SELECT * FROM cd")
def q_category_distribution(spark, d):
    return catalogue.category_distribution(fx.product_category(spark, d), fx.categories(spark, d))


@query("head_tail_categories", _DIST_SQL + f"""
SELECT * FROM (
  SELECT 'head' AS part, CAST(row_number() OVER (ORDER BY num_products DESC, code) AS INTEGER) AS position,
         code, category_name, num_products, pct FROM cd) h WHERE position <= {labels.HEAD_CATEGORIES}
UNION ALL
SELECT * FROM (
  SELECT 'tail' AS part, CAST(row_number() OVER (ORDER BY num_products, code) AS INTEGER) AS position,
         code, category_name, num_products, pct FROM cd) t WHERE position <= {labels.TAIL_CATEGORIES}""")
def q_head_tail_categories(spark, d):
    return catalogue.head_tail_categories(fx.product_category(spark, d), fx.categories(spark, d))


_PER_PRODUCT = """per AS (SELECT code_pr, count(code) AS num_categories
        FROM (SELECT DISTINCT code_pr, code FROM pc) p GROUP BY code_pr)"""
_PER_CATEGORY = """perc AS (SELECT code, count(code_pr) AS num_products
         FROM (SELECT DISTINCT code_pr, code FROM pc) p GROUP BY code)"""


@query("multi_category_products", with_(PC, _PER_PRODUCT) + f"""
SELECT count(*) AS unique_products,
       count(*) FILTER (WHERE num_categories > 1) AS multi_category_products,
       {r(f"coalesce({pct('count(*) FILTER (WHERE num_categories > 1)', 'count(*)')}, 0.0)")}
         AS multi_category_pct
FROM per""")
def q_multi_category_products(spark, d):
    return catalogue.multi_category_products(fx.product_category(spark, d))


@query("relation_averages", with_(PC, _PER_PRODUCT, _PER_CATEGORY) + f"""
SELECT (SELECT {r('avg(num_categories)')} FROM per) AS avg_categories_per_product,
       (SELECT {r('avg(num_products)')} FROM perc) AS avg_products_per_category""")
def q_relation_averages(spark, d):
    return catalogue.relation_averages(fx.product_category(spark, d))


@query("category_relations", with_(PC, _PER_PRODUCT, _PER_CATEGORY) + f"""
SELECT 'multi_category_products' AS metric,
       {r('count(*) FILTER (WHERE num_categories > 1)')} AS value FROM per
UNION ALL SELECT 'multi_category_pct',
       {r(f"coalesce({pct('count(*) FILTER (WHERE num_categories > 1)', 'count(*)')}, 0.0)")} FROM per
UNION ALL SELECT 'avg_categories_per_product', {r('avg(num_categories)')} FROM per
UNION ALL SELECT 'avg_products_per_category', {r('avg(num_products)')} FROM perc""")
def q_category_relations(spark, d):
    return catalogue.category_relations(fx.product_category(spark, d))


# ---------------------------------------------------------------------------
# baskets and items
# ---------------------------------------------------------------------------

# The string operators run on an existing text column, the others on lines.
_TEXT_SIZES = """s AS (SELECT CAST(len(string_split(text, ' ')) AS INTEGER) AS basket_size
      FROM documents WHERE text IS NOT NULL)"""
_SIZES = """s AS (SELECT CAST(count(*) AS INTEGER) AS basket_size FROM lineitem GROUP BY l_orderkey)"""
_QUART = """q AS (SELECT quantile_disc(basket_size, 0.25) AS p25, quantile_disc(basket_size, 0.5) AS median,
             quantile_disc(basket_size, 0.75) AS p75 FROM s)"""
_MODE = """m AS (SELECT basket_size AS mode_size, count(*) AS baskets FROM s
      GROUP BY basket_size ORDER BY count(*) DESC, basket_size LIMIT 1)"""


@query("basket_statistics", with_(_TEXT_SIZES, _QUART, _MODE) + f"""
SELECT count(*) AS baskets, {r('avg(s.basket_size)')} AS mean_size,
       {r('stddev_samp(s.basket_size)')} AS stddev_size,
       min(s.basket_size) AS min_size, max(s.basket_size) AS max_size,
       any_value(m.mode_size) AS mode_size, q.p25, q.median, q.p75, q.p75 - q.p25 AS iqr,
       {r('CAST(q.p25 AS DOUBLE) - 1.5 * CAST(q.p75 - q.p25 AS DOUBLE)')} AS lower_fence,
       {r('CAST(q.p75 AS DOUBLE) + 1.5 * CAST(q.p75 - q.p25 AS DOUBLE)')} AS upper_fence,
       count(*) FILTER (WHERE s.basket_size < CAST(q.p25 AS DOUBLE) - 1.5 * CAST(q.p75 - q.p25 AS DOUBLE)
                           OR s.basket_size > CAST(q.p75 AS DOUBLE) + 1.5 * CAST(q.p75 - q.p25 AS DOUBLE))
         AS outliers
FROM s, q, m GROUP BY q.p25, q.median, q.p75""")
def q_basket_statistics(spark, d):
    return baskets.basket_statistics(fx.texts(spark, d), "text")


@query("basket_statistics_lines", with_(_SIZES, _QUART, _MODE) + f"""
SELECT count(*) AS baskets, {r('avg(s.basket_size)')} AS mean_size,
       {r('stddev_samp(s.basket_size)')} AS stddev_size,
       min(s.basket_size) AS min_size, max(s.basket_size) AS max_size,
       any_value(m.mode_size) AS mode_size, q.p25, q.median, q.p75, q.p75 - q.p25 AS iqr,
       {r('CAST(q.p25 AS DOUBLE) - 1.5 * CAST(q.p75 - q.p25 AS DOUBLE)')} AS lower_fence,
       {r('CAST(q.p75 AS DOUBLE) + 1.5 * CAST(q.p75 - q.p25 AS DOUBLE)')} AS upper_fence,
       count(*) FILTER (WHERE s.basket_size < CAST(q.p25 AS DOUBLE) - 1.5 * CAST(q.p75 - q.p25 AS DOUBLE)
                           OR s.basket_size > CAST(q.p75 AS DOUBLE) + 1.5 * CAST(q.p75 - q.p25 AS DOUBLE))
         AS outliers
FROM s, q, m GROUP BY q.p25, q.median, q.p75""")
def q_basket_statistics_lines(spark, d):
    return baskets.basket_statistics_from_lines(fx.basket_lines(spark, d))


@query("basket_summary", with_(_SIZES) + f"""
SELECT count(*) AS baskets, {r('avg(basket_size)')} AS mean_size,
       {r('stddev_samp(basket_size)')} AS stddev_size,
       min(basket_size) AS min_size, max(basket_size) AS max_size FROM s""")
def q_basket_summary(spark, d):
    return baskets.basket_summary(fx.basket_lines(spark, d), lines="tx_id")


_QUANT_ROWS = """
SELECT CAST(0.25 AS DOUBLE) AS p, p25 AS value FROM q
UNION ALL SELECT CAST(0.5 AS DOUBLE), median FROM q
UNION ALL SELECT CAST(0.75 AS DOUBLE), p75 FROM q"""


@query("basket_quantiles", with_(_SIZES, _QUART) + _QUANT_ROWS)
def q_basket_quantiles(spark, d):
    return baskets.basket_quantiles(fx.basket_lines(spark, d), lines="tx_id")


@query("basket_quantiles_approx", with_(_SIZES, _QUART) + _QUANT_ROWS)
def q_basket_quantiles_approx(spark, d):
    return baskets.basket_quantiles_approx(fx.basket_lines(spark, d), lines="tx_id")


@query("basket_mode", with_(_SIZES, _MODE) + "SELECT mode_size, baskets FROM m")
def q_basket_mode(spark, d):
    return baskets.basket_mode(fx.basket_lines(spark, d), lines="tx_id")


@query("basket_outliers", with_(_SIZES, _QUART) + f"""
SELECT q.p25, q.p75, q.p75 - q.p25 AS iqr,
       {r('CAST(q.p25 AS DOUBLE) - 1.5 * CAST(q.p75 - q.p25 AS DOUBLE)')} AS lower_fence,
       {r('CAST(q.p75 AS DOUBLE) + 1.5 * CAST(q.p75 - q.p25 AS DOUBLE)')} AS upper_fence,
       count(*) FILTER (WHERE s.basket_size < CAST(q.p25 AS DOUBLE) - 1.5 * CAST(q.p75 - q.p25 AS DOUBLE)
                           OR s.basket_size > CAST(q.p75 AS DOUBLE) + 1.5 * CAST(q.p75 - q.p25 AS DOUBLE))
         AS outliers
FROM s, q GROUP BY q.p25, q.p75""")
def q_basket_outliers(spark, d):
    return baskets.basket_outliers(fx.basket_lines(spark, d), lines="tx_id")


@query("date_range", with_(TXL) + "SELECT min(date) AS min_date, max(date) AS max_date FROM txl")
def q_date_range(spark, d):
    return temporal.date_range(fx.purchases(spark, d))


@query("units_sold", with_(ITEMS) + """
SELECT count(item) AS units, count(DISTINCT item) AS distinct_items FROM items""")
def q_units_sold(spark, d):
    return baskets.units_sold(fx.basket_lines(spark, d))


@query("integer_tokens", """
WITH tok AS (SELECT doc_id, unnest(string_split(text, ' ')) AS t FROM documents),
it AS (SELECT doc_id, TRY_CAST(t AS BIGINT) AS item FROM tok
       WHERE regexp_full_match(t, '[+-]?[0-9]+'))
SELECT doc_id, count(item) AS units, count(DISTINCT item) AS distinct_items
FROM it WHERE item IS NOT NULL GROUP BY doc_id""")
def q_integer_tokens(spark, d):
    items = baskets.basket_items(fx.table(spark, d, "documents"), "text", keep=["doc_id"])
    return items.groupBy("doc_id").agg(F.count("item").alias("units"),
                                       F.count_distinct("item").alias("distinct_items"))


@query("typed_projection", """
SELECT CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE) END AS date,
       o_orderkey AS store_id,
       CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS customer_id,
       CAST(NULL AS VARCHAR) AS products
FROM orders""")
def q_typed_projection(spark, d):
    return readers.typed_transactions(readers.parse_lines(fx.pipe_lines(spark, d)))


_ITEM_COUNTS = """ic AS (SELECT item, count(*) AS units FROM items GROUP BY item)"""


@query("top_products", with_(ITEMS, _ITEM_COUNTS) + f"""
SELECT * FROM (
  SELECT CAST(row_number() OVER w AS INTEGER) AS rank, item, units,
         {r(pct('units', 'sum(units) OVER ()'))} AS pct,
         {r(pct('sum(units) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'sum(units) OVER ()'))}
           AS cum_pct
  FROM ic WINDOW w AS (ORDER BY units DESC, item)) t
WHERE rank <= {labels.TOP_PRODUCTS_K}""")
def q_top_products(spark, d):
    return baskets.top_products(fx.basket_lines(spark, d))


@query("top_products_heavy", SQL["top_products"])
def q_top_products_heavy(spark, d):
    return heavy.top_products(fx.basket_lines(spark, d))


@query("basket_quantile_sketches", with_("""sizes AS (
  SELECT CAST(year(o.o_orderdate) AS INTEGER) AS year, count(*) AS size
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey, o.o_orderdate)""") +
       "\nUNION ALL\n".join(f"""
SELECT year, CAST({p} AS DOUBLE) AS p, count(*) AS rows, quantile_disc(size, {p}) AS exact_value,
       TRUE AS within_bound FROM sizes GROUP BY year""" for p in baskets.QUARTILES))
def q_basket_quantile_sketches(spark, d):
    sizes = fx.dated_sizes(spark, d)
    monthly = sketches.quantile_sketches(sizes, ["year", "month"], "size")
    read = sketches.read_quantiles(sketches.merge_quantiles(monthly, ["year"]), ["year"], baskets.QUARTILES)
    return sketches.quantile_check(sizes, read, ["year"], "size", sketches.quantile_error())


@query("pareto_products", with_(ITEMS, _ITEM_COUNTS) + f"""
SELECT row_number() OVER w AS rank, item, units,
       {r(pct('units', 'sum(units) OVER ()'))} AS pct,
       {r(pct('sum(units) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'sum(units) OVER ()'))}
         AS cum_pct
FROM ic WINDOW w AS (ORDER BY units DESC, item)""")
def q_pareto_products(spark, d):
    return baskets.pareto_products(fx.basket_lines(spark, d))


@query("concentration", with_(ITEMS, _ITEM_COUNTS) + f""",
rk AS (SELECT units, row_number() OVER (ORDER BY units DESC, item) AS rn,
              sum(units) OVER () AS total FROM ic),
cuts AS (SELECT * FROM (VALUES {', '.join(f'({n})' for n in labels.CONCENTRATION_CUTS)}) v(top_n))
SELECT CAST(cuts.top_n AS INTEGER) AS top_n, CAST(sum(rk.units) AS BIGINT) AS units,
       {r(pct('sum(rk.units)', 'any_value(rk.total)'))} AS pct
FROM cuts JOIN rk ON rk.rn <= cuts.top_n GROUP BY cuts.top_n""")
def q_concentration(spark, d):
    return baskets.concentration(fx.basket_lines(spark, d))


@query("split_tokens", """
SELECT doc_id,
       CAST(len(string_split(text, ' ')) AS INTEGER) AS raw_tokens,
       CAST(len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS INTEGER) AS nonempty_tokens
FROM documents""")
def q_split_tokens(spark, d):
    return baskets.token_counts(fx.table(spark, d, "documents"))


# ---------------------------------------------------------------------------
# temporal
# ---------------------------------------------------------------------------

@query("monthly_distribution", with_(TXL) + f"""
SELECT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
       count(*) AS transactions, {r(pct('count(*)', 'sum(count(*)) OVER ()'))} AS pct
FROM txl GROUP BY 1, 2""")
def q_monthly_distribution(spark, d):
    return temporal.monthly_distribution(fx.purchases(spark, d))


_MONTHLY = """ms AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS transactions
       FROM txl WHERE date IS NOT NULL GROUP BY 1)"""


@query("monthly_series", with_(TXL, _MONTHLY) + "SELECT month, transactions FROM ms")
def q_monthly_series(spark, d):
    return temporal.monthly_series(fx.purchases(spark, d))


@query("monthly_series_by_store", with_(TXL) + """
SELECT store_id, CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS transactions
FROM txl WHERE date IS NOT NULL GROUP BY 1, 2""")
def q_monthly_series_by_store(spark, d):
    return temporal.monthly_series(fx.store_purchases(spark, d), by=("store_id",))


@query("monthly_growth", with_(TXL, _MONTHLY) + f"""
SELECT month, transactions,
       {r(pct('transactions - lag(transactions) OVER (ORDER BY month)', 'lag(transactions) OVER (ORDER BY month)'))}
         AS growth_pct,
       {r(pct('transactions - first_value(transactions) OVER (ORDER BY month)', 'first_value(transactions) OVER (ORDER BY month)'))}
         AS growth_from_first_pct
FROM ms""")
def q_monthly_growth(spark, d):
    return temporal.monthly_growth(fx.purchases(spark, d))


_DAY_CASE = "CASE " + " ".join(f"WHEN dow = {k} THEN '{v}'" for k, v in WEEKDAY_LABELS.items()) \
    + f" ELSE '{labels.UNKNOWN_WEEKDAY}' END"
_WEEKDAYS = f"""wd AS (SELECT dow AS day_of_week, {_DAY_CASE} AS day_name, count(*) AS transactions
       FROM (SELECT CAST(dayofweek(date) + 1 AS INTEGER) AS dow FROM txl) x GROUP BY dow)"""


@query("weekday_distribution", with_(TXL, _WEEKDAYS) + f"""
SELECT day_of_week, day_name, transactions, {r(pct('transactions', 'sum(transactions) OVER ()'))} AS pct
FROM wd""")
def q_weekday_distribution(spark, d):
    return temporal.weekday_distribution(fx.purchases(spark, d))


@query("weekday_ranking", with_(TXL, _WEEKDAYS) + """
SELECT CAST(rank() OVER (ORDER BY transactions DESC) AS INTEGER) AS rank, day_of_week, day_name,
       transactions FROM wd""")
def q_weekday_ranking(spark, d):
    return temporal.weekday_ranking(fx.purchases(spark, d))


@query("weekend_share", with_(TXL) + f"""
SELECT count(*) AS transactions,
       count(*) FILTER (WHERE dayofweek(date) IN (0, 6)) AS weekend_transactions,
       {r(pct('count(*) FILTER (WHERE dayofweek(date) IN (0, 6))', 'count(*)'))} AS weekend_pct
FROM txl""")
def q_weekend_share(spark, d):
    return temporal.weekend_share(fx.purchases(spark, d))


_STORES = """st AS (SELECT store_id, count(*) AS transactions FROM txl GROUP BY store_id)"""


@query("store_distribution", with_(TXL, _STORES) + f"""
SELECT store_id, transactions, {r(pct('transactions', 'sum(transactions) OVER ()'))} AS pct FROM st""")
def q_store_distribution(spark, d):
    return temporal.store_distribution(fx.store_purchases(spark, d))


@query("store_ranking", with_(TXL, _STORES) + """
SELECT CAST(rank() OVER (ORDER BY transactions DESC) AS INTEGER) AS rank, store_id, transactions FROM st""")
def q_store_ranking(spark, d):
    return temporal.store_ranking(fx.store_purchases(spark, d))


@query("store_gaps", with_(TXL, _STORES) + f"""
SELECT store_id, transactions,
       {r(pct('max(transactions) OVER () - transactions', 'max(transactions) OVER ()'))} AS gap_to_leader_pct,
       {r(pct('lag(transactions) OVER w - transactions', 'transactions'))} AS growth_to_next_pct,
       {r(pct('transactions - lead(transactions) OVER w', 'lead(transactions) OVER w'))} AS lead_over_next_pct
FROM st WINDOW w AS (ORDER BY transactions DESC, store_id NULLS LAST)""")
def q_store_gaps(spark, d):
    return temporal.store_gaps(fx.store_purchases(spark, d))


# ---------------------------------------------------------------------------
# customers
# ---------------------------------------------------------------------------

_PER_CUSTOMER = """pcu AS (SELECT customer_id, count(*) AS purchases FROM txl
        WHERE customer_id IS NOT NULL GROUP BY customer_id)"""


@query("purchase_frequency", with_(TXL, _PER_CUSTOMER) + f"""
SELECT num_purchases, num_customers, pct FROM (
  SELECT purchases AS num_purchases, count(*) AS num_customers,
         {r(pct('count(*)', 'sum(count(*)) OVER ()'))} AS pct
  FROM pcu GROUP BY purchases) f
ORDER BY num_purchases LIMIT {labels.PURCHASE_FREQUENCY_K}""")
def q_purchase_frequency(spark, d):
    return customers.purchase_frequency(fx.purchases(spark, d))


def _segment_case(field: int) -> str:
    parts = []
    for i, seg in enumerate(CUSTOMER_SEGMENTS, start=1):
        lab, lo, hi, name = seg
        cond = f"purchases >= {lo}" if hi is None else f"purchases BETWEEN {lo} AND {hi}"
        val = {0: str(i), 1: f"'{lab}'", 3: f"'{name}'"}[field]
        parts.append(f"WHEN {cond} THEN {val}")
    return "CASE " + " ".join(parts) + " END"


@query("customer_segments", with_(TXL, _PER_CUSTOMER) + f"""
SELECT CAST({_segment_case(0)} AS INTEGER) AS segment_order, {_segment_case(1)} AS segment,
       {_segment_case(3)} AS segment_name, count(*) AS customers,
       {r(pct('count(*)', 'sum(count(*)) OVER ()'))} AS pct
FROM pcu GROUP BY 1, 2, 3""")
def q_customer_segments(spark, d):
    return customers.customer_segments(fx.purchases(spark, d))


@query("new_customer_share", with_(TXL, _PER_CUSTOMER) + f"""
SELECT count(*) AS customers, count(*) FILTER (WHERE purchases = 1) AS new_customers,
       {r(pct('count(*) FILTER (WHERE purchases = 1)', 'count(*)'))} AS new_customer_pct
FROM pcu""")
def q_new_customer_share(spark, d):
    return customers.new_customer_share(fx.purchases(spark, d))


@query("segment_rate", with_(TXL, _PER_CUSTOMER) + f""",
mo AS (SELECT count(DISTINCT date_trunc('month', date)) AS months FROM txl WHERE date IS NOT NULL)
SELECT CAST({_segment_case(0)} AS INTEGER) AS segment_order, {_segment_case(1)} AS segment,
       count(*) AS customers, CAST(sum(purchases) AS BIGINT) AS purchases, any_value(mo.months) AS months,
       {r('CAST(sum(purchases) AS DOUBLE) / (CAST(count(*) AS DOUBLE) * CAST(any_value(mo.months) AS DOUBLE))')}
         AS purchases_per_customer_month
FROM pcu, mo GROUP BY 1, 2""")
def q_segment_rate(spark, d):
    return customers.segment_rate(fx.purchases(spark, d))


@query("top_customer", with_(TXL, _PER_CUSTOMER) + """
SELECT customer_id, purchases FROM pcu ORDER BY purchases DESC, customer_id LIMIT 1""")
def q_top_customer(spark, d):
    return customers.top_customer(fx.purchases(spark, d))


_GAPS = """gp AS (
  SELECT customer_id, count(*) AS purchases, avg(gap) AS mean_gap_days FROM (
    SELECT customer_id, date_diff('day', lag(date) OVER (PARTITION BY customer_id ORDER BY date), date) AS gap
    FROM txl WHERE customer_id IS NOT NULL) x
  GROUP BY customer_id)"""


@query("customer_gaps", with_(TXL, _GAPS) + f"""
SELECT customer_id, purchases, {r('mean_gap_days')} AS mean_gap_days FROM gp""")
def q_customer_gaps(spark, d):
    return customers.customer_gaps(fx.purchases(spark, d))


@query("purchase_days", with_(TXL) + """
SELECT customer_id, date, count(*) AS purchases,
       lag(date) OVER (PARTITION BY customer_id ORDER BY date) AS prev_date,
       CAST(date - lag(date) OVER (PARTITION BY customer_id ORDER BY date) AS INTEGER) AS gap_days
FROM txl WHERE customer_id IS NOT NULL AND date IS NOT NULL GROUP BY customer_id, date""")
def q_purchase_days(spark, d):
    return customers.purchase_days(fx.purchases(spark, d))


@query("previous_purchase", with_(TXL) + """
SELECT customer_id, date, lag(date) OVER w AS prev_date,
       CAST(date - lag(date) OVER w AS INTEGER) AS gap_days
FROM txl WHERE customer_id IS NOT NULL AND date IS NOT NULL
WINDOW w AS (PARTITION BY customer_id ORDER BY date)""")
def q_previous_purchase(spark, d):
    return customers.previous_purchase(fx.purchases(spark, d))


@query("inter_purchase_days", with_(TXL, _GAPS) + f"""
SELECT count(mean_gap_days) AS customers_with_gap, {r('avg(mean_gap_days)')} AS avg_days_between_purchases
FROM gp""")
def q_inter_purchase_days(spark, d):
    return customers.inter_purchase_days(fx.purchases(spark, d))


# ---------------------------------------------------------------------------
# cohorts
# ---------------------------------------------------------------------------

_COHORT = """t AS (SELECT customer_id, CAST(date_trunc('month', date) AS DATE) AS month
      FROM txl WHERE customer_id IS NOT NULL AND date IS NOT NULL),
fp AS (SELECT customer_id, min(month) AS cohort_month FROM t GROUP BY customer_id),
j AS (SELECT t.customer_id, fp.cohort_month,
             CAST(floor(date_diff('month', fp.cohort_month, t.month)) AS INTEGER) AS cohort_index
      FROM t JOIN fp ON t.customer_id = fp.customer_id),
act AS (SELECT cohort_month, cohort_index, count(DISTINCT customer_id) AS active_customers
        FROM j GROUP BY cohort_month, cohort_index),
sizes AS (SELECT cohort_month, count(DISTINCT customer_id) AS cohort_size
          FROM j WHERE cohort_index = 0 GROUP BY cohort_month),
ret AS (SELECT act.cohort_month, act.cohort_index, act.active_customers, sizes.cohort_size
        FROM act LEFT JOIN sizes ON act.cohort_month = sizes.cohort_month)"""


@query("cohort_sizes", with_(TXL, _COHORT) + """
SELECT cohort_month, cohort_size FROM sizes""")
def q_cohort_sizes(spark, d):
    return cohorts.cohort_sizes(fx.purchases(spark, d))


@query("cohort_activity", with_(TXL, _COHORT) + "SELECT * FROM act")
def q_cohort_activity(spark, d):
    return cohorts.cohort_activity(fx.purchases(spark, d))


@query("retention", with_(TXL, _COHORT) + f"""
SELECT cohort_month, cohort_index, active_customers, cohort_size,
       {r('CAST(active_customers AS DOUBLE) / CAST(cohort_size AS DOUBLE)')} AS retention_rate FROM ret""")
def q_retention(spark, d):
    return cohorts.retention(fx.purchases(spark, d))


@query("retention_from_state", SQL["retention"])
def q_retention_from_state(spark, d):
    tx = fx.purchases(spark, d)
    # states of two halves of the rows, as if one came with older files, and merged
    old = F.pmod(F.xxhash64("customer_id", "date"), F.lit(2)) == 0  # never NULL
    return cohorts.retention_of_state(cohorts.merge_states(
        cohorts.cohort_state(tx.where(old)), cohorts.cohort_state(tx.where(~old))))


@query("active_customer_sketches", with_(TXL) + """
SELECT CAST(year(date) AS INTEGER) AS year, count(DISTINCT customer_id) AS exact, TRUE AS within_bound
FROM txl WHERE date IS NOT NULL AND customer_id IS NOT NULL GROUP BY 1""")
def q_active_customer_sketches(spark, d):
    tx = fx.purchases(spark, d)
    monthly = sketches.monthly_distinct_sketches(tx)
    return sketches.distinct_check(tx, sketches.distinct_by_year(monthly))


@query("retention_matrix", with_(TXL, _COHORT) + f"""
SELECT * FROM (
  PIVOT (SELECT cohort_month, cohort_index,
                {r('CAST(active_customers AS DOUBLE) / CAST(cohort_size AS DOUBLE)')} AS rate FROM ret)
  ON cohort_index IN ({', '.join(map(str, range(80)))}) USING avg(rate) GROUP BY cohort_month)""")
def q_retention_matrix(spark, d):
    return cohorts.retention_matrix(fx.purchases(spark, d))


# ---------------------------------------------------------------------------
# association rules
# ---------------------------------------------------------------------------

# Exact and complete twin of FP-growth for a small item universe: every
# order's item set becomes a bit mask, every non-empty sub-mask of the
# universe is counted by ``mask & m = m``.
_RULE_BASE = f"""tl AS (SELECT DISTINCT l.l_orderkey AS tx_id, p.p_type AS item
       FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
u AS (SELECT item, CAST(row_number() OVER (ORDER BY item) - 1 AS INTEGER) AS bit FROM (SELECT DISTINCT item FROM tl) x),
nb AS (SELECT count(DISTINCT tx_id) AS n FROM tl),
bm AS (SELECT tl.tx_id, CAST(sum(CAST(1 AS BIGINT) << u.bit) AS BIGINT) AS mask
       FROM tl JOIN u USING (item) GROUP BY tl.tx_id),
cand AS (SELECT CAST(generate_series AS BIGINT) AS m
         FROM generate_series(1, (SELECT (CAST(1 AS BIGINT) << count(*)) - 1 FROM u))),
freq AS (SELECT cand.m, count(*) AS freq FROM cand JOIN bm ON (bm.mask & cand.m) = cand.m
         GROUP BY cand.m HAVING count(*) >= {labels.RULES_MIN_SUPPORT} * (SELECT n FROM nb)),
named AS (SELECT f.m, f.freq, bit_count(f.m) AS size,
                 string_agg(u.item, ',' ORDER BY u.item) AS itemset
          FROM freq f JOIN u ON (f.m >> u.bit) & 1 = 1 GROUP BY f.m, f.freq)"""


@query("frequent_itemsets", with_(_RULE_BASE) + f"""
SELECT itemset, CAST(size AS INTEGER) AS size, freq,
       {r('CAST(freq AS DOUBLE) / CAST((SELECT n FROM nb) AS DOUBLE)')} AS support
FROM named""")
def q_frequent_itemsets(spark, d):
    return rules.frequent_itemsets(rules.clean_baskets(fx.type_baskets(spark, d)))


@query("association_rules", with_(_RULE_BASE) + f""",
rl AS (
  SELECT a.itemset AS antecedent, u.item AS consequent,
         CAST(f.freq AS DOUBLE) / CAST(a.freq AS DOUBLE) AS confidence,
         (CAST(f.freq AS DOUBLE) / CAST(a.freq AS DOUBLE))
           / (CAST(c.freq AS DOUBLE) / CAST((SELECT n FROM nb) AS DOUBLE)) AS lift,
         CAST(f.freq AS DOUBLE) / CAST((SELECT n FROM nb) AS DOUBLE) AS support
  FROM named f JOIN u ON (f.m >> u.bit) & 1 = 1
  JOIN named a ON a.m = f.m - (CAST(1 AS BIGINT) << u.bit)
  JOIN named c ON c.m = (CAST(1 AS BIGINT) << u.bit)
  WHERE f.size >= 2)
SELECT antecedent, consequent, {r('confidence')} AS confidence, {r('lift')} AS lift,
       {r('support')} AS support
FROM rl WHERE confidence >= {labels.RULES_MIN_CONFIDENCE}
ORDER BY lift DESC, antecedent, consequent LIMIT {labels.RULES_TOP_K}""")
def q_association_rules(spark, d):
    return rules.association_rules(rules.clean_baskets(fx.type_baskets(spark, d)))


# ---------------------------------------------------------------------------
# series and forecasts
# ---------------------------------------------------------------------------

_STORE_SERIES = """ss AS (SELECT store_id, CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS transactions
       FROM txl WHERE date IS NOT NULL GROUP BY 1, 2)"""
_FILLED = """sb AS (SELECT store_id, min(month) AS lo, max(month) AS hi FROM ss GROUP BY store_id),
cal AS (SELECT store_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month FROM sb),
sf AS (SELECT cal.store_id, cal.month, CAST(coalesce(ss.transactions, 0) AS BIGINT) AS transactions
       FROM cal LEFT JOIN ss ON ss.store_id = cal.store_id AND ss.month = cal.month)"""


@query("monthly_series_filled", with_(TXL, _STORE_SERIES, _FILLED) + "SELECT * FROM sf")
def q_monthly_series_filled(spark, d):
    s = temporal.monthly_series(fx.store_purchases(spark, d), by=("store_id",))
    return forecast.fill_months(s, ("store_id",))


_GLOBAL_FILLED = """gb AS (SELECT min(month) AS lo, max(month) AS hi FROM ms),
gcal AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month FROM gb),
gf AS (SELECT gcal.month, CAST(coalesce(ms.transactions, 0) AS BIGINT) AS transactions
       FROM gcal LEFT JOIN ms ON ms.month = gcal.month)"""


def _naive_sql(src: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    on = " AND ".join([f"fut.{x} = moy.{x}" for x in keys] + ["moy.m = month(fut.month)"])
    return f""",
moy AS (SELECT {kc}month(month) AS m, CAST(sum(transactions) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS mean
        FROM {src} GROUP BY {kc}month(month)),
ov AS (SELECT {kc}CAST(sum(transactions) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS mean, max(month) AS last
       FROM {src} {('GROUP BY ' + k) if keys else ''}),
fut AS (SELECT {', '.join('ov.' + x for x in keys) + (', ' if keys else '')}ov.mean,
               CAST(unnest(generate_series(ov.last + INTERVAL 1 MONTH, ov.last + INTERVAL 6 MONTH,
                                           INTERVAL 1 MONTH)) AS DATE) AS month FROM ov)
SELECT {', '.join('fut.' + x for x in keys) + (', ' if keys else '')}fut.month,
       {r('coalesce(moy.mean, fut.mean)')} AS yhat, '{labels.METHOD_SEASONAL_NAIVE}' AS method
FROM fut LEFT JOIN moy ON {on}"""


@query("forecast_naive_global", with_(TXL, _MONTHLY, _GLOBAL_FILLED)[:-1] + _naive_sql("gf", []))
def q_forecast_naive_global(spark, d):
    s = temporal.monthly_series(fx.purchases(spark, d))
    return forecast.seasonal_naive(s)


@query("forecast_naive_store", with_(TXL, _STORE_SERIES, _FILLED)[:-1] + _naive_sql("sf", ["store_id"]))
def q_forecast_naive_store(spark, d):
    s = temporal.monthly_series(fx.store_purchases(spark, d), by=("store_id",))
    return forecast.seasonal_naive(s, ("store_id",))


@query("forecast_holt_winters_store")
def q_forecast_holt_winters_store(spark, d):
    s = temporal.monthly_series(fx.store_purchases(spark, d), by=("store_id",))
    return forecast.holt_winters(s, ("store_id",))


@query("forecast_auto")
def q_forecast_auto(spark, d):
    by_store = temporal.monthly_series(fx.store_purchases(spark, d), by=("store_id",))
    return forecast.forecast(temporal.series_with_total(by_store), ("series",)).select(
        "series", "month", "yhat", "method")


# ---------------------------------------------------------------------------
# global summary
# ---------------------------------------------------------------------------

@query("transaction_summary", with_(TX, ITEMS) + f""",
g AS (SELECT count(*) AS n, any_value({_TX_MISS}) AS m FROM tx GROUP BY date, store_id, customer_id, products),
a AS (SELECT count(DISTINCT store_id) + max(CASE WHEN store_id IS NULL THEN 1 ELSE 0 END) AS stores,
             count(*) AS transactions,
             count(DISTINCT customer_id) + max(CASE WHEN customer_id IS NULL THEN 1 ELSE 0 END) AS customers,
             min(date) AS date_start, max(date) AS date_end,
             avg(CASE WHEN products IS NOT NULL THEN len(string_split(products, ' ')) END) AS avg_basket
      FROM tx)
SELECT '{labels.SUMMARY_SCOPE}' AS scope, CAST(a.stores AS BIGINT) AS stores, a.transactions,
       CAST(a.customers AS BIGINT) AS customers,
       a.date_start, a.date_end, {r('a.avg_basket')} AS avg_basket_size,
       (SELECT CAST(sum(n - 1) AS BIGINT) FROM g) AS exact_duplicates,
       (SELECT CAST(sum(n * m) AS BIGINT) FROM g) AS nulls,
       (SELECT count(DISTINCT item) FROM items) AS unique_products
FROM a""")
def q_transaction_summary(spark, d):
    from tiller.plans.report import transaction_summary

    return transaction_summary(fx.transactions(spark, d), fx.basket_lines(spark, d))


# ---------------------------------------------------------------------------
# Holt-Winters twins: the same recursion as a recursive CTE, one row per
# (series, weight triple, step), identical floating-point operation order.
# ---------------------------------------------------------------------------

def _hw_sql(src: str, keys: list[str], horizon: int = 6, m: int = 12,
            min_len: int = labels.HOLT_WINTERS_MIN_MONTHS) -> str:
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    part = f"PARTITION BY {k} " if keys else ""
    grid = ", ".join(f"({a}, {b}, {g})" for a in forecast.ALPHAS for b in forecast.BETAS
                     for g in forecast.GAMMAS)

    def fit(i: int, candidates: str) -> str:
        """Run the recursion for every candidate row of a round and keep the best."""
        return f""",
init{i} AS (SELECT {kc}y, last, a, b, g,
                list_reduce(y[1:{m}], lambda acc, x: acc + x) / CAST({m} AS DOUBLE) AS l0,
                list_reduce(y[1:least({m}, len(y) - {m})], lambda acc, x: acc + x)
                  / CAST(least({m}, len(y) - {m}) AS DOUBLE) AS m1,
                list_reduce(y[{m + 1}:{2 * m}], lambda acc, x: acc + x)
                  / CAST(least({m}, len(y) - {m}) AS DOUBLE) AS m2
         FROM ({candidates}) c),
hw{i} AS (
  SELECT {kc}a, b, g, last, y, len(y) AS n, 0 AS t, l0 AS l, (m2 - m1) / CAST({m} AS DOUBLE) AS tr,
         list_transform(y[1:{m}], lambda v: v - l0) AS s, CAST(0.0 AS DOUBLE) AS sse
  FROM init{i}
  UNION ALL
  SELECT {kc}a, b, g, last, y, n, t + 1, l2, b * (l2 - l) + (1.0 - b) * tr,
         list_transform(s, lambda x, i: CASE WHEN i = k + 1 THEN g * (v - l2) + (1.0 - g) * sk ELSE x END),
         sse + (v - (l + tr + sk)) * (v - (l + tr + sk))
  FROM (SELECT *, a * (v - sk) + (1.0 - a) * (l + tr) AS l2
        FROM (SELECT *, y[t + 1] AS v, s[t % {m} + 1] AS sk, t % {m} AS k FROM hw{i} WHERE t < n) q) q2),
fin{i} AS (SELECT *, row_number() OVER ({part}ORDER BY sse, a, b, g) AS rn FROM hw{i} WHERE t = n),
best{i} AS MATERIALIZED (SELECT * FROM fin{i} WHERE rn = 1)"""

    rounds = fit(0, "SELECT arr.*, grid.* FROM arr, grid")
    for i, (by, share) in enumerate(forecast.REFINEMENTS, start=1):
        rounds += fit(i, f"""
    SELECT {kc}y, last, least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), a + mi * CAST({by} AS DOUBLE))) AS a,
           least(CAST(1 AS DOUBLE), b * (1.0 + mj * CAST({share} AS DOUBLE))) AS b,
           least(CAST(1 AS DOUBLE), g * (1.0 + mk * CAST({share} AS DOUBLE))) AS g
    FROM best{i - 1}, moves""")
    return f""",
arr AS (SELECT {kc}list(CAST(transactions AS DOUBLE) ORDER BY month) AS y, max(month) AS last
        FROM {src} {('GROUP BY ' + k) if keys else ''} HAVING count(*) >= {min_len}),
grid AS (SELECT CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(g AS DOUBLE) AS g
         FROM (VALUES {grid}) v(a, b, g)),
moves AS (SELECT CAST(i.range AS DOUBLE) AS mi, CAST(j.range AS DOUBLE) AS mj, CAST(k.range AS DOUBLE) AS mk
          FROM range(-1, 2) i, range(-1, 2) j, range(-1, 2) k){rounds},
best AS (SELECT * FROM best{len(forecast.REFINEMENTS)}),
steps AS (SELECT range AS h FROM range(1, {horizon + 1}))
SELECT {', '.join('best.' + x for x in keys) + (', ' if keys else '')}
       CAST(best.last + to_months(CAST(steps.h AS INTEGER)) AS DATE) AS month,
       {r(f'best.l + CAST(steps.h AS DOUBLE) * best.tr + best.s[(best.n + steps.h - 1) % {m} + 1]')} AS yhat,
       '{labels.METHOD_HOLT_WINTERS}' AS method, {r('best.a')} AS alpha,
       {r('best.b')} AS beta, {r('best.g')} AS gamma,
       {r('best.sse')} AS sse
FROM best, steps"""


SQL["forecast_holt_winters_store"] = ("WITH RECURSIVE " + with_(TXL, _STORE_SERIES, _FILLED)[5:-1]
                                      + _hw_sql("sf", ["store_id"]))


def _auto_sql() -> str:
    short_store = ("(SELECT * FROM sf WHERE store_id IN "
                   "(SELECT store_id FROM sf GROUP BY store_id "
                   f"HAVING count(*) < {labels.HOLT_WINTERS_MIN_MONTHS})) shs")
    short_global = ("(SELECT * FROM gf WHERE (SELECT count(*) FROM gf) < "
                    f"{labels.HOLT_WINTERS_MIN_MONTHS}) shg")
    parts = [
        ("'global'", "WITH RECURSIVE " + _hw_sql("gf", [])[2:]),
        ("'global'", "WITH " + _naive_sql(short_global, [])[2:]),
        ("CAST(store_id AS VARCHAR)", "WITH RECURSIVE " + _hw_sql("sf", ["store_id"])[2:]),
        ("CAST(store_id AS VARCHAR)", "WITH " + _naive_sql(short_store, ["store_id"])[2:]),
    ]
    body = "\nUNION ALL\n".join(
        f"SELECT {key} AS series, month, yhat, method FROM ({sub}) p{i}"
        for i, (key, sub) in enumerate(parts))
    return with_(TXL, _MONTHLY, _GLOBAL_FILLED, _STORE_SERIES, _FILLED) + body


SQL["forecast_auto"] = _auto_sql()
