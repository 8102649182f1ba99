"""Stand-ins for the retail tables, derived by Spark from the star-schema
test tables (``region nation customer supplier part orders lineitem ...``).

| role | derivation |
| --- | --- |
| purchases | orders: date = order date, customer = o_custkey |
| store purchases | orders LEFT JOIN customer: store = customer nation |
| transactions | store purchases LEFT JOIN documents on the key: products = the text (NULL where there is none) |
| basket lines | lineitem(l_orderkey, l_partkey) - the exploded baskets |
| dated sizes | lines per order JOIN orders: year, month, size |
| product-category | lineitem JOIN supplier: product = l_partkey, category = s_nationkey |
| categories | nation: id = n_nationkey, name = n_name |
| order facts, line orders | the keys of orders and of the orders that have lines |
| type baskets | distinct part types of an order's lines (for association rules) |

Every frame grows with the underlying tables; nothing is sampled or cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, customer_id): one row per order, from orders alone."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_custkey").cast("bigint").alias("customer_id"))


def store_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, store_id, customer_id): for the operators that ask for the store."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (orders.join(customer, orders.o_custkey == customer.c_custkey, "left")
            .select(F.col("o_orderdate").cast("date").alias("date"),
                    F.col("c_nationkey").cast("bigint").alias("store_id"),
                    F.col("o_custkey").cast("bigint").alias("customer_id")))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, store_id, customer_id, products): one row per order.

    The basket string is a column that exists (a document's text), joined on a
    key that is unique on both sides, so no list is built per order.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    texts = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("products"))
    return (orders.join(customer, orders.o_custkey == customer.c_custkey, "left")
            .join(texts, orders.o_orderkey == texts.doc_id, "left")
            .select(F.col("o_orderdate").cast("date").alias("date"),
                    F.col("c_nationkey").cast("bigint").alias("store_id"),
                    F.col("o_custkey").cast("bigint").alias("customer_id"), "products"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(text, lang, source, n_chars): documents without their id - real duplicates."""
    return table(spark, sf_dir, "documents").select("text", "lang", "source", "n_chars")


def pipe_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value): orders as lines of a transaction file, ``date|store|customer|products``.

    Two kinds of bad lines come with the data's own values: statuses, which are
    no dates, stand in the date field of orders that are open, and priorities
    in the customer field of those without a clerk's approval ("P").
    """
    orders = table(spark, sf_dir, "orders")
    date = F.when(F.col("o_orderstatus") == "O", F.col("o_orderstatus")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd"))
    customer = F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise(
        F.col("o_custkey").cast("string"))
    return orders.select(F.concat_ws("|", date, F.col("o_orderkey").cast("string"), customer,
                                     F.lit("")).alias("value"))


def basket_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tx_id, item): the exploded baskets, straight from lineitem."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("tx_id"), F.col("l_partkey").alias("item"))


def dated_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(year, month, size): the number of lines of every order that has some."""
    sizes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("size"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return sizes.join(orders, sizes.l_orderkey == orders.o_orderkey).select(
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), "size")


def product_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code_pr, code): one row per line item, product x supplier nation."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    su = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return li.join(su, li.l_suppkey == su.s_suppkey).select(
        F.col("l_partkey").alias("code_pr"), F.col("s_nationkey").alias("code"))


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, category_name)."""
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("category_name"))


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code): the key of every order; those without lines are natural orphans."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("code"))


def line_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id): the order keys that lines name."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"))


def type_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tx_id, items): the part types bought together in one order."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return (li.join(part, li.l_partkey == part.p_partkey)
            .groupBy(F.col("l_orderkey").alias("tx_id"))
            .agg(F.collect_set("p_type").alias("items")))
