"""Product-category statistics.

``pc`` is the product-category bridge (code_pr, code); ``cat`` the category
names (id, category_name).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiller.functions.columns import share_pct, with_share_of_total
from tiller.functions.labels import HEAD_CATEGORIES, TAIL_CATEGORIES, UNKNOWN_CATEGORY
from tiller.operators._util import metric_rows


def category_names(cat: DataFrame) -> DataFrame:
    """One name per category id (the smallest when an id repeats), so a
    lookup can never fan out."""
    return cat.groupBy("id").agg(F.min("category_name").alias("category_name"))


def with_category_name(dist: DataFrame, cat: DataFrame, code: str = "code") -> DataFrame:
    """Left equi join on the category code with a default name.

    Both sides hold one row per code; the planner broadcasts the name side
    only when its measured size passes the broadcast threshold (AQE).
    """
    names = category_names(cat).withColumnRenamed("id", "_id")
    return (dist.join(names, F.col(code) == F.col("_id"), "left")
            .withColumn("category_name", F.coalesce("category_name", F.lit(UNKNOWN_CATEGORY)))
            .drop("_id"))


def _distribution(pc: DataFrame, cat: DataFrame) -> DataFrame:
    dist = pc.groupBy("code").agg(F.count(F.lit(1)).alias("num_products"))
    dist = with_share_of_total(dist, "num_products")
    return with_category_name(dist, cat).select("code", "category_name", "num_products", "pct")


def category_distribution(pc: DataFrame, cat: DataFrame) -> DataFrame:
    """Rows per category code with share and name, largest first.

    (code, category_name, num_products, pct)
    """
    return _distribution(pc, cat).orderBy(F.desc("num_products"), F.asc_nulls_last("code"))


def head_tail_categories(pc: DataFrame, cat: DataFrame, head: int = HEAD_CATEGORIES,
                         tail: int = TAIL_CATEGORIES) -> DataFrame:
    """The ``head`` largest and ``tail`` smallest categories.

    (part, position, code, category_name, num_products, pct); ties are broken
    by code ascending in both lists.
    """
    dist = pc.groupBy("code").agg(F.count(F.lit(1)).alias("num_products"))
    total = dist.agg(F.sum("num_products")).scalar()

    def part(name: str, size: int, order: list) -> DataFrame:
        # a top-k first; the window numbers those rows only
        top = dist.orderBy(*order).limit(size)
        return top.select(F.lit(name).alias("part"),
                          F.row_number().over(Window.orderBy(*order)).alias("position"),
                          "code", "num_products",
                          share_pct(F.col("num_products"), total).alias("pct"))

    code = F.asc_nulls_last("code")
    both = part("head", head, [F.desc("num_products"), code]).unionByName(
        part("tail", tail, [F.asc("num_products"), code]))
    return with_category_name(both, cat).select("part", "position", "code", "category_name",
                                                "num_products", "pct")


def _pairs(pc: DataFrame) -> DataFrame:
    """Distinct (product, category) pairs - computed once for A8/A9."""
    return pc.select("code_pr", "code").dropDuplicates()


def categories_per_product(pc: DataFrame) -> DataFrame:
    """(code_pr, num_categories): distinct categories of each product."""
    return _pairs(pc).groupBy("code_pr").agg(F.count("code").alias("num_categories"))


def products_per_category(pc: DataFrame) -> DataFrame:
    """(code, num_products): distinct products of each category."""
    return _pairs(pc).groupBy("code").agg(F.count("code_pr").alias("num_products"))


def multi_category_products(pc: DataFrame) -> DataFrame:
    """Products in more than one category.

    (unique_products, multi_category_products, multi_category_pct)
    """
    per = categories_per_product(pc)
    return per.agg(
        F.count(F.lit(1)).alias("unique_products"),
        F.count_if(F.col("num_categories") > 1).alias("multi_category_products"),
    ).withColumn("multi_category_pct",
                 F.coalesce(share_pct("multi_category_products", "unique_products"), F.lit(0.0)))


def relation_averages(pc: DataFrame) -> DataFrame:
    """(avg_categories_per_product, avg_products_per_category)."""
    a = categories_per_product(pc).agg(F.avg("num_categories").alias("avg_categories_per_product"))
    b = products_per_category(pc).agg(F.avg("num_products").alias("avg_products_per_category"))
    return a.unionByName(b, allowMissingColumns=True).agg(
        F.max("avg_categories_per_product").alias("avg_categories_per_product"),
        F.max("avg_products_per_category").alias("avg_products_per_category"))


def category_relations(pc: DataFrame) -> DataFrame:
    """A8 + A9 as (metric, value) rows - the relations report section."""
    m = metric_rows(multi_category_products(pc), [
        ("multi_category_products", F.col("multi_category_products")),
        ("multi_category_pct", F.col("multi_category_pct")),
    ])
    a = metric_rows(relation_averages(pc), [
        ("avg_categories_per_product", F.col("avg_categories_per_product")),
        ("avg_products_per_category", F.col("avg_products_per_category")),
    ])
    return m.unionByName(a)
