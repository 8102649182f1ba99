"""The report job: every section of the retail report as a DataFrame, and a
writer that stores each section as its own directory (S5-S8, A27).

The job persists the transaction table while the sections that share it run
(S8); the file list reads the files' metadata and rows again, and the catalogue
files are small and read by each of their sections.  Sections are written in
distributed formats (Parquet / JSON / CSV); nothing is collected.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiller.functions.columns import basket_size
from tiller.functions.labels import (
    FINE_COLUMNS,
    FORECAST_HORIZON,
    REPORT_DECIMALS,
    REPORT_DECIMALS_FINE,
    SUMMARY_SCOPE,
)
from tiller.operators import (
    baskets,
    catalogue,
    cohorts,
    customers,
    forecast,
    profile,
    rules,
    temporal,
)
from tiller.operators._util import combine_rows
from tiller.sources.sinks import write_document, write_sections

# Sections that the document repeats, in its order.
DOCUMENT_SECTIONS = ("schema", "nulls", "quality", "summary", "basket_statistics",
                     "units_sold", "top_products", "concentration", "monthly", "monthly_growth",
                     "weekday", "weekend_share", "stores", "store_gaps", "top_customer",
                     "purchase_frequency", "customer_segments", "new_customer_share",
                     "segment_rate", "days_between_purchases", "cohort_sizes", "retention",
                     "forecast_global", "forecast_stores", "association_rules", "source_files", "forecast_settings",
                     "catalogue_schema", "catalogue_nulls", "catalogue_summary", "product_keys",
                     "category_distribution", "head_tail_categories", "category_relations")


def report_rounded(df: DataFrame) -> DataFrame:
    """Round floating columns for presentation (S5-S7 only; operators return
    unrounded values): rule measures and retention rates to four decimals,
    every other floating column (shares, means, deviations, forecasts) to
    two.  Pivoted retention columns count as retention rates."""
    from pyspark.sql import types as T

    cols = []
    fine_all = "cohort_month" in df.columns and "retention_rate" not in df.columns
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            digits = REPORT_DECIMALS_FINE if (f.name in FINE_COLUMNS or fine_all) else REPORT_DECIMALS
            c = F.round(c, digits).alias(f.name)
        cols.append(c)
    return df.select(*cols)


def transaction_summary(tx: DataFrame, items: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """A27 (global): one row - scope, stores, transactions, customers, date_start,
    date_end, avg_basket_size, exact_duplicates, nulls, unique_products
    and, when ``files`` (``source_files`` output) is given, num_files; the
    names are a section of their own.

    Distinct counts treat NULL as a value, as ``distinct().count()`` does.
    The transactions are read once and shuffled as fingerprints with the few
    narrow values that the metrics ask for; baskets never leave their task.
    """
    size = basket_size("products").cast("bigint")
    g = profile.row_groups(tx, [profile.missing_cells(tx), size, F.col("store_id"),
                                F.col("customer_id"), F.col("date")])
    missing, size, store, customer, date = (F.col(f"_carry{i}") for i in range(5))
    n = F.col("_n")

    def distinct(c):
        return (F.count_distinct(c) + F.max(F.when(c.isNull(), 1).otherwise(0))).cast("bigint")

    main = g.agg(distinct(store).alias("stores"),
                 F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("transactions"),
                 distinct(customer).alias("customers"),
                 F.min(date).alias("date_start"), F.max(date).alias("date_end"),
                 F.try_divide(F.sum(size * n).cast("double"),
                              F.sum(F.when(size.isNotNull(), n)).cast("double"))
                 .alias("avg_basket_size"),
                 F.coalesce(F.sum(n - 1), F.lit(0)).cast("bigint").alias("exact_duplicates"),
                 F.coalesce(F.sum(n * missing), F.lit(0)).cast("bigint").alias("nulls"))
    prods = items.agg(F.count_distinct("item").alias("unique_products"))
    cols = ["stores", "transactions", "customers", "date_start", "date_end", "avg_basket_size",
            "exact_duplicates", "nulls", "unique_products"]
    parts = [main, prods]
    if files is not None:
        parts.append(files.agg(F.count(F.lit(1)).alias("num_files")))
        cols = ["num_files"] + cols
    return combine_rows(parts).select(F.lit(SUMMARY_SCOPE).alias("scope"), *cols)


def catalogue_sections(pc: DataFrame, cat: DataFrame,
                       paths: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Sections of the catalogue report: summary (with each table's source
    path when ``paths`` is given), distribution, relations."""
    summary = profile.catalogue_summary({"categories": cat, "product_category": pc})
    if paths:
        pairs = []
        for k, v in paths.items():
            pairs += [F.lit(k), F.lit(v)]
        summary = summary.withColumn("source_file", F.create_map(*pairs)[F.col("table_name")])
    nulls = None
    schema = None
    for name, df in (("categories", cat), ("product_category", pc)):
        n = profile.null_counts(df).select(F.lit(name).alias("table_name"), "*")
        s = profile.schema_profile(df).select(F.lit(name).alias("table_name"), "*")
        nulls = n if nulls is None else nulls.unionByName(n)
        schema = s if schema is None else schema.unionByName(s)
    return {
        "catalogue_schema": schema,
        "catalogue_nulls": nulls,
        "catalogue_summary": summary,
        "product_keys": combine_rows([
            profile.repeated_keys(pc, "code_pr"),
            profile.distinct_count(pc, "code", "unique_categories")]),
        "category_distribution": catalogue.category_distribution(pc, cat),
        "head_tail_categories": catalogue.head_tail_categories(pc, cat),
        "category_relations": catalogue.category_relations(pc),
    }


def transaction_sections(tx: DataFrame, items: DataFrame | None = None,
                         with_rules: bool = True, with_forecast: bool = True,
                         files: DataFrame | None = None) -> dict[str, DataFrame | None]:
    """Sections of the transaction report.

    ``items`` defaults to the exploded baskets of ``tx``.  Association rules
    fit a model (an action) and are optional.
    """
    items = items if items is not None else baskets.basket_items(tx)
    sec: dict[str, DataFrame | None] = {
        "schema": profile.schema_profile(tx),
        "nulls": profile.null_counts(tx),
        "quality": profile.quality_scorecard(tx),
        "summary": transaction_summary(tx, items, files),
        "basket_statistics": baskets.basket_statistics(tx),
        "units_sold": baskets.units_sold(items),
        "top_products": baskets.top_products(items),
        "concentration": baskets.concentration(items),
        "monthly": temporal.monthly_distribution(tx),
        "monthly_growth": temporal.monthly_growth(tx),
        "weekday": temporal.weekday_distribution(tx),
        "weekend_share": temporal.weekend_share(tx),
        "stores": temporal.store_distribution(tx),
        "store_gaps": temporal.store_gaps(tx),
        "top_customer": customers.top_customer(tx),
        "purchase_frequency": customers.purchase_frequency(tx),
        "customer_segments": customers.customer_segments(tx),
        "new_customer_share": customers.new_customer_share(tx),
        "segment_rate": customers.segment_rate(tx),
        "days_between_purchases": customers.inter_purchase_days(tx),
        "cohort_sizes": cohorts.cohort_sizes(tx),
        "retention": cohorts.retention(tx),
        "retention_matrix": cohorts.retention_matrix(tx),
    }
    if files is not None:
        sec["source_files"] = files
    if with_forecast:
        by_store = temporal.monthly_series(tx, by=("store_id",))
        sec["forecast_global"] = forecast.forecast(temporal.total_series(by_store))
        sec["forecast_stores"] = forecast.forecast(by_store, ("store_id",))
        sec["forecast_settings"] = tx.sparkSession.range(1).select(
            F.lit(FORECAST_HORIZON).alias("horizon_months"))
    if with_rules:
        sec["association_rules"] = rules.association_rules(rules.baskets_from_products(tx))
    return sec


def run_report(spark: SparkSession, transactions_dir: str | None, out_dir: str,
               categories_path: str | None = None, product_category_path: str | None = None,
               fmt: str = "parquet") -> list[str]:
    """Read the pipe-separated inputs, build every section and write them.

    Returns the names of the written sections.
    """
    from tiller.sources.readers import (
        read_categories,
        read_product_category,
        read_transactions,
        source_files,
    )

    written: list[str] = []
    small: dict[str, DataFrame] = {}
    root = out_dir.rstrip("/")

    def small_view(name: str, df: DataFrame) -> DataFrame:
        # sections are read back from what was just written, so the document
        # does not compute them again (FP-growth would mine again)
        reader = spark.read.schema(df.schema).option("header", fmt == "csv")
        return reader.format(fmt).load(f"{root}/{name}")

    if categories_path and product_category_path:
        cat = read_categories(spark, categories_path)
        pc = read_product_category(spark, product_category_path)
        paths = {"categories": categories_path, "product_category": product_category_path}
        sec = {k: report_rounded(v) for k, v in catalogue_sections(pc, cat, paths).items()}
        written += write_sections(sec, out_dir, fmt)
        small.update({k: small_view(k, v) for k, v in sec.items() if k in DOCUMENT_SECTIONS})
    if transactions_dir:
        tx = read_transactions(spark, transactions_dir).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            files = source_files(spark, transactions_dir)
            sec = {k: (report_rounded(v) if v is not None else None)
                   for k, v in transaction_sections(tx, files=files).items()}
            written += write_sections(sec, out_dir, fmt)
            small.update({k: small_view(k, v) for k, v in sec.items()
                          if k in DOCUMENT_SECTIONS and v is not None})
            if small:
                write_document(small, f"{root}/document")
                written.append("document")
        finally:
            tx.unpersist()
            rules.release()
    if small and "document" not in written:
        write_document(small, f"{root}/document")
        written.append("document")
    return written


def main(argv: list[str] | None = None) -> None:
    """Command line: ``python -m tiller.plans.report --transactions DIR --out DIR
    [--categories FILE --product-category FILE] [--format parquet|json|csv]``."""
    import argparse

    p = argparse.ArgumentParser(prog="tiller-report")
    p.add_argument("--transactions")
    p.add_argument("--categories")
    p.add_argument("--product-category")
    p.add_argument("--out", required=True)
    p.add_argument("--format", default="parquet", choices=["parquet", "json", "csv"])
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("tiller-report").getOrCreate()
    for name in run_report(spark, a.transactions, a.out, a.categories, a.product_category, a.format):
        print(name)


if __name__ == "__main__":
    main()
