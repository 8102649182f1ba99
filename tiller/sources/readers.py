"""Readers for the pipe-separated retail inputs.

Every source has an explicit schema: no inference pass over the data, stable
types, and CSV scans that prune unused columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATEGORIES_SCHEMA = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("category_name", T.StringType()),
])

PRODUCT_CATEGORY_SCHEMA = T.StructType([
    T.StructField("code_pr", T.IntegerType()),
    T.StructField("code", T.IntegerType()),
])

# Transactions are read as text and typed afterwards (``typed_transactions``)
# so that a malformed value becomes NULL instead of failing the scan.
RAW_TRANSACTIONS_SCHEMA = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("store_id", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("products", T.StringType()),
])

TRANSACTIONS_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("store_id", T.LongType()),
    T.StructField("customer_id", T.LongType()),
    T.StructField("products", T.StringType()),
])

# Header names of the catalogue files, in the order of the schemas (fixed
# values of the input).
CATEGORIES_HEADER = ("id", "category_name")
PRODUCT_CATEGORY_HEADER = ("v.code_pr", "v.code")

TRANSACTION_FILE_GLOB = "*_Tran.csv"


def _csv(spark: SparkSession, schema: T.StructType, header: bool):
    return (spark.read.schema(schema)
            .option("sep", "|")
            .option("header", header)
            .option("mode", "PERMISSIVE"))


def read_catalogue(spark: SparkSession, path: str,
                   schema: T.StructType = CATEGORIES_SCHEMA,
                   header: tuple[str, ...] = CATEGORIES_HEADER) -> DataFrame:
    """S1 + P1 + P2: a pipe-separated catalogue file with a header line.

    Columns are matched by the file's own names, then renamed to ``schema``'s;
    a header with other names or another order is an error, as is a missing
    file.  No back-ticks are needed downstream.
    """
    named = T.StructType([T.StructField(h, f.dataType)
                          for h, f in zip(header, schema.fields, strict=True)])
    return (_csv(spark, named, header=True).option("enforceSchema", False)
            .csv(path).toDF(*schema.fieldNames()))


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    return read_catalogue(spark, path, CATEGORIES_SCHEMA, CATEGORIES_HEADER)


def read_product_category(spark: SparkSession, path: str) -> DataFrame:
    return read_catalogue(spark, path, PRODUCT_CATEGORY_SCHEMA, PRODUCT_CATEGORY_HEADER)


def read_transactions_raw(spark: SparkSession, directory: str) -> DataFrame:
    """S2 (untyped): every ``*_Tran.csv`` file of a directory as one table.

    Files not matching the glob are ignored.  A directory without matching
    files yields zero rows of the same schema (S4); a missing one is an error.
    """
    return (_csv(spark, RAW_TRANSACTIONS_SCHEMA, header=False)
            .option("pathGlobFilter", TRANSACTION_FILE_GLOB)
            .csv(directory))


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """The raw columns of transaction lines that are already a text column."""
    row = F.from_csv(F.col(value), RAW_TRANSACTIONS_SCHEMA.simpleString()[7:-1].replace(":", " "),
                     {"sep": "|", "mode": "PERMISSIVE"})
    return lines.select(row.alias("r")).select("r.*")


def typed_transactions(raw: DataFrame, *keep: str) -> DataFrame:
    """Typed projection of the raw transaction columns, and those of ``keep``.

    Unparsable dates and ids become NULL (counted later as missing); ids are
    BIGINT so that identifiers beyond the INT range survive at scale.
    """
    return raw.select(
        F.try_to_date(F.col("date"), "yyyy-MM-dd").alias("date"),
        F.col("store_id").try_cast("bigint").alias("store_id"),
        F.col("customer_id").try_cast("bigint").alias("customer_id"),
        F.col("products"),
        *keep,
    )


def read_transactions(spark: SparkSession, directory: str) -> DataFrame:
    """S2 + P3: typed transactions (date, store_id, customer_id, products)."""
    return typed_transactions(read_transactions_raw(spark, directory))


def source_files(spark: SparkSession, directory: str) -> DataFrame:
    """S3: which files fed the transaction table and how many rows each."""
    names = read_transactions_raw(spark, directory).select(
        F.col("_metadata.file_name").alias("file_name"))
    return names.groupBy("file_name").agg(F.count(F.lit(1)).alias("rows"))
