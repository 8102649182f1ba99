"""A month-partitioned copy of the transaction files, kept up to date file by file.

``data`` holds the typed rows by month, ``manifest`` which source files are in it.
An update parses only files that are new or changed, and rewrites only the months
they have rows in; an update that broke off is repeated with the same result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiller.functions.columns import month_start
from tiller.sources.readers import (
    RAW_TRANSACTIONS_SCHEMA,
    TRANSACTION_FILE_GLOB,
    _csv,
    typed_transactions,
)

STORE_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()), T.StructField("store_id", T.LongType()),
    T.StructField("customer_id", T.LongType()), T.StructField("products", T.StringType()),
    T.StructField("source_file", T.StringType()), T.StructField("month", T.DateType())])
MANIFEST_SCHEMA = T.StructType([
    T.StructField("file_name", T.StringType()), T.StructField("file_size", T.LongType()),
    T.StructField("file_modification_time", T.TimestampType())])


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    fs, target = _path(spark, path)
    return spark.read.schema(schema).parquet(path) if fs.exists(target) else \
        spark.createDataFrame([], schema)


def manifest(spark: SparkSession, store: str) -> DataFrame:
    """(file_name, file_size, file_modification_time) of the files in the store."""
    return _read(spark, f"{store}/manifest", MANIFEST_SCHEMA)


def read_store(spark: SparkSession, store: str, first: str | None = None,
               last: str | None = None) -> DataFrame:
    """(date, store_id, customer_id, products, source_file, month) of the store.

    With ``first`` and ``last`` the rows of those days alone, and only the
    partitions of their months are read.  Rows without a date are in the NULL month.
    """
    rows = _read(spark, f"{store}/data", STORE_SCHEMA)
    for day, above in ((first, True), (last, False)):
        if day is not None:
            start = F.trunc(F.lit(day).cast("date"), "month")
            rows = rows.where((F.col("month") >= start) & (F.col("date") >= F.lit(day).cast("date"))
                              if above else
                              (F.col("month") <= start) & (F.col("date") <= F.lit(day).cast("date")))
    return rows


def changed_files(spark: SparkSession, directory: str, store: str) -> DataFrame:
    """The directory's transaction files that the manifest does not hold as they are now.

    Only the listing is read, not the files.
    """
    names = [f"_metadata.{f.name}" for f in MANIFEST_SCHEMA.fields]
    files = (spark.read.format("binaryFile").option("pathGlobFilter", TRANSACTION_FILE_GLOB)
             .load(directory).select(*names))
    return files.join(manifest(spark, store), MANIFEST_SCHEMA.fieldNames(), "left_anti")


def update_store(spark: SparkSession, directory: str, store: str) -> list[str]:
    """Bring new and changed files into the store; returns their names, sorted.

    A changed file replaces its former rows.  Files that are gone from the directory
    stay in the store.  What reaches the driver are names of files and months.  One
    update at a time: two at once would overwrite each other's months.
    """
    files = changed_files(spark, directory, store).collect()
    if not files:
        return []
    names = sorted(f["file_name"] for f in files)
    staging = f"{store}/incoming-{uuid.uuid4().hex}"
    raw = _csv(spark, RAW_TRANSACTIONS_SCHEMA, header=False).csv(
        [f"{directory.rstrip('/')}/{n}" for n in names])
    source = raw.select("*", F.col("_metadata.file_name").alias("source_file"))
    typed = typed_transactions(source, "source_file")
    typed.withColumn("month", month_start("date")).write.parquet(staging)
    new = spark.read.schema(STORE_SCHEMA).parquet(staging)
    held = _read(spark, f"{store}/data", STORE_SCHEMA)
    replaced = F.col("source_file").isin(names)
    # only files that were in the store before can have rows to replace
    known = manifest(spark, store).where(F.col("file_name").isin(names)).limit(1).count()
    # an update that breaks off leaves the files marked: not as they are, but known
    _record(spark, store, names, [(n, None, None) for n in names])
    present = {r["month"] for r in new.select("month").distinct().collect()}
    broken = held.where(replaced) if known else held.limit(0)
    months = present | {r["month"] for r in broken.select("month").distinct().collect()}
    inside = F.col("month").isin([m for m in months if m is not None])
    inside = inside | F.col("month").isNull() if None in months else inside
    rest = held.where(inside).where(~replaced)
    (rest.unionByName(new).hint("rebalance", "month").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(f"{store}/data"))
    _drop_empty(spark, store, names, months - present)
    _record(spark, store, names, files)
    fs, target = _path(spark, staging)
    fs.delete(target, True)
    return names


def _record(spark: SparkSession, store: str, names: list[str], files: list) -> None:
    """Write the manifest anew, with ``files`` in place of the rows of ``names``."""
    old = manifest(spark, store).where(~F.col("file_name").isin(names))
    path = f"{store}/manifest-{uuid.uuid4().hex}"
    old.unionByName(spark.createDataFrame(files, MANIFEST_SCHEMA)).coalesce(1).write.parquet(path)
    fs, target = _path(spark, f"{store}/manifest")
    fs.delete(target, True)
    fs.rename(_path(spark, path)[1], target)


def _drop_empty(spark: SparkSession, store: str, names: list[str], months: set) -> None:
    """Remove months that held rows of the replaced files alone; an overwrite leaves them."""
    for month in months:
        same = F.col("month").eqNullSafe(F.lit(month).cast("date"))
        left = _read(spark, f"{store}/data", STORE_SCHEMA).where(same)
        if not left.where(~F.col("source_file").isin(names)).limit(1).count():
            name = "__HIVE_DEFAULT_PARTITION__" if month is None else month.isoformat()
            fs, target = _path(spark, f"{store}/data/month={name}")
            fs.delete(target, True)
