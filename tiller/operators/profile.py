"""Table profiling and data quality.

Every metric comes out of one aggregation pass per question, with partial
(map-side) aggregation; nothing loops over columns with separate jobs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiller.functions.columns import is_missing, share_pct
from tiller.operators._util import col, metric_rows


def schema_profile(df: DataFrame) -> DataFrame:
    """A1: one row per column - (ordinal, column_name, data_type, num_rows)."""
    described = [F.struct(F.lit(i).alias("ordinal"), F.lit(f.name).alias("column_name"),
                          F.lit(f.dataType.simpleString()).alias("data_type"))
                 for i, f in enumerate(df.schema.fields, start=1)]
    return (df.agg(F.count(F.lit(1)).alias("num_rows"))
            .select(F.inline(F.array(*described)), "num_rows"))


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A2: missing values per column in a single pass - (ordinal, column_name, nulls).

    Missing = NULL, NaN for floating columns, ``""`` for string columns.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    counts = df.agg(*[F.count_if(is_missing(f)).alias(f"c{i}") for i, f in enumerate(fields)])
    rows = [F.struct(F.lit(i + 1).alias("ordinal"), F.lit(f.name).alias("column_name"),
                     F.col(f"c{i}").alias("nulls")) for i, f in enumerate(fields)]
    return counts.select(F.inline(F.array(*rows)))


def row_fingerprint(df: DataFrame) -> list[Column]:
    """Columns that are equal for rows equal in every column, and for no others.

    Three 64-bit hashes of the values, from different seeds: 192 bits in all
    whatever the width of the row, so rows that collide in one hash or two are still
    told apart.  Hashes skip NULLs; which columns hold one is hashed as well, and
    nested values are hashed as JSON, which writes their NULLs.  Negative zeros
    count as zeros, as in ``groupBy``.
    """
    def cell(f):
        c = col(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            return (c + F.lit(0.0)).cast(f.dataType)
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            return F.to_json(c)
        return c

    cells = [cell(f) for f in df.schema.fields]
    gaps = F.concat_ws("", *[c.isNull().cast("int") for c in cells])
    return [F.xxhash64(F.lit(seed), gaps, *cells).alias(name)
            for seed, name in enumerate(("_high", "_low", "_check"))]


def row_groups(df: DataFrame, carry: Sequence[Column] = (),
                fingerprint: Sequence[Column] | None = None) -> DataFrame:
    """(_n, *carry): a row for each distinct row of ``df``, found by its fingerprint.

    What is shuffled are fingerprints, counts and the ``carry`` expressions, which
    are the same for all rows of a group and narrow; never the rows themselves.
    """
    prints = list(fingerprint) if fingerprint is not None else row_fingerprint(df)
    names = [f"_carry{i}" for i in range(len(carry))]
    rows = df.select(*[p.alias(n) for p, n in zip(prints, ("_high", "_low", "_check"))],
                     *[c.alias(n) for c, n in zip(carry, names)])
    return rows.groupBy("_high", "_low", "_check").agg(
        F.count(F.lit(1)).alias("_n"), *[F.max(n).alias(n) for n in names]).drop(
        "_high", "_low", "_check")


def _key_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("_n"))


def missing_cells(df: DataFrame) -> Column:
    """Missing values of a row."""
    return reduce(add, [is_missing(f).cast("bigint") for f in df.schema.fields])


def exact_duplicates(df: DataFrame) -> DataFrame:
    """A3: rows identical on every column.

    (num_rows, distinct_rows, duplicates, duplicate_pct); NULLs compare equal
    as in ``dropDuplicates``.
    """
    return duplicates_on(df, None)


def duplicates_on(df: DataFrame, keys: Sequence[str] | None) -> DataFrame:
    """A4: rows repeating a key (all columns, by fingerprint, when ``keys`` is None)."""
    g = row_groups(df) if keys is None else _key_groups(df, keys)
    return g.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("num_rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicates"),
    ).withColumn("duplicate_pct",
                 F.coalesce(share_pct("duplicates", "num_rows"), F.lit(0.0)))


def distinct_count(df: DataFrame, column: str, alias: str | None = None) -> DataFrame:
    """A5: distinct values of a column, NULL counted as one value."""
    c = col(column)
    return df.agg((F.count_distinct(c) + F.max(F.when(c.isNull(), 1).otherwise(0)))
                  .cast("bigint").alias(alias or f"distinct_{column}"))


def distinct_counts(df: DataFrame, columns: Sequence[str],
                    aliases: Sequence[str] | None = None) -> DataFrame:
    """A5 for several columns of one table in one aggregation (one scan;
    Spark expands the rows once per distinct column before the shuffle).
    NULL counts as one value, as in ``distinct().count()``."""
    aliases = list(aliases) if aliases is not None else [f"distinct_{c}" for c in columns]
    return df.agg(*[(F.count_distinct(col(c)) + F.max(F.when(col(c).isNull(), 1).otherwise(0)))
                    .cast("bigint").alias(a) for c, a in zip(columns, aliases)])


def repeated_keys(df: DataFrame, column: str) -> DataFrame:
    """(total_rows, unique_keys, repeated_keys) for one column."""
    g = df.groupBy(col(column)).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("total_rows"),
                 F.count(F.lit(1)).alias("unique_keys")) \
        .withColumn("repeated_keys", F.col("total_rows") - F.col("unique_keys"))


def orphans(facts: DataFrame, dim: DataFrame, fact_key: str, dim_key: str = "id") -> DataFrame:
    """Fact keys without a dimension row - (key, num_rows).

    The facts are first reduced to one row per key (partial aggregation, so
    a hot key never travels as raw rows); only then the left anti join runs,
    between two key-unique sides.  Spark broadcasts a side only when its
    measured size passes the threshold.
    """
    return _orphans_of(_rows_per_key(facts, fact_key), dim, fact_key, dim_key)


def _rows_per_key(facts: DataFrame, fact_key: str) -> DataFrame:
    return facts.groupBy(col(fact_key)).agg(F.count(F.lit(1)).alias("num_rows"))


def _orphans_of(per_key: DataFrame, dim: DataFrame, fact_key: str, dim_key: str) -> DataFrame:
    keys = dim.select(col(dim_key).alias("_k")).distinct()
    return per_key.join(keys, col(fact_key) == F.col("_k"), "left_anti")


def orphan_summary(facts: DataFrame, dim: DataFrame, fact_key: str,
                   dim_key: str = "id") -> DataFrame:
    """Referential integrity: (total_rows, orphan_rows, orphan_keys, integrity_pct).

    The facts are aggregated once per key; one left join to the distinct keys of
    the dimension and one conditional aggregate give all four.
    """
    keys = dim.select(col(dim_key).alias("_k")).distinct()
    joined = _rows_per_key(facts, fact_key).join(keys, col(fact_key) == F.col("_k"), "left")
    orphan = F.col("_k").isNull()
    out = joined.agg(
        F.coalesce(F.sum("num_rows"), F.lit(0)).cast("bigint").alias("total_rows"),
        F.coalesce(F.sum(F.when(orphan, F.col("num_rows"))), F.lit(0)).cast("bigint").alias("orphan_rows"),
        F.count_if(orphan).alias("orphan_keys"))
    return out.withColumn(
        "integrity_pct",
        F.coalesce(F.lit(100.0) - share_pct("orphan_rows", "total_rows"), F.lit(100.0)))


def table_summary(name: str, df: DataFrame) -> DataFrame:
    """A27 (catalogue): one row per table from a single grouped pass.

    (table_name, num_rows, num_columns, total_nulls, duplicates, duplicate_pct)
    """
    fields = df.schema.fields
    g = row_groups(df, [missing_cells(df)])
    return g.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("num_rows"),
        F.coalesce(F.sum(F.col("_n") * F.col("_carry0")), F.lit(0)).cast("bigint").alias("total_nulls"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicates"),
    ).select(
        F.lit(name).alias("table_name"), "num_rows",
        F.lit(len(fields)).cast("bigint").alias("num_columns"),
        "total_nulls", "duplicates",
        F.coalesce(share_pct("duplicates", "num_rows"), F.lit(0.0)).alias("duplicate_pct"))


def catalogue_summary(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table_summary`` of several tables, stacked."""
    frames = [table_summary(n, df) for n, df in tables.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def quality_scorecard(tx: DataFrame, keys: Sequence[str] = ("date", "customer_id"),
                      facts: DataFrame | None = None, dim: DataFrame | None = None,
                      fact_key: str = "code", dim_key: str = "id",
                      date_col: str = "date", period: tuple[str, str] | None = None) -> DataFrame:
    """Data-quality metrics as (metric, value) rows.

    nulls, completeness_pct, exact_duplicates(_pct), key_duplicates(_pct),
    dates_outside_pct (NULL dates, or dates outside ``period``) and, when a
    fact/dimension pair is given, integrity_pct.
    """
    fields = tx.schema.fields
    d = F.col(f"`{date_col}`")
    outside = d.isNull()
    if period is not None:
        outside = outside | (d < F.lit(period[0]).cast("date")) | (d > F.lit(period[1]).cast("date"))
    g = row_groups(tx, [missing_cells(tx), outside.cast("bigint"), *[col(k) for k in keys]])
    exact = g.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("_n") * F.col("_carry0")), F.lit(0)).alias("nulls"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("dups"),
        F.coalesce(F.sum(F.col("_n") * F.col("_carry1")), F.lit(0)).alias("outside"))
    cells = F.col("rows") * F.lit(len(fields))
    parts = [metric_rows(exact, [
        ("nulls", F.col("nulls")),
        ("completeness_pct", F.coalesce(F.lit(100.0) - share_pct("nulls", cells), F.lit(100.0))),
        ("exact_duplicates", F.col("dups")),
        ("exact_duplicates_pct", F.coalesce(share_pct("dups", "rows"), F.lit(0.0))),
        ("dates_outside_pct", F.coalesce(share_pct("outside", "rows"), F.lit(0.0))),
    ])]
    # Key duplicates re-aggregate the already grouped rows (the keys, a few narrow
    # columns, travel with them), so the table is read once for both checks.
    kd = (g.groupBy(*[f"_carry{i + 2}" for i in range(len(keys))]).agg(F.sum("_n").alias("_k"))
          .agg(F.coalesce(F.sum("_k"), F.lit(0)).alias("_rows"),
               F.coalesce(F.sum(F.col("_k") - 1), F.lit(0)).alias("duplicates"))
          .withColumn("duplicate_pct", F.coalesce(share_pct("duplicates", "_rows"), F.lit(0.0))))
    parts.append(metric_rows(kd, [("key_duplicates", F.col("duplicates")),
                                  ("key_duplicates_pct", F.col("duplicate_pct"))]))
    if facts is not None and dim is not None:
        integ = orphan_summary(facts, dim, fact_key, dim_key)
        parts.append(metric_rows(integ, [("integrity_pct", F.col("integrity_pct"))]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
