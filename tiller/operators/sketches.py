"""Mergeable summaries: quantile (A11) and distinct-count (A5) sketches.

A sketch is a few kilobytes, whatever it stands for.  Kept per month and store, the
sketches of old files merge with those of new ones, and any range of months is
answered from them without reading the rows again.  Building one is a partially
aggregated ``groupBy``: a key with a third of all rows sends one sketch per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiller.functions.columns import month_start
from tiller.operators._util import col

#: Size of a quantile sketch.
KLL_K = 800
#: Size of a distinct-count sketch: 2^12 registers.
HLL_LG_K = 12


def quantile_error(k: int = KLL_K) -> float:
    """Largest rank error to expect of a quantile sketch, as a share of the rows.

    Three times the published 99 % error of one quantile (2.296 / k^0.9021).
    """
    return 3 * 2.296 / k ** 0.9021


def distinct_error(lg_k: int = HLL_LG_K) -> float:
    """Largest relative error to expect of a distinct count: five standard errors."""
    return 5 * 1.04 / 2 ** (lg_k / 2)


def quantile_sketches(df: DataFrame, by: Sequence[str], value: str, k: int = KLL_K) -> DataFrame:
    """(*by, sketch): a quantile sketch of the integer column ``value`` per group.

    NULL values are ignored; a NULL key is a group of its own.
    """
    return df.where(col(value).isNotNull()).groupBy(*[col(b) for b in by]).agg(
        F.expr(f"kll_sketch_agg_bigint(CAST(`{value}` AS BIGINT), {k})").alias("sketch"))


def merge_quantiles(sketches: DataFrame, by: Sequence[str] = (), k: int = KLL_K) -> DataFrame:
    """(*by, sketch): sketches of finer groups, old or new, merged."""
    return sketches.groupBy(*[col(b) for b in by]).agg(
        F.expr(f"kll_merge_agg_bigint(sketch, {k})").alias("sketch"))


def read_quantiles(sketches: DataFrame, by: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(*by, p, estimate, rows): quantiles read from sketches."""
    # a quantile's rank must be a literal, so each has an expression of its own
    read = F.explode(F.array(*[F.struct(
        F.lit(float(p)).alias("p"),
        F.expr(f"kll_sketch_get_quantile_bigint(sketch, {float(p)!r}D)").alias("estimate"))
        for p in probs])).alias("_read")
    keys = [col(b) for b in by]
    return sketches.select(*keys, "sketch", read).select(
        *keys, "_read.p", "_read.estimate", F.expr("kll_sketch_get_n_bigint(sketch)").alias("rows"))


def quantile_check(df: DataFrame, estimates: DataFrame, by: Sequence[str], value: str,
                   error: float) -> DataFrame:
    """(*by, p, rows, exact_value, within_bound): estimates held against exact ranks.

    A value's ranks run from the share of smaller values to that of values not
    larger; an estimate is within the bound if ``p`` is no further than ``error``
    from them.  The exact side is a histogram, one row for each distinct value.
    ``by`` holds the key on which both sides are joined, one column at least.
    """
    if not by:
        raise ValueError("no key to join the estimates on")
    keys = [f"_by{i}" for i in range(len(by))]
    hist = (df.where(col(value).isNotNull())
            .groupBy(*[col(b).alias(n) for b, n in zip(by, keys)], col(value).alias("_value"))
            .agg(F.count(F.lit(1)).alias("_n")))
    rising = Window.partitionBy(*keys).orderBy("_value").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    hist = (hist.withColumn("_upto", F.sum("_n").over(rising))
            .withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys))))
    same = [col(b).eqNullSafe(F.col(n)) for b, n in zip(by, keys)]
    joined = estimates.join(hist, same)
    need = F.greatest(F.ceil(F.col("p") * F.col("_total")), F.lit(1))
    below = F.max(F.when(F.col("_value") < F.col("estimate"), F.col("_upto")))
    upto = F.max(F.when(F.col("_value") <= F.col("estimate"), F.col("_upto")))
    out = joined.groupBy(*[col(b) for b in by], "p").agg(
        F.max("_total").alias("rows"),
        F.min(F.when(F.col("_upto") >= need, F.col("_value"))).alias("exact_value"),
        F.coalesce(below, F.lit(0)).alias("_below"), F.coalesce(upto, F.lit(0)).alias("_at"))
    near = ((F.col("p") >= F.col("_below") / F.col("rows") - error)
            & (F.col("p") <= F.col("_at") / F.col("rows") + error))
    return out.select(*[col(b) for b in by], "p", "rows", "exact_value", near.alias("within_bound"))


def monthly_distinct_sketches(tx: DataFrame, column: str = "customer_id", date: str = "date",
                              lg_k: int = HLL_LG_K) -> DataFrame:
    """(month, sketch): a sketch of a column's distinct values per month.

    Rows without a date or a value are in no sketch.
    """
    return tx.where(col(date).isNotNull() & col(column).isNotNull()).groupBy(
        month_start(date).alias("month")).agg(F.hll_sketch_agg(col(column), lg_k).alias("sketch"))


def distinct_between(sketches: DataFrame, first: str, last: str) -> DataFrame:
    """(estimate): distinct values of the months ``first`` to ``last``, from sketches alone."""
    inside = F.col("month").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return sketches.where(inside).agg(
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).alias("estimate"))


def distinct_by_year(sketches: DataFrame) -> DataFrame:
    """(year, estimate): the months of a year merged."""
    return sketches.groupBy(F.year("month").alias("year")).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def distinct_check(tx: DataFrame, estimates: DataFrame, column: str = "customer_id",
                   date: str = "date", error: float | None = None) -> DataFrame:
    """(year, exact, within_bound): yearly estimates next to exact distinct counts."""
    error = distinct_error() if error is None else error
    exact = (tx.where(col(date).isNotNull() & col(column).isNotNull())
             .select(F.year(col(date)).alias("year"), col(column).alias("_value")).distinct()
             .groupBy("year").agg(F.count(F.lit(1)).alias("exact")))
    return exact.join(estimates, "year").select(
        "year", "exact",
        (F.abs(F.col("estimate") - F.col("exact")) <= F.col("exact") * error).alias("within_bound"))
