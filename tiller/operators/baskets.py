"""Basket statistics, items and product concentration
(A10-A16, A31, P5, P8, W5).

Basket-size statistics are computed from a histogram (one row per distinct
size) built with one partially aggregated shuffle; quantiles, mode and
Tukey fences are then exact and read only that histogram, whose size is
bounded by the largest basket, never by the number of transactions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiller.functions.columns import basket_size, basket_tokens, share_pct
from tiller.functions.labels import CONCENTRATION_CUTS, QUANTILE_ACCURACY, TOP_PRODUCTS_K

QUARTILES = (0.25, 0.5, 0.75)
# Every token that casts to an integer has this form (a sign and blanks may surround it).
INTEGER_FORM = "^[^0-9A-Za-z]*[0-9]+[^0-9A-Za-z]*$"
# Ranges that spread products with the same number of units.
RANGES = 64


# --------------------------------------------------------------------------
# basket sizes
# --------------------------------------------------------------------------

def with_basket_size(tx: DataFrame, products: str = "products",
                     out: str = "basket_size") -> DataFrame:
    """Raw token count of each basket (empty tokens count, NULL stays NULL)."""
    return tx.withColumn(out, basket_size(products))


def size_histogram(tx: DataFrame, products: str = "products") -> DataFrame:
    """(basket_size, baskets) for every non-NULL basket size."""
    sized = tx.select(basket_size(products).alias("basket_size"))
    return (sized.where(F.col("basket_size").isNotNull())
            .groupBy("basket_size").agg(F.count(F.lit(1)).alias("baskets")))


def size_histogram_from_lines(lines: DataFrame, tx: str = "tx_id") -> DataFrame:
    """(basket_size, baskets) from exploded baskets (one row per line).

    Sizes are a partially aggregated count per transaction, so even a
    transaction holding a third of all lines costs one row per map task, and
    no basket is ever materialised as a string or list.
    """
    sizes = lines.groupBy(F.col(tx)).agg(F.count(F.lit(1)).cast("int").alias("basket_size"))
    return sizes.groupBy("basket_size").agg(F.count(F.lit(1)).alias("baskets"))


def _histogram(frame: DataFrame, products: str, lines: str | None) -> DataFrame:
    """The histogram of basket strings or, when ``lines`` names the transaction
    column, of exploded baskets."""
    return size_histogram_from_lines(frame, lines) if lines else size_histogram(frame, products)


def _histogram_stats(hist: DataFrame, probs: Sequence[float],
                     fences: tuple[int, int] | None = None) -> DataFrame:
    """Moments, exact quantiles (smallest value whose cumulative count
    reaches p*n), mode and - when ``fences`` names the indices of the
    lower/upper quartile in ``probs`` - Tukey fences and the outlier count.

    Everything reads the histogram only; its windows span at most one row
    per distinct basket size.
    """
    w = Window.orderBy("basket_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wall = Window.partitionBy()
    h = (hist.withColumn("_cum", F.sum("baskets").over(w))
         .withColumn("_n", F.sum("baskets").over(wall)))
    for i, p in enumerate(probs):
        h = h.withColumn(f"q{i}", F.min(F.when(F.col("_cum") >= F.lit(float(p)) * F.col("_n"),
                                               F.col("basket_size"))).over(wall))
    x = F.col("basket_size").cast("decimal(38,0)")
    c = F.col("baskets").cast("decimal(38,0)")
    aggs = [
        F.coalesce(F.sum("baskets"), F.lit(0)).cast("bigint").alias("baskets"),
        F.sum(x * c).alias("_s1"),
        F.sum(x * x * c).alias("_s2"),
        F.min("basket_size").alias("min_size"),
        F.max("basket_size").alias("max_size"),
        F.min(F.struct((-F.col("baskets")).alias("neg"), F.col("basket_size").alias("v")))
        .alias("_mode"),
    ] + [F.max(f"q{i}").alias(f"q{i}") for i in range(len(probs))]
    extra = []
    if fences is not None:
        lo_q, hi_q = (F.col(f"q{fences[0]}"), F.col(f"q{fences[1]}"))
        iqr = hi_q - lo_q
        lo = lo_q - F.lit(1.5) * iqr
        hi = hi_q + F.lit(1.5) * iqr
        aggs.append(F.coalesce(F.sum(F.when((F.col("basket_size") < lo) | (F.col("basket_size") > hi),
                                            F.col("baskets"))), F.lit(0))
                    .cast("bigint").alias("outliers"))
        extra = ["outliers"]
    out = h.agg(*aggs)
    n = F.col("baskets").cast("decimal(38,0)")
    var_num = n * F.col("_s2") - F.col("_s1") * F.col("_s1")
    var_den = n * (n - F.lit(1))
    return out.select(
        "baskets",
        F.try_divide(F.col("_s1").cast("double"), F.col("baskets").cast("double")).alias("mean_size"),
        F.when(F.col("baskets") > 1,
               F.sqrt(var_num.cast("double") / var_den.cast("double"))).alias("stddev_size"),
        "min_size", "max_size",
        F.col("_mode.v").alias("mode_size"),
        *[F.col(f"q{i}") for i in range(len(probs))],
        *extra,
    )


def _statistics_row(hist: DataFrame) -> DataFrame:
    st = _histogram_stats(hist, QUARTILES, fences=(0, 2))
    iqr = F.col("q2") - F.col("q0")
    return st.select(
        "baskets", "mean_size", "stddev_size", "min_size", "max_size", "mode_size",
        F.col("q0").alias("p25"), F.col("q1").alias("median"), F.col("q2").alias("p75"),
        iqr.alias("iqr"),
        (F.col("q0") - F.lit(1.5) * iqr).alias("lower_fence"),
        (F.col("q2") + F.lit(1.5) * iqr).alias("upper_fence"),
        "outliers")


def basket_statistics(tx: DataFrame, products: str = "products") -> DataFrame:
    """A10-A13 + P8 in one row.

    (baskets, mean_size, stddev_size, min_size, max_size, mode_size, p25,
    median, p75, iqr, lower_fence, upper_fence, outliers)

    NULL baskets are ignored.  Quantiles are exact (``percentile_disc``
    semantics); ``basket_quantiles_approx`` gives the sketch-based variant.
    """
    return _statistics_row(size_histogram(tx, products))


def basket_statistics_from_lines(lines: DataFrame, tx: str = "tx_id") -> DataFrame:
    """``basket_statistics`` for baskets given as lines (tx_id, item): the
    same row, computed from ``size_histogram_from_lines``."""
    return _statistics_row(size_histogram_from_lines(lines, tx))


def basket_summary(tx: DataFrame, products: str = "products",
                   lines: str | None = None) -> DataFrame:
    """A10: (baskets, mean_size, stddev_size, min_size, max_size)."""
    st = _histogram_stats(_histogram(tx, products, lines), ())
    return st.select("baskets", "mean_size", "stddev_size", "min_size", "max_size")


def basket_quantiles(tx: DataFrame, probs: Sequence[float] = QUARTILES,
                     products: str = "products", lines: str | None = None) -> DataFrame:
    """A11 (exact): one row (p, value) per probability."""
    st = _histogram_stats(_histogram(tx, products, lines), probs)
    rows = [F.struct(F.lit(float(p)).alias("p"), F.col(f"q{i}").alias("value"))
            for i, p in enumerate(probs)]
    return st.select(F.inline(F.array(*rows)))


def basket_quantiles_approx(tx: DataFrame, probs: Sequence[float] = QUARTILES,
                            accuracy: int = QUANTILE_ACCURACY,
                            products: str = "products", lines: str | None = None) -> DataFrame:
    """A11 as in the original analysis: ``percentile_approx`` sketch."""
    sizes = (tx.groupBy(lines).agg(F.count(F.lit(1)).cast("int").alias("basket_size")) if lines
             else with_basket_size(tx, products))
    q = F.percentile_approx(F.col("basket_size"), [float(p) for p in probs], accuracy)
    st = sizes.agg(q.alias("_q"))
    rows = [F.struct(F.lit(float(p)).alias("p"), F.col("_q")[i].alias("value"))
            for i, p in enumerate(probs)]
    return st.select(F.inline(F.array(*rows)))


def basket_mode(tx: DataFrame, products: str = "products", lines: str | None = None) -> DataFrame:
    """Most frequent basket size (ties: smallest size) and its count."""
    hist = _histogram(tx, products, lines)
    m = hist.agg(F.min(F.struct((-F.col("baskets")).alias("neg"),
                                F.col("basket_size").alias("v"))).alias("m"))
    return m.select(F.col("m.v").alias("mode_size"), (-F.col("m.neg")).alias("baskets"))


def basket_outliers(tx: DataFrame, products: str = "products",
                    lines: str | None = None) -> DataFrame:
    """A12 + P8: (p25, p75, iqr, lower_fence, upper_fence, outliers)."""
    return _statistics_row(_histogram(tx, products, lines)).select(
        "p25", "p75", "iqr", "lower_fence", "upper_fence", "outliers")


# --------------------------------------------------------------------------
# items
# --------------------------------------------------------------------------

def basket_items(tx: DataFrame, products: str = "products",
                 keep: Sequence[str] = ()) -> DataFrame:
    """P5: explode baskets into one row per item; non-integer tokens (empty
    strings from double spaces, junk) are dropped.  (*keep, item)

    A failed cast costs an error each, so only tokens that can be integers -
    digits without a letter or another digit group beside them - are cast at all.
    """
    tok = F.explode(basket_tokens(products)).alias("_tok")
    item = F.when(F.col("_tok").rlike(INTEGER_FORM), F.col("_tok").try_cast("bigint"))
    return (tx.select(*keep, tok).where(F.col("_tok").rlike(INTEGER_FORM))
            .select(*keep, item.alias("item")).where(F.col("item").isNotNull()))


def units_sold(items: DataFrame, item: str = "item") -> DataFrame:
    """A15 (+ A5 for items): (units, distinct_items)."""
    return items.agg(F.count(F.col(item)).alias("units"),
                     F.count_distinct(F.col(item)).alias("distinct_items"))


def item_counts(items: DataFrame, item: str = "item") -> DataFrame:
    """(item, units) - one row per product, partial aggregation first."""
    return items.groupBy(F.col(item).alias("item")).agg(F.count(F.lit(1)).alias("units"))


def _with_total(top: DataFrame, counts: DataFrame) -> DataFrame:
    """Attach the grand total of ``counts.units`` to the (small) ``top``
    frame: the total row joins the union and is spread by a window."""
    tot = counts.agg(F.sum("units").alias("_total")).withColumn("_is_total", F.lit(True))
    u = top.withColumn("_is_total", F.lit(False)).unionByName(tot, allowMissingColumns=True)
    return (u.withColumn("_total", F.max("_total").over(Window.partitionBy()))
            .where(~F.col("_is_total")).drop("_is_total"))


def top_products(items: DataFrame, k: int = TOP_PRODUCTS_K, item: str = "item") -> DataFrame:
    """The ``k`` best-selling items with their share of all units and
    the cumulative share down the list.

    (rank, item, units, pct, cum_pct); ties by item ascending.  The limit is
    the feature (a top-k report) and runs as a TakeOrderedAndProject; the
    rank and running sum are windows over those k rows only.
    """
    counts = item_counts(items, item)
    top = counts.orderBy(F.desc("units"), F.asc("item")).limit(k)
    return ranked_shares(top, counts)


def ranked_shares(top: DataFrame, counts: DataFrame) -> DataFrame:
    """(rank, item, units, pct, cum_pct) of the few rows of ``top``, of all of ``counts.units``."""
    top = _with_total(top, counts)
    w = Window.orderBy(F.desc("units"), F.asc("item"))
    ranked = (top.withColumn("rank", F.row_number().over(w))
              .withColumn("_cum", F.sum("units").over(
                  w.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    return ranked.select("rank", "item", "units", share_pct("units", "_total").alias("pct"),
                         share_pct("_cum", "_total").alias("cum_pct"))


def pareto_products(items: DataFrame, item: str = "item") -> DataFrame:
    """Every product with its rank, share and cumulative share.

    (rank, item, units, pct, cum_pct).  One row per product after aggregation;
    the running sum adds prefix sums of three levels, all in the JVM:

    1. products with the same units - one row per distinct number, of which
       there are at most about the square root of twice the lines;
    2. within those, ranges of items between ``RANGES`` quantiles, so that a tie
       of most products is spread;
    3. within a range, a row number in item order.

    Products of one group have equal units, so a sum is units times a rank.
    """
    counts = item_counts(items, item)
    kind = counts.schema["item"].dataType
    if isinstance(kind, T.NumericType):
        # one row: the quantiles, read where they are needed
        edges = counts.agg(F.percentile_approx(
            "item", [i / RANGES for i in range(1, RANGES)], 10 * RANGES).alias("e")).scalar()
        part = sum(((edges[i] < F.col("item")).cast("int") for i in range(RANGES - 1)), F.lit(0))
    else:
        part = F.substring(F.col("item").cast("string"), 1, 2)
    parted = counts.withColumn("_part", F.when(F.col("item").isNotNull(), part))
    by_part = parted.groupBy("units", "_part").agg(F.count(F.lit(1)).alias("_n"))
    by_units = by_part.groupBy("units").agg(F.sum("_n").alias("_n"))
    w = Window.orderBy(F.desc("units"))
    above = by_units.select(
        "units", (F.sum("_n").over(w) - F.col("_n")).alias("_items_above"),
        (F.sum(F.col("_n") * F.col("units")).over(w) - F.col("_n") * F.col("units")).alias("_sum_above"),
        F.sum(F.col("_n") * F.col("units")).over(Window.partitionBy()).alias("_total"))
    w = Window.partitionBy("units").orderBy("_part")
    before = by_part.select("units", "_part", (F.sum("_n").over(w) - F.col("_n")).alias("_before"))
    w = Window.partitionBy("units", "_part").orderBy("item")
    rows = (parted.withColumn("_nth", F.row_number().over(w)).alias("r")
            .join(before.alias("b"), (F.col("r.units") == F.col("b.units"))
                  & F.col("r._part").eqNullSafe(F.col("b._part")))
            .select("r.item", "r.units", (F.col("_before") + F.col("_nth")).alias("_in"))
            .join(above, "units"))
    return rows.select(
        (F.col("_items_above") + F.col("_in")).cast("bigint").alias("rank"), "item", "units",
        share_pct("units", "_total").alias("pct"),
        share_pct(F.col("_sum_above") + F.col("units") * F.col("_in"), F.col("_total"))
        .alias("cum_pct"))


def concentration(items: DataFrame, cuts: Sequence[int] = CONCENTRATION_CUTS,
                  item: str = "item") -> DataFrame:
    """Share of all units sold by the top-N products, for each N.

    (top_n, units, pct).  Only the ``max(cuts)`` best rows are ever sorted.
    """
    counts = item_counts(items, item)
    kmax = max(cuts)
    top = counts.orderBy(F.desc("units"), F.asc("item")).limit(kmax)
    top = _with_total(top, counts)
    w = Window.orderBy(F.desc("units"), F.asc("item"))
    top = (top.withColumn("_r", F.row_number().over(w))
           .withColumn("_cum", F.sum("units").over(w.rowsBetween(Window.unboundedPreceding,
                                                                 Window.currentRow))))
    top = top.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy()))
    # every cut-off reads the same (at most max(cuts)) ranked rows
    cut = F.explode(F.array(*[F.lit(int(n)) for n in cuts])).alias("top_n")
    return (top.select("*", cut)
            .where(F.col("_r") == F.least(F.col("top_n"), F.col("_rows")))
            .select("top_n", F.col("_cum").alias("units"),
                    share_pct("_cum", "_total").alias("pct")))


# --------------------------------------------------------------------------
# text tokens
# --------------------------------------------------------------------------

def token_counts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """split / size parity on free text: (key, raw_tokens, nonempty_tokens).

    ``raw_tokens`` keeps the empty strings produced by repeated spaces, as a
    basket's raw size does; ``nonempty_tokens`` drops them.  Whole texts.
    """
    tok = basket_tokens(text)
    present = F.col(text).isNotNull()
    return docs.select(
        F.col(key), F.when(present, F.size(tok)).alias("raw_tokens"),
        F.when(present, F.size(F.filter(tok, lambda t: t != F.lit("")))).alias("nonempty_tokens"))
