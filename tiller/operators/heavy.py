"""Heavy hitters (A16, A31): the best-selling items without shuffling every item.

Each task keeps a bounded table of counters over its rows: when it overflows, the
same amount is taken off every counter and those at zero go.  What was taken off is
the task's error, so an item's true count lies between its summed counters and that
plus all errors.  A second pass counts the items that the bounds leave in question,
and those alone; the result is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiller.functions.labels import TOP_PRODUCTS_K
from tiller.operators import baskets
from tiller.operators._util import col

#: Counters that a task sends on.
COUNTERS = 1 << 14


def count_table(items: DataFrame, item: str = "item", counters: int = COUNTERS) -> DataFrame:
    """(item, units, error): each task's counters, and a row with the task's error.

    Tables of different files can be stacked: sums of ``units`` are lower bounds of
    the counts, and the sum of ``error`` is what they can lack at most.  The error
    stands in a row of its own with NULL ``units``; a NULL item is counted like
    any other.
    """
    def tables(batches):
        import numpy as np
        import pyarrow as pa

        held, taken = {}, 0
        kind = pa.null()

        def cut():
            nonlocal held, taken
            if len(held) > counters:
                values = np.fromiter(held.values(), np.int64, len(held))
                off = int(np.partition(values, len(values) - counters - 1)[len(values) - counters - 1])
                held = {k: v - off for k, v in held.items() if v > off}
                taken += off

        for batch in batches:
            kind = batch.column(0).type
            for row in batch.column(0).value_counts().to_pylist():
                held[row["values"]] = held.get(row["values"], 0) + row["counts"]
            if len(held) > 2 * counters:
                cut()
        cut()
        if held or taken:
            keys = [*held, None]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, kind), pa.array([*held.values(), None], pa.int64()),
                 pa.array([None] * len(held) + [taken], pa.int64())], ["item", "units", "error"])

    rows = items.select(col(item).alias("item"))
    kind = rows.schema["item"].dataType.simpleString()
    return rows.mapInArrow(tables, f"item {kind}, units bigint, error bigint")


def bounds(table: DataFrame, k: int) -> tuple[int, int]:
    """(error, least): what all counters lack at most, and the k-th largest lower bound.

    ``least`` is 0 if fewer than ``k`` items have counters.  One job; ``k`` numbers
    reach the driver.
    """
    lower = _lower(table).orderBy(F.desc("units")).limit(k)
    row = (lower.agg(F.min("units").alias("least"), F.count(F.lit(1)).alias("n"))
           .withColumn("error", F.lit(None).cast("bigint"))
           .unionByName(table.agg(F.sum("error").alias("error")), allowMissingColumns=True)
           .agg(*[F.max(c).alias(c) for c in ("least", "n", "error")]).first())
    return row["error"] or 0, row["least"] if row["n"] == k else 0


def _lower(table: DataFrame) -> DataFrame:
    return table.where("units is not null").groupBy("item").agg(F.sum("units").alias("units"))


def top_items(items: DataFrame, k: int = TOP_PRODUCTS_K, item: str = "item",
              counters: int = COUNTERS) -> DataFrame:
    """(item, units) of the ``k`` best-selling items, exact; ties by item ascending.

    Items in question are those whose upper bound reaches the k-th lower bound.
    Where that bound does not rise above the error - nearly all items sell alike - an
    item without a counter may be among the best, and all items are counted instead.
    Runs one job while the plan is built, for the bounds; whether the candidates are
    broadcast is left to adaptive execution, which measures them.
    """
    table = count_table(items, item, counters)
    error, least = bounds(table, k)
    rows = items.select(col(item).alias("item"))
    if not error:
        counts = _lower(table)  # no counter was ever cut: the sums are the counts
    elif least <= error:
        counts = baskets.item_counts(rows)
    else:
        wanted = _lower(table).where(F.col("units") + F.lit(error) >= F.lit(least)).select(
            F.col("item").alias("_item"))
        counts = baskets.item_counts(
            rows.join(wanted, F.col("item").eqNullSafe(F.col("_item")), "left_semi"))
    return counts.orderBy(F.desc("units"), F.asc("item")).limit(k)


def top_products(items: DataFrame, k: int = TOP_PRODUCTS_K, item: str = "item",
                 counters: int = COUNTERS) -> DataFrame:
    """``baskets.top_products`` from heavy hitters: the same rows.

    The total is a count of the lines, which shuffles one number per task.
    """
    total = items.agg(F.count(F.lit(1)).alias("units"))
    return baskets.ranked_shares(top_items(items, k, item, counters), total)
