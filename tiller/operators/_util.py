"""Small DataFrame idioms shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def combine_rows(frames: Sequence[DataFrame]) -> DataFrame:
    """Merge several one-row aggregates into one row without a join.

    The frames (disjoint column sets) are stacked with ``unionByName`` and
    collapsed with ``max``; each column has one non-NULL value.  An empty
    input frame contributes NULLs.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(F.col(f"`{c}`")).alias(c) for c in stacked.columns])


def metric_rows(row: DataFrame, metrics: Sequence[tuple[str, Column]],
                name_col: str = "metric", value_col: str = "value") -> DataFrame:
    """Unpivot expressions over a (one-row) frame into (metric, value) rows."""
    structs = [F.struct(F.lit(m).alias(name_col), e.cast("double").alias(value_col))
               for m, e in metrics]
    return row.select(F.inline(F.array(*structs)))


def col(name: str) -> Column:
    """Column by name, quoting dots."""
    return F.col(f"`{name}`")
