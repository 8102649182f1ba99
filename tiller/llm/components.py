"""Connected components of a links table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiller.llm.common import staged

#: Links (two numbers each) that one task works off sooner than a shuffle starts.
ONE_TASK = 100_000


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` of every id in ``links`` (a, b); ``component`` is the smallest id.

    Rounds of large stars and small stars: every node points its larger, then
    its smaller neighbours to the smallest one it knows, until nothing changes.
    A round is two aggregations; links never grow in number.  Each round's links
    are written to the shared folder, which keeps the plan short and survives
    lost executors.  The number of rounds grows with the logarithm of the size.
    Links counted at ``ONE_TASK`` or fewer need no shuffle.
    """
    edges = staged(links.where("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _print(edges)
    if before[0]["edges"] <= ONE_TASK:
        edges = edges.coalesce(1)
    while before[0]["edges"]:
        both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(
            F.col("b").alias("a"), F.col("a").alias("b")))))
        large = both.groupBy("a").agg(F.min("b").alias("low"))
        low = F.least("low", "a")
        # larger neighbours of a node go to the smallest node it knows
        starred = (both.join(large, "a").where("b > a").select(F.col("b").alias("a"), low.alias("b"))
                   .where("a != b").distinct())
        small = starred.groupBy("a").agg(F.min("b").alias("low"))
        joined = starred.join(small, "a")
        # smaller neighbours, and the node itself, go to the smallest of them
        edges = staged(joined.select(F.inline(F.array(
            F.struct(F.col("b").alias("a"), F.col("low").alias("b")),
            F.struct("a", F.col("low").alias("b"))))).where("a != b").distinct(), "links")
        after = _print(edges)
        if after[0]["edges"] <= ONE_TASK:
            edges = edges.coalesce(1)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _print(edges: DataFrame) -> list:
    """Number and checksum of the links."""
    return edges.agg(F.count(F.lit(1)).alias("edges"),
                     F.sum(F.xxhash64("a", "b").bitwiseAND((1 << 40) - 1))).collect()
