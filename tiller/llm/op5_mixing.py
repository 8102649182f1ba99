"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents that belong to the same set of sources form a pattern.  The network is
small (source -> pattern -> sink): a pattern offers its tokens once at cost 1,
a second time at cost 3, and so on, marginal costs rising with each repetition;
each source demands its quota.  Only the patterns' token sums reach the driver,
never documents.  The flow says how many tokens of a pattern serve each source;
documents are then picked by a seeded hash up to that amount, by a histogram of
the hash that is refined twice, so no sort holds a whole source.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiller.llm.common import staged

#: Fixed values of the contract: weights of the sources in order, and the share.
WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_REPEATS = 2
#: Patterns and sources the driver takes; more is an error, never a cut.
MOST_PATTERNS = 200_000


def source_targets(sizes: dict[str | None, int], weights=WEIGHTS, share_percent=SHARE_PERCENT,
                   most: int = MOST_REPEATS) -> dict[str | None, float]:
    """Each source's target: weighted shares, none above ``most`` times its size.

    Sources are in code point order, NULL last; weights repeat.  The excess of
    those at their limit is shared by weight among the others until none is above.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = sum(sizes.values()) * share_percent / 100
    targets: dict[str | None, float] = {}
    open_ = list(order)
    while open_:
        left = total - sum(targets.values())
        sum_w = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / sum_w for s in open_}
        full = [s for s in open_ if share[s] > most * sizes[s]]
        if not full:
            return targets | share
        targets.update({s: float(most * sizes[s]) for s in full})
        open_ = [s for s in open_ if s not in targets]
    return targets


def min_cost_flow(supply: dict, demand: dict, members: dict, most: int = MOST_REPEATS
                  ) -> dict[tuple, int]:
    """Tokens of each (pattern, source), by successive cheapest paths.

    ``supply``: tokens of a pattern; ``members``: its sources; ``demand``: tokens
    a source wants.  Repetition r of a pattern costs 2r - 1 a token.  The flow
    meets as much demand as can be met, at the least total cost.
    """
    flow = {(p, s): 0 for p in supply for s in members[p]}
    used, unmet = dict.fromkeys(supply, 0), dict(demand)
    of_source: dict = {s: [] for s in demand}
    for p, sources in members.items():
        for s in sources:
            if s in of_source:
                of_source[s].append(p)
    for level in range(1, most + 1):
        # all capacity of one repetition has one cost: at each level a largest flow
        # through the residual network is a cheapest one
        while True:
            came: dict = {}
            queue = deque(("s", s) for s in sorted(unmet, key=lambda s: (s is None, s or ""))
                          if unmet[s] > 0)
            came.update({x: None for x in queue})
            end = None
            while queue and end is None:
                kind, x = node = queue.popleft()
                if kind == "s":
                    steps = [("p", p) for p in of_source[x]]
                elif used[x] < level * supply[x]:
                    end = node
                    break
                else:
                    steps = [("s", s) for s in members[x] if flow[x, s] > 0]
                for nxt in steps:
                    if nxt not in came:
                        came[nxt] = node
                        queue.append(nxt)
            if end is None:
                break
            path = [end]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            path.reverse()  # source, pattern, source, pattern, ...
            amount = min(unmet[path[0][1]], level * supply[end[1]] - used[end[1]])
            for (ka, a), (_, b) in zip(path, path[1:], strict=False):
                if ka == "p":
                    amount = min(amount, flow[a, b])
            for (ka, a), (_, b) in zip(path, path[1:], strict=False):
                if ka == "s":
                    flow[b, a] += amount
                else:
                    flow[a, b] -= amount
            used[end[1]] += amount
            unmet[path[0][1]] -= amount
    return flow


def _seeded(seed: int, *cols):
    return F.xxhash64(F.lit(seed), *cols)


def pick(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Adds ``extra``: size of the rows picked, about ``want`` tokens of each pattern.

    ``rows`` has pattern, hash, id, size and row, a number of its own; ``wanted``
    has pattern and want.  Rows are picked in order of the hash, id and size up to
    ``want``, the last one in part.  Sums over 4096 bins of the hash find the bin
    where that ends, sums over its 4096 bins the next; only the rows of that last
    bin are sorted, those that are alike as one with their count.  If the end falls
    among alike rows, they are picked the same way in order of a hash of their
    number, which decides nothing, for they are alike.
    Tables with a row for each pattern, at most MOST_PATTERNS, are broadcast, so
    that a pattern with most rows stays where its rows are.
    """
    wanted = F.broadcast(wanted)
    first, second = F.shiftrightunsigned("hash", 52), F.shiftrightunsigned("hash", 40).bitwiseAND(4095)
    rows = rows.withColumns({"b1": first, "b2": second})

    def edge(binned: DataFrame, bin_col: str, out: str) -> DataFrame:
        """The bin in which the running sum passes ``want``, and the sum before it."""
        w = Window.partitionBy("pattern").orderBy(bin_col)
        sums = (binned.groupBy("pattern", bin_col, "want", "base").agg(F.sum("size").alias("n"))
                .withColumn("before", F.col("base") + F.sum("n").over(w) - F.col("n")))
        return (sums.where(F.col("before") < F.col("want")).groupBy("pattern", "want")
                .agg(F.max_by(F.struct(F.col(bin_col), "before"), bin_col).alias("e"))
                .select("pattern", "want", F.col(f"e.{bin_col}").alias(out),
                        F.col("e.before").alias("base")))

    e1 = edge(rows.join(wanted, "pattern").withColumn("base", F.lit(0).cast("long")), "b1", "c1")
    e1 = staged(e1, "mix-bins")
    e2 = edge(rows.join(F.broadcast(e1), "pattern").where("b1 = c1"), "b2", "c2")
    limits = staged(e1.select("pattern", "want", "c1").join(
        e2.select("pattern", "c2", "base"), "pattern", "left"), "mix-limits")
    marked = rows.join(F.broadcast(limits), "pattern", "left")
    inside = (F.col("b1") == F.col("c1")) & (F.col("b2") == F.col("c2"))
    below = (F.col("b1") < F.col("c1")) | (F.col("b1") == F.col("c1")) & (F.col("b2") < F.col("c2"))
    names = [c for c in rows.columns if c not in ("b1", "b2")] + ["extra"]
    rest = marked.where(F.coalesce(~inside, F.lit(True))).withColumn(
        "extra", F.when(F.coalesce(below, F.lit(False)), F.col("size")).otherwise(0))
    # rows that are alike in all that orders them are one group, however many they are
    w = Window.partitionBy("pattern").orderBy("hash", "id", "size")
    groups = (marked.where(inside).groupBy("pattern", "want", "base", "hash", "id", "size")
              .agg(F.count(F.lit(1)).alias("n"))
              .withColumn("at", F.col("base") + F.sum(F.col("n") * F.col("size")).over(
                  w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") * F.col("size")))
    left = F.greatest(F.lit(0), F.least(F.col("n") * F.col("size"), F.col("want") - F.col("at")))
    cut = (F.col("n") > 1) & (left > 0) & (left < F.col("n") * F.col("size"))
    groups = staged(groups.select(
        F.col("pattern").alias("of_pattern"), F.col("hash").alias("of"), F.col("id").alias("of_id"),
        F.col("size").alias("of_size"), left.alias("left"), cut.alias("cut")), "mix-edge")
    last = marked.where(inside).join(groups, (
        F.col("pattern") == F.col("of_pattern")) & (F.col("hash") == F.col("of"))
        & F.col("id").eqNullSafe(F.col("of_id")) & (F.col("size") == F.col("of_size")))
    out = rest.select(*names).unionByName(last.where("not cut").withColumn(
        "extra", F.least("size", "left")).select(*names))
    split = groups.where("cut")
    if split.isEmpty():
        return out
    # the one group of a pattern that is taken in part: alike rows, ordered by their number
    alike = (last.where("cut").select(*names[:-1]).withColumnRenamed("hash", "_hash")
             .withColumn("hash", F.xxhash64("row")).withColumnRenamed("id", "_id")
             .withColumn("id", F.col("row")))
    again = pick(alike, split.select(F.col("of_pattern").alias("pattern"), F.col("left").alias("want")))
    again = again.drop("hash", "id").withColumnsRenamed({"_hash": "hash", "_id": "id"})
    return out.unionByName(again.select(*names))


def mix(docs: DataFrame, id_col: str, size_col, sources_col, seed: int = 7,
        most: int = MOST_REPEATS, targets=source_targets) -> tuple[DataFrame, dict]:
    """``(id, pattern, size, taken)`` of every row, and the targets by source.

    ``size_col`` gives a row's tokens and ``sources_col`` the array of sources it
    belongs to.  ``taken`` counts repetitions: a whole number of times the size,
    but for one document of a pattern, of which the first words fill the rest.
    Repeated rows are documents of their own; rows of size 0 or NULL
    take 0; a NULL source is a source; an empty table gives no rows.  Reruns agree.
    """
    rows = staged(docs.select(F.col(id_col).alias("id"), F.coalesce(
                                  size_col.cast("long"), F.lit(0)).alias("size"),
                              F.array_sort(F.array_distinct(sources_col)).alias("pattern"),
                              F.monotonically_increasing_id().alias("row")),
                  "mix-sizes").withColumn("hash", _seeded(seed, F.col("id"), F.col("size")))
    sums = rows.groupBy("pattern").agg(F.sum("size").alias("n")).limit(MOST_PATTERNS + 1).collect()
    if len(sums) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    supply = {tuple(r["pattern"]): int(r["n"]) for r in sums}
    sizes: dict = {}
    for p, n in supply.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    target = targets(sizes)
    flow = min_cost_flow(supply, {s: math.floor(t + 0.5) for s, t in target.items()},
                         {p: p for p in supply}, most)
    spark = docs.sparkSession
    kind = rows.schema["pattern"].dataType.simpleString()
    total = {p: sum(flow[p, s] for s in p) for p in supply}
    plan = [(list(p), total[p] // n if n else 0, total[p] % n if n else 0)
            for p, n in supply.items()]
    wanted = spark.createDataFrame(plan, f"pattern {kind}, rounds long, want long")
    picked = pick(rows, wanted.where("want > 0").select("pattern", "want"))
    return picked.join(F.broadcast(wanted.select("pattern", "rounds")), "pattern").select(
        F.col("id").alias(id_col), "pattern", "size",
        (F.col("rounds") * F.col("size") + F.col("extra")).cast("long").alias("taken")), target
