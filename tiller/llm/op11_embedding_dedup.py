"""Near-duplicate embeddings: sorted projection passes.

A pass orders the vectors lexicographically by concatenated random hashes - each
the number and sign of the largest of ``PROJECTIONS`` random projections - and
compares every vector with the ``WINDOW`` before it.  Verified pairs of all passes
are united to components.  A pair at the threshold shares a bit of its hash with
probability ``AGREE``, so the number of passes that finds it with the asked
certainty follows from the number of vectors: it grows, the window does not.

Equal vectors are one class from the start.  The window bounds what a pass
compares, not what is linked: within a component all links are counted exactly.
Members of a crowded component that lie within half the threshold's angle of its
centre are all linked with one another by the triangle inequality; the others are
compared with every member, in a grid of blocks.  Pairs are never rows: a window
gives a link for each two groups that it joins, a block a count for each member.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiller.llm.common import sized, staged
from tiller.llm.components import components
from tiller.llm.op2_near_dedup import grouped
from tiller.llm.vectors import binary_matrix, element_type, row_slices

COSINE = 0.9
WINDOW = 256
#: Chance that all passes miss a pair at the threshold that nothing else joins.
MISS = 1e-3
#: Projections of a hash, and hashes that a key concatenates (7 bits each).
PROJECTIONS, HASHES = 64, 9
#: Chance, for each bit of a hash, that vectors at cosine 0.9 agree (0.464 for all
#: seven bits of one, by simulation; the dimension hardly matters).
AGREE = 0.896
#: Vectors of a range are so many windows at least: what the borders cut is small.
RANGE_WINDOWS = 8
#: Passes that one job runs; bounds the disk that it uses.
AT_ONCE = 4
#: Members of a component that are compared at once, and members in a grid's column.
CROWD, COLUMN = 1024, 1 << 14


def passes_for(vectors: int, window: int = WINDOW, miss: float = MISS, agree: float = AGREE) -> int:
    """Passes after which a pair at the threshold is missed with chance ``miss``."""
    bits = max(0.0, math.log2(max(1, vectors) / window))
    found = agree ** bits * (1 - 1 / (2 * RANGE_WINDOWS))
    return max(2, math.ceil(math.log(miss) / math.log(1 - found)))


def unit(values: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow."""
    values = values.astype(np.float64)
    values /= np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def order_keys(units: np.ndarray, seed: int) -> np.ndarray:
    """One key a row: ``HASHES`` hashes of 7 bits, the first in the highest bits."""
    key = np.zeros(len(units), np.int64)
    for number in range(HASHES):
        random = np.random.default_rng((seed, number, units.shape[1]))
        y = units @ random.standard_normal((units.shape[1], PROJECTIONS))
        most = np.abs(y).argmax(axis=1)
        sign = y[np.arange(len(y)), most] > 0
        key = key * (2 * PROJECTIONS) + 2 * most + sign
    return key


def _prints(dtype: np.dtype):
    """128-bit names of vectors; none for those that link with nothing."""
    def emit(batches):
        for batch in batches:
            column, offset = batch.column("vector"), 0
            names = np.zeros((batch.num_rows, 2), np.int64)
            raw: list[bytes | None] = [None] * batch.num_rows
            for i, value in enumerate(column):
                own = value.values
                if own is None or len(own) == 0 or own.null_count:
                    continue
                row = own.to_numpy(zero_copy_only=False).astype(dtype) + dtype.type(0)
                if np.isfinite(row).all() and row.any():
                    raw[i] = row.tobytes()
                    names[i] = np.frombuffer(hashlib.blake2b(raw[i], digest_size=16).digest(), "<i8")
            none = np.array([r is None for r in raw], bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(names[:, 0], mask=none),
                 pa.array(names[:, 1], mask=none), pa.array(raw, pa.binary())],
                ["id", "high", "low", "vector"])

    return emit


def _keyed(dtype: np.dtype, seed: int):
    """Rows with the key that a pass orders them by."""
    def emit(batches):
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column("vector").to_pylist()], np.int64)
            key = np.zeros(len(sizes), np.int64)
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                dim = int(size) // dtype.itemsize
                for a, b in row_slices(len(own), dim):
                    at = own[a:b]
                    rows = binary_matrix(batch.column("vector").take(pa.array(at)), dtype, dim)
                    key[at] = order_keys(unit(rows), seed)
            yield pa.RecordBatch.from_arrays(
                [pa.array(sizes.astype(np.int32)), pa.array(key), batch.column("class"),
                 batch.column("vector")], ["bytes", "key", "class", "vector"])

    return emit


def _runs(batches, column: str, most: int):
    """Parts of at most ``most`` rows with one value of ``column``; (first of its run?, part)."""
    for _, new, run in grouped(batches, column):
        for a in range(0, run.num_rows, most):
            yield new and a == 0, run.slice(a, min(most, run.num_rows - a))


def _windows(dtype: np.dtype, cosine: float, window: int):
    """Links between vectors at most ``window`` places apart, as few as join the same groups."""
    def emit(batches):
        names = group = units = None
        fresh = 0
        for new, part in _runs(batches, "bytes", window):
            dim = part.column("bytes")[0].as_py() // dtype.itemsize
            own = unit(binary_matrix(part.column("vector"), dtype, dim))
            if new:
                names, group, units = np.zeros(0, np.int64), np.zeros(0, np.int64), own[:0]
            held, n = len(names), len(own)
            names = np.concatenate((names, part.column("class").to_numpy()))
            group = np.concatenate((group, np.arange(fresh, fresh + n)))
            units = np.concatenate((units, own))
            fresh += n
            near = own @ units.T >= cosine
            distance = np.arange(held, held + n)[:, None] - np.arange(held + n)
            near &= (distance > 0) & (distance <= window)
            one, two = [], []
            for i in np.flatnonzero(near.any(axis=1)).tolist():
                met = np.flatnonzero(near[i])
                for label, j in zip(*np.unique(group[met], return_index=True), strict=True):
                    if group[held + i] != label:
                        one.append(names[held + i])
                        two.append(names[met[j]])
                        group[group == label] = group[held + i]
            if one:
                yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()),
                                                  pa.array(two, pa.int64())], ["a", "b"])
            names, group, units = names[-window:], group[-window:], units[-window:]

    return emit


def _counts_within(dtype: np.dtype, cosine: float):
    """Links of every member of components that fit into one comparison."""
    def count(parts):
        rows = pa.Table.from_batches(parts)
        raw = rows.column("vector").combine_chunks()
        own = unit(binary_matrix(raw, dtype, len(raw[0].as_py()) // dtype.itemsize))
        n = rows.column("n").to_numpy()
        links = (own @ own.T >= cosine) @ n - 1
        return pa.RecordBatch.from_arrays(
            [rows.column("class").combine_chunks(), pa.array(links)], ["class", "links"])

    def emit(batches):
        parts: list = []
        for _, new, part in grouped(batches, "component"):
            if new and parts:
                yield count(parts)
                parts = []
            parts.append(part)
        if parts:
            yield count(parts)

    return emit


def _centre_sums(dtype: np.dtype):
    """Sums of the unit vectors of each component, a row for each place."""
    def emit(batches):
        for _, _, part in grouped(batches, "component"):
            dim = len(part.column("vector")[0].as_py()) // dtype.itemsize
            for a, b in row_slices(part.num_rows, dim):
                own = unit(binary_matrix(part.column("vector").slice(a, b - a), dtype, dim))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(part.column("component")[:1].to_numpy(), dim)),
                     pa.array(np.arange(dim, dtype=np.int32)), pa.array(own.sum(axis=0))],
                    ["component", "place", "total"])

    return emit


def _cores(dtype: np.dtype, cosine: float):
    """Members, marked if they lie within half the threshold's angle of the centre."""
    half = math.cos(math.acos(cosine) / 2) + 1e-9

    def emit(batches):
        for batch in batches:
            core = []
            for raw, centre in zip(batch.column("vector").to_pylist(),
                                   batch.column("centre").to_pylist(), strict=True):
                centre = np.asarray(centre)
                length = math.sqrt(centre @ centre)
                own = unit(np.frombuffer(raw, dtype)[None])[0]
                core.append(length > 0 and own @ centre >= half * length)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("class", "component", "n", "vector")),
                 pa.array(core, pa.bool_())], ["class", "component", "n", "vector", "core"])

    return emit


def _counts_across(dtype: np.dtype, cosine: float):
    """Links between a block's askers and its other rows; counts for both sides.

    Askers count all members they meet, the others (if core) only askers.
    """
    def rows(names, links):
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(links, pa.int64())],
                                          ["class", "links"])

    def emit(batches):
        held: list = []
        ready = total = None
        for new, part in _runs(batches, "block", CROWD):
            if new:
                if ready is not None:
                    yield rows(ready[0], total)
                held, ready = [], None
            asks = part.column("asks").to_numpy(zero_copy_only=False)
            dim = len(part.column("vector")[0].as_py()) // dtype.itemsize
            own = unit(binary_matrix(part.column("vector"), dtype, dim))
            names, n, core = (part.column(c).to_numpy(zero_copy_only=False)
                              for c in ("class", "n", "core"))
            if asks.any():
                held.append((names[asks], n[asks], own[asks]))
            if asks.all():
                continue
            if ready is None:
                ready = [np.concatenate(x) for x in zip(*held, strict=True)]
                total = np.zeros(len(ready[0]), np.int64)
            near = ready[2] @ own[~asks].T >= cosine
            total += near @ n[~asks]
            back = ready[1] @ near
            told = core[~asks] & (back > 0)
            yield rows(names[~asks][told], back[told])
        if ready is not None:
            yield rows(ready[0], total)

    return emit


def _crowded_links(crowds: DataFrame, dtype: np.dtype, cosine: float, parts: int) -> DataFrame:
    """``(class, links)`` of members of components of more than ``CROWD`` classes."""
    sums = crowds.select("component", "vector").sortWithinPartitions("component").mapInArrow(
        _centre_sums(dtype), "component long, place int, total double")
    centres = (sums.groupBy("component", "place").agg(F.sum("total").alias("total"))
               .groupBy("component").agg(F.transform(F.array_sort(F.collect_list(
                   F.struct("place", "total"))), lambda s: s["total"]).alias("centre")))
    placed = staged(crowds.join(sized(staged(centres, "centres"), 10_000), "component").mapInArrow(
        _cores(dtype, cosine), "class long, component long, n long, vector binary, core boolean"),
        "placed")
    sizes = staged(placed.groupBy("component").agg(
        F.coalesce(F.sum(F.when(F.col("core"), F.col("n"))), F.lit(0)).alias("n_core"),
        F.count_if(~F.col("core")).alias("n_asking"), F.count(F.lit(1)).alias("n_members")), "crowds")
    inside = placed.join(sized(sizes), "component")
    core = inside.where("core").select("class", (F.col("n_core") - 1).alias("links"))

    def cut(n, size):
        return F.greatest(F.lit(1), F.ceil(F.col(n) / size)).cast("int")

    def place(own, n):
        return F.when(own, F.array(F.pmod(F.xxhash64("class"), n).cast("int"))).otherwise(
            F.sequence(F.lit(0), n - 1))

    open_ = inside.where("n_asking > 0")
    sides = open_.where("not core").withColumn("asks", F.lit(True)).unionByName(
        open_.withColumn("asks", F.lit(False)))
    blocks = (sides.withColumn("row", F.explode(place(F.col("asks"), cut("n_asking", CROWD))))
              .withColumn("column", F.explode(place(~F.col("asks"), cut("n_members", COLUMN))))
              .withColumn("block", F.xxhash64("component", "row", "column"))
              .select("block", "asks", "class", "n", "core", "vector")
              .repartition(parts, "block").sortWithinPartitions("block", F.desc("asks"), "class"))
    across = blocks.mapInArrow(_counts_across(dtype, cosine), "class long, links long")
    # a class that asks meets itself among the members
    itself = inside.where("not core").select("class", F.lit(-1).cast("long").alias("links"))
    return core.unionByName(across).unionByName(itself)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                 cosine: float = COSINE, window: int = WINDOW, miss: float = MISS) -> DataFrame:
    """``(id, n_links, component_id, kept)`` of every row of ``vectors``.

    Pairs with a cosine of ``cosine`` or more are linked; ``n_links`` counts the
    other rows linked directly, ``component_id`` is the smallest id that links
    reach, its own included, and ``kept`` marks it.  Vectors that are NULL,
    empty, all zero or hold a NULL or non-finite component link with nothing, nor
    do vectors of different lengths.  Rows may share an id; each is a vector
    of its own.  A NULL id names no component: such a row has the smallest id
    of its links, and NULL if there is none.  Other columns are ignored.
    ``AGREE`` is measured at cosine 0.9; a higher threshold misses less.
    """
    spark = vectors.sparkSession
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dtype = element_type(vectors, vec_col)
    rows = staged(vectors.select(F.col(id_col).cast("long").alias("id"),
                                 F.col(vec_col).alias("vector")).mapInArrow(
        _prints(dtype), "id long, high long, low long, vector binary"), "vectors")
    classes = staged(rows.where("vector is not null").groupBy("high", "low").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector"))
        .withColumn("class", F.monotonically_increasing_id()), "vector-classes")
    count = classes.count()
    ranges = max(1, min(shuffle, count // (RANGE_WINDOWS * window)))

    def ordered(seed):
        keyed = classes.select("class", "vector").mapInArrow(
            _keyed(dtype, seed), "bytes int, key long, class long, vector binary")
        return (keyed.repartitionByRange(ranges, "bytes", "key", "class")
                .sortWithinPartitions("bytes", "key", "class")
                .mapInArrow(_windows(dtype, cosine, window), "a long, b long"))

    links = spark.createDataFrame([], "a long, b long")
    seeds = list(range(passes_for(count, window, miss)))
    for a in range(0, len(seeds), AT_ONCE):
        found = ordered(seeds[a])
        for seed in seeds[a + 1 : a + AT_ONCE]:
            found = found.unionByName(ordered(seed))
        links = links.unionByName(staged(found, "near-pairs"))

    label = components(links).withColumnRenamed("id", "class")
    members = staged(classes.join(label, "class"), "members")
    sizes = staged(members.groupBy("component").agg(
        F.count(F.lit(1)).alias("size"), F.min("id").alias("component_id")), "component-sizes")
    member = members.join(sized(sizes), "component").select(
        "class", "component", "n", "vector", "size")
    small = (member.where(F.col("size") <= CROWD).repartition(shuffle, "component")
             .sortWithinPartitions("component")
             .mapInArrow(_counts_within(dtype, cosine), "class long, links long"))
    counted = small
    if sizes.where(F.col("size") > CROWD).limit(1).count():
        crowds = staged(member.where(F.col("size") > CROWD).drop("size"), "crowded")
        counted = small.unionByName(_crowded_links(crowds, dtype, cosine, shuffle))
    n_links = counted.groupBy("class").agg(F.sum("links").alias("n_links"))
    linked = members.join(n_links, "class").join(sized(sizes), "component").select(
        "high", "low", "n_links", "component_id")
    copies = (classes.where("n > 1").join(members.select("class"), "class", "left_anti")
              .select("high", "low", (F.col("n") - 1).alias("n_links"),
                      F.col("id").alias("component_id")))
    # a read table, so that the rows of a hot class can be split
    final = sized(staged(linked.unionByName(copies), "vector-links"))
    return (rows.drop("vector").join(final, ["high", "low"], "left")
            .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                    F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
                    .alias("component_id"))
            .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))))
