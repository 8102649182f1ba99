"""Near-duplicate documents: MinHash signatures and a multi-index Hamming join.

A signature is ``PARTS`` minima of 16 bits.  It is cut into chunks; two
signatures that differ in fewer than ``2 * chunks`` places have, by the
pigeonhole principle, a chunk with at most one difference.  So every chunk is
indexed once for each of its places left out, and all pairs under the distance
meet in a bucket.  At similarity 0.8 a place differs with probability 0.2, and
32 of 64 differ less than once in 10^7 pairs.

Documents with equal shingle sets are one class from the start.  In a bucket the
classes are first compared with its smallest, a linear number of pairs; links
confirmed on full shingle sets join components.  Members of a bucket that holds
several components are still open.  Open classes that can reach the similarity
share one of their rarest shingles (as many as may differ, and one more), so
their pairs are sought in the lists of these shingles alone.  Rounds take more and
more of the open classes as pivots, compare each with all that its lists hold and
strike it from them, until every list's members are in one component or all have
been pivots: every pair is compared or already joined.  A pair is a row only if
the places of a shared shingle in both sets leave room for the similarity, so
unlike members of a bucket, whose rarest shingles are their own, are no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiller.llm.common import mix, sized, staged, text_or_empty, text_slices, word_hashes
from tiller.llm.components import components

PARTS = 64
CHUNKS = 16
PER_CHUNK = PARTS // CHUNKS
#: The largest distance that the index guarantees.
DISTANCE = 2 * CHUNKS - 1
#: Open classes that are pivots in the first round; so many times more in each next one.
MORE_PIVOTS = 64
#: Blocks over which the partners of one pivot are spread.
SPREAD = 256
SHINGLE, PERCENT = 5, 80
#: Signatures (128 bytes and a name each) that may be broadcast.
SIGNATURES = 100_000
#: Earlier places that a row of a list remembers, so that a pair meets in few lists.
BEFORE = 8
#: Bytes of text that one numpy pass handles.
SLICE = 1 << 19

_SEEDS = mix(np.arange(1, 2 * PARTS + 1, dtype=np.uint64))
_MULTIPLY = _SEEDS[:PARTS] | np.uint64(1)
_ADD = _SEEDS[PARTS:]
_PLACE = [mix(np.arange(1, 6, dtype=np.uint64) + np.uint64(16 * j)) for j in range(64)]


def shingle_sets(raw: list[bytes], size: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted; texts are lower-cased bytes.

    A text of fewer words than ``size`` has its whole sequence as one shingle.
    """
    words, first = word_hashes(raw)
    if len(words) >= size:
        joint = words[: len(words) - size + 1] * _PLACE[0][0]
        for j in range(1, size):
            joint = mix(joint) + words[j : len(words) - size + 1 + j] * (_PLACE[j][0] | np.uint64(1))
        joint = mix(joint)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(joint[a : b - size + 1]))
        elif b > a:
            text = words[a:b].tobytes()
            out.append(np.frombuffer(hashlib.blake2b(text, digest_size=8).digest(), np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> bytes:
    """``PARTS`` minima under multiply-shift hashes, the top 16 bits of each, mixed."""
    best = np.empty(PARTS, np.uint64)
    for a in range(0, PARTS, 16):
        h = shingles[None, :] * _MULTIPLY[a : a + 16, None] + _ADD[a : a + 16, None]
        best[a : a + 16] = h.min(axis=1)
    return (mix(best) >> np.uint64(48)).astype("<u2").tobytes()


def _signatures(size: int):
    def emit(batches):
        for batch in batches:
            for a, b, raw in text_slices(batch.column("text"), SLICE):
                sets = shingle_sets([r.lower() for r in raw], size)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id")[a:b], pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_class(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([signature(s) if len(s) else None for s in sets], pa.binary()),
                ], ["id", "n_shingles", "class", "signature"])

    return emit


def _class(shingles: np.ndarray) -> int:
    """64-bit name of a shingle set."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little",
                          signed=True)


def index_keys(signatures: np.ndarray) -> np.ndarray:
    """Keys of signatures (n, PARTS): one for each chunk and place of it left out."""
    chunks = signatures.reshape(len(signatures), CHUNKS, PER_CHUNK).astype(np.uint64)
    number = (np.arange(CHUNKS, dtype=np.uint64) * np.uint64(PER_CHUNK))[None, :]
    keys = []
    for out in range(PER_CHUNK):
        key = mix(np.broadcast_to(number + np.uint64(out), chunks.shape[:2]) + np.uint64(1))
        for j in range(PER_CHUNK):
            if j != out:
                key = mix(key ^ chunks[:, :, j])
        keys.append(key)
    return np.stack(keys, axis=2).reshape(len(signatures), -1)


def _index(batches):
    slots = np.arange(PARTS, dtype=np.int32)
    for batch in batches:
        names = batch.column("class").to_numpy()
        signatures = _matrix(batch.column("signature"))
        for a in range(0, len(names), 2000):
            keys = index_keys(signatures[a : a + 2000])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(slots, len(keys))),
                 pa.array(np.repeat(names[a : a + 2000], PARTS))], ["key", "slot", "class"])


def _near(batches):
    """Pairs whose signatures are within the distance."""
    for batch in batches:
        one, two = (_matrix(batch.column(c)) for c in ("sig_a", "sig_b"))
        near = np.count_nonzero(one != two, axis=1) <= DISTANCE
        yield pa.RecordBatch.from_arrays(
            [batch.column(c).filter(pa.array(near)) for c in ("a", "b")], ["a", "b"])


def _class_sets(size: int):
    """Class and shingles of texts."""
    def emit(batches):
        for batch in batches:
            for _, _, raw in text_slices(batch.column("text"), SLICE):
                sets = [s for s in shingle_sets([r.lower() for r in raw], size) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_class(s) for s in sets], pa.int64()),
                     pa.array([s.tobytes() for s in sets], pa.binary())], ["class", "shingles"])

    return emit


def grouped(batches, key: str):
    """Runs of rows with the same key, as they come; a long run comes in parts.

    Yields (key, first part of its run?, record batch).
    """
    last = None
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            if a < b:
                yield keys[a], keys[a] != last, batch.slice(a, b - a)
                last = keys[a]


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, PARTS)


def _compare(percent: int):
    """Links between the asking classes of a block and its others, on full sets.

    The askers' shingles lie in one sorted array, so a class is compared with all
    of them at once; of the links to one component, an asker's first is enough.
    """
    def emit(batches):
        names, comps, sets, ready = [], [], [], None
        for _, new, part in grouped(batches, "block"):
            if new:
                names, comps, sets, ready = [], [], [], None
            found: dict[tuple, int] = {}
            for name, comp, asks, raw in zip(
                    *(part.column(c).to_pylist() for c in
                      ("class", "component", "asks", "shingles")), strict=True):
                shingles = np.frombuffer(raw, np.uint64)
                if asks:
                    names.append(name)
                    comps.append(comp)
                    sets.append(shingles)
                    continue
                if ready is None:
                    sizes = np.asarray([len(s) for s in sets])
                    joint = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                    order = np.argsort(joint, kind="stable")
                    ready = sizes, joint[order], np.repeat(np.arange(len(sets)), sizes)[order]
                sizes, joint, owner = ready
                low, high = (np.searchsorted(joint, shingles, side) for side in ("left", "right"))
                each = high - low
                at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                both = np.bincount(owner[at + np.repeat(low, each)], minlength=len(sets))
                linked = 100 * both >= percent * (sizes + len(shingles) - both)
                for i in np.flatnonzero(linked).tolist():
                    if comps[i] != comp:
                        found.setdefault((names[i], comp), name)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a for a, _ in found], pa.int64()),
                     pa.array(list(found.values()), pa.int64())], ["a", "b"])

    return emit


def _verified(blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links found in blocks (block, class, component, asks), on full sets."""
    spark = blocks.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = sets.join(sized(blocks), "class")
    return staged((rows.repartition(parts, "block")
                   .sortWithinPartitions("block", F.desc("asks"), "class")
                   .mapInArrow(_compare(percent), "a long, b long")), "near-links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` of every row of ``docs``.

    Words are lower-cased (A-Z) runs without \\x20 and \\x09-\\x0D.  Texts whose
    sets share ``percent`` of their union are linked; ``component_id`` is the
    smallest id that links reach and ``kept`` marks it.  NULL and empty texts
    have no shingles and no links.  Rows that share an id are one document,
    linked by any of their texts; each gives a row.  A NULL id stays alone.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"),
                       text_or_empty(F.col(text_col)).alias("text"))
    signed = staged(rows.mapInArrow(_signatures(shingle), "id long, n_shingles long, "
                                    "class long, signature binary"), "signatures")
    linked = signed.where("id is not null and class is not null")
    # equal sets are one class, represented by its smallest id
    classes = staged(linked.groupBy("class").agg(
        F.min("id").alias("id"), F.min("signature").alias("signature")), "classes")
    sigs = sized(classes.select("class", "signature"), SIGNATURES)

    keys = staged(classes.select("class", "signature").mapInArrow(
        _index, "key long, slot int, class long"), "index-keys")
    met = staged(_met(keys), "buckets")
    known = staged(_within(met.select(F.col("class").alias("a"), F.col("pivot").alias("b"))
                           .distinct(), sigs), "near-pairs")

    # sets of the classes that a bucket or a pair needs
    crowded = met.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    needed = staged(known.select(F.explode(F.array("a", "b")).alias("class")).unionByName(
        met.join(crowded, "key", "left_semi").select("class")).distinct()
        .join(classes.select("class", "id"), "class"), "needed")
    texts = rows.join(sized(needed.select("id").distinct()), "id", "left_semi")
    sets = staged(texts.mapInArrow(_class_sets(shingle), "class long, shingles binary")
                  .dropDuplicates(["class"]), "shingle-sets")

    links = _against(known, sets, percent)
    # what is left: members of a bucket that are not all in one component
    label = components(links)
    open_ = staged(_open(met, label), "open-classes")
    links = links.unionByName(_open_links(open_, links, sets, percent))

    # rows of one document belong together
    alike = linked.groupBy("id").agg(F.min("class").alias("b"), F.max("class").alias("m")).where(
        "b != m").join(linked, "id").select(F.col("class").alias("a"), "b")
    label = components(links.unionByName(alike)).withColumnRenamed("id", "class")
    named = classes.join(label, "class", "left").select(
        "class", "id", F.coalesce("component", "class").alias("component"))
    lowest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    # a read table, so that the rows of many copies of one text can be split
    final = staged(named.join(lowest, "component").select("class", "component_id"), "components")
    return (signed.join(final, "class", "left")
            .select(F.col("id").alias(id_col), "n_shingles",
                    F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
                    .alias("component_id"))
            .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))))


def _met(keys: DataFrame) -> DataFrame:
    """Every bucket's members but the smallest, its ``pivot``.

    A join of read tables, so that a hot bucket's rows can be split.
    """
    pivots = staged(keys.groupBy("key").agg(F.min("class").alias("pivot"), F.max("class").alias("last"))
                    .where("pivot != last").select("key", "pivot"), "pivots")
    return keys.join(sized(pivots), "key").where("class != pivot")


def _open(met: DataFrame, label: DataFrame) -> DataFrame:
    """``(class, component)`` of the members of buckets with several components."""
    member = met.join(label, F.col("class") == F.col("id"), "left").select(
        "key", "class", F.coalesce("component", "class").alias("component"))
    mixed = member.groupBy("key").agg(
        F.min("component").alias("least"), F.max("component").alias("most")).where("least != most")
    return member.join(sized(staged(mixed.select("key"), "mixed-buckets")), "key", "left_semi").select(
        "class", "component").distinct()


def _against(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among distinct pairs (a, pivot b), in blocks of a pivot and some of its partners.

    ``SPREAD`` blocks a pivot at most; no more rows for pivots than there are pairs.
    """
    placed = pairs.withColumn("block", F.xxhash64("b", F.pmod(F.xxhash64("a"), F.lit(SPREAD))))
    blocks = staged(placed.select("block", F.col("a").alias("class"), F.col("a").alias("component"),
                                  F.lit(False).alias("asks"))
                    .unionByName(placed.select("block", F.col("b").alias("class"),
                                               F.col("b").alias("component"),
                                               F.lit(True).alias("asks")).distinct()), "blocks")
    return _verified(blocks, sets, percent)


def _shingles(batches):
    """A row for each shingle of each set."""
    for batch in batches:
        for name, raw in zip(*(batch.column(c).to_pylist() for c in ("class", "shingles")),
                             strict=True):
            own = np.frombuffer(raw, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own), pa.array(np.full(len(own), name)),
                 pa.array(np.full(len(own), len(own)))], ["shingle", "class", "n"])


def rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """``(shingle, class, n, place, before)``: the rarest shingles of each set (class, shingles).

    Sets of n that share ``percent`` of their union share at least
    ceil(percent * n / 100); ordered alike, each has one of the shared ones among
    its first n - ceil(percent * n / 100) + 1.  Those of one set only take their
    places but need no row.  ``before`` are the last ``BEFORE`` shingles with an
    earlier row: sets that share one of them have met already.
    """
    each = staged(sets.mapInArrow(_shingles, "shingle long, class long, n long"), "open-shingles")
    common = staged(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1"),
                    "common-shingles")
    own = Window.partitionBy("class")  # one set: bounded by its text
    rising = own.orderBy("sets", "shingle")
    rank = F.row_number().over(rising)
    alone = F.col("n") - F.count(F.lit(1)).over(own)
    most = F.floor((100 - percent) * F.col("n") / 100) + 1  # n - ceil(percent * n / 100) + 1
    return (each.join(sized(common), "shingle").withColumn("place", rank + alone)
            .where(F.col("place") <= most)
            .withColumn("before", F.collect_list("shingle").over(rising.rowsBetween(-BEFORE, -1)))
            .select("shingle", "class", "n", "place", "before"))


def _open_links(open_: DataFrame, links: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between open classes of different components, sought in lists of rare shingles."""
    found, count = links.limit(0), open_.count()
    if not count:
        return found
    rare = rare_shingles(sets.join(sized(open_), "class", "left_semi"), percent)
    lists = staged(rare.join(sized(open_), "class"), "lists")
    pivots = 1
    while pivots < count:
        pivots *= MORE_PIVOTS
        mixed = staged(lists.groupBy("shingle").agg(
            F.min("component").alias("least"), F.max("component").alias("most"))
            .where("least != most").select("shingle"), "mixed-lists")
        if not mixed.limit(1).count():
            break
        bound = int(min(1.0, pivots / count) * (1 << 30))
        marked = lists.join(sized(mixed), "shingle").withColumn(
            "pivot", F.pmod(F.xxhash64("class"), F.lit(1 << 30)) < bound)
        chosen = marked.where("pivot").select(
            "shingle", F.col("class").alias("b"), F.col("component").alias("own"),
            F.col("n").alias("n_b"), F.col("place").alias("place_b"),
            F.col("before").alias("before_b"))
        # what both sets hold from the shared shingle on, if it is their first; a row
        # is left out only for an earlier one, which has more room, in the same lists
        room = F.least(F.col("n") - F.col("place"), F.col("n_b") - F.col("place_b")) + 1
        pairs = (marked.join(sized(chosen), "shingle")
                 .where((F.col("component") != F.col("own"))
                        & ((100 + percent) * room >= percent * (F.col("n") + F.col("n_b")))
                        & ~F.arrays_overlap("before", "before_b"))
                 .select(F.greatest("class", "b").alias("a"), F.least("class", "b").alias("b"))
                 .distinct())
        found = found.unionByName(_against(staged(pairs, "list-pairs"), sets, percent))
        if pivots < count:
            label = components(links.unionByName(found)).select(
                F.col("id").alias("class"), F.col("component").alias("now"))
            lists = staged(marked.where("not pivot").join(label, "class", "left").select(
                "shingle", "class", "n", "place", "before", F.coalesce("now", "component").alias("component")),
                "lists")
    return found


def _within(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs whose signatures are within the guaranteed distance."""
    for side in ("a", "b"):
        pairs = pairs.join(sigs.select(F.col("class").alias(side),
                                       F.col("signature").alias(f"sig_{side}")), side)
    return pairs.mapInArrow(_near, "a long, b long")
