"""Repeated byte strings across a corpus, by bucket-pointer refinement.

A suffix array of all positions would not fit; it is not needed either.  Of the
q-grams in every string of ``length`` bytes the one with the smallest hash is its
anchor, so equal strings have equal anchors at the same offset.  An anchor stands
for all strings that chose it, a range of offsets.

Anchors first lie in buckets by their q-gram.  A bucket is refined by identifiers
of longer spans at later offsets: all members are the same in what every string
of a range covers (the core), and those that are the same in all that the range
touches (the hull) are settled, with every string in it.  Members whose core
nobody shares are settled too.  The rest go on with a range cut into blocks, then
into single strings, always within the buckets found so far; one member of each
settled class goes with them, for others may share a part of it.  Buckets are
aggregations and joins on identifiers, so no bucket is ever gathered in a task.

Strings are of bytes, or of words: the same refinement on the words' hashes finds
passages of many words that are too short in bytes to be removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiller.llm.common import (
    mix,
    prefix_hash,
    sized,
    slices,
    span_hash,
    staged,
    text_or_empty,
    word_hashes,
)

LENGTH = 400
GRAM = 49
BLOCK = 32
#: Words, grams and blocks of the passages that are counted: over 50 words.
PASSAGE, PASSAGE_GRAM, PASSAGE_BLOCK = 51, 12, 8
#: Window starts that are handled at once.
SEGMENT = 1 << 20
_POSITION = np.uint64((1 << 22) - 1)
_NODE = "text_key long, pos long, lo int, hi int, core long, hull long, weight long"


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    span, out = 1, values
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, valid: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(anchor, first start, last start, core, hull) of the runs of starts with one anchor.

    ``valid`` marks the starts of strings that lie within one text.
    """
    if len(data) > int(_POSITION) + 1:
        raise ValueError("more bytes than positions can name")
    prefix = prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    grams = span_hash(prefix, at, at + gram)
    packed = (grams & ~_POSITION) | (_POSITION - at.astype(np.uint64))
    least = sliding_min(packed, length - gram + 1)
    starts = np.flatnonzero(valid[: len(least)])
    chosen = (_POSITION - (least[starts] & _POSITION)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    anchor, low, high = chosen[first], starts[first], starts[last]
    hull = _with_range(span_hash(prefix, low, high + length), anchor - high, anchor - low)
    return anchor, low, high, grams[anchor], hull


def _with_range(hashes, lo, hi):
    return mix(hashes ^ (lo * 1024 + hi + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def byte_units(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts, one after another, and each text's first (one entry more)."""
    ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], ends))


def _first_nodes(length: int, gram: int, units):
    def emit(batches):
        for batch in batches:
            # a text has as many bytes as units, or more
            batch = batch.filter(pc.greater_equal(pc.binary_length(batch.column("text")), length))
            keys = batch.column("text_key").to_numpy()
            raw = [t.encode() for t in batch.column("text").to_pylist()]
            for a, b in slices(raw):
                data, bounds = units(raw[a:b])
                valid = np.zeros(len(data), bool)
                for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    valid[s : max(s, e - length + 1)] = True
                for at in range(0, len(data) - length + 1, SEGMENT):
                    end = at + SEGMENT
                    if not valid[at:end].any():
                        continue
                    anchor, low, high, core, hull = anchors(
                        data[at : end + length - 1], valid[at:end], length, gram)
                    owner = np.searchsorted(bounds, low + at, "right") - 1
                    yield _batch(keys[a:b][owner], anchor + at - bounds[owner], anchor - high,
                                 anchor - low, core, hull, np.ones(len(anchor), np.int64))

    return emit


def _batch(key, pos, lo, hi, core, hull, weight) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(key), pa.array(pos, pa.int64()), pa.array(lo, pa.int32()),
         pa.array(hi, pa.int32()), pa.array(core.view(np.int64)), pa.array(hull.view(np.int64)),
         pa.array(weight, pa.int64())],
        ["text_key", "pos", "lo", "hi", "core", "hull", "weight"])


def _finer(step: int, length: int, units):
    """Cuts nodes' ranges at multiples of ``step`` and names the cores and hulls of the parts."""
    def emit(batches):
        for batch in batches:
            keys = batch.column("text_key").to_numpy()
            raw = [t.encode() for t in batch.column("text").to_pylist()]
            nodes = batch.column("nodes")
            for a, b in slices(raw, most=1 << 19):
                data, begin = units(raw[a:b])
                prefix = prefix_hash(data)
                own = nodes[a:b]
                flat = own.flatten()
                pos, lo, hi, weight = (flat.field(i).to_numpy() for i in range(4))
                of = np.repeat(np.arange(b - a), own.value_lengths().to_numpy())
                # some nodes at a time: each becomes several
                for c in range(0, len(pos), 50_000):
                    s = slice(c, c + 50_000)
                    first, n = lo[s] // step, hi[s] // step - lo[s] // step + 1
                    node = np.repeat(np.arange(len(n)), n) + c
                    part = np.arange(len(node)) - np.repeat(np.cumsum(n) - n, n) \
                        + np.repeat(first, n)
                    at = pos[node] + begin[of[node]]
                    cut_lo = np.maximum(lo[node], part * step)
                    cut_hi = np.minimum(hi[node], part * step + step - 1)
                    core = span_hash(prefix, at - part * step,
                                     at - (part * step + step - 1) + length)
                    core = _with_range(core, part, np.full(len(part), step))
                    hull = _with_range(span_hash(prefix, at - cut_hi, at - cut_lo + length),
                                       cut_lo, cut_hi)
                    yield _batch(keys[a:b][of[node]], pos[node], cut_lo, cut_hi, core, hull,
                                 weight[node])

    return emit


def refine(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(settled repeats, nodes to refine) of nodes in buckets by their cores.

    A node of weight 2 stands for a settled class, which is only compared with.
    """
    # both sides of each join below are read tables: a hot core's rows can be split
    shared = staged(nodes.groupBy("core").agg(F.sum("weight").alias("n")).where("n > 1")
                    .select("core"), "shared-cores")
    live = staged(nodes.join(shared, "core", "left_semi"), "live-nodes")
    rep = F.min(F.struct("text_key", "pos", "lo", "hi")).alias("rep")
    hulls = staged(live.groupBy("core", "hull").agg(F.sum("weight").alias("n"), rep), "hulls")
    repeats = live.where("weight = 1").join(
        hulls.where("n > 1").select("core", "hull"), ["core", "hull"], "left_semi"
    ).select("text_key", "pos", "lo", "hi")
    open_ = staged(hulls.where("n = 1").select("core").distinct(), "open-cores")
    on = hulls.join(open_, "core", "left_semi").select(
        "rep.*", F.least(F.lit(2), "n").alias("weight"))
    return repeats, on


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK,
                   units=byte_units) -> DataFrame:
    """``(text_key, spans)`` of the texts with repeats in ``docs`` (text_key, text).

    ``spans`` lists (start, stop) of runs of bytes in strings of ``length`` bytes
    that occur at two positions or more; they may overlap.  Every row counts.
    With ``word_hashes`` as ``units``, all these are words instead.
    """
    if (length - gram + 1) % block:
        raise ValueError("the blocks must divide the offsets")
    nodes = staged(docs.mapInArrow(_first_nodes(length, gram, units), _NODE), "anchors")
    found, on = refine(nodes)
    texts = None
    for step in (block, 1):
        on = staged(on, "open-nodes")
        if texts is None:
            keys = staged(on.select("text_key").distinct(), "open-texts")
            texts = staged(docs.join(sized(keys), "text_key", "left_semi")
                           .dropDuplicates(["text_key"]), "texts")
        by_text = on.groupBy("text_key").agg(
            F.collect_list(F.struct("pos", "lo", "hi", "weight")).alias("nodes"))
        nodes = staged(texts.join(by_text, "text_key").select("text_key", "text", "nodes")
                       .mapInArrow(_finer(step, length, units), _NODE), "finer-nodes")
        more, on = refine(nodes)
        found = found.unionByName(more)
    span = F.struct((F.col("pos") - F.col("hi")).alias("start"),
                    (F.col("pos") - F.col("lo") + length).alias("stop"))
    return found.select("text_key", span.alias("span")).groupBy("text_key").agg(
        F.collect_set("span").alias("spans"))


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs that spans (n, 2) cover."""
    if not len(spans):
        return []
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(spans)) - 1
    return list(zip(spans[first, 0].tolist(), reach[last].tolist(), strict=True))


def covered(spans):
    """Column: how many positions an array of spans covers."""
    zero = F.lit(0).cast("long")
    return F.aggregate(
        F.array_sort(spans), F.struct(zero.alias("reach"), zero.alias("n")),
        lambda acc, span: F.struct(
            F.greatest(acc["reach"], span["stop"]).alias("reach"),
            (acc["n"] + F.greatest(zero, span["stop"] - F.greatest(acc["reach"], span["start"])))
            .alias("n")),
        lambda acc: acc["n"])


def _cut(carried: list[str]):
    def emit(batches):
        for batch in batches:
            lists = batch.column("spans")
            out = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                raw, own = text.encode(), lists[i].values
                runs = merged(np.stack([own.field(0).to_numpy(), own.field(1).to_numpy()], 1))
                edges = [0, *(x for run in runs for x in run), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(raw), len(raw) - len(kept), len(runs), kept,
                            hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(c, pa.int64()) for c in columns[:3]),
                 pa.array(columns[3], pa.binary()), pa.array(columns[4], pa.string()),
                 *(batch.column(c) for c in carried)],
                ["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", *carried])

    return emit


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   length: int = LENGTH, gram: int = GRAM, block: int = BLOCK,
                   passages: tuple[int, int, int] | None = None) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept, kept_sha256)`` of every row of ``docs``.

    Every byte in a string of ``length`` bytes that starts at another position
    too, in whichever row, is removed; ``kept`` holds the other bytes (it need
    not be UTF-8) and ``n_spans`` counts the runs removed.  NULL texts are empty;
    shorter texts stay whole.  Repeated rows repeat all their strings.  Ids are
    only carried, so they may be NULL or repeated; other columns are ignored.

    With ``passages`` (words, gram, block in words), ``n_repeat_words`` follows:
    the words in strings of so many words that start at another position too, in
    whichever row.  These may be shorter than ``length`` and are only counted.
    """
    text = text_or_empty(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"),
                       text.alias("text"))
    texts = rows.select("text_key", "text")
    marks = staged(repeated_spans(texts, length, gram, block), "spans")
    carried = []
    zero = F.lit(0).cast("long")
    if passages:
        carried = ["n_repeat_words"]
        none = F.array().cast(marks.schema["spans"].dataType)
        words = repeated_spans(texts, *passages, units=word_hashes).select(
            "text_key", covered(F.col("spans")).alias("n_repeat_words"))
        marks = staged(marks.join(words, "text_key", "full").select(
            "text_key", F.coalesce("spans", none).alias("spans"),
            F.coalesce("n_repeat_words", zero).alias("n_repeat_words")), "marks")
    kind = rows.schema["id"].dataType.simpleString()
    keys = sized(marks.select("text_key"))
    cut = (rows.join(keys, "text_key", "left_semi").join(marks, "text_key")
           .select("id", "text", "spans", *carried)
           .mapInArrow(_cut(carried), ", ".join(
               [f"id {kind}, n_bytes long, n_removed long, n_spans long, "
                "kept binary, kept_sha256 string", *(f"{c} long" for c in carried)])))
    whole = rows.join(keys, "text_key", "left_anti").select(
        "id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"),
        zero.alias("n_spans"), F.col("text").cast("binary").alias("kept"),
        F.sha2("text", 256).alias("kept_sha256"), *(zero.alias(c) for c in carried))
    return cut.unionByName(whole).withColumnRenamed("id", id_col)
