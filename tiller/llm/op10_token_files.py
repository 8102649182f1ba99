"""Token ids of a corpus as Simple-8b coded binary files, written and read by Spark.

Every text is encoded where it was read; its ids, with the end id, become
Simple-8b words.  Only those words are shuffled: to shards by ranges of the
document id, in ascending order.  A shard's documents are laid end to end in
rows of about ``row_words`` words, the rows of a binary Parquet column, which
Spark's writer commits, so a lost task leaves nothing behind.

A row holds the shard and its position there, the ids, lengths and block word
counts of its documents and the words; a reader decodes a row in one numpy pass,
or one document or block alone by the word counts.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tiller.llm import simple8b
from tiller.llm.common import shared_dir, slices, text_or_empty, text_slices
from tiller.llm.tokens import piece_encoder

END_ID = 2
ROW_WORDS = 1 << 17
#: Documents a shard should hold, and the most shards.
SHARD_DOCS, MOST_SHARDS = 4_000, 10_000
SLICE = 1 << 19

ROWS = ("shard int, nth long, doc_ids array<long>, lengths array<long>, "
        "blocks array<int>, words binary")


def _coded(bounds: np.ndarray, vocabulary: str, end_id: int):
    end = np.asarray([end_id], "<u4").tobytes()

    def encode(batches):
        encoder = piece_encoder(vocabulary)
        for batch in batches:
            keys = batch.column("doc_id").to_numpy(zero_copy_only=False)
            shards = np.searchsorted(bounds, np.nan_to_num(keys.astype(np.float64), nan=-np.inf))
            for a, b, texts in text_slices(batch.column("text"), SLICE):
                raw = [ids + end for ids in encoder.encode([t.decode() for t in texts])]
                lengths = np.asarray([len(r) // 4 for r in raw])
                words, blocks = simple8b.encode(np.frombuffer(b"".join(raw), "<u4"), lengths)
                n_blocks = -(-lengths // simple8b.BLOCK)
                last = np.cumsum(n_blocks)
                cut = np.concatenate(([0], np.cumsum(blocks)))[np.concatenate(([0], last))]
                data, counts = words.astype("<u8").tobytes(), blocks.astype("<u2")
                yield pa.RecordBatch.from_arrays([
                    pa.array(shards[a:b], pa.int32()), batch.column("doc_id")[a:b],
                    pa.array(lengths, pa.int64()),
                    pa.array([counts[e - k : e].tobytes() for k, e in
                              zip(n_blocks.tolist(), last.tolist(), strict=True)], pa.binary()),
                    pa.array([data[8 * x : 8 * y] for x, y in
                              zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary()),
                ], ["shard", "doc_id", "length", "blocks", "words"])

    return encode


def _rows(row_words: int):
    """Lays a shard's documents, which come in order, end to end."""

    def pack(batches):
        held: list[tuple] = []
        size, nth, shard = 0, 0, None

        def row():
            keys, lengths, blocks, words = zip(*held, strict=True)
            counts = np.frombuffer(b"".join(blocks), "<u2")
            return pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([nth], pa.int64()),
                pa.array([list(keys)], pa.list_(pa.int64())),
                pa.array([list(lengths)], pa.list_(pa.int64())),
                pa.array([counts.astype(np.int32)], pa.list_(pa.int32())),
                pa.array([b"".join(words)], pa.binary()),
            ], ["shard", "nth", "doc_ids", "lengths", "blocks", "words"])

        for batch in batches:
            columns = [batch.column(c).to_pylist()
                       for c in ("shard", "doc_id", "length", "blocks", "words")]
            for s, *document in zip(*columns, strict=True):
                if held and (s != shard or size >= 8 * row_words):
                    yield row()
                    held, size, nth = [], 0, nth + 1
                if s != shard:
                    shard, nth = s, 0
                held.append(tuple(document))
                size += len(document[3])
        if held:
            yield row()

    return pack


def write_token_files(docs: DataFrame, vocabulary: str, path: str, id_col: str = "doc_id",
                      text_col: str = "text", end_id: int = END_ID, shards: int | None = None,
                      row_words: int = ROW_WORDS) -> None:
    """Write the coded ids of every row of ``docs`` under ``path``.

    NULL and empty texts have the end id alone.  A NULL document id sorts first.
    Repeated document ids stay rows of their own, ordered by their coded ids.
    Other columns are ignored; an empty table writes an empty set of rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       text_or_empty(F.col(text_col)).alias("text"))
    if shards is None:
        shards = max(1, min(MOST_SHARDS, -(-rows.count() // SHARD_DOCS)))
    bounds = rows.select("doc_id").na.drop().approxQuantile(
        "doc_id", [k / shards for k in range(1, shards)], 0.1 / shards) if shards > 1 else []
    coded = rows.mapInArrow(
        _coded(np.unique(np.asarray(bounds, np.float64)), vocabulary, end_id),
        "shard int, doc_id long, length long, blocks binary, words binary")
    (coded.repartitionById(shards, "shard").sortWithinPartitions("shard", "doc_id", "length", "words")
     .mapInArrow(_rows(row_words), ROWS).write.option("compression", "none").parquet(path))


def _decoded(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            shard, nth, keys, lengths, blocks, words = (
                batch.column(c)[i].as_py()
                for c in ("shard", "nth", "doc_ids", "lengths", "blocks", "words"))
            words, blocks = np.frombuffer(words, "<u8"), np.asarray(blocks, np.int64)
            lengths = np.asarray(lengths, np.int64)
            ends = np.cumsum(-(-lengths // simple8b.BLOCK))
            word_ends = np.cumsum(blocks)[ends - 1].tolist() if len(ends) else []
            # documents in runs: bounds what is decoded at once
            before = np.cumsum(lengths) - lengths
            first_word = 0
            for a, b in slices(lengths.tolist(), size=int, most=1 << 18):
                ids = simple8b.decode(words[first_word : word_ends[b - 1]]).astype("<u4")
                first_word = word_ends[b - 1]
                raw, edges = ids.tobytes(), np.concatenate(([0], np.cumsum(lengths[a:b] * 4)))
                pieces = [raw[x:y] for x, y in
                          zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard] * (b - a), pa.int32()), pa.array([nth] * (b - a), pa.int64()),
                    pa.array(keys[a:b], pa.int64()), pa.array(before[a:b], pa.int64()),
                    pa.array(lengths[a:b], pa.int64()), pa.array(pieces, pa.binary()),
                ], ["shard", "nth", "doc_id", "before", "n_tokens", "ids"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``(shard, nth, doc_id, before, n_tokens, ids)`` of every document in the files.

    ``before`` counts the ids ahead of it in its row; ``ids`` holds little-endian
    unsigned 32-bit integers.
    """
    return spark.read.schema(ROWS).parquet(path).mapInArrow(
        _decoded, "shard int, nth long, doc_id long, before long, n_tokens long, ids binary")


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files.

    ``start`` counts the ids of all documents before it.  Lengths add up from
    file rows to shards to the whole, so the one unpartitioned window sees a row
    for each shard, at most MOST_SHARDS.
    """
    def checked(batches):
        for batch in _decoded(batches):
            sums = [zlib.crc32(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("shard", "nth", "doc_id", "before", "n_tokens")),
                 pa.array(sums, pa.int64())],
                ["shard", "nth", "doc_id", "before", "n_tokens", "ids_crc32"])

    files = spark.read.schema(ROWS).parquet(path)
    sizes = files.select("shard", "nth", F.aggregate(
        "lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    shard_start = sizes.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", (
        F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    row_start = sizes.select("shard", "nth", (F.sum("n").over(
        Window.partitionBy("shard").orderBy("nth")) - F.col("n")).alias("row_start"))
    starts = row_start.join(shard_start, "shard")
    documents = files.mapInArrow(checked, "shard int, nth long, doc_id long, before long, "
                                          "n_tokens long, ids_crc32 long")
    return documents.join(starts, ["shard", "nth"]).select(
        "doc_id", (F.col("shard_start") + F.col("row_start") + F.col("before")).alias("start"),
        "n_tokens", "ids_crc32")


def new_path(spark: SparkSession) -> str:
    """A fresh folder for token files in the shared one."""
    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
