"""Line dedup: lines that many documents share stay in one of them only.

Lines are normalised, hashed and exploded to one row for each document and key;
keys found in enough documents are joined back to the documents that hold them,
and the texts are put together again, by position, from the lines that stay.
Only hashes are shuffled for the counts; a hot line is one row for each map task
after partial aggregation, and the join back on it can be split.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiller.llm.common import SPACES, staged, text_or_empty

MIN_CHARS = 20
MIN_DOCS = 3


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """128-bit hash of a line's key; None for keys that are too short."""
    bare = line.strip(SPACES)
    if len(bare) < min_chars:
        return None
    return hashlib.blake2b(bare.encode().lower(), digest_size=16).digest()


def _keys(min_chars: int):
    def emit(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                counts, high = [], []
                for text in part.column("text").to_pylist():
                    own = {line_key(line, min_chars) for line in text.split("\n")}
                    own.discard(None)
                    high += own
                    counts.append(len(own))
                owners = pa.array(np.repeat(np.arange(len(counts)), counts))
                pair = np.frombuffer(b"".join(high), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(owners), part.column("text_key").take(owners),
                     pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())],
                    ["id", "text_key", "k1", "k2"])

    return emit


def _rebuild(min_chars: int):
    def emit(batches):
        for batch in batches:
            dropped = batch.column("dropped")
            texts = batch.column("text").to_pylist()
            n_lines, n_dropped, kept = [], [], []
            for i, text in enumerate(texts):
                lines = text.split("\n")
                n_lines.append(len(lines))
                if dropped[i].is_valid:
                    gone = {np.array([d["k1"], d["k2"]], "<i8").tobytes()
                            for d in dropped[i].as_py()}
                    stay = [line for line in lines if line_key(line, min_chars) not in gone]
                    n_dropped.append(len(lines) - len(stay))
                    kept.append("\n".join(stay))
                else:
                    n_dropped.append(0)
                    kept.append(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()),
                 pa.array(kept, pa.string())], ["id", "n_lines", "n_dropped", "text"])

    return emit


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(id, n_lines, n_dropped, text)`` of every row, ``text`` without dropped lines.

    A line's key is the line stripped of white space with A-Z in lower case.  A
    key of ``min_chars`` characters or more that ``min_docs`` documents hold
    loses its lines everywhere but in the document with the largest id; there
    all of them stay.  A NULL text is an empty one, with one empty line.  Rows
    that share an id are one document (each still gives a row); a NULL id
    counts as one document, below all others.  Other columns are ignored.

    The keys that a text loses are gathered by id and text, so a list is never
    longer than the text it belongs to, however many rows share an id.
    """
    text = text_or_empty(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"),
                       F.xxhash64(text).alias("text_key"))
    kind = rows.schema["id"].dataType.simpleString()
    held = staged(rows.mapInArrow(
        _keys(min_chars), f"id {kind}, text_key long, k1 long, k2 long"), "line-keys")
    # a read table, so that the rows of a hot line can be split in the join
    shared = staged(held.select("id", "k1", "k2").distinct().groupBy("k1", "k2")
                    .agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("keeper"))
                    .where(F.col("n_docs") >= min_docs), "shared-lines")
    dropped = (held.join(shared, ["k1", "k2"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
               .groupBy(F.col("id").alias("of"), F.col("text_key").alias("of_text"))
               .agg(F.collect_set(F.struct("k1", "k2")).alias("dropped")))
    joined = rows.join(dropped, F.col("id").eqNullSafe(F.col("of"))
                       & (F.col("text_key") == F.col("of_text")), "left")
    return (joined.select("id", "text", "dropped")
            .mapInArrow(_rebuild(min_chars), f"id {kind}, n_lines long, n_dropped long, text string")
            .withColumnRenamed("id", id_col))
