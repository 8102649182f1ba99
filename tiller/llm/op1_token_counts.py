"""Token counts with overlap resynchronisation for huge texts.

A text of more than ``huge_chars`` characters is encoded in overlapping chunks
with offsets.  Neighbouring chunks are spliced at a boundary that both encodings
have, that white space proves to be one for the whole text (no token crosses
white space), and after which both agree on the ids to the end of the overlap.
Where they have none, the overlap is widened and the chunk encoded again, in the
end up to the whole rest of the text, so every text gets its exact count.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiller.llm.common import slices, text_or_empty
from tiller.llm.tokens import piece_encoder, tokenizer

HUGE_CHARS = 32_768
CHUNK_CHARS = 16_384
OVERLAP_CHARS = 128
#: Tokens that both encodings must share from a boundary on.
AGREE = 3


def _encoded(library, text: str, start: int, end: int) -> list[tuple[int, int]]:
    """(offset in the whole text, id) of the tokens of ``text[start:end]``."""
    got = library.encode(text[start:end], add_special_tokens=False)
    return [(start + a, i) for (a, _), i in zip(got.offsets, got.ids, strict=True)]


def common_boundary(text: str, left: list[tuple[int, int]], right: list[tuple[int, int]],
                    start: int, end: int, agree: int = AGREE) -> int | None:
    """A stable boundary of both encodings within ``text[start:end]``, or None.

    ``left`` ends at ``end`` and ``right`` begins at ``start``.  A boundary is
    the offset of a token after a space or line end from which on ``agree``
    tokens are the same in both.
    """
    a, b = bisect_left(left, (start, -1)), 0
    tail = left[a:]
    while len(tail) >= agree and b + agree <= len(right) and right[b][0] < end:
        at = right[b][0]
        if at > start and text[at - 1] in " \n":
            k = bisect_left(tail, (at, -1))
            if k + agree <= len(tail) and tail[k : k + agree] == right[b : b + agree]:
                return at
        b += 1
    return None


def resync_ids(library, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS
               ) -> Iterator[list[int]]:
    """Ids of a whole text, in runs that each come from one chunk."""
    start, end = 0, min(len(text), chunk)
    left = _encoded(library, text, start, end)
    while end < len(text):
        wide = overlap
        while True:
            begin = max(start, end - wide)
            after = min(len(text), end + chunk)
            if begin == start:
                # nothing left to align with: take this chunk and the next as one
                left, end = _encoded(library, text, start, after), after
                break
            right = _encoded(library, text, begin, after)
            at = common_boundary(text, left, right, begin, end)
            if at is not None:
                yield [i for o, i in left if o < at]
                left, start, end = [x for x in right if x[0] >= at], at, after
                break
            wide *= 2
            chunk = max(chunk, 2 * wide)
    yield [i for _, i in left]


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id",
                 text_col: str = "text", huge_chars: int = HUGE_CHARS,
                 chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """``(id, n_bytes, n_tokens)`` of every row of ``docs``.

    ``vocabulary`` is the path of a tokenizer file that every worker can read.
    NULL and empty texts have no token.  Repeated rows each give a row; other
    columns are ignored, and no rows give no rows.  A text without white space
    is encoded as one piece, whatever its length.
    """

    def count(batches):
        encoder = piece_encoder(vocabulary)
        library = tokenizer(vocabulary)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = [0] * len(texts)
            short = [i for i, t in enumerate(texts) if len(t) <= huge_chars]
            for a, b in slices([texts[i] for i in short]):
                some = short[a:b]
                for i, ids in zip(some, encoder.encode([texts[i] for i in some]), strict=True):
                    counts[i] = len(ids) // 4
            for i, t in enumerate(texts):
                if len(t) > huge_chars:
                    counts[i] = sum(map(len, resync_ids(library, t, chunk_chars, overlap_chars)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                ["id", "n_bytes", "n_tokens"])

    text = text_or_empty(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"),
                       F.octet_length(text).cast("long").alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    return (rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
            .withColumnRenamed("id", id_col))
