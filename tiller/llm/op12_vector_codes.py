"""Vector code compression: product codes by memoised grid cells.

Components become integers, so codebooks, codes and errors are exact and do not
depend on the order of sums.  A vector is cut into parts, each with a codebook of
its own.  To find the nearest entry, a part's coarse grid cell is looked up: the
first part that falls into a cell bounds, for the cell's box, every entry's
distance from below and above; entries whose lower bound exceeds the smallest
upper one are nearest nowhere in the box.  The others are kept for the cell, and
every part that falls into it is compared with those alone, exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiller.llm.common import sized, staged
from tiller.llm.vectors import binary_matrix, dimension, integer_rows, row_slices, summed

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Width of a grid cell, in integer units.
CELL = 1024
#: Cells that a task remembers for a part; it starts anew beyond that.
MOST_CELLS = 1 << 16
#: Components are smaller than this, so that squares and sums are exact.
LIMIT = 1 << 27


class Cells:
    """Entries of one codebook that can be nearest, by grid cell."""

    def __init__(self, entries: np.ndarray, width: int = CELL):
        self.entries, self.width = entries, width
        self.known: dict[bytes, np.ndarray] = {}
        self.evaluated = 0

    def _not_dominated(self, cells: np.ndarray) -> np.ndarray:
        """Entries whose least distance to a cell's box is within the least greatest one."""
        low = cells[:, None, :] * self.width - self.entries[None]
        high = low + (self.width - 1)
        outside = np.maximum(0, np.maximum(low, -high))
        far = np.maximum(np.abs(low), np.abs(high))
        least, most = (outside * outside).sum(axis=2), (far * far).sum(axis=2)
        return least <= most.min(axis=1, keepdims=True)

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """(rows, entries): which entries are compared with each row."""
        if not x.shape[1]:
            return np.ones((len(x), len(self.entries)), bool)
        cells = np.ascontiguousarray(np.floor_divide(x, self.width).astype("<i4"))
        names, first, of = np.unique(cells.view(np.dtype((np.void, cells.itemsize * cells.shape[1])))
                                     .ravel(), return_index=True, return_inverse=True)
        names = [n.tobytes() for n in names]
        missing = [i for i, n in enumerate(names) if n not in self.known]
        if len(self.known) + len(missing) > MOST_CELLS:
            self.known.clear()
            missing = list(range(len(names)))
        step = max(1, (1 << 17) // max(1, cells.shape[1]))
        for a in range(0, len(missing), step):
            own = missing[a : a + step]
            for i, mask in zip(own, self._not_dominated(cells[first[own]].astype(np.int64)),
                               strict=True):
                self.known[names[i]] = mask
        return np.stack([self.known[n] for n in names])[of]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's nearest entry (ties: the lower index) and its squared distance."""
        best = np.full(len(x), np.iinfo(np.int64).max)
        index = np.zeros(len(x), np.int64)
        open_ = self.candidates(x)
        self.evaluated += int(open_.sum())
        for e, entry in enumerate(self.entries):
            rows = np.flatnonzero(open_[:, e])
            gap = x[rows] - entry
            squared = (gap * gap).sum(axis=1)
            nearer = squared < best[rows]
            best[rows[nearer]], index[rows[nearer]] = squared[nearer], e
        return index, best


def cuts(dim: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """Consecutive parts; equal ones where ``parts`` divides the dimension."""
    edges = [dim * i // parts for i in range(parts + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _matrices(batches, dim: int):
    for batch in batches:
        for a, b in row_slices(batch.num_rows, dim):
            part = batch.slice(a, b - a)
            yield part, binary_matrix(part.column("x"), "<i4", dim).astype(np.int64)


def _sums(books: list[np.ndarray], dim: int):
    """Per part and entry: componentwise sums, then counts, of the parts nearest to it."""
    bounds, n = cuts(dim, len(books)), len(books[0])

    def partial(batches):
        cells = [Cells(book) for book in books]
        total, count = np.zeros((n, dim), np.int64), np.zeros((len(books), n), np.int64)
        for _, x in _matrices(batches, dim):
            for p, (a, b) in enumerate(bounds):
                index, _ = cells[p].nearest(np.ascontiguousarray(x[:, a:b]))
                count[p] += np.bincount(index, minlength=n)
                for e in range(n):
                    total[e, a:b] += x[index == e, a:b].sum(axis=0)
        return np.concatenate((total.ravel(), count.ravel())) if count.any() else None

    return partial


def _code(books: list[np.ndarray], dim: int):
    bounds = cuts(dim, len(books))

    def emit(batches):
        cells = [Cells(book) for book in books]
        for part, x in _matrices(batches, dim):
            codes, error = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x), np.int64)
            for p, (a, b) in enumerate(bounds):
                index, squared = cells[p].nearest(np.ascontiguousarray(x[:, a:b]))
                codes[:, p] = index
                error += squared
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("label"),
                 pa.array([row.tobytes().hex() for row in codes]), pa.array(error)],
                ["id", "label", "code", "error"])

    return emit


def learn(rows: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES,
          rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks of the ``(id, x)`` rows: an array (entry, place) for each part.

    They start with the rows of the smallest ids (ties: by content; NULL last).
    The driver holds the codebooks and their sums, whatever the number of rows.
    """
    first = rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    start = np.array([np.frombuffer(r["x"], "<i4") for r in first], np.int64).reshape(len(first), dim)
    books = [start[:, a:b] for a, b in cuts(dim, parts)]
    for _ in range(rounds if len(start) else 0):
        sums = summed(rows.select("x"), _sums(books, dim), np.int64)
        total = sums[: len(start) * dim].reshape(len(start), dim)
        count = sums[len(start) * dim :].reshape(parts, len(start))
        books = [np.where(n[:, None] > 0, total[:, a:b] // np.maximum(n, 1)[:, None], book)
                 for book, n, (a, b) in zip(books, count, cuts(dim, parts), strict=True)]
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist())
                          .encode()).hexdigest()


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                 label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES,
                 rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """``(id, code, error, label_error, codebooks_sha256)`` of every vector that can be coded.

    Left out are vectors that are NULL, hold a NULL or non-finite component or
    have another length than most (ties: the shorter); an empty table gives no
    rows.  Rows that share an id, or have none, are coded each.  A NULL label is
    a label.  Fewer vectors than ``entries`` give as many entries.  Parts are
    equal where ``parts`` divides the length, else they differ by one.  A
    component of 2^27 / ``scale`` or more is an error.  Other columns are ignored.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits")
    dim = dimension(vectors, vec_col)
    named = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"),
                           F.col(vec_col).alias("vector"))
    rows = staged(integer_rows(named, "vector", dim, scale, LIMIT, ["id", "label"]), "integers")
    books = learn(rows.select("id", "x"), dim, parts, entries, rounds)
    label = rows.schema["label"].dataType.simpleString()
    coded = staged(rows.mapInArrow(_code(books, dim), f"id long, label {label}, code string, "
                                   "error long"), "codes")
    totals = staged(coded.groupBy(F.col("label").alias("of")).agg(
        F.sum("error").alias("label_error")), "label-errors")
    return (coded.join(sized(totals), F.col("label").eqNullSafe(F.col("of")))
            .select(F.col("id").alias(id_col), "code", "error", "label_error",
                    F.lit(digest(books)).alias("codebooks_sha256")))
