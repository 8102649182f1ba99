"""What the operators on vectors share: reading list columns, sums over all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Components that one numpy pass handles; bounds a task's memory.
SLICE_CELLS = 1 << 19
#: Groups in which partial sums meet before the driver adds them.
SUM_GROUPS = 16


def element_type(df: DataFrame, vec_col: str) -> np.dtype:
    """Single precision for arrays of floats, double for all other numbers."""
    kind = df.schema[vec_col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    return np.dtype("<f4" if single else "<f8")


def dimension(df: DataFrame, vec_col: str) -> int:
    """The most common length of the vectors (ties: the smallest); 0 if there is none."""
    sizes = (df.select(F.size(vec_col).alias("n")).where("n > 0")
             .groupBy("n").agg(F.count(F.lit(1)).alias("rows")))
    most = sizes.orderBy(F.desc("rows"), "n").limit(1).collect()
    return most[0]["n"] if most else 0


def row_slices(rows: int, dim: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``SLICE_CELLS`` components."""
    step = max(1, SLICE_CELLS // max(1, dim))
    for a in range(0, rows, step):
        yield a, min(rows, a + step)


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold ``dim`` finite components, and these rows as doubles."""
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # NULL: NaN
    first = np.cumsum(length) - length
    fits = (length == dim) & (dim > 0)
    out = values[first[fits][:, None] + np.arange(dim)]
    good = np.isfinite(out).all(axis=1)
    fits[fits] = good
    return fits, out[good]


def binary_matrix(column: pa.Array, dtype, dim: int) -> np.ndarray:
    """Rows of a binary column, all of ``dim`` values."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, dim)


def integer_rows(df: DataFrame, vec_col: str, dim: int, scale: int, limit: int,
                 keep: list[str]) -> DataFrame:
    """``(*keep, x)``: floor(scale * component) of the rows with ``dim`` finite components.

    ``x`` holds them as little-endian 32-bit integers.  Components beyond
    ``limit`` are an error: sums of them would not be exact.
    """
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{c}` {fields[c]}" for c in keep), "x binary"])

    def emit(batches):
        for batch in batches:
            for a, b in row_slices(batch.num_rows, dim):
                part = batch.slice(a, b - a)
                fits, values = matrix(part.column(len(keep)), dim)
                x = np.floor(scale * values) + 0.0
                if x.size and np.abs(x).max() >= limit:
                    raise ValueError(f"a component is {limit / scale:g} or more")
                rows = part.filter(pa.array(fits))
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(i) for i in range(len(keep))),
                     pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary())], [*keep, "x"])

    return df.select(*keep, F.col(vec_col).alias("_vector")).mapInArrow(emit, schema)


def summed(df: DataFrame, partial: Callable, dtype) -> np.ndarray | None:
    """Sum over all partitions of the arrays that ``partial(batches)`` returns.

    A partition gives one array (or None for nothing), whose size does not depend
    on its rows; ``SUM_GROUPS`` tasks add those of their partitions in the order
    of the partitions, so a sum of doubles is the same in every run, and the
    driver adds what is left.
    """
    dtype = np.dtype(dtype)

    def first(batches):
        total = partial(batches)
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()),
                 pa.array([np.ascontiguousarray(total, dtype).tobytes()], pa.binary())],
                ["part", "sums"])

    def second(batches):
        total, part = None, 0
        for batch in batches:
            for number, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(raw, dtype)
                total, part = (own.copy(), number) if total is None else (total + own, part)
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                ["part", "sums"])

    schema = "part int, sums binary"
    groups = (df.mapInArrow(first, schema).repartition(SUM_GROUPS, "part")
              .sortWithinPartitions("part").mapInArrow(second, schema))
    found = [np.frombuffer(r["sums"], dtype) for r in sorted(groups.collect())]
    return np.sum(found, axis=0, dtype=dtype) if found else None
