"""What the corpus operators share: table access, scratch tables, word hashes."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of text that one numpy pass handles; bounds a task's memory.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers this package, as ``--py-files`` would; once an application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp()) / f"corpus_operators_{uuid.uuid4().hex[:8]}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for name in [package.parent / "__init__.py", *package.glob("*.py")]:
                z.write(name, name.relative_to(package.parent.parent))
        spark.sparkContext.addPyFile(str(archive))
        _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` when the cluster names it; a session without it
    (tests) uses its warehouse, which is shared as well.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage: a lost executor costs a reread, not a recomputation.
    The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few numbers each that may be broadcast: some tens of MB at most.
BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A staged table, broadcast if it is counted and small; shuffled beyond that."""
    return F.broadcast(df) if df.count() <= rows else df


def lower_az(col):
    """A-Z in lower case, every other character as it is."""
    ascii_only = F.octet_length(col) == F.char_length(col)
    return F.when(ascii_only, F.lower(col)).otherwise(F.translate(col, _UPPER, _LOWER))


def text_or_empty(col):
    """NULL texts count as empty."""
    return F.coalesce(col, F.lit(""))


def slices(values: Iterable, size=len, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of ``values`` of about ``most`` bytes each (one value at least)."""
    start = held = 0
    n = 0
    for n, v in enumerate(values, 1):
        held += size(v)
        if held >= most:
            yield start, n
            start, held = n, 0
    if start < n:
        yield start, n


_tables: dict[tuple[str, str], object] = {}


def kept(owner: str, name: str, make):
    """A table that a worker keeps between its tasks, for one owner at a time.

    What another kind of operator left there is dropped first, so a pipeline's
    stages do not add up in the workers' memory.
    """
    for key in [k for k in _tables if k[0] != owner]:
        del _tables[key]
    if (owner, name) not in _tables:
        _tables[owner, name] = make()
    return _tables[owner, name]


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """Ranges of a batch's texts of about ``most`` bytes, and the texts as bytes (NULL: empty)."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for a, b in slices(sizes, size=int, most=most):
        yield a, b, [t or b"" for t in column[a:b].cast(pa.binary()).to_pylist()]


# --- vectorised 64-bit hashes -------------------------------------------------

_STEP = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash's base and of its inverse (mod 2^64)."""
    held = kept("hashes", "powers", dict)
    if len(held.get("up", ())) < n:
        size = max(n, SLICE_BYTES + (SLICE_BYTES >> 2))
        for key, base in (("up", _STEP), ("down", _INVERSE)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            held[key] = np.multiply.accumulate(row)
    return held["up"][:n], held["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which :func:`span_hash` gets any span's hash (of bytes, or of hashes)."""
    out = np.zeros(len(data) + 1, np.uint64)
    up, _ = powers(max(1, len(data)))
    values = _BYTE[data] if data.dtype == np.uint8 else data
    np.cumsum(values * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes ``start:end``; equal bytes give equal hashes wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] ^ (end - start).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, one after another, and each text's first word.

    Words are runs of bytes other than \\x20 and \\x09-\\x0D.  The second array
    has one entry more than there are texts.
    """
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    gap = _SPACE[data]
    starts = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    ends = np.flatnonzero(gap & np.concatenate(([False], ~gap[:-1])))
    at = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
    return span_hash(prefix_hash(data), starts, ends), np.searchsorted(starts, at)
