"""Quality classifier: random-indexing vectors, pooled, and a small numpy network.

Every word has a sparse index vector of signs that its hash gives.  A word's
context vector is the sum of the index vectors of its neighbours in the whole
corpus; words share a fixed number of hashed rows, so a task's sums, the shuffled
partial sums and the table sent back to the tasks have a fixed size while all
texts count.  Each word is read twice, as it is and by its shape (runs of small
letters, capitals, digits, each sign), and both have vectors.

A document is the mean and spread of its vectors and the likeness of neighbours.
A two-layer network is fitted on a bounded, seeded sample of labelled documents,
its temperature on a part of them that the fit leaves out, and every document is
scored where it is read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiller.llm.common import mix, staged, text_or_empty, text_slices, word_hashes

ROWS, DIMS = 1 << 14, 32
#: Neighbours on either side.
REACH = 2
#: Labelled documents that the fit takes at most, and the part that calibrates.
TRAIN_ROWS, CALIBRATE = 20_000, 0.2
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 25, 256, 2e-3, 1e-4
SEED = 11
#: Bytes of text whose vectors a task holds at once.
SLICE = 1 << 18
CUTOFF = 0.7

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[128:] = ord("a")
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True


def shapes(text: bytes) -> bytes:
    """The text with every run of one kind of character within a word as one character."""
    data = _SHAPE[np.frombuffer(text, np.uint8)]
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != data[:-1]) | _BLANK[data[1:]]
    return data[keep].tobytes()


def streams(raw: list[bytes]):
    """Word and shape hashes of texts, with each text's first word."""
    yield word_hashes(raw)
    yield word_hashes([shapes(r) for r in raw])


def _index(hashes: np.ndarray):
    """The two signed dimensions of the words' index vectors."""
    h = mix(hashes)
    for shift in (0, 16):
        part = h >> np.uint64(shift)
        yield ((part % np.uint64(DIMS)).astype(np.int64),
               np.where(part >> np.uint64(8) & np.uint64(1), 1.0, -1.0))


def _row(hashes: np.ndarray, stream: int) -> np.ndarray:
    return (hashes >> np.uint64(50)).astype(np.int64) + stream * ROWS


def context_sums(raw: list[bytes], sums: np.ndarray) -> None:
    """Add the texts' neighbours to ``sums`` (2 * ROWS, DIMS)."""
    flat = sums.reshape(-1)
    for stream, (hashes, first) in enumerate(streams(raw)):
        text = np.repeat(np.arange(len(raw)), np.diff(first))
        rows = _row(hashes, stream) * DIMS
        lo = stream * ROWS * DIMS
        for dim, sign in _index(hashes):
            for gap in range(1, REACH + 1):
                same = text[gap:] == text[:-gap]
                for at, of in ((slice(None, -gap), slice(gap, None)),
                               (slice(gap, None), slice(None, -gap))):
                    where = (rows[at] + dim[of])[same] - lo
                    flat[lo : lo + ROWS * DIMS] += np.bincount(
                        where, sign[of][same], ROWS * DIMS)


def _sums(batches):
    sums = np.zeros((2 * ROWS, DIMS))
    for batch in batches:
        for _, _, raw in text_slices(batch.column("text"), SLICE):
            context_sums(raw, sums)
    used = np.flatnonzero(sums.any(axis=1))
    for a in range(0, len(used), 4096):
        some = used[a : a + 4096]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), *(pa.array(c) for c in sums[some].T.astype(np.int64))],
            ["row", *(f"d{i}" for i in range(DIMS))])


def word_vectors(texts: DataFrame) -> np.ndarray:
    """Unit context vectors (2 * ROWS, DIMS) over all of ``texts``; unused rows are zero."""
    columns = [f"d{i}" for i in range(DIMS)]
    parts = texts.select("text").mapInArrow(
        _sums, "row long, " + ", ".join(f"{c} long" for c in columns))
    total = parts.groupBy("row").agg(*(F.sum(c).alias(c) for c in columns)).toPandas()
    vectors = np.zeros((2 * ROWS, DIMS), np.float32)
    if len(total):
        vectors[total["row"].to_numpy()] = total[columns].to_numpy(np.float32)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norm, out=vectors, where=norm > 0)


#: For each stream: mean, spread, likeness of neighbours at 1 and 2, equal
#: neighbours, distinct words; and the length.
N_FEATURES = 2 * (2 * DIMS + 4) + 1


def document_features(raw: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Pooled features (n, N_FEATURES); zeros for texts without words."""
    out = []
    n = len(raw)
    for stream, (hashes, first) in enumerate(streams(raw)):
        count = np.diff(first)
        text = np.repeat(np.arange(n), count)
        own = vectors[_row(hashes, stream)]
        held = np.maximum(count, 1)[:, None]

        def pooled(x, edges=first[:-1], count=count, held=held):
            # wordless texts at the end start behind the last word: a zero row is there
            x = np.concatenate((x, np.zeros((1, x.shape[1]), x.dtype)))
            return np.where(count[:, None] > 0, np.add.reduceat(x, edges, axis=0), 0) / held

        mean = pooled(own)
        spread = np.sqrt(np.maximum(pooled(own * own) - mean * mean, 0))
        columns = []
        for gap in (1, 2):
            like = np.zeros(len(own), np.float32)
            if len(own) > gap:
                same = text[gap:] == text[:-gap]
                like[gap:] = np.einsum("ij,ij->i", own[gap:], own[:-gap]) * same
            columns.append(pooled(like[:, None]))
        equal = np.zeros(len(own), np.float32)
        if len(own) > 1:
            equal[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
        columns.append(pooled(equal[:, None]))
        order = np.lexsort((hashes, text))
        new = np.ones(len(own), np.float32)
        if len(own) > 1:
            new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (text[order][1:] != text[order][:-1])
        columns.append(pooled(new[:, None]))
        out += [mean, spread, *columns]
    out.append(np.log1p(count)[:, None] / 10)
    return np.hstack(out).astype(np.float32)


def _features(shared):
    def emit(batches):
        vectors = shared.value
        for batch in batches:
            for a, b, raw in text_slices(batch.column("text"), SLICE):
                rows = document_features(raw, vectors).astype("<f4")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[a:b], pa.array([r.tobytes() for r in rows], pa.binary())],
                    ["id", "features"])

    return emit


class Network:
    """Two layers, a tanh between them, and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        hold = rng.random(len(x)) < CALIBRATE
        if len(set(y[~hold])) < 2 or len(set(y[hold])) < 2:
            hold[:] = False
        fit_x, fit_y = x[~hold], y[~hold]
        self.mean, self.scale = fit_x.mean(0), fit_x.std(0) + 1e-3
        self.layers = [rng.normal(0, n ** -0.5, (n, m)) for n, m in ((x.shape[1], HIDDEN), (HIDDEN, 1))]
        self.biases = [np.zeros(HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        z = (fit_x - self.mean) / self.scale
        parameters = [*self.layers, *self.biases]
        first, second = ([np.zeros_like(p) for p in parameters] for _ in range(2))
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(z))
            for a in range(0, len(z), BATCH):
                some = order[a : a + BATCH]
                h = np.tanh(z[some] @ self.layers[0] + self.biases[0])
                logit = (h @ self.layers[1] + self.biases[1])[:, 0]
                error = ((_sigmoid(logit) - fit_y[some]) / len(some))[:, None]
                back = error @ self.layers[1].T * (1 - h * h)
                slopes = [z[some].T @ back + DECAY * self.layers[0],
                          h.T @ error + DECAY * self.layers[1], back.sum(0), error.sum(0)]
                step += 1
                for p, g, m, v in zip(parameters, slopes, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        if hold.any():
            logits, truth = self.logits(x[hold]), y[hold]
            trial = np.exp(np.linspace(-2, 3, 101))
            loss = [np.logaddexp(0, np.where(truth > 0, -logits, logits) / t).mean() for t in trial]
            self.temperature = float(trial[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh((x - self.mean) / self.scale @ self.layers[0] + self.biases[0])
        return (h @ self.layers[1] + self.biases[1])[:, 0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


class Constant:
    """The model when labels of one kind, or none, are known: their share, 1 for none."""

    def __init__(self, y: np.ndarray):
        self.share = float(y.mean()) if len(y) else 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -x))


def _scored(shared, model, text_col: str):
    def emit(batches):
        vectors = shared.value
        for batch in batches:
            texts = batch.column("row").field(text_col)
            scores = [model.scores(document_features(raw, vectors).astype(np.float64))
                      for _, _, raw in text_slices(texts, SLICE)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(np.concatenate(scores) if scores else [], pa.float64())],
                ["row", "score"])

    return emit


def add_scores(docs: DataFrame, labels: DataFrame, trains: Column, id_col: str = "doc_id",
               text_col: str = "text", label_col: str = "quality", score_col: str = "score",
               train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` with ``score_col``: the calibrated probability of label 1.

    ``trains`` tells, from the column ``id``, the documents whose labels may be
    learnt; at most ``train_rows`` of them are, in the order of a seeded hash.
    Labels other than 0 and 1 are ignored; of several for one document the
    smallest holds.  Without labels of both kinds every score is their share of
    ones, 1 if there are none (nothing speaks against a text).  NULL and empty texts have a score like any;
    repeated rows each give a row.  Only the text is an input of a score.  All
    columns stay; one that is named as ``score_col`` is replaced.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    vectors = spark.sparkContext.broadcast(word_vectors(rows))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(
        F.col("label").isin(0, 1) & trains).groupBy("id").agg(F.min("label").alias("label"))
    # at most train_rows rows
    chosen = staged(known.join(rows.select("id").distinct(), "id", "left_semi")
                    .orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(train_rows), "train-labels")
    kind = rows.schema["id"].dataType.simpleString()
    sample = (rows.join(F.broadcast(chosen.select("id")), "id", "left_semi")
              .mapInArrow(_features(vectors), f"id {kind}, features binary")
              .join(F.broadcast(chosen), "id").groupBy("id")
              .agg(F.min("features").alias("features"), F.first("label").alias("label"))
              .orderBy("id").collect())
    x = np.frombuffer(b"".join(bytes(r["features"]) for r in sample), "<f4")
    x, y = x.reshape(-1, N_FEATURES).astype(np.float64), np.asarray([r["label"] for r in sample], float)
    model = Network(x, y) if len(set(y)) == 2 else Constant(y)
    names = [c for c in docs.columns if c != score_col]
    packed = docs.select(F.struct(*names).alias("row"))
    kind = packed.schema["row"].dataType.simpleString()
    scored = packed.mapInArrow(_scored(vectors, model, text_col), f"row {kind}, score double")
    return scored.select("row.*", F.col("score").alias(score_col))
