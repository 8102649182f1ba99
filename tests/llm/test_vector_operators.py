import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tiller.llm import op11_embedding_dedup as near
from tiller.llm import op12_vector_codes as codes
from tiller.llm import op13_whitening as white

SCHEMA = ("vec_id long, embedding array<float>, label string, class long, component int, n string, "
          "x int, key string, vector string, size int")
CLASH = (1, 2, "n", 3, "k", "v", None)
DIM = 16


def odd_rows(vectors):
    """Rows of these vectors, and rows that cannot be used or come twice."""
    rows = [(i, v, f"l{i % 3}" if i % 5 else None) for i, v in enumerate(vectors)]
    rows += [(1000, None, "l0"), (1001, [], "l0"), (1002, [None] * DIM, None),
             (1003, [0.5] * (DIM - 1) + [math.nan], "l1"), (1004, [math.inf] + [0.1] * (DIM - 1), "l1"),
             (1005, [0.25] * 3, "l2"), (1006, [0.25] * 3, "l2"), (None, vectors[0], "l1"),
             (None, vectors[5], None), (3, vectors[3], "l0"), (1007, vectors[3], "l9")]
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA).repartition(parts)


def usable(rows, dim=DIM):
    return [r for r in rows if r[1] is not None and len(r[1]) == dim
            and all(c is not None and math.isfinite(c) for c in r[1])]


def groups(seed, sizes, spread, alone=60, dim=DIM):
    """Single vectors, and groups around centres."""
    rnd = np.random.default_rng(seed)
    out = [rnd.standard_normal((alone, dim))]
    for n in sizes:
        centre = rnd.standard_normal(dim)
        out.append(centre + spread * rnd.standard_normal((n, dim)))
    return np.concatenate(out).astype(np.float32).tolist()


def as_single(v):
    return None if v is None else [c if c is None else float(np.float32(c)) for c in v]


def brute_links(rows):
    """(id, n_links, component_id) of each row, by all pairs."""
    def cosine(a, b):
        return a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)

    ready = [np.array(v) if v and all(c is not None and math.isfinite(c) for c in v) and any(v)
             else None for _, v, _ in rows]
    to = [[j for j, b in enumerate(ready) if j != i and a is not None and b is not None
           and len(a) == len(b) and cosine(a, b) >= 0.9] for i, a in enumerate(ready)]
    out = []
    for i, row in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in to[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((row[0], len(to[i]), min((rows[j][0] for j in seen if rows[j][0] is not None),
                                            default=None)))
    return out


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("window,crowd", [(near.WINDOW, near.CROWD), (8, 12)])
def test_near_vectors(spark, monkeypatch, window, crowd):
    """Against all pairs; small windows and crowds go through passes, centres and the grid."""
    monkeypatch.setattr(near, "CROWD", crowd)
    monkeypatch.setattr(near, "COLUMN", 2 * crowd)
    vectors = groups(1, (2, 5, 40, 70), 0.12) + groups(2, (45, 3), 0.3, alone=0)
    rows = [(i, as_single(v), label) for i, v, label in odd_rows(vectors)]
    rows.append((2000, [0.0] * DIM, "zero"))
    got = near.near_vectors(frame(spark, rows), window=window)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = [tuple(r) for r in got.collect()]
    assert ordered((i, n, c) for i, n, c, _ in got) == ordered(brute_links(rows))
    assert all(kept == (i == c) for i, _, c, kept in got)


def test_near_vectors_of_a_crowd_split_over_many_ranges(spark):
    """A third of all rows are near copies, a tenth equal ones; every link is counted."""
    vectors = groups(3, (400,), 0.05, alone=700)
    rows = [(i, v, None) for i, v in enumerate(vectors)]
    rows += [(5000 + i, vectors[0], None) for i in range(120)]
    got = near.near_vectors(frame(spark, rows, 8), window=16).collect()
    assert ordered((r[0], r[1], r[2]) for r in got) == ordered(brute_links(rows))


def test_lone_pairs_at_the_threshold_are_found(spark):
    """Recall where it is hardest: pairs at a cosine just above 0.9 that nothing else joins."""
    rnd = np.random.default_rng(5)
    a = rnd.standard_normal((1500, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rnd.standard_normal(a.shape)
    b -= (b * a).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    both = np.concatenate((a, 0.901 * a + math.sqrt(1 - 0.901 ** 2) * b)).tolist()
    table = spark.createDataFrame(list(enumerate(both)), "vec_id long, embedding array<double>")
    linked = near.near_vectors(table, window=32).where("n_links > 0").count()
    assert linked >= 0.99 * 3000


def test_more_vectors_take_more_passes():
    counts = [near.passes_for(n) for n in (0, 10 ** 3, 10 ** 5, 10 ** 7, 10 ** 9)]
    assert counts == sorted(counts) and counts[0] >= 2


def brute_codes(rows, parts=8, entries=16, rounds=6):
    rows = sorted(usable(rows), key=lambda r: (
        r[0] is None, r[0] or 0, np.floor(4096 * np.array(r[1])).astype("<i4").tobytes()))
    x = [[math.floor(4096 * c) for c in r[1]] for r in rows]
    edges = [DIM * i // parts for i in range(parts + 1)]
    cut = [[v[a:b] for a, b in zip(edges, edges[1:])] for v in x]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        fresh = [list(b) for b in books]
        for p in range(parts):
            own = [nearest(p, v[p])[1] for v in cut]
            for e in range(len(books[p])):
                members = [v[p] for v, i in zip(cut, own) if i == e]
                if members:
                    fresh[p][e] = [sum(c) // len(members) for c in zip(*members)]
        books = fresh
    found = [[nearest(p, v[p]) for p in range(parts)] for v in cut]
    error = [sum(d for d, _ in f) for f in found]
    by = {}
    for r, e in zip(rows, error):
        by[r[2]] = by.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(r[0], "".join(f"{i:02x}" for _, i in f), e, by[r[2]], digest)
            for r, f, e in zip(rows, found, error)]


@pytest.mark.parametrize("count", [120, 6])
def test_codes(spark, count):
    vectors = (np.array(groups(7, (30, 20), 0.2)) * 0.2)[:count].astype(np.float32).tolist()
    rows = [(i, as_single(v), label) for i, v, label in odd_rows(vectors[:max(6, count)])]
    got = codes.vector_codes(frame(spark, rows))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert ordered(tuple(r) for r in got.collect()) == ordered(brute_codes(rows))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2 ** 32), st.integers(1, 5), st.sampled_from([1, 7, 64, 1024]))
def test_cells_give_the_nearest_entry(seed, dim, width):
    rnd = np.random.default_rng(seed)
    entries = rnd.integers(-300, 300, (9, dim))
    entries[4] = entries[2]  # a tie goes to the lower index
    x = rnd.integers(-400, 400, (200, dim))
    cells = codes.Cells(entries, width)
    for rows in (x[:100], x):
        index, squared = cells.nearest(rows)
        every = ((rows[:, None] - entries[None]) ** 2).sum(2)
        assert (index == every.argmin(1)).all() and (squared == every.min(1)).all()


def test_cells_are_remembered_and_spare_comparisons(monkeypatch):
    rnd = np.random.default_rng(0)
    entries, x = rnd.integers(-2000, 2000, (16, 2)), rnd.integers(-2000, 2000, (5000, 2))
    cells = codes.Cells(entries, 256)
    first = cells.nearest(x)
    assert cells.evaluated < 0.5 * len(x) * len(entries)
    monkeypatch.setattr(cells, "_not_dominated", None)  # every cell is known now
    assert all((a == b).all() for a, b in zip(first, cells.nearest(x)))
    monkeypatch.setattr(codes, "MOST_CELLS", 3)
    cells = codes.Cells(entries, 256)
    assert all((a == b).all() for a, b in zip(first, cells.nearest(x)))


def brute_whitening(rows, k=4):
    x = np.floor(256 * np.array([r[1] for r in rows])) + 0.0
    fit = np.unique(x, axis=0)
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(x.shape[1], -1))
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    real = values > 1e-9 * values[0]
    total = fit.sum(0).astype(np.int64)
    return (len(fit), values[real] / np.cov(fit.T, bias=True).trace(),
            (x - fit.mean(0)) @ axes[:, real] / np.sqrt(values[real]),
            ((len(fit) * x.astype(np.int64) - total) ** 2).sum(1))


def whitened(spark, rows, **how):
    got = white.whiten(frame(spark, rows), **how)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained",
                           "identity_error"]
    return got.collect()


@pytest.mark.parametrize("block", [white.BLOCK, 8])
def test_whitening(spark, monkeypatch, block):
    """Both with a block as large as the dimension and with the filter at work."""
    monkeypatch.setattr(white.eigenpairs, "__defaults__", (block, white.DEGREE))
    rows = [(i, as_single(v), label) for i, v, label in odd_rows(groups(9, (30,), 0.4, alone=150))]
    got = whitened(spark, rows)
    fit = usable(rows)
    n, explained, values, deviation = brute_whitening(fit)
    assert len(got) == 4 * len(fit) and {r["n"] for r in got} == {n}
    assert {r["identity_error"] for r in got}.pop() < 1e-9
    ours: dict = {}
    for r in got:
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9
        ours.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r["whitened"])
    signs = {}
    for (i, *_), v, d in zip(fit, values, deviation.tolist()):
        for c in range(4):
            for own in ours[i, d][c + 1]:
                if abs(v[c]) > 1e-6:
                    sign = signs.setdefault(c, math.copysign(1, own * v[c]))
                    if (i, d) != (None, None):
                        assert min(abs(sign * o - v[c]) for o in ours[i, d][c + 1]) < 1e-8


def test_eigenpairs_of_hard_spectra():
    rnd = np.random.default_rng(1)
    turn = np.linalg.qr(rnd.standard_normal((80, 80)))[0]
    for values in (np.ones(80), np.r_[np.ones(50), np.zeros(30)], np.r_[9.0, np.zeros(79)],
                   np.r_[5.0, 4.999, 4.998, 4.997, 4.996, np.linspace(4.9, 0, 75)],
                   np.r_[1e6, 1e3, 10, 1, np.full(76, 0.5)], 1 + 0.001 * np.arange(80)):
        matrix = (turn * values) @ turn.T
        passes = []
        got, axes = white.eigenpairs(lambda q, m=matrix: (passes.append(1), m @ q)[1], 80, 4, 16)
        assert np.allclose(got, np.sort(values)[::-1][:4], rtol=1e-9, atol=1e-9 * values.max())
        assert np.abs(matrix @ axes - axes * got).max() < 1e-9 * values.max()
        assert np.abs(axes.T @ axes - np.eye(4)).max() < 1e-9


@pytest.mark.parametrize("vectors,components", [
    ([[1.0, 2.0, 0.0]] * 3, 0), ([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [1.0, 0.0, 0.0]], 1),
    (np.eye(3).tolist(), 2)])
def test_whitening_of_few_directions(spark, vectors, components):
    table = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = white.whiten(table).collect()
    assert sorted((r["vec_id"], r["component"]) for r in got) == [
        (i, c) for i in range(3) for c in range(1, components + 1)]
    assert all(r["identity_error"] < 1e-9 for r in got)


def test_deviations_beyond_64_bits_inside_are_exact(spark):
    vectors = [[8.0e6, 1.0], [-8.0e6, 2.0], [0.0, 3.0]]
    table = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="(?i)overflow|too (large|big)|convert"):
        white.whiten(table).collect()
    small = [[8.0e5, 1.0], [-8.0e5, 2.0], [0.0, 3.0]]
    table = spark.createDataFrame(list(enumerate(small)), "vec_id long, embedding array<double>")
    x = [[int(256 * c) for c in v] for v in small]
    total = [sum(c) for c in zip(*x)]
    want = {i: sum((3 * a - s) ** 2 for a, s in zip(v, total)) for i, v in enumerate(x)}
    assert {r["vec_id"]: r["deviation"] for r in white.whiten(table).collect()} == want


def test_components_too_large_for_exact_sums_are_an_error(spark):
    table = spark.createDataFrame([(0, [1e9] * 8, 1)], "vec_id long, embedding array<double>, label int")
    for operator in (codes.vector_codes, white.whiten):
        with pytest.raises(Exception, match="a component is"):
            operator(table).collect()


@pytest.mark.parametrize("rows", [[], [(1, None, None), (2, [], "a"), (None, [None], "b")]])
def test_tables_without_vectors(spark, rows):
    table = frame(spark, rows) if rows else spark.createDataFrame([], SCHEMA)
    assert ordered((r[0], r[1], r[2]) for r in near.near_vectors(table).collect()) == ordered(
        (i, 0, i) for i, _, _ in rows)
    assert codes.vector_codes(table).collect() == []
    assert white.whiten(table).collect() == []
