import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_helpers import lower

from tiller.llm import op2_near_dedup as near
from tiller.llm.components import components
from tiller.llm.op6_line_dedup import dedup_lines
from tiller.llm.op9_substring_dedup import anchors, merged, remove_repeats, sliding_min


def test_components(spark):
    import random

    rnd = random.Random(2)
    links = [(rnd.randint(0, 80), rnd.randint(0, 80)) for _ in range(45)] + [
        (i, i + 1) for i in range(200, 260)] + [(5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r["id"]: r["component"] for r in components(
        spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_components(rows, size, percent=80):
    sets = defaultdict(list)
    for d, t, *_ in rows:
        w = lower(t).encode().split()
        s = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else (
            {tuple(w)} if w else set())
        sets[d].append(s)
    ids = [d for d in sets if d is not None]
    parent = {d: d for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if any(s and t and 100 * len(s & t) >= percent * len(s | t)
                   for s in sets[a] for t in sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in ids}, sets


def test_near_duplicates(spark, corpus):
    for size in (4, 5):
        want, sets = brute_components(corpus.rows, size)
        got = near.near_duplicates(corpus.frame(spark), shingle=size).collect()
        assert len(got) == len(corpus.rows)
        for r in got:
            assert r["component_id"] == want.get(r["doc_id"])
            assert r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]}
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert near.near_duplicates(corpus.empty(spark)).count() == 0


def test_near_group_around_the_threshold(spark):
    """Many copies with changes: links go through others than the bucket's pivot."""
    import random

    rnd = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rnd.randint(0, 5)):
            own[rnd.randrange(100)] = f"v{rnd.randrange(10 ** 6)}"
        rows.append((i, " ".join(own)))
    want, _ = brute_components(rows, 4)
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()}
    assert got == want and len(set(want.values())) > 5


def test_index_finds_every_pair_within_the_distance():
    rng = np.random.default_rng(1)
    one = rng.integers(0, 1 << 16, (300, near.PARTS)).astype("<u2")
    two = one.copy()
    for i in range(len(two)):
        places = rng.choice(near.PARTS, rng.integers(0, near.DISTANCE + 1), replace=False)
        two[i, places] ^= 1
    a, b = near.index_keys(one), near.index_keys(two)
    assert (a == b).any(axis=1).all()


def test_thousands_of_unlike_texts_in_one_bucket(spark, monkeypatch):
    """Copies with changes of their own: most share buckets, few are linked.

    Few rows are made of them: unlike texts meet in no list of rare shingles.
    """
    import random

    rnd = random.Random(6)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(2400):
        own = list(base)
        for place in rnd.sample(range(100), rnd.choice((0, 1, 1, 2, 3, 5, 8, 12))):
            own[place] = f"v{rnd.randrange(10 ** 6) if i % 3 else rnd.randrange(4)}"
        rows.append((i, " ".join(own)))
    sets = [{tuple(w[j:j + 4]) for j in range(len(w) - 3)} for w in (t.split() for _, t in rows)]
    of: dict = {}
    table = np.zeros((len(rows), 1 << 16), np.float32)
    for i, own in enumerate(sets):
        for shingle in own:
            table[i, of.setdefault(shingle, len(of))] = 1
    table = table[:, : len(of)]
    both = table @ table.T
    size = table.sum(axis=1)
    linked = 100 * both >= 80 * (size[:, None] + size - both)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        x, y = sorted((root(i), root(j)))
        parent[y] = x
    pairs = []
    real = near._against
    monkeypatch.setattr(near, "_against", lambda p, *more: (pairs.append(p.count()), real(p, *more))[1])
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()}
    assert got == {i: root(i) for i in range(len(rows))}
    assert len(set(got.values())) > 800 and sum(pairs[1:]) < 40 * len(rows), pairs


def test_rare_shingles_hold_a_shared_one_of_every_link(spark):
    """Whatever the sets: those that reach the similarity share a row of the lists."""
    rng = np.random.default_rng(8)
    pool = rng.integers(-(1 << 60), 1 << 60, 60)
    sets = [np.unique(rng.choice(pool, rng.integers(1, 40)) if i % 2 else np.concatenate(
        (pool[: rng.integers(20, 40)], rng.integers(0, 1 << 60, rng.integers(0, 6))))) for i in range(120)]
    frame = spark.createDataFrame([(i, s.astype("<i8").tobytes()) for i, s in enumerate(sets)],
                                  "class long, shingles binary")
    held: dict = {}
    for r in near.rare_shingles(frame, 80).collect():
        held.setdefault(r["class"], set()).add(r["shingle"])
    met = 0
    for i, a in enumerate(sets):
        for j in range(i):
            a_, b_ = set(a.tolist()), set(sets[j].tolist())
            if 100 * len(a_ & b_) >= 80 * len(a_ | b_):
                met += 1
                assert held[i] & held[j]
    assert met > 30


def test_pivots_without_a_window(spark):
    """No bucket's rows are gathered in a task for its pivot, however many they are."""
    rows = [(1, 0, c) for c in range(-300, 300)] + [(2, 1, 9), (2, 1, 4), (3, 1, 4), (3, 1, 4), (4, 2, 5)]
    met = near._met(spark.createDataFrame(rows, "key long, slot int, class long"))
    assert sorted(tuple(r) for r in met.select("key", "slot", "class", "pivot").collect()) == [
        *((1, 0, c, -300) for c in range(-299, 300)), (2, 1, 9, 4)]
    assert "Window" not in met._jdf.queryExecution().executedPlan().toString()


def test_lines(spark, corpus):
    rows = corpus.rows
    holders = defaultdict(set)

    def key(line):
        k = lower(line.strip(" \t\n\x0b\x0c\r"))
        return k if len(k) >= 20 else None

    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            if key(line):
                holders[key(line)].add(d)
    want = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) is None or len(holders[key(x)]) < 3
                or d == max(holders[key(x)], key=lambda i: (i is not None, i))]
        want.append((str(d), len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = dedup_lines(corpus.frame(spark)).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    assert any(w[2] for w in want)
    assert dedup_lines(corpus.empty(spark)).count() == 0


def brute_repeats(rows, length):
    seen = Counter()
    raws = [(d, (t or "").encode()) for d, t, *_ in rows]
    for _, raw in raws:
        seen.update(raw[i:i + length] for i in range(len(raw) - length + 1))
    out = []
    for d, raw in raws:
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            if seen[raw[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((str(d), len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_lines_of_rows_without_an_id(spark):
    """A third of all rows is the one document without an id; each loses its own lines only."""
    lines = [f"line number {n:04} of the one document" for n in range(400)]
    rows = [(None, f"{lines[n]}\nkept {n}") for n in range(400)]
    rows += [(i, f"{lines[i % 400]}\n{lines[(7 * i) % 400]}\nown {i}") for i in range(800)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    holders = {}
    for i, text in rows:
        for line in set(text.split("\n")):
            if len(line) >= 20:
                holders.setdefault(line, set()).add(-1 if i is None else i)
    want = []
    for i, text in rows:
        stay = [x for x in text.split("\n") if len(holders.get(x, ())) < 3
                or max(holders[x]) == (-1 if i is None else i)]
        want.append((str(i), "\n".join(stay)))
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == sorted(want)


def test_repeats(spark, corpus):
    for length, gram, block in ((40, 9, 8), (400, 49, 32)):
        got = remove_repeats(corpus.frame(spark), length=length, gram=gram, block=block).drop("kept")
        assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == brute_repeats(corpus.rows, length)
    assert remove_repeats(corpus.empty(spark)).count() == 0


def test_repeats_of_parts_of_runs(spark):
    """Runs that begin and end anywhere, in two or more texts, and in one text twice."""
    import random

    rnd = random.Random(6)

    def junk(n):
        return "".join(rnd.choice("abcdefgh ") for _ in range(n))

    run = junk(300)
    rows = []
    for i in range(40):
        a = rnd.randrange(250)
        rows.append((i, junk(rnd.randrange(60)) + run[a:a + rnd.randrange(30, 140)] + junk(rnd.randrange(60))))
    rows += [(90, "ab" * 200), (91, run + junk(5) + run), (92, "c" * 39), (93, "c" * 40), (94, "c" * 41)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"),
                         length=40, gram=9, block=8).drop("kept").collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == brute_repeats(rows, 40)


def test_anchor_of_equal_strings_is_the_same():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 50, 500)
    for width in (1, 2, 7, 33):
        assert sliding_min(values, width).tolist() == [
            values[i:i + width].min() for i in range(500 - width + 1)]
    shared = rng.integers(97, 122, 120).astype(np.uint8)
    found = []
    for before in (0, 13, 77):
        data = np.concatenate((rng.integers(97, 122, before).astype(np.uint8), shared))
        valid = np.arange(len(data)) <= len(data) - 40
        anchor, low, high, core, _ = anchors(data, valid, 40, 9)
        at = np.searchsorted(low, before, "right") - 1
        found.append((anchor[at] - before, core[at]))
    assert len(set(found)) == 1
    assert merged(np.array([[5, 9], [0, 3], [3, 4], [8, 12]])) == [(0, 4), (5, 12)]


def test_repeats_far_into_a_huge_text_behind_others(spark):
    """Runs past 4 MiB of a text that follows smaller ones in its batch."""
    rng = np.random.default_rng(8)

    def junk(n):
        return rng.integers(97, 123, n).astype(np.uint8).tobytes().decode()

    runs = [junk(700), junk(400), junk(1500)]
    place = [4_400_000, 4_700_000, (5 << 20) - 200]  # the last lies across a segment's end
    huge = junk(5_600_000)
    for run, at in zip(runs, place):
        huge = huge[:at - 1] + "1" + run + "2" + huge[at + len(run) + 1:]
    others = "3".join(["", *runs, ""])
    rows = [(0, junk(500)), (1, junk(900)), (2, huge), (3, others), (4, junk(600))]
    got = {r["doc_id"]: r for r in remove_repeats(
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    total = sum(map(len, runs))
    assert (got[2]["n_removed"], got[2]["n_spans"]) == (total, 3)
    for run in runs:
        huge = huge.replace(run, "")
    assert bytes(got[2]["kept"]) == huge.encode()
    assert (got[3]["n_removed"], bytes(got[3]["kept"])) == (total, b"3333")
    assert all(got[i]["n_removed"] == 0 for i in (0, 1, 4))


def test_anchors_refuse_more_than_positions_can_name():
    data = np.zeros((1 << 22) + 1, np.uint8)
    with pytest.raises(ValueError):
        anchors(data, np.zeros(len(data), bool))


def brute_repeat_words(texts, size):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i:i + size]) for w in words for i in range(len(w) - size + 1))
    return [len({j for i in range(len(w) - size + 1) if seen[tuple(w[i:i + size])] > 1
                 for j in range(i, i + size)}) for w in words]


def test_passages_of_words_are_counted_where_too_short_to_be_removed(spark):
    """Passages of over 50 words under 400 bytes, behind other spaces, in part, and twice in a text."""
    import random

    rnd = random.Random(4)

    def junk(n):
        return " ".join("".join(rnd.choice("abcdé") for _ in range(rnd.randrange(3, 7)))
                        for _ in range(n))

    passage = junk(60)
    assert len(passage.encode()) < 400
    words = passage.split(" ")
    texts = [f"{junk(30)} {passage} {junk(9)}", f"{passage}\n{junk(70)}", "\t\n ".join(words),
             f"{junk(5)} {' '.join(words[4:55])} {junk(80)}",  # 51 words
             f"{junk(5)} {' '.join(words[4:54])} {junk(80)}",  # 50 words
             f"{junk(200)}", f"{junk(51)}", "", None, "a " * 51, "b " * 52, "c " * 50]
    twice = junk(55)
    texts += [f"{twice} {junk(3)} {twice}", junk(90)] + [junk(120)] * 2
    got = {r["doc_id"]: r for r in remove_repeats(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"),
        passages=(51, 12, 8)).collect()}
    assert [got[i]["n_repeat_words"] for i in range(len(texts))] == brute_repeat_words(texts, 51)
    assert [got[i]["n_repeat_words"] for i in range(5)] == [60, 60, 60, 51, 0]
    assert [got[i]["n_removed"] for i in range(5)] == [0] * 5
    assert brute_repeats(list(enumerate(texts)), 400) == sorted(
        (str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
        for r in got.values())


def test_passages_of_parts_of_runs(spark, corpus):
    import random

    rnd = random.Random(9)
    run = [rnd.choice(["x", "yy", "zzz"]) for _ in range(90)]
    rows = []
    for i in range(40):
        a = rnd.randrange(70)
        own = [f"{i}_{j}" for j in range(rnd.randrange(12))]
        rows.append((i, " ".join(own + run[a:a + rnd.randrange(8, 50)] + own[::-1])))
    rows += [(90, "u " * 60), (91, "v " * 12), (92, "w " * 13)]
    got = dict(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"),
                              passages=(12, 5, 4)).select("doc_id", "n_repeat_words").collect())
    assert [got[d] for d, _ in rows] == brute_repeat_words([t for _, t in rows], 12)
    for size in ((12, 5, 4), (51, 12, 8)):
        more = remove_repeats(corpus.frame(spark), length=40, gram=9, block=8, passages=size)
        expected = brute_repeat_words([r[1] for r in corpus.rows], size[0])
        assert sorted((str(r["doc_id"]), r["n_repeat_words"]) for r in more.collect()) == sorted(
            (str(r[0]), n) for r, n in zip(corpus.rows, expected))
    assert remove_repeats(corpus.empty(spark), passages=(51, 12, 8)).count() == 0
