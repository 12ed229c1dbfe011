import hashlib
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from parenlake.llm import debruijn, jaccard, sparse_suffix
from parenlake.llm.common import WordHashes, minimizers
from parenlake.llm.components import components
from parenlake.llm.jaccard import Measure, keep_one, keys_of, link
from tests.llm.corpus import SCHEMA, clashing, empty, odd, odd_rows, words


def slow_dedupe(rows, k):
    texts = [(d, (t or "").encode().split()) for d, t, *_ in rows]
    seen = Counter(tuple(w[j : j + k]) for _, w in texts for j in range(len(w) - k + 1))
    out = []
    for d, w in texts:
        gone = {p for j in range(len(w) - k + 1) if seen[tuple(w[j : j + k])] > 1 for p in range(j, j + k)}
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest()))
    return Counter(out)


def many_rows():
    passage, other = words(50, 75), words(51, 40)
    rows = odd_rows()
    rows += [(200 + k, f"{words(60 + k, 30 + k)} {passage if k % 3 else other} {words(90 + k, 20)}", None, None, None) for k in range(25)]
    rows += [(300, words(70, 34), None, None, None), (301, words(70, 34), None, None, None), (302, words(71, 35), None, None, None), (303, words(71, 35), None, None, None)]
    return rows


@pytest.mark.parametrize("operator, k", [(lambda d: debruijn.dedupe(d, 35), 35), (lambda d: sparse_suffix.dedupe(d, 50), 50)])
def test_repeated_passages_as_by_brute_force(spark, operator, k):
    rows = many_rows()
    got = operator(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == slow_dedupe(rows, k)
    assert operator(clashing(spark)).count() == len(odd_rows())
    assert operator(empty(spark)).count() == 0


def edited_copies(seed, n, length, share):
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 5000, length)]
    return [(k, " ".join(f"x{rng.integers(0, 5000)}" if rng.random() < share else w for w in base), None, None, None) for k in range(n)]


def around(head, left, right, own):
    """A head with words of two common contexts, cut short by words of its own."""
    before, after = words(80, 24, 10**6).split(), words(81, 24, 10**6).split()
    fill = [f"{own}-{k}" for k in range(60)]
    return " ".join([*fill[:30], *before[24 - left :], head, *after[:right], *fill[30:]])


def test_edited_copies_as_by_brute_force(spark):
    head = words(82, 26, 10**6)
    shared = [(k, around(head, left, right, f"d{k}"), None, None, None) for k, (left, right) in enumerate([(10, 14), (10, 14), (0, 20), (0, 14), (0, 15), (12, 0), (11, 0), (18, 3)])]
    for rows in (shared, edited_copies(1, 100, 300, 0.02), edited_copies(2, 150, 300, 0.05)):
        got = sparse_suffix.dedupe(spark.createDataFrame(rows, SCHEMA).repartition(3), 50).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == slow_dedupe(rows, 50)


def test_a_passage_between_partial_ones(spark):
    """Two documents share 50 words; many others their last or first 49."""
    passage = [f"p{k}" for k in range(50)]

    def placed(some, own):
        return " ".join([*[f"{own}-{k}" for k in range(30)], *some, *[f"{own}+{k}" for k in range(30)]])

    rows = [(k, placed(passage, f"d{k}"), None, None, None) for k in range(2)]
    rows += [(10 + k, placed(passage[1:], f"r{k}"), None, None, None) for k in range(60)]
    rows += [(100 + k, placed(passage[:-1], f"l{k}"), None, None, None) for k in range(60)]
    got = sparse_suffix.dedupe(spark.createDataFrame(rows, SCHEMA).repartition(3), 50).collect()
    assert {r.doc_id: r.n_removed for r in got if r.n_removed} == {0: 50, 1: 50}


def unitigs(spark, texts, k=35):
    """How many compacted paths each document lies on, and segments per path."""
    df = spark.createDataFrame([(j, t, None, None, None) for j, t in enumerate(texts)], SCHEMA)
    documents = debruijn.opened(rows := debruijn.rows_of(df), debruijn.suspects(rows, debruijn.ANCHOR, k - debruijn.ANCHOR))
    read = debruijn.read_back(documents, debruijn.segments(debruijn.graph(debruijn.occurrences(documents, k))), k)
    paths = Counter(r.path for r in debruijn.compacted(read).collect())
    lies = {r.doc_id: r.n_paths for r in debruijn.dedupe(df, k).collect()}
    return [lies[j] for j in range(len(texts))], sorted(paths.values())


def test_paths_end_where_the_graph_branches(spark):
    a, b, c, d = (words(110 + j, 60, 10**6) for j in range(4))
    own = [words(120 + j, 30, 10**6) for j in range(6)]
    # b is followed by c or d, both twice: one path up to the branch, one after each side.
    texts = [f"{own[0]} {a} {c}", f"{own[1]} {a} {c}", f"{own[2]} {a} {d}", f"{own[3]} {a} {d}", b]
    lies, paths = unitigs(spark, texts)
    assert lies == [2, 2, 2, 2, 0] and paths == [1, 1, 1]
    # A text that begins inside a path, and one that ends there, cut segments but not the path.
    whole = f"{a} {b} {c}"
    lies, paths = unitigs(spark, [whole, f"{b} {c}", f"{a} {b}", f"{own[4]} {words(130, 40, 10**6)}"])
    assert lies == [1, 1, 1, 0] and len(paths) == 1 and paths[0] > 1
    # A circle of one edge, and one of more.
    assert unitigs(spark, ["same " * 300])[0] == [1]
    circle = " ".join(f"c{k}" for k in range(50))
    assert unitigs(spark, [" ".join([circle] * 4)])[0] == [1]


def test_equal_occurrences_of_a_batch_travel_once(spark, monkeypatch):
    rows = many_rows() + [(500 + k, words(50, 75) + " " + words(140, 50), None, None, None) for k in range(40)]
    monkeypatch.setattr(debruijn, "MERGED", 300)
    for parts in (1, 4):
        got = debruijn.dedupe(spark.createDataFrame(rows, SCHEMA).repartition(parts), 35).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == slow_dedupe(rows, 35)


def test_wide_sketches_never_tell_too_many_differences():
    rng = np.random.default_rng(4)
    for n, cut in ((1500, 100), (3000, 900), (2047, 0), (1025, 1025)):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[cut:], rng.integers(0, 1 << 63, cut + 300).astype(np.uint64)]))
        assert jaccard.unlike(jaccard.wide_sketch(x), jaccard.wide_sketch(y)) <= len(np.setxor1d(x, y))
    assert jaccard.wide_sketch(np.arange(1024, dtype=np.uint64)) is None


@pytest.mark.parametrize("parts, block", [(1, 50_000), (5, 50_000), (2, 7)])
def test_stretches_around_a_head_in_any_blocks(spark, parts, block):
    rng, side = np.random.default_rng(3), 24
    near = lambda: "".join(chr(97 + x) for x in np.where(rng.random(side) < 0.1, rng.integers(0, 26, side), 0))[: rng.integers(8, side + 1)]
    code = lambda t: b"".join(ord(c).to_bytes(8, "big") for c in t)
    rows = [(int(h), near(), near(), 1000 * k + 100) for k, h in enumerate(rng.integers(0, 4, 200))]
    kept = spark.createDataFrame([(h, bytearray(code(a)), bytearray(code(b)), loc) for h, a, b, loc in rows], "head long, after binary, before binary, loc long")
    seen = Counter((h, i, a[:i], b[: side - i]) for h, a, b, _ in rows for i in range(side + 1) if len(a) >= i and len(b) >= side - i)
    want = {loc - (side - i) + p for h, a, b, loc in rows for i in range(side + 1) if seen[h, i, a[:i], b[: side - i]] > 1 for p in range(50)}
    got = {r.loc + p for r in sparse_suffix.repeats(kept, parts, 50, block).collect() for p in range(r.len)}
    assert want and got == want


def test_stretches_of_neighbours_are_shared_words():
    """Also where a word's value is 0, with which short contexts are filled."""
    rng, side = np.random.default_rng(6), 6
    for _ in range(50):
        n = int(rng.integers(1, 40))
        head, known = rng.integers(0, 2, n), rng.integers(0, side + 1, n)
        table = np.where(np.arange(side) < known[:, None], rng.integers(0, 2, (n, side)), 0).astype(np.uint64)
        ranked = sparse_suffix.Side(head, table, known)
        for words_ in range(side + 1):
            has, at = np.flatnonzero(known >= words_), ranked.stretches(words_)
            for i in has:
                for j in has:
                    same = head[i] == head[j] and (table[i, :words_] == table[j, :words_]).all()
                    assert (at[i] == at[j]) == same


def test_rows_group_by_all_keys():
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 4, 100), rng.integers(0, 4, 100)
    first, group, count = sparse_suffix.grouped(a, b)
    pairs = list(zip(a.tolist(), b.tolist(), strict=True))
    seen = Counter(pairs)
    assert [count[g] for g in group] == [seen[x] for x in pairs]
    assert all(pairs[first[g]] == x and pairs.index(x) == first[g] for g, x in zip(group, pairs, strict=True))
    assert [len(x) for x in sparse_suffix.grouped(a[:0], b[:0])] == [0, 0, 0]


def test_every_window_holds_a_minimizer():
    rng = np.random.default_rng(5)
    for n, w in ((24, 24), (100, 24), (500, 7), (60, 1)):
        for high in (3, 1 << 60):
            values = rng.integers(0, high, n).astype(np.uint64)
            at = set(minimizers(values, w).tolist())
            for s in range(n - w + 1):
                assert s + int(values[s : s + w].argmin()) in at
    assert len(minimizers(np.zeros(3, np.uint64), 5)) == 0


@pytest.mark.parametrize("measure", [Measure(4, 85, 100), Measure(5, 80, 100), Measure(1, 50, 100)])
def test_linked_sets_share_a_key(measure):
    rng, tried = np.random.default_rng(9), 0
    for _ in range(600):
        n = int(rng.integers(3, 300))
        x = rng.integers(0, 1 << 63, n).astype(np.uint64)
        cut, new = int(rng.integers(0, n // 6 + 2)), int(rng.integers(0, n // 6 + 2))
        y = np.unique(np.concatenate([x[cut:], rng.integers(0, 1 << 63, new).astype(np.uint64)]))
        x = np.unique(x)
        both = len(np.intersect1d(x, y))
        if measure.whole * both >= measure.part * (len(x) + len(y) - both) and not np.array_equal(x, y):
            tried += 1
            assert len(np.intersect1d(keys_of(x, measure), keys_of(y, measure)))
    assert tried > 50


def slow_groups(rows, measure):
    known = WordHashes()
    sets = [set(jaccard.shingles((t or "").encode(), measure.words, known).tolist()) for _, t, *_ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and measure.whole * both >= measure.part * (len(sets[i]) + len(sets[j]) - both):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    low = {}
    order = lambda d: -1 if d is None else d
    for g, (d, *_) in zip(group, rows):
        low[g] = min(low.get(g, d), d, key=order)
    return Counter((d, len(s), low[g]) for (d, *_), s, g in zip(rows, sets, group)), len(set(group))


@pytest.mark.parametrize("measure", [Measure(4, 85, 100), Measure(5, 80, 100)])
def test_groups_as_by_brute_force(spark, measure, monkeypatch):
    rows = many_rows()
    base = words(40, 200, 5000).split()
    for k in range(60):  # a chain of edits, and a group with frequent keys
        base = list(base)
        base[(7 * k) % 200] = f"x{k}"
        rows.append((400 + k, " ".join(base), None, None, None))
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    df = spark.createDataFrame(rows, SCHEMA)
    want, _ = slow_groups(rows, measure)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in link(df, measure).collect()) == want
    assert link(empty(spark), measure).count() == 0 and link(clashing(spark), measure).count() == len(odd_rows())


def test_one_of_each_group_stays(spark):
    kept = keep_one(odd(spark)).collect()
    # Copies and the near copy go, also of the repeated row; texts without words stay.
    _, groups = slow_groups(odd_rows(), Measure())
    assert len(kept) == groups
    assert sum(r.doc_id == 0 for r in kept) == 1 and not any(r.doc_id in (1, 2, 14) for r in kept)
    assert keep_one(empty(spark)).count() == 0 and keep_one(clashing(spark)).columns == clashing(spark).columns


def test_repeated_rows_without_words_stay(spark):
    blank = [(1, "\t\n", "en", "a", 2)] * 3 + [(2, " ", "en", "a", 1)] * 2
    rows = [*blank, (3, words(1, 50), "en", "a", 1), (3, words(1, 50), "en", "a", 1)]
    assert Counter(r.doc_id for r in keep_one(spark.createDataFrame(rows, SCHEMA)).collect()) == {1: 3, 2: 2, 3: 1}


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(links.limit(0)).count() == 0


def test_members_of_a_large_key_are_compared_in_little_memory():
    n, rng = 1500, np.random.default_rng(4)
    sketch = rng.integers(-(1 << 62), 1 << 62, (n // 3, jaccard.SKETCH)).repeat(3, axis=0)  # three alike in a row
    middle = [rng.bytes(jaccard.MIDDLE) for _ in range(n // 3)]
    own, part = np.arange(n) % 2, np.arange(n) // 2
    columns = [np.zeros(n, np.int64), np.zeros(n, np.int32), np.ones(n, np.int32), own.astype(np.int32), np.arange(n) + 7, np.full(n, 2000), part]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * jaccard.SKETCH, pa.int32()), pa.array(sketch.ravel()))
    held = pa.table([*map(pa.array, columns), lists, pa.array([middle[k // 3] for k in range(n)], pa.binary())], names=["key", "low", "high", "own", "node", "n", "part", "sketch", "middle"])
    tracemalloc.start()
    found = [tuple(x) for b in jaccard.close_members(held, Measure()) for x in zip(*[c.to_pylist() for c in b.columns], strict=True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    alike = [(a + 7, b + 7) for k in range(0, n, 3) for a in range(k, k + 3) for b in range(a + 1, k + 3)]
    assert sorted(found) == [(a, b) for a, b in alike if own[a - 7] != own[b - 7] and part[a - 7] != part[b - 7]]
    assert peak < 24 << 20
