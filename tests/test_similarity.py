import random
import time
from functools import cache

import pytest

from parenlake.functions import distance as D
from parenlake.functions.distance import distance, encode
from parenlake.functions.reader import read
from parenlake.operators import similarity as S

SCHEMA = "file_id long, path string, dialect string, text string"


def corpus(seed, files=14):
    """Files of a few forms: copies, renamed atoms, dropped and added parts."""
    rng = random.Random(seed)
    atom = lambda: rng.choice(["a", "b", "x", "y", "1", "foo", "bar", "'q", '"s"'])
    form = lambda depth: "(" + " ".join([rng.choice(["f", "g"]), *[form(depth - 1) if depth and rng.random() < 0.4 else atom() for _ in range(rng.randrange(1, 6))]]) + ")"
    known = [form(2) for _ in range(6)]
    rows = []
    for k in range(files):
        texts = []
        for _ in range(rng.randrange(1, 4)):
            text = rng.choice(known)
            for _ in range(rng.choice((0, 0, 1, 2))):
                text = text.replace(rng.choice(["a", "b", "x"]), atom(), 1) if rng.random() < 0.7 else text[:-1] + " " + form(0) + ")"
            texts.append(text)
        rows.append((k, f"{k}.lisp", "common-lisp", "\n".join(texts)))
    return [*rows, (90, "none.lisp", "common-lisp", None), (91, "bad.lisp", "common-lisp", "(f a"), (92, "empty.lisp", "common-lisp", "(()) ((a))")]


def brute(rows, threshold, scope, top):
    """All pairs, one after the other: those with one head, those sizes rule
    out, and those that match, as (file, path, file, path) -> distance."""
    forms = []
    for file, _, dialect, text in rows:
        try:
            tree = read(text or "", dialect)
        except Exception:  # noqa: BLE001
            continue
        for k, node in enumerate(tree.nodes):
            if node.kind == "list" and node.delimiter == "paren" and (not top or not node.parent) and len(tree.subtree(k)) >= 2:
                forms.append((file, tree.path(k), tree.head(k), encode(tree, k)))
    possible = pruned = 0
    matches = {}
    for i, (f, p, head, x) in enumerate(forms):
        for g, q, other, y in forms[i + 1 :]:
            if head != other or (scope == "same-file" and f != g) or (scope == "cross-file" and f == g):
                continue
            possible += 1
            low, high = sorted((len(x[0]), len(y[0])))
            if high - low > (1 - threshold) * high + 1e-9:
                pruned += 1
                continue
            cost = distance(x, y)
            if max(0.0, 1 - cost / (10.0 * high)) >= threshold:
                a, b = sorted(((f, p), (g, q)))
                matches[(a[0], ".".join(map(str, a[1])), b[0], ".".join(map(str, b[1])))] = cost
    return possible, pruned, matches


@pytest.mark.parametrize(("seed", "threshold", "scope", "top", "block"), [(1, 0.87, "all", False, 256), (2, 0.95, "cross-file", False, 2), (3, 0.75, "same-file", False, 3), (4, 0.5, "all", True, 2), (5, 0.0, "all", True, 256), (6, 1.0, "cross-file", False, 1)])
def test_by_brute_force(spark, monkeypatch, seed, threshold, scope, top, block):
    monkeypatch.setattr(S, "BLOCK", block)
    rows = corpus(seed)
    s = spark.createDataFrame(rows, SCHEMA).repartition(2)
    possible, pruned, matches = brute(rows, threshold, scope, top)
    options = {"min_node_count": 2, "form_scope": "top-level" if top else "all"}
    got = S.similarity(s, threshold, comparison_scope=scope, overlap_policy="all", max_results=None, **options).collect()
    assert {(r.left_file, r.left_path, r.right_file, r.right_path): r.distance_x10 for r in got} == matches and len(got) == len(matches)
    told = S.similarity_summary(s, threshold, comparison_scope=scope, max_results=7, **options).first()
    assert (told.possible, told.pruned, told.evaluated, told.matched) == (possible, pruned, possible - pruned, len(matches))
    assert (told.reported, told.truncated) == (min(7, len(matches)), len(matches) > 7)
    if scope == "all":
        links = {}
        for a, p, b, q in matches:
            links[a, p] = links.get((a, p), 0) + 1
            links[b, q] = links.get((b, q), 0) + 1
        assert {(r.file_id, r.path): r.links for r in S.similarity_classes(s, threshold, **options).collect() if r.links} == links


@pytest.mark.parametrize("n", [32, 64, 128])
def test_counts_of_the_three_workloads(spark, tmp_path, n):
    from parenlake.sources.corpus import measures

    spark.range(n).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    half = 2 * (n // 2 * (n // 2 - 1) // 2)
    due = {"names": (0, n * (n - 1) // 2), "sizes": ((n // 2) ** 2, half), "leaves": (0, half)}
    for kind, (pruned, matched) in due.items():
        told = S.similarity_summary(measures(spark, str(tmp_path), kind), 0.9, min_node_count=2, form_scope="top-level").first()
        assert (told.possible, told.pruned, told.evaluated, told.matched) == (n * (n - 1) // 2, pruned, n * (n - 1) // 2 - pruned, matched)


def test_summary_of_overlaps_and_decisions(spark):
    s = spark.createDataFrame([(1, "a.lisp", "common-lisp", "(f (g a b c) (g a b c) x)"), (2, "b.lisp", "common-lisp", "(f (g a b c) (g a b c) x)")], SCHEMA)
    told = S.similarity_summary(s, 0.9, overlap_policy="maximal", fail_on_matches=True).first()
    shown = S.similarity(s, 0.9, max_results=None).count()
    # Of the (g a b c), all across the files lie inside the match of the wholes.
    assert (told.matched, told.matched - told.suppressed, told.reported, told.decision) == (7, shown, shown, "failed")
    empty = spark.createDataFrame([], SCHEMA)
    told = S.similarity_summary(empty, 0.9).first()
    assert (told.possible, told.pruned, told.matched, told.decision) == (0, 0, 0, "passed") and S.similarity_classes(empty).count() == 0


def nested(tree, k):
    """A subtree as (label, subtrees)."""
    node = tree.nodes[k]
    marks = ",".join(node.prefixes)
    label = f"a{tree.text(k)}\0{marks}" if node.kind == "atom" else f"l{node.delimiter}\0{marks}"
    return (label, tuple(nested(tree, c) for c in node.children))


@cache
def plain(ours, theirs):
    """Edit distance of two forests by its definition."""
    size = lambda forest: sum(1 + size(kids) for _, kids in forest)
    if not ours or not theirs:
        return 10 * (size(ours) + size(theirs))
    (a, below), (b, under) = ours[-1], theirs[-1]
    change = 0 if a == b else 3 if a[0] == b[0] == "a" else 10
    return min(plain(ours[:-1] + below, theirs) + 10, plain(ours, theirs[:-1] + under) + 10, plain(ours[:-1], theirs[:-1]) + plain(below, under) + change)


def test_distance_by_definition_and_within_a_bound():
    rng = random.Random(7)
    atom = lambda: rng.choice(["a", "b", "'q", "1"])
    form = lambda depth: "(" + " ".join(form(depth - 1) if depth and rng.random() < 0.5 else atom() for _ in range(rng.randrange(0, 4))) + ")"
    for _ in range(300):
        trees = [read(form(3)), read(form(3))]
        x, y = (encode(t, 1) for t in trees)
        due = plain((nested(trees[0], 1),), (nested(trees[1], 1),))
        assert distance(x, y) == due
        for most in (0, 9.5, 20, 33, 60, 120):
            got = distance(x, y, most)
            assert got == due if due <= most else got > most


def test_large_forms_are_decided_or_skipped(spark, monkeypatch):
    wide = "(f " + " ".join(f"(g{k % 7} (h {k}) x)" for k in range(330)) + ")"
    other = "(f (new) " + " ".join(f"(g{k % 7} (h {k + (k == 200)}) x y)" if k % 50 == 9 else f"(g{k % 7} (h {k}) x)" for k in range(328)) + " (new))"
    x, y = (encode(read(t), 1) for t in (wide, other))
    assert min(len(x[0]), len(y[0])) > 1900
    began = time.time()
    cost = distance(x, y, 0.05 * 2000 * 10)
    assert 0 < cost <= 1000 and time.time() - began < 20
    assert distance(x, y, 0.05 * 2000 * 10, limit=1000) is None
    s = spark.createDataFrame([(1, "a.lisp", "common-lisp", wide), (2, "b.lisp", "common-lisp", other)], SCHEMA)
    options = {"min_node_count": 1000, "fail_on_matches": True}
    told = S.similarity_summary(s, 0.95, **options).first()
    assert (told.matched, told.skipped, told.decision) == (1, 0, "failed")
    monkeypatch.setattr(D, "CELLS", 1000)
    assert distance(x, y) is None


@pytest.mark.parametrize("seed", range(3))
def test_maximal_pairs_by_brute_force(spark, seed):
    s = spark.createDataFrame(corpus(seed + 20, files=6), SCHEMA).repartition(2)
    found = S.staged(S.forms(s, 2).select("file_id", "path", S._head().alias("head"), "tree", "subtree_nodes", "span_start", "span_end", "labels", "leftmost"), "forms")
    table = S.staged(S._form_pairs(found, S.class_links(S.classes(found), 0.8), "all"), "pairs")
    pairs, place = table.collect(), lambda p: tuple(p[n] for n in S.NAMES if "span" in n or "file" in n)
    holds = lambda o, p: all(o[f"{s}_file_id"] == p[f"{s}_file_id"] and o[f"{s}_span_start"] <= p[f"{s}_span_start"] and o[f"{s}_span_end"] >= p[f"{s}_span_end"] for s in "lr")
    due = {place(p) for p in pairs if not any(o is not p and holds(o, p) for o in pairs)}
    got = S._maximal(table).collect()
    assert {place(p) for p in got} == due and len(got) == len(due) and 0 < len(due) < len(pairs)


def test_labels_of_their_own_make_no_more_distances(spark, tmp_path):
    from parenlake.sources.corpus import bindings, measures

    spark.range(1, 61).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    for table, due in ((bindings(spark, str(tmp_path)), 10), (measures(spark, str(tmp_path), "sizes"), 2)):
        found = S.staged(S.forms(table, 2, top_level_only=True), "forms")
        trees = S.classes(found)
        marked = S.patterns(trees)
        links = S.pattern_links(trees, marked, 0.9)
        # (* width 1) shares its number with others: a pattern of its own.
        assert marked.count() == 60 and 2 <= links.count() <= due
        assert S.class_links(trees, 0.9).distinct().count() == (60 * 59 // 2 if due > 2 else 2 * (30 * 29 // 2))


@pytest.mark.parametrize(("seed", "dealt", "scope"), [(31, 1, "all"), (32, 2, "all"), (33, 3, "cross-file"), (34, 2, "same-file"), (35, 2048, "all")])
def test_all_pairs_by_blocks(spark, monkeypatch, seed, dealt, scope):
    """Blocks give what joins of classes with their forms give, in their order;
    copies, and files listed twice, among them."""
    monkeypatch.setattr(S, "DEALT", dealt)
    rows = corpus(seed, files=9)
    s = spark.createDataFrame([*rows, rows[2], (rows[3][0], "again.lisp", "common-lisp", rows[4][3])], SCHEMA).repartition(3)
    found = S.staged(S.forms(s, 2).select("file_id", "path", S._head().alias("head"), "tree", "subtree_nodes", "span_start", "span_end", "labels", "leftmost"), "forms")
    pairs = S._form_pairs(found, S.class_links(S.classes(found), 0.75), scope).collect()
    dotted = lambda path: ".".join(map(str, path))
    due = sorted((p.l_file_id, dotted(p.l_path), p.r_file_id, dotted(p.r_path), p.distance_x10) for p in pairs)
    made = S.similarity(s, 0.75, 2, comparison_scope=scope, overlap_policy="all", max_results=None, digits=6).collect()
    assert sorted(tuple(r)[:5] for r in made) == due and len(due) > 5
    number = lambda path: [int(x) for x in path.split(".")]
    assert (order := [(-r.score, -r.similarity, r.left_file, number(r.left_path), r.right_file, number(r.right_path)) for r in made]) == sorted(order)
    sizes = {(f.file_id, dotted(f.path)): f.subtree_nodes for f in found.collect() if f.file_id != rows[3][0]}
    for r in made:
        if (a := sizes.get((r.left_file, r.left_path))) and (b := sizes.get((r.right_file, r.right_path))):
            alike = 1 - r.distance_x10 / (10 * max(a, b))
            assert (r.similarity, r.score) == (round(alike, 6), round(alike * (a + b) / 2, 6))


def test_pairs_are_made_where_they_go_out(spark, tmp_path, capsys):
    """No pair is joined, shuffled or rounded once it is made."""
    from parenlake.plans.registry import QUERIES

    spark.range(30).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    got = QUERIES["similarity_suppliers"](spark, str(tmp_path))
    got.explain()
    plan = capsys.readouterr().out.split("Generate explode(r_forms")[0]
    assert "Join" not in plan and "Exchange" not in plan and "round(" not in plan
    assert got.count() == 30 * 29 // 2


def test_texts_are_dealt_out(spark):
    one = spark.createDataFrame([(k, f"{k}.lisp", "common-lisp", f"(f x {k} y)") for k in range(40)], SCHEMA).coalesce(1)
    assert S.forms(one).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
