import time

import pytest
from pyspark.sql import functions as F

from parenlake.functions import facts
from parenlake.functions.distance import distance, encode
from parenlake.functions.facts import SITES, columns, sites
from parenlake.functions.reader import read
from parenlake.operators import reports as R
from parenlake.operators import rewrites as W
from parenlake.operators.nodes import comments, named, nodes
from parenlake.operators.similarity import similarity, similarity_summary
from parenlake.plans.registry import QUERIES
from parenlake.sources.corpus import admitted, bindings, dialect_column, from_files, quota, read_within, skipped_summary, workspace

SCHEMA = "file_id long, path string, dialect string, text string"


def sources(spark, *files):
    df = spark.createDataFrame([(k, p, t) for k, (p, t) in enumerate(files)], "file_id long, path string, text string")
    return df.withColumn("dialect", dialect_column(F.col("path"))).select("file_id", "path", "dialect", "text")


FREIGHT = (
    ("core.lisp", "(defun freight (weight distance) (* weight distance))\n(defun invoice () (freight 10 20))\n(defun ledger () (+ (freight 3 4) 1))"),
    ("init.el", "(defun courier-mode () (freight 5 6))"),
)


def test_calls_and_graph(spark):
    got = R.calls(sources(spark, *FREIGHT), "freight").orderBy("file_id", "path").collect()
    assert [(r.argument_count, r.enclosing_definition) for r in got] == [(2, "invoice"), (2, "ledger"), (2, "courier-mode")]
    edges = R.call_graph(sources(spark, *FREIGHT), "freight").collect()
    assert {(e.caller, e.internal) for e in edges if e.callee == "FREIGHT"} == {("invoice", True), ("ledger", True), ("courier-mode", True)}


def test_signature_statuses(spark):
    more = ("x.lisp", "(defun a () (freight 1)) (defun b () (freight 1 2 3)) (defun c () (nothing)) (defun d () (labels ((freight (x) x)) (freight 1)))")
    got = [r.status for r in R.signature(sources(spark, *FREIGHT, more), "freight").orderBy("file_id", "path").collect()]
    assert sorted(got) == ["exact", "exact", "exact", "extra-arguments", "missing-arguments"]
    twice = sources(spark, ("a.lisp", "(defun f (x) x) (defun f (x) x) (f 1)"))
    assert [r.status for r in R.signature(twice).collect()] == ["ambiguous-definition"]


def test_impact(spark):
    files = (("core.lisp", "(defun freight (weight distance) (* weight distance))\n(defun invoice () (freight 10) freight)"), ("init.el", "(defun draw () (freight 5 6))"))
    r = R.impact(sources(spark, *files), "freight").first()
    assert (r.definitions, r.references, r.calls, r.non_call_references, r.risk_level) == (1, 3, 2, 1, "warning")
    assert r.risks == "inbound-callers,non-call-references,signature-mismatch"


def test_definitions_packages_dependencies(spark):
    text = "(defpackage #:parcel (:use #:cl) (:import-from #:lib #:f) (:export #:g) (:nicknames #:d))\n(in-package #:parcel)\n(defun g (x) (other:h x))\n(define-trading-strategy s :a 1)\n(require :asdf)"
    s = sources(spark, ("a.lisp", text), ("b.asd", '(defsystem "b" :depends-on ("c" (:version "z" "1.0")) :components ((:file "e")))'))
    got = R.definitions(s).filter("file_id = 0").orderBy("path").collect()
    assert [(d.name, d.category, d.package) for d in got] == [("#:parcel", "package", None), ("g", "function", "#:parcel"), ("s", "unknown-macro", "#:parcel"), (":asdf", "package", "#:parcel")]
    p = R.packages(s).first()
    assert (p.uses, p.exports, p.nicknames, p.imports, p.option_count) == ("#:cl", "#:g", "#:d", "#:lib", 4)
    kinds = {(r.dependency, r.target) for r in R.dependencies(s).collect()}
    assert {("defpackage-use", "#:cl"), ("defpackage-import-from", "#:lib"), ("qualified-symbol", "other"), ("require", ":asdf"), ("asdf-depends-on", '"c"'), ("asdf-depends-on", '"z"'), ("asdf-component", '"e"')} <= kinds


def test_dependencies_leave_out_what_is_not_evaluated(spark):
    s = sources(spark, ("a.lisp", "(defun stock () #.(list (depot:shelf) (yard:gate 1)) (depot:shelf 2))\n'(crane:lift x)\n'(require :quay)"))
    assert [(r.dependency, r.target) for r in R.dependencies(s).collect()] == [("qualified-symbol", "depot")]


def test_local_functions_are_no_calls(spark):
    s = sources(
        spark, ("a.el", "(defun ship () (cl-flet ((label (x) (stamp x))) (label 1) (stamp 2)))"), ("b.el", "(defun ship () (cl-labels ((label (x) (label x) (stamp x))) (label 1)))"),
        ("c.el", "(defun ship () (cl-macrolet ((label (x) (list 'stamp x))) (label 1)))"),
    )
    got = R.calls(s).orderBy("file_id", "span_start").collect()
    assert [(r.file_id, r.head) for r in got if r.head != "list"] == [(0, "stamp"), (0, "stamp"), (1, "stamp")]


def test_local_bindings_are_no_references(spark):
    text = "(defun dock () :here)\n(defun crane () (let ((dock 1)) (+ dock dock)))\n(defun quay () (flet ((dock () 2)) (dock)))\n(defun pier (dock) (list dock))"
    assert {r.name for r in R.unused_definitions(sources(spark, ("a.lisp", text))).collect()} == {"dock", "crane", "quay", "pier"}
    called = text + "\n(let ((dock 1)) (dock dock))"
    assert {r.name for r in R.unused_definitions(sources(spark, ("a.lisp", called))).collect()} == {"crane", "quay", "pier"}


def test_policies_and_summaries(spark):
    s = sources(spark, *FREIGHT, ("x.lisp", "(defun extra () (freight 1))\n(let ((a (freight 1 2))) (list a a))"))
    assert R.signature_policy(R.signature(s)).first().violations == ["mismatch"]
    assert R.signature_policy(R.signature(s), fail_on_mismatch=False, require_calls=100).first().violations == ["calls"]
    assert R.calls_policy(R.calls(s, "freight"), 5).first().passed and not R.calls_policy(R.calls(s, "nothing")).first().passed
    assert not R.unused_policy(R.unused_definitions(s)).first().passed
    assert R.impact_policy(R.impact(s, "nothing"), require_definitions=1).first().violations == ["risk-level", "definitions"]
    assert R.lets_policy(R.lets(s), fail_on_duplicate_evaluation=True).first().violations == ["duplicate-evaluation"]
    assert R.duplicates_policy(R.duplicates(s), max_groups=50).first().passed
    statuses = {r.status: r["count"] for r in R.signature_summary(s).collect()}
    assert statuses[None] == sum(n for k, n in statuses.items() if k) and statuses["missing-arguments"] == 1
    assert {r.category: r["count"] for r in R.definition_summary(s).collect()} == {None: 5, "function": 5}
    assert {(r.name, r.made, r.received) for r in R.graph_nodes(s).collect()} >= {("FREIGHT", 1, 5), ("EXTRA", 1, 0)}
    big = " ".join(f"(a{k} b)" for k in range(1100))
    pair = sources(spark, ("l.lisp", f"(defun f () {big})"), ("r.lisp", f"(defun f () {big} c)"))
    told = similarity_summary(pair, 0.5, form_scope="top-level", fail_on_skipped=True).first()
    assert (told.possible, told.skipped, told.evaluated, told.passed) == (1, 1, 0, False)


def test_workspace_check_and_discovery(spark, tmp_path):
    s = sources(spark, ("core.lisp", "(defun f ())"), ("init.el", "(defvar x)"), ("bad.scm", "(a"))
    total = [r for r in R.workspace(s).collect() if r.dialect is None and r.status is None]
    assert [(r.files, r.definitions) for r in total] == [(3, 2)]
    bad = R.check(s).filter("status = 'error'").collect()
    assert [(r.file, r.error_code, r.error_position) for r in bad] == [("bad.scm", "unclosed-list", 0)]
    for name in ("a.lisp", ".hidden/b.lisp", "build/c.lisp", "notes.txt", "skip/d.lisp"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("(defun f ())")
    files = from_files(spark, [str(tmp_path)])
    named = from_files(spark, [f"{tmp_path}/notes.txt", f"file://{tmp_path}/a.lisp"])
    assert {r.path.rsplit("/", 1)[-1]: r.ordinal for r in named.collect()} == {"notes.txt": 0, "a.lisp": 1}
    found = {r.path.rsplit("/", 1)[-1]: r.skipped for r in workspace(files, f"file:{tmp_path}", exclude=("skip",)).collect()}
    assert found["a.lisp"] is None and found["notes.txt"] == "unknown" and found["c.lisp"] == "generated" and found["d.lisp"] == "excluded"


@pytest.mark.parametrize(
    ("name", "text", "due"),
    [
        ("a.scm", "(let ((x (fetch))) (show x))", ["fetch", "show"]),
        ("b.scm", "(let* ((x (fetch)) (y (next x))) (show y))", ["fetch", "next", "show"]),
        ("c.scm", "(let again ((i (first))) (again (next i)))", ["i", "first", "again", "next"]),
        ("d.lisp", "(with-slots ((a slot-a) b) (thing) (show a))", ["with-slots", "thing", "show"]),
        ("e.lisp", "(with-accessors ((a get-a)) thing (show a))", ["with-accessors", "show"]),
        ("f.clj", "(let [x (fetch) y (next x)] (show y))", ["let", "fetch", "next", "show"]),
        ("g.janet", "(let [x (fetch)] (show x))", ["let", "fetch", "show"]),
        ("h.fnl", "(let [x (fetch)] (show x))", ["let", "fetch", "show"]),
        ("i.lisp", "(do ((i (first) (next i)) j) ((done i) (total)) (show i))", ["do", "first", "next", "done", "total", "show"]),
        ("j.el", "(let* ((a (fetch)) b) (show a))", ["let*", "fetch", "show"]),
        ("k.lisp", "(prog (a (b (fetch))) (show b))", ["prog", "fetch", "show"]),
        ("l.lisp", "(let)", ["let"]),
    ],
)
def test_calls_of_binding_forms(spark, name, text, due):
    assert [r["head"] for r in R.calls(sources(spark, (name, text))).orderBy("span_start").collect()] == due


def test_symbols_and_forms(spark):
    s = sources(spark, ("a.lisp", "(foo 'bar (baz cl:foo \"foo\")) ; foo\n'(foo) FOO"))
    got = [(r.path, r.text, r.quoted) for r in R.symbols(s, "foo").orderBy("span_start").collect()]
    assert got == [("0.0", "foo", False), ("0.2.1", "cl:foo", False), ("1.0", "foo", False), ("2", "FOO", False)]
    assert [(r.path, r.quoted) for r in R.symbols(s, "bar").collect()] == [("0.1", True)]
    f = R.form(s, path="0").first()
    assert (f.kind, f.head, f.child_count, f.atom_count, f.list_count, f.max_depth) == ("list", "foo", 3, 5, 2, 2)
    assert R.form(s, at=10).first().head == "baz"
    assert comments(s).first().text == "; foo"
    st = R.stats(s).first()
    assert (st.top_level_forms, st.outline_entries, st.atom_occurrences) == (3, 2, 6)
    assert nodes(s).filter("kind = 'root'").count() == 1


def test_names_are_counted_where_they_are_read(spark):
    """Definitions and one row for each other name, not one for each node."""
    files = [(f"{k}.lisp", f"(defun own-{k} (own-1) (own-{k} own-1) (shared 1) (shared 2))") for k in range(40)]
    table = named(sources(spark, *files, ("p.lisp", "(defpackage p (:export #:own-3)) (defun shared (x) x)")).coalesce(1))
    rows = [(r.needle, r.uses, r.exported) for r in table.filter("category IS NULL").collect()]
    assert sorted(r for r in rows if not r[0].startswith("OWN-")) == [("1", 40, False), ("2", 40, False), ("DEFUN", 41, False), ("SHARED", 80, False)]
    assert [r for r in rows if r[0].startswith("OWN-")] == [("OWN-3", 0, True)]
    told = {r.name: (r.reference_count, r.unused) for r in R.unused_definitions(sources(spark, *files, ("s.lisp", "(defun shared (x) x)")), include_protected=True).collect()}
    assert told == {"shared": (80, False)} | {f"own-{k}": (0, True) for k in range(40)}


def test_shapes_make_rows_of_large_lists_only():
    text = "(defun f (a b) (g [x (h 1 2 3)] 'c) ())"
    tree = read(text, "unknown")
    whole = columns(tree, {"shape_hash", "subtree_nodes", "node_id", "head", "path"})
    for least in (1, 4, 9):
        want = [k for k, h in enumerate(whole["shape_hash"]) if h is not None and whole["subtree_nodes"][k] >= least]
        got = facts.shaped(tree, least, {"head", "path"})
        assert got == {c: [whole[c][k] for k in want] for c in ("shape_hash", "node_id", "subtree_nodes", "head", "path")}


def test_unused_and_removal(spark):
    text = "(defpackage p (:export kept))\n(defun used () 1)\n(defun kept () (used))\n(defun gone () (gone))\n(defstruct s)"
    s = sources(spark, ("a.lisp", text))
    unused = {r.name: r.actionable for r in R.unused_definitions(s).collect()}
    assert unused == {"kept": True, "gone": True, "s": False, "p": False}
    plan = {r.name: r.skipped for r in W.remove_unused(s).collect()}
    assert plan == {"kept": "exported", "gone": None, "s": "protected", "p": "protected"}
    edits = W.remove_unused(s).filter("skipped IS NULL").select("file_id", "start", "end", "replacement")
    assert "gone" not in W.apply_edits(s, edits).first().text


def test_shapes_of_deep_and_headless_forms(spark):
    deep = "(" * 10_000 + ")" * 10_000
    s = sources(spark, ("deep.lisp", deep), ("a.clj", "((x) [y] z) ((x) [q] 1) (w (x))"), ("b.clj", "(w (y)) (v (y)) ((x) [y z] z)"))
    groups = {r["shape"]: (r["count"], r["files"]) for r in R.duplicates(s, min_node_count=3).collect() if not r["shape"].startswith("(paren (paren (paren")}
    assert groups == {"(paren (paren _atom) (bracket _atom) _atom)": (2, 1), "(paren head:w (paren _atom))": (2, 2)}
    began = time.time()
    tree = read(deep)
    assert len(set(facts.shape_hashes(tree)) - {None}) == 10_000 and time.time() - began < 5


def test_duplicates_lets_similarity(spark):
    s = sources(spark, ("a.lisp", "(deftest a (is (f 1 2)))\n(deftest b (is (f 3 4)))\n(defun x () (f 1))"))
    assert [(r["count"], r["head"]) for r in R.duplicates(s, min_node_count=7).collect()] == [(2, "deftest")]
    assert [r.replaced for r in R.replacement_plan(s, min_node_count=7, keep_first=True).collect()] == ["1"]
    lets = R.lets(sources(spark, ("a.lisp", "(defun invoice () (let ((product (* w h))) (+ product m)))\n(let ((x (compute))) (+ x x))"))).orderBy("path").collect()
    assert [(r.path, r.reference_count, r.inlineable, r.risks) for r in lets] == [("0.3", 1, True, ""), ("1", 2, False, "duplicate-evaluation")]
    pair = sources(spark, ("left.lisp", "(defun alpha (x) (+ x 1))"), ("right.lisp", "(defun beta (y) (+ y 2))"))
    got = similarity(pair, 0.8, comparison_scope="cross-file").collect()
    assert len(got) == 1 and got[0].distance_x10 == 12
    ends = similarity(sources(spark, ("a.lisp", "(foo a b) (foo a b) (foo a c)")), 1.0).collect()
    assert [(r.left_path, r.right_path, r.similarity) for r in ends] == [("0", "1", 1.0)]
    for n in (8, 16):
        rows = sources(spark, *[(f"{k}.lisp", f"(defun f{k} (x) (+ x 1))") for k in range(n)])
        assert similarity(rows, 0.9, min_node_count=2, form_scope="top-level", overlap_policy="all", max_results=None).count() == n * (n - 1) // 2
    with pytest.raises(ValueError):
        similarity(rows, 2.0)


def test_risks_of_let_bindings(spark):
    text = "(let ((crate hook)) (let ((hook 1)) (list hook crate)))\n(let ((*level* 2)) (pour))\n(let ((a 1) (b 2)) (+ a b))\n(let ((k 1)) (+ k k))"
    got = {r.name: r.risks for r in R.lets(sources(spark, ("a.lisp", text))).collect()}
    assert got["crate"] == "capture" and got["*level*"] == "possible-dynamic-variable-rebind" and got["k"] == "duplicate-evaluation"
    assert got["a"] == got["b"] == "multiple-bindings,unsupported-by-inline-let" and got["hook"] == ""


def test_similarity_of_all_suppliers(spark, tmp_path):
    keys = [1, 2, 3, 58, 59, 60, 61, 62, 100, 1000]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    trees = {}
    for r in bindings(spark, str(tmp_path)).collect():
        tree = read(r.text, r.dialect)
        trees[r.file_id] = encode(tree, next(k for k, n in enumerate(tree.nodes) if not n.parent and n.kind == "list"))
    want = {(a, b, distance(trees[a], trees[b])) for a in keys for b in keys if a < b}
    got = QUERIES["similarity_suppliers"](spark, str(tmp_path)).collect()
    assert {(r.left_file, r.right_file, r.distance_x10) for r in got} == want and len(got) == len(want)


def test_all_pairs_are_not_sorted(spark, tmp_path, capsys):
    """No pair waits for the others: SQL leaves the order of all pairs open."""
    spark.createDataFrame([(k,) for k in range(6)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    got = QUERIES["similarity_suppliers"](spark, str(tmp_path))
    got.explain()
    assert "rangepartitioning" not in capsys.readouterr().out
    assert got.count() == 15


def test_manifest_lifecycle(spark, tmp_path):
    s = sources(spark, *FREIGHT)
    manifest = W.preview(s, "rename-function", from_="freight", to="haulage")
    W.write_manifest(manifest, f"{tmp_path}/m")
    again = W.read_manifest(spark, f"{tmp_path}/m")
    assert W.preview_policy(again, require_changed_files=2).first().passed
    assert W.manifest_status(again, s).first()["action"] == "apply"
    assert "+(defun courier-mode () (haulage 5 6))" in "".join(r.diff for r in W.diff(again, s).collect())
    stale = s.withColumn("text", F.concat("text", F.lit(" ")))
    assert W.manifest_status(again, stale).first()["action"] == "preview-again"
    with pytest.raises(ValueError):
        W.apply_manifest(again, stale, f"{tmp_path}/no")
    W.apply_manifest(again, s, f"{tmp_path}/new")
    after = spark.read.parquet(f"{tmp_path}/new")
    assert all(r.passed for r in W.verify(s, "freight", "haulage", after=after).collect())
    steps = {r.step: r.passed for r in W.workspace_execute(s, "freight", "size", f"{tmp_path}/newer").collect()}
    assert steps == {"preview": True, "pre-verify": True, "write": True, "old-symbol-gone": True, "new-symbol-present": True}
    moved = {r.path: r.text for r in W.move_forms(s, "core.lisp", "init.el", names=["ledger"]).collect()}
    assert "ledger" not in moved["core.lisp"] and moved["init.el"].endswith("(defun ledger () (+ (freight 3 4) 1))\n")
    assert W.plan(s, "missing").first().decision == "manual"
    mark = W.manifest_hash(again)
    assert W.manifest_hash(again.orderBy(F.desc("path"))) == mark and W.check_manifest(again, s, expect_hash=mark).count() == 2
    with pytest.raises(ValueError, match="expected"):
        W.check_manifest(again, s, expect_hash="0" * 16)
    assert {r.status for r in W.check_manifest(again, s, root="elsewhere").collect()} == {"outside"}


def test_moves_to_an_anchor(spark):
    s = sources(spark, ("a.lisp", "(defun one () 1)\n(defun two () 2)\n"), ("b.lisp", "(first)\n(second)\n"))
    at = lambda **more: {r.path: r.text for r in W.move_forms(s, "a.lisp", "b.lisp", names=["one"], **more).collect()}["b.lisp"]
    assert at(insert="before", anchor_path="1") == "(first)\n(defun one () 1)\n\n(second)\n"
    assert at(insert="after", anchor_path="0") == "(first)\n\n(defun one () 1)\n(second)\n"
    stays = {r.path: r.text for r in W.move_forms(s, "a.lisp", "b.lisp", names=["one"], insert="after", anchor_path="9").collect()}
    assert stays == {r.path: r.text for r in s.collect()}
    with pytest.raises(ValueError):
        W.move_forms(s, "a.lisp", "b.lisp", names=["one"], insert="before")


def test_workspace_commands(spark):
    s = sources(spark, ("w/a.lisp", FREIGHT[0][1]), ("w/build/b.lisp", FREIGHT[0][1]), ("w/c.txt", "x"))
    assert W.workspace_plan(s, "w", "freight").first().decision == "automatic"
    manifest = W.workspace_preview(s, "w", "freight", "haulage")
    assert [r.path for r in manifest.collect()] == ["w/a.lisp"] and "haulage" in manifest.first().rewritten
    steps = {r.step: r.passed for r in W.workspace_execute(s.filter("path = 'w/a.lisp'"), "freight", "ledger", mode="function", fail_on_target_conflict=True).collect()}
    assert steps == {"preview": False, "pre-verify": True}
    with pytest.raises(ValueError, match="mode"):
        W.workspace_preview(s, "w", "freight", "haulage", mode="all")
    kept = workspace(s, "w", include_unknown=True, max_file_bytes=10)
    assert {r.skipped: r.files for r in skipped_summary(kept).collect()} == {"too-large": 2, None: 1}
    assert quota(kept, max_files=1).first().passed and quota(kept, max_bytes=0).first().violations == ["bytes"]


def test_relations_of_an_impact(spark):
    s = sources(spark, *FREIGHT, ("b.lisp", "(defun loop-back (n) (loop-back n)) (mapcar 'freight x) (list #'freight (freight 1))"))
    places = {(r.file_id, r.path): (r.context, r["head"]) for r in R.impact_references(s, "freight").collect()}
    assert places[0, "0.1"] == ("definition-name", "defun") and places[0, "1.3.0"] == ("call", "freight")
    assert places[2, "1.1"] == ("reference", "mapcar") and places[2, "2.1"] == ("reference", "list") and places[2, "2.2.0"] == ("call", "freight") and len(places) == 7
    edges = {(r.direction, r.caller, r.callee, r.calls) for r in R.impact_edges(s, "loop-back").collect()}
    assert edges == {("inbound", "loop-back", "LOOP-BACK", 1), ("outbound", "loop-back", "LOOP-BACK", 1)}
    assert {r.status: r["count"] for r in R.impact_statuses(s, "freight").collect()} == {"exact": 3, "missing-arguments": 1, None: 4}
    bounds = {(r["head"], r.min_parameter_count, r.max_parameter_count) for r in R.signature(sources(spark, ("a.lisp", "(defun f (a &optional b) a) (defun g (a &rest r) a) (f 1) (g 1) (h 1)")), bounds=True).collect()}
    assert bounds == {("f", 1, 2), ("g", 1, None), ("h", None, None)}
    empty = sources(spark, ("a.lisp", "")).filter("false")
    assert R.impact_edges(empty, "f").count() == R.impact_references(empty, "f").count() == 0 and [tuple(r) for r in R.replacement_summary(empty).collect()] == [(0, 0, 0)]


@pytest.mark.parametrize("limits", [(None, None), (3, None), (None, 1000), (40, 900), (0, None), (None, 0)])
def test_admission_in_order(spark, limits):
    rows = [(f"w/{k * 7919 % 97:03d}.lisp", (k * 31) % 60 if k % 9 else None) for k in range(97)]
    got = {r.path: r for r in admitted(spark.createDataFrame(rows, "path string, bytes long").repartition(5), *limits).collect()}
    assert len(got) == 97
    total, over = 0, False
    for nth, (path, size) in enumerate(sorted(rows), 1):
        total += size or 0
        files, much = (limit is not None and value > limit for limit, value in zip(limits, (nth, total), strict=True))
        due = "after-limit" if over else "breaks-limit" if files or much else "admitted"
        over = over or files or much
        assert (got[path].ordinal, got[path].total_bytes, got[path].status) == (nth, total, due)
        assert got[path].broken == (("files" if files else "bytes") if due == "breaks-limit" else None)
    none = admitted(spark.createDataFrame([], "path string, bytes long"), *limits)
    assert none.count() == 0


def test_files_behind_the_limit_are_never_opened(spark, tmp_path):
    for name, size in (("a b.lisp", 10), ("b.lisp", 20), ("c.lisp", 400), ("d.lisp", 5)):
        (tmp_path / name).write_text("x" * size)
    files, listing = read_within(spark, [str(tmp_path)], max_bytes=100)
    assert [(r.path.rsplit("/", 1)[1], r.status, r.broken) for r in listing.orderBy("path").collect()] == [
        ("a%20b.lisp", "admitted", None), ("b.lisp", "admitted", None), ("c.lisp", "breaks-limit", "bytes"), ("d.lisp", "after-limit", None),
    ]
    assert sorted(len(r.text) for r in files.collect()) == [10, 20]
    scan = files._jdf.queryExecution().executedPlan()
    while scan.children().nonEmpty():
        scan = scan.children().head()
    assert scan.metrics().apply("numFiles").value() == 2
    assert read_within(spark, [str(tmp_path)], max_files=0)[0].count() == 0


def test_overlapping_edits_are_an_error(spark):
    s = sources(spark, ("a.lisp", "(abc)"))
    edits = spark.createDataFrame([(0, 1, 3, "x"), (0, 2, 4, "y")], "file_id long, start long, end long, replacement string")
    with pytest.raises(Exception, match="overlap"):
        W.apply_edits(s, edits).collect()


def test_stream_index(spark, tmp_path):
    from parenlake.streaming.index import index_stream

    sources(spark, *FREIGHT).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    index_stream(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/nodes").filter("is_call").count() > 4


def test_policy_and_capabilities(spark):
    s = sources(spark, *FREIGHT)
    g = R.policy(R.signature(s), "signature", mismatch=F.sum(F.when(F.col("status").isin("missing-arguments", "extra-arguments"), 1)) > 0).first()
    assert g.passed and g.violations == []
    assert R.capabilities(spark).count() > 100


@pytest.mark.parametrize("report", [R.symbols, R.calls, R.signature, R.impact_references, R.impact, R.impact_statuses])
def test_only_texts_that_may_hold_a_symbol_are_parsed(spark, monkeypatch, report):
    seen = []
    texts = ["(defun fee (x) x)", "(FEE 1)", "(f (quote p:fee))", r"(f\ee 2)", "(|FEE| 3)", "(|fee| 4)", "(coffee 1)", "(feed 1)", None, "(fee"]
    s = sources(spark, *[(f"{k}.lisp", t) for k, t in enumerate(texts)])
    for name in ("nodes", "parsed", "sites"):
        make = getattr(R, name)
        monkeypatch.setattr(R, name, lambda table, *more, make=make: (seen.append({r.path for r in table.select("path").collect()}), make(table, *more))[1])
    got = report(s, "fee")
    assert got.count() > 0 and seen[0] == {f"{k}.lisp" for k in (0, 1, 2, 3, 4, 5, 6, 9)}
    monkeypatch.setattr(R, "holding", lambda table, *names: table)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, report(s, "fee").collect()))


def test_sites_are_the_calls_and_definitions_of_the_nodes():
    texts = ["(defun f (a &optional b) (g a) (flet ((h (x) x)) (h 1)))", "'(defun q (x) x) (let ((a (b))) `(c ,(d)))", "[(e) {f (g)}] (defmethod m :after ((x y)) (z))", "", "a b", "((f)) ()", "(defvar *v* 1)\n(define-thing t2 :on)"]
    for text in texts:
        for dialect in ("common-lisp", "emacs-lisp", "scheme", "clojure", "unknown"):
            try:
                tree = read(text, dialect)
            except ValueError:
                continue
            whole, got = columns(tree), sites(tree, set(SITES))
            kept = [k for k in range(len(tree.nodes)) if whole["is_call"][k] or whole["category"][k] is not None]
            assert set(got) == SITES and all(got[n] == [whole[n][k] for k in kept] for n in SITES)
            assert len(kept) < len(tree.nodes)
