"""A query for each command: a corpus in which every file holds one form that
the command must rewrite and, by turns, one that it must refuse or leave alone.

Each entry is a command, its arguments, a form, what must become of it, and a
form that stays as it is (with whether that is a refusal). "{k}" stands for a
supplier's key, so files differ and the SQL knows each result from the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parenlake.operators.rewrites import rewrite

#: (command, arguments, form, result, form that stays, whether it is refused)
COMMANDS: list[tuple[str, dict, str, str, str, bool]] = [
    ("select", {"path": "0.1"}, "(load n{k} off)", "(load n{k} off)", "(n{k})", True),
    ("replace", {"path": "0.2", "with_": "(new)"}, "(store n{k} old)", "(store n{k} (new))", "(n{k} 1)", True),
    ("transpose-backward", {"path": "0.2"}, "(pair n{k} right)", "(pair right n{k})", "(n{k} 1)", True),
    ("slurp-backward", {"path": "1"}, "n{k} (rest of it)", "(n{k} rest of it)", "(n{k} x)", True),
    ("barf-backward", {"path": "0"}, "(n{k} stays in)", "n{k} (stays in)", "n{k}", True),
    ("repair-unclosed-lists", {}, "(open (list n{k}", "(open (list n{k}))", "(whole n{k})", True),
    ("format", {}, "(let ((box (find n{k})) (tag 1)) (send box tag))", "(let ((box (find n{k}))\n      (tag 1))\n  (send box tag))\n", "(list n{k}", True),
    ("insert-top-level", {"with_": "(added)"}, "(first n{k})\n", "(first n{k})\n\n(added)\n", "n{k})", True),
    ("replace-forms", {"paths": ["0.1", "0.3"], "with_": "(same)"}, "(list (a) n{k} (b))", "(list (same) n{k} (same))", "(n{k})", True),
    ("remove-definition", {"path": "0"}, "(defun gone-{k} () 1)\n(defun kept-{k} () 2)", "(defun kept-{k} () 2)", "(call n{k})", True),
    ("sort-definitions", {}, "(defun z-{k} ()) (defun a-{k} ())", "(defun a-{k} ()) (defun z-{k} ())", "(defun a-{k} ()) (defun z-{k} ())", False),
    ("add-export", {"symbol": "made"}, "(defpackage shelf-{k} (:export top))", "(defpackage shelf-{k} (:export top made))", "(list n{k})", True),
    ("sort-package-exports", {}, "(defpackage shelf-{k} (:export third first second))", "(defpackage shelf-{k} (:export first second third))", "(list n{k})", True),
    ("sort-package-options", {}, "(defpackage shelf-{k} (:export top) (:use cl))", "(defpackage shelf-{k} (:use cl) (:export top))", "(list n{k})", True),
    ("merge-package-options", {}, "(defpackage shelf-{k} (:use cl) (:use alexandria cl))", "(defpackage shelf-{k} (:use cl alexandria))", "(list n{k})", True),
    ("rename-package", {"from_": "depot", "to": "store"}, "(defpackage #:depot (:use :cl)) (in-package :depot) (depot::fetch {k})", "(defpackage #:store (:use :cl)) (in-package :store) (store::fetch {k})", "(in-package :other) (fetch {k})", False),
    ("rename-at", {"at": 7, "to": "total"}, "(let ((sum {k})) (* sum sum))", "(let ((total {k})) (* total total))", "(a)", True),
    ("rename-in-form", {"path": "0", "from_": "cost", "to": "price"}, "(add cost {k} cost) (cost)", "(add price {k} price) (cost)", "(add fee {k})", False),
    ("rename-function", {"from_": "weigh", "to": "measure"}, "(defun weigh (x) (* x {k}))\n(weigh 2)\n(flet ((weigh (y) y)) (weigh 3))", "(defun measure (x) (* x {k}))\n(measure 2)\n(flet ((weigh (y) y)) (weigh 3))", "#+sbcl (defun weigh () {k})\n(weigh)", True),
    ("rename-macrolet", {"from_": "twice", "to": "double"}, "(macrolet ((twice (x) `(* 2 ,x))) (twice {k}))", "(macrolet ((double (x) `(* 2 ,x))) (double {k}))", "(macrolet ((thrice (x) x)) (thrice {k}))", True),
    ("rename-symbol-macro", {"from_": "here", "to": "place"}, "(define-symbol-macro here (car box))\n(setf here {k})", "(define-symbol-macro place (car box))\n(setf place {k})", "(list n{k})", True),
    ("rename-local-function", {"from_": "step", "to": "next"}, "(labels ((step (x) (if x (step nil) {k}))) (step t))", "(labels ((next (x) (if x (next nil) {k}))) (next t))", "(list n{k})", True),
    ("rename-block", {"path": "0", "from_": "exit", "to": "done"}, "(block exit (return-from exit {k}))", "(block done (return-from done {k}))", "(list n{k})", True),
    ("rename-tag", {"path": "0", "from_": "again", "to": "retry"}, "(tagbody again (poll {k}) (go again))", "(tagbody retry (poll {k}) (go retry))", "(list n{k})", True),
    ("unwrap-function-calls", {"function": "read-item", "wrapper": "checked"}, "(use (checked (read-item {k})))", "(use (read-item {k}))", "(use (read-item {k}))", False),
    ("unwrap-call", {"path": "0.1", "argument_index": 1}, "(keep (drop a n{k}))", "(keep n{k})", "(n{k})", True),
    ("thread-expression", {"path": "0"}, "(third (second (first n{k}) 1) 2)", "(-> n{k} first (second 1) (third 2))", "n{k}", True),
    ("unthread-expression", {"path": "0"}, "(-> n{k} first (second 1))", "(second (first n{k}) 1)", "(list n{k})", True),
    ("extract-function", {"path": "0.3.1", "name": "area"}, "(defun cost (w h) (+ (* w h) {k}))", "(defun cost (w h) (+ (area w h) {k}))\n\n(defun area (w h) (* w h))\n", "(n{k})", True),
    ("extract-local-function", {"path": "0.2", "enclosing_path": "0", "name": "more"}, "(let ((x {k})) (+ x 2))", "(flet ((more (x) (+ x 2))) (let ((x {k})) (more x)))", "(n{k})", True),
    ("inline-function", {"definition_path": "0"}, "(defun half (x) (/ x 2)) (half {k})", "(defun half (x) (/ x 2)) (/ {k} 2)", "(list n{k})", True),
    ("inline-lambda", {"path": "0"}, "((lambda (x) (+ x 1)) {k})", "(let ((x {k})) (+ x 1))", "(list n{k})", True),
    ("inline-local-function", {"path": "0"}, "(flet ((inc (x) (+ x 1))) (* (inc {k}) 3))", "(* (+ {k} 1) 3)", "(list n{k})", True),
    ("inline-symbol-macro", {"path": "0"}, "(symbol-macrolet ((top (car pile))) (use top {k}))", "(use (car pile) {k})", "(list n{k})", True),
    ("inline-literal-constant", {"path": "0"}, "(defconstant +max+ {k})\n(clip +max+)", "(clip {k})", "(list n{k})", True),
    ("convert-labels-to-flet", {"path": "0"}, "(labels ((one () {k})) (one))", "(flet ((one () {k})) (one))", "(labels ((one () (one))) {k})", True),
    ("convert-flet-to-labels", {"path": "0"}, "(flet ((one () {k})) (one))", "(labels ((one () {k})) (one))", "(flet ((one () (one))) {k})", True),
    ("remove-unused-block", {"path": "0", "name": "out"}, "(block out (work {k}))", "(work {k})", "(block out (return-from out {k}))", True),
    ("remove-unused-tag", {"path": "0", "name": "mark"}, "(tagbody mark (work {k}))", "(tagbody (work {k}))", "(tagbody mark (go mark) {k})", True),
    ("add-function-parameter", {"definition_path": "0", "name": "unit", "argument": "1"}, "(defun ship (box) box) (ship {k})", "(defun ship (box unit) box) (ship {k} 1)", "(list n{k})", True),
    ("move-function-parameter", {"definition_path": "0", "name": "a", "to_index": 2}, "(defun mix (a b c) a) (mix {k} 2 3)", "(defun mix (b c a) a) (mix 2 3 {k})", "(list n{k})", True),
    ("swap-function-parameters", {"definition_path": "0", "left_name": "a", "right_name": "b"}, "(defun less (a b) (- a b)) (less {k} 2)", "(defun less (b a) (- a b)) (less 2 {k})", "(list n{k})", True),
    ("reorder-function-parameters", {"definition_path": "0", "parameter_order": ["b", "a"]}, "(defun put (a b) a) (put {k} 2)", "(defun put (b a) a) (put 2 {k})", "(list n{k})", True),
    ("remove-function-parameter", {"definition_path": "0", "name": "b"}, "(defun take (a b) a) (take {k} 2)", "(defun take (a) a) (take {k})", "(defun take (a b) (+ a b)) (take {k} 2)", True),
    ("introduce-let", {"path": "0.1", "name": "item", "all_occurrences": True}, "(join (find {k}) (find {k}))", "(let ((item (find {k}))) (join item item))", "n{k}", True),
    ("convert-let-star-to-let", {"path": "0"}, "(let* ((a 1) (b {k})) (+ a b))", "(let ((a 1) (b {k})) (+ a b))", "(let* ((a {k}) (b a)) b)", True),
    ("convert-do-star-to-do", {"path": "0"}, "(do* ((i 0 (+ i 1))) ((= i {k})) (show i))", "(do ((i 0 (+ i 1))) ((= i {k})) (show i))", "(list n{k})", True),
    ("convert-prog-star-to-prog", {"path": "0"}, "(prog* ((a 1)) (use a {k}))", "(prog ((a 1)) (use a {k}))", "(list n{k})", True),
    ("merge-nested-let-star", {"path": "0"}, "(let* ((a {k})) (let* ((b a)) b))", "(let* ((a {k}) (b a)) b)", "(list n{k})", True),
    ("merge-nested-let", {"path": "0"}, "(let ((a {k})) (let ((b 2)) (+ a b)))", "(let ((a {k}) (b 2)) (+ a b))", "(let ((a {k})) (let ((b a)) b))", True),
    ("merge-nested-flet", {"path": "0"}, "(flet ((f () {k})) (flet ((g () 2)) (f)))", "(flet ((f () {k}) (g () 2)) (f))", "(list n{k})", True),
    ("split-let-star", {"path": "0", "binding_index": 1}, "(let* ((a {k}) (b a)) b)", "(let* ((a {k})) (let* ((b a)) b))", "(list n{k})", True),
    ("split-let", {"path": "0", "binding_index": 1}, "(let ((a {k}) (b 2)) (+ a b))", "(let ((a {k})) (let ((b 2)) (+ a b)))", "(list n{k})", True),
    ("eliminate-empty-binding-form", {"path": "0.1"}, "(call (let () (a) {k}))", "(call (progn (a) {k}))", "(n{k})", True),
    ("flatten-progn", {"path": "0"}, "(progn a (progn b {k}) d)", "(progn a b {k} d)", "(list n{k})", True),
    ("convert-if-to-cond", {"path": "0"}, "(if ready {k} (wait))", "(cond (ready {k}) (t (wait)))", "(list n{k})", True),
    ("convert-cond-to-if", {"path": "0"}, "(cond (ready {k}) (t (wait)))", "(if ready {k} (wait))", "(list n{k})", True),
    ("convert-when-to-if", {"path": "0"}, "(when ready (go-on) {k})", "(if ready (progn (go-on) {k}))", "(list n{k})", True),
    ("convert-unless-to-if", {"path": "0"}, "(unless ready {k})", "(if ready nil {k})", "(list n{k})", True),
    ("convert-if-to-when", {"path": "0"}, "(if ready {k} nil)", "(when ready {k})", "(if ready {k} (wait))", True),
    ("convert-if-to-unless", {"path": "0"}, "(if ready nil {k})", "(unless ready {k})", "(if ready {k} (wait))", True),
]


def corpus(spark: SparkSession, sf_dir: str, form: str, stays: str) -> DataFrame:
    """A Common Lisp file for each supplier; every third one stays."""
    key = F.col("s_suppkey").cast("string")
    text = F.replace(F.when(F.col("s_suppkey") % 3 == 2, F.lit(stays)).otherwise(F.lit(form)), F.lit("{k}"), key)
    table = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return table.select(F.col("s_suppkey").alias("file_id"), F.concat(F.lit("forms/"), key, F.lit(".lisp")).alias("path"), F.lit("common-lisp").alias("dialect"), text.alias("text"))


def query(command: str, args: dict, form: str, stays: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rewrite(corpus(spark, sf_dir, form, stays), command, **args).select("file_id", "rewritten", "changed", F.col("refused").isNotNull().alias("refused"))

    return run


def quoted(text: str) -> str:
    """A text as SQL writes it."""
    return " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in text.split("\n"))


def sql(form: str, result: str, stays: str, refused: bool) -> str:
    last = "s_suppkey % 3 = 2"
    return (
        f"SELECT s_suppkey AS file_id, replace(CASE WHEN {last} THEN {quoted(stays)} ELSE {quoted(result)} END, '{{k}}', CAST(s_suppkey AS VARCHAR)) AS rewritten, "
        f"NOT ({last}) AND {str(form != result).lower()} AS changed, {last} AND {str(refused).lower()} AS refused FROM supplier"
    )


QUERIES = {"command_" + name.replace("-", "_"): query(name, args, form, stays) for name, args, form, _, stays, _ in COMMANDS}
ORACLES = {"command_" + name.replace("-", "_"): sql(form, result, stays, refused) for name, _, form, result, stays, refused in COMMANDS}
