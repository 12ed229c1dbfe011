"""Registered queries over the generated corpora, with SQL for their results.

The corpora encode the base tables as source text, so what a report must say
follows from the tables alone; the SQL never looks at a syntax tree.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parenlake.operators import reports as R
from parenlake.operators.nodes import shared_folder
from parenlake.operators.rewrites import apply_edits, check_manifest, commit_manifest, diff, hashed, manifest_status, plan, preview, preview_policy, remove_unused, rewrite, verify
from parenlake.operators.similarity import similarity, similarity_classes, similarity_summary
from parenlake.plans import commands
from parenlake.sources import corpus as C
from parenlake.sources import versions, walk

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Orders as the corpus writes them.
_ITEMS = """
items AS (
    SELECT l_orderkey AS k, l_partkey AS p, l_partkey % 10 < 7 AS known, CASE WHEN l_partkey % 10 < 7 THEN 'part-' ELSE 'spare-' END || l_partkey AS name, l_linenumber % 3 + 1 AS args,
           '(' || name || repeat(' ' || CAST(l_quantity AS BIGINT), l_linenumber % 3 + 1) || ')' AS call,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS i
    FROM lineitem
), texts AS (
    SELECT k, count(*) AS n, sum(args) AS a, '(defun order-' || k || ' (customer priority)' || chr(10) || '  ' || string_agg(call, chr(10) || '  ' ORDER BY i) || ')' || chr(10) AS text
    FROM items GROUP BY k
), library AS (
    SELECT p_partkey AS p, '(defun part-' || p_partkey || ' (x y)' || chr(10) || '  (list x y))' || chr(10) AS text FROM part WHERE p_size % 5 <> 0
), stock AS (
    SELECT p_partkey AS p, '(defvar stock-' || p_partkey || ' 0)' || chr(10) AS text FROM part WHERE p_size % 5 = 0
)"""
_CUSTOMERS = """
files AS (
    SELECT c_custkey AS k, c_nationkey % 7 AS turn,
           ['common-lisp', 'emacs-lisp', 'scheme', 'clojure', 'janet', 'fennel', 'unknown'][CAST(c_nationkey % 7 + 1 AS BIGINT)] AS dialect,
           ['lisp', 'el', 'scm', 'clj', 'janet', 'fnl', 'txt'][CAST(c_nationkey % 7 + 1 AS BIGINT)] AS ext
    FROM customer
)"""
_LETS = """
lets AS (
    SELECT s_suppkey AS k, s_suppkey % 3 AS turn,
           CASE s_suppkey % 3 WHEN 0 THEN '(+ value 1)' WHEN 1 THEN '(+ value value)' ELSE '(+ width 1)' END AS body
    FROM supplier
), texts AS (
    SELECT *, '(defun supplier-' || k || ' (width)' || chr(10) || '  (let ((value (* width ' || k || ')))' || chr(10) || '    ' || body || '))' || chr(10) AS text FROM lets
)"""


def add(name: str, sources: Callable[[SparkSession, str], DataFrame], report: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: report(sources(spark, sf_dir))
    if sql:
        ORACLES[name] = sql


add("check_orders", C.orders, R.check, f"WITH {_ITEMS} SELECT k AS file_id, 'orders/' || k || '.lisp' AS file, 'ok' AS status, CAST(NULL AS VARCHAR) AS error_code, CAST(NULL AS BIGINT) AS error_position FROM texts")
add("check_events", C.events, R.check, "SELECT event_id AS file_id, 'events/' || event_id || '.json' AS file, 'ok' AS status, CAST(NULL AS VARCHAR) AS error_code, CAST(NULL AS BIGINT) AS error_position FROM events")
add("check_documents", C.documents, R.check)
add("dialect_customers", C.customers, R.dialect, f"WITH {_CUSTOMERS} SELECT k AS file_id, 'customers/' || k || '.' || ext AS file, dialect, CASE WHEN dialect LIKE '%lisp' THEN 'lisp' ELSE dialect END AS family FROM files")
add("stats_orders", C.orders, R.stats, f"WITH {_ITEMS} SELECT k AS file_id, CAST(1 AS BIGINT) AS top_level_forms, CAST(1 AS BIGINT) AS outline_entries, CAST(4 + n + a AS BIGINT) AS atom_occurrences FROM texts")
add("outline_orders", C.orders, R.outline, f"WITH {_ITEMS} SELECT k AS file_id, '0' AS path, CAST(0 AS BIGINT) AS start, CAST(length(text) - 1 AS BIGINT) AS \"end\", 'defun' AS head, true AS definition_like FROM texts")
add("agent_report_orders", C.orders, lambda s: R.agent_report(s).select("file_id", "top_level_forms", "outline_entries", "atom_occurrences", F.size("outline").cast("long").alias("outline_rows"), F.size("atoms").cast("long").alias("atom_rows")),
    f"WITH {_ITEMS} SELECT k AS file_id, CAST(1 AS BIGINT) AS top_level_forms, CAST(1 AS BIGINT) AS outline_entries, CAST(4 + n + a AS BIGINT) AS atom_occurrences, CAST(1 AS BIGINT) AS outline_rows, CAST(4 + n + a AS BIGINT) AS atom_rows FROM texts")
add("form_orders", C.orders, lambda s: R.form(s, path="0"),
    f"WITH {_ITEMS} SELECT k AS file_id, 'list' AS kind, 'defun' AS head, CAST(3 + n AS BIGINT) AS child_count, CAST(4 + n + a AS BIGINT) AS atom_count, CAST(2 + n AS BIGINT) AS list_count, CAST(2 AS BIGINT) AS max_depth FROM texts")
add("form_symbols_suppliers", C.bindings, lambda s: R.form_symbols(s, path="0.3"),
    f"""WITH {_LETS}, words AS (SELECT k, length('(defun supplier-' || k || ' (width)') + 3 AS pos, body, unnest(['let', 'value', '*', 'width', CAST(k AS VARCHAR), '+', CASE turn WHEN 2 THEN 'width' ELSE 'value' END, CASE turn WHEN 1 THEN 'value' ELSE '1' END]) AS text,
        unnest([1, 7, 14, 16, 22, 22 + length(CAST(k AS VARCHAR)) + 9, 22 + length(CAST(k AS VARCHAR)) + 11, 22 + length(CAST(k AS VARCHAR)) + 17]) AS off FROM texts)
        SELECT k AS file_id, text, count(*) AS count, CAST(min(pos + off) AS BIGINT) AS first_start FROM words GROUP BY k, text""")  # fmt: skip
add("symbols_part", C.shop, lambda s: R.symbols(s, "part-3").select("file_id", "path", "text", "quoted", "form_head"),
    f"WITH {_ITEMS} SELECT k AS file_id, '0.' || (3 + i) || '.0' AS path, 'part-3' AS text, false AS quoted, 'defun' AS form_head FROM items WHERE p = 3 UNION ALL SELECT -4, '0.1', 'part-3', false, 'defun' FROM library WHERE p = 3")
add("calls_orders", C.orders, R.calls,
    f"""WITH {_ITEMS}, spans AS (SELECT *, length('(defun order-' || k || ' (customer priority)') + 3 + coalesce(sum(length(call) + 3) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM items)
        SELECT k AS file_id, '0.' || (3 + i) AS path, CAST(pos AS BIGINT) AS span_start, CAST(pos + length(call) AS BIGINT) AS span_end, name AS head, CAST(args AS BIGINT) AS argument_count, CAST(NULL AS VARCHAR) AS category, 'order-' || k AS enclosing_definition FROM spans""")  # fmt: skip
add("calls_scopes", C.scopes, lambda s: R.calls(s).select("file_id", "path", "head", "argument_count"),
    """WITH told(turn, path, head, args) AS (VALUES (0, '0', 'with-slots', 3), (0, '0.2', 'get-', 0), (0, '0.3', 'use-', 2), (1, '0', 'let*', 2), (1, '0.1.0.1', 'get-', 0), (1, '0.2', 'use-', 2),
            (2, '0.1.0.1', 'get-', 0), (2, '0.2', 'use-', 2), (3, '0', 'let', 2), (3, '0.1.1', 'get-', 0), (3, '0.2', 'use-', 2), (4, '0', 'let', 2), (4, '0.1.1', 'get-', 0), (4, '0.2', 'use-', 2),
            (5, '0', 'let', 2), (5, '0.1.1', 'get-', 0), (5, '0.2', 'use-', 2), (6, '0', 'do', 3), (6, '0.1.0.1', 'get-', 0), (6, '0.1.0.2', 'next-', 1), (6, '0.2.0', 'done-', 1), (6, '0.3', 'use-', 2))
        SELECT c_custkey AS file_id, path, head || CASE WHEN ends_with(head, '-') THEN CAST(c_custkey AS VARCHAR) ELSE '' END AS head, CAST(args AS BIGINT) AS argument_count FROM customer JOIN told ON c_nationkey % 7 = turn""")  # fmt: skip
add("signature_shop", C.shop, R.signature,
    f"""WITH {_ITEMS} SELECT k AS file_id, '0.' || (3 + i) AS path, name AS head, CAST(args AS BIGINT) AS argument_count,
        CASE WHEN library.p IS NULL THEN 'unknown-definition' WHEN args < 2 THEN 'missing-arguments' WHEN args > 2 THEN 'extra-arguments' ELSE 'exact' END AS status FROM items LEFT JOIN library ON items.p = library.p AND known
        UNION ALL SELECT -1 - p, '0.3', 'list', CAST(2 AS BIGINT), 'unknown-definition' FROM library""")  # fmt: skip
add("call_graph_shop", C.shop, R.call_graph,
    f"""WITH {_ITEMS} SELECT 'order-' || k AS caller, upper(name) AS callee, count(*) AS calls, library.p IS NOT NULL AS internal, CAST(CASE WHEN library.p IS NULL THEN 0 ELSE 1 END AS BIGINT) AS definition_count, CASE WHEN library.p IS NULL THEN '' ELSE 'function' END AS callee_categories
        FROM items LEFT JOIN library ON items.p = library.p AND known GROUP BY k, name, library.p UNION ALL SELECT 'part-' || p, 'LIST', 1, false, CAST(0 AS BIGINT), '' FROM library""")  # fmt: skip
add("impact_part", C.shop, lambda s: R.impact(s, "part-3"),
    f"""WITH {_ITEMS}, one AS (SELECT (SELECT count(*) FROM library WHERE p = 3) AS d, (SELECT count(*) FROM items WHERE p = 3) AS c, (SELECT count(*) FROM items WHERE p = 3 AND (args <> 2 OR NOT EXISTS (SELECT 1 FROM library WHERE p = 3))) AS m)
        SELECT 'part-3' AS symbol, d AS definitions, c AS "references", c AS calls, CAST(0 AS BIGINT) AS non_call_references, m AS signature_mismatches,
        concat_ws(',', CASE WHEN d = 0 THEN 'missing-definition' END, CASE WHEN c > 0 THEN 'inbound-callers' END, CASE WHEN m > 0 THEN 'signature-mismatch' END) AS risks, CASE WHEN d = 0 OR c > 0 THEN 'warning' ELSE 'info' END AS risk_level FROM one""")  # fmt: skip
add("workspace_customers", C.customers, R.workspace,
    f"""WITH {_CUSTOMERS} SELECT CAST(NULL AS VARCHAR) AS dialect, CAST(NULL AS VARCHAR) AS status, count(*) AS files, count(*) AS top_level_forms, count(*) AS definitions FROM files
        UNION ALL SELECT dialect, NULL, count(*), count(*), count(*) FROM files GROUP BY dialect UNION ALL SELECT NULL, 'ok', count(*), count(*), count(*) FROM files""")  # fmt: skip
add("definitions_customers", C.customers, R.definitions,
    f"""WITH {_CUSTOMERS} SELECT k AS file_id, '0' AS path, ['defun', 'defvar', 'define', 'defn', 'defn', 'fn', 'define-thing'][CAST(turn + 1 AS BIGINT)] AS head, 'customer-' || k AS name,
        ['function', 'variable', 'function', 'function', 'function', 'function', 'other'][CAST(turn + 1 AS BIGINT)] AS category, CAST([2, NULL, NULL, 1, 1, 1, NULL][CAST(turn + 1 AS BIGINT)] AS BIGINT) AS parameter_count,
        CAST([1, 1, 0, 1, 1, 1, 1][CAST(turn + 1 AS BIGINT)] AS BIGINT) AS body_form_count, CAST(NULL AS VARCHAR) AS package FROM files""")  # fmt: skip
add("definitions_nations", C.nations, R.definitions,
    """SELECT CAST(n_nationkey AS BIGINT) AS file_id, '0' AS path, 'defpackage' AS head, '#:nation-' || n_nationkey AS name, 'package' AS category, CAST(NULL AS BIGINT) AS parameter_count, CAST(2 AS BIGINT) AS body_form_count, CAST(NULL AS VARCHAR) AS package FROM nation
        UNION ALL SELECT n_nationkey, '2', 'defvar', '*name*', 'variable', NULL, 1, '#:nation-' || n_nationkey FROM nation""")  # fmt: skip
add("packages_nations", C.nations, R.packages,
    """SELECT CAST(n_nationkey AS BIGINT) AS file_id, '0' AS path, '#:nation-' || n_nationkey AS package, '#:cl #:region-' || n_regionkey AS uses, coalesce(string_agg('#:supplier-' || s_suppkey, ' ' ORDER BY s_suppkey), '') AS exports, '' AS nicknames, '' AS imports, CAST(2 AS BIGINT) AS option_count
        FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_regionkey""")  # fmt: skip
add("dependencies_nations", C.nations, lambda s: R.dependencies(s).select("file_id", "dependency", "target"),
    """SELECT CAST(n_nationkey AS BIGINT) AS file_id, 'defpackage-use' AS dependency, '#:cl' AS target FROM nation UNION ALL SELECT n_nationkey, 'defpackage-use', '#:region-' || n_regionkey FROM nation
        UNION ALL SELECT n_nationkey, 'qualified-symbol', 'region-' || n_regionkey FROM nation""")  # fmt: skip
add("unused_definitions_shop", C.shop, R.unused_definitions,
    f"""WITH {_ITEMS} SELECT k AS file_id, '0' AS path, 'order-' || k AS name, 'function' AS category, CAST(0 AS BIGINT) AS reference_count, true AS unused, true AS actionable FROM texts
        UNION ALL SELECT -1 - p, '0', 'part-' || p, 'function', 0, true, true FROM library WHERE p NOT IN (SELECT p FROM items WHERE known)
        UNION ALL SELECT -1 - p, '0', 'stock-' || p, 'variable', 0, true, true FROM stock""")  # fmt: skip
add("duplicates_orders", C.orders, lambda s: R.duplicates(s),
    f"""WITH {_ITEMS}, forms AS (SELECT k, name AS head, '(paren head:' || name || repeat(' _atom', args) || ')' AS shape FROM items WHERE args >= 2
        UNION ALL SELECT k, 'defun', '(paren head:defun _atom (paren _atom _atom) ' || string_agg('(paren _atom' || repeat(' _atom', args) || ')', ' ' ORDER BY i) || ')' FROM items GROUP BY k)
        SELECT shape, count(*) AS count, count(DISTINCT k) AS files, min(head) AS head FROM forms GROUP BY shape HAVING count(*) >= 2""")  # fmt: skip
add("replacement_plan_orders", C.orders, lambda s: R.replacement_plan(s).select("file_id", "shape", "count", "replaced"),
    f"""WITH {_ITEMS} SELECT k AS file_id, '(paren head:' || name || repeat(' _atom', args) || ')' AS shape, count(*) AS count, string_agg('0.' || (3 + i), ' ' ORDER BY i) AS replaced FROM items WHERE args >= 2 GROUP BY k, name, args HAVING count(*) >= 2""")
add("similarity_suppliers", C.bindings, lambda s: similarity(s, 0.9, form_scope="top-level", max_results=None, ranked=False, digits=9),
    f"""WITH {_LETS}, pairs AS (SELECT a.k AS x, b.k AS y, 6 + CASE WHEN a.turn = b.turn THEN 0 WHEN a.turn + b.turn = 3 THEN 6 ELSE 3 END AS c FROM lets a JOIN lets b ON a.k < b.k)
        SELECT x AS left_file, '0' AS left_path, y AS right_file, '0' AS right_path, CAST(c AS BIGINT) AS distance_x10, round(1 - c / 180.0::DOUBLE, 9) AS similarity, round((1 - c / 180.0::DOUBLE) * 18, 9) AS score FROM pairs""")  # fmt: skip
add("lets_suppliers", C.bindings, R.lets,
    f"""WITH {_LETS} SELECT k AS file_id, '0.3' AS path, 'let' AS head, CAST(0 AS INTEGER) AS binding_index, 'value' AS name, '(* width ' || k || ')' AS value, 'list-pair' AS style,
        CAST(CASE turn WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS BIGINT) AS reference_count, turn = 0 AS inlineable, CASE turn WHEN 0 THEN '' WHEN 1 THEN 'duplicate-evaluation' ELSE 'unused-binding' END AS risks FROM lets""")  # fmt: skip
add("plan_rename_part", C.shop, lambda s: plan(s, "part-3").select("symbol", "definitions", "references", "operation", F.array_join("blocking_gates", ",").alias("blocking_gates"), "decision"),
    f"""WITH {_ITEMS}, one AS (SELECT (SELECT count(*) FROM library WHERE p = 3) AS d, (SELECT count(*) FROM items WHERE p = 3) AS c) SELECT 'part-3' AS symbol, d AS definitions, c AS "references", 'rename' AS operation, CASE WHEN d = 0 THEN 'definitions' ELSE '' END AS blocking_gates, CASE WHEN d = 0 THEN 'manual' ELSE 'automatic' END AS decision FROM one""")
add("remove_unused_shop", C.shop, lambda s: remove_unused(s).select("file_id", "name", "skipped", "start", "end"),
    f"""WITH {_ITEMS} SELECT k AS file_id, 'order-' || k AS name, CAST(NULL AS VARCHAR) AS skipped, CAST(0 AS BIGINT) AS start, CAST(length(text) - 1 AS BIGINT) AS "end" FROM texts
        UNION ALL SELECT -1 - p, 'part-' || p, NULL, 0, length(text) - 1 FROM library WHERE p NOT IN (SELECT p FROM items WHERE known)
        UNION ALL SELECT -1 - p, 'stock-' || p, NULL, 0, length(text) - 1 FROM stock""")  # fmt: skip


def _rewritten(name: str, sources, expected: str, base: str, where: str = "true", /, **args: object) -> None:
    command = name
    key = "rewrite_" + name.replace("-", "_")
    add(key, sources, lambda s: rewrite(s, command, **args).select("file_id", "rewritten", "changed", F.col("refused").isNotNull().alias("refused")),
        f"WITH {base}, out AS (SELECT k, text, CASE WHEN {where} THEN {expected} ELSE text END AS new, NOT ({where}) AS refused FROM texts) SELECT k AS file_id, new AS rewritten, new <> text AS changed, refused FROM out")


_DEF = "'(defun supplier-' || k || ' (width)' || chr(10) || '  '"
_rewritten("rename-symbol", C.orders, "replace(text, '(customer priority)', '(client priority)')", _ITEMS, from_="customer", to="client")
_rewritten("rename-binding", C.bindings, "replace(text, 'value', 'area')", _LETS, path="0.3", from_="value", to="area")
_rewritten("inline-let", C.bindings, f"{_DEF} || '(+ (* width ' || k || ') 1))' || chr(10)", _LETS, "turn = 0", path="0.3")
_rewritten("convert-let-to-let-star", C.bindings, "replace(text, '(let (', '(let* (')", _LETS, path="0.3")
_rewritten("remove-unused-binding", C.bindings, "replace(text, '((value (* width ' || k || ')))', '()')", _LETS, "turn = 2", path="0.3", allow_drop_value=True)
_rewritten("replace-function-calls", C.bindings, "replace(text, '(* width', '(times width')", _LETS, from_="*", to="times")
_rewritten("wrap", C.bindings, "replace(text, '(* width ' || k || ')', '((* width ' || k || '))')", _LETS, path="0.3.1.0.1")
_rewritten("splice", C.bindings, "replace(text, '(* width ' || k || ')', '* width ' || k)", _LETS, path="0.3.1.0.1")
_rewritten("raise", C.bindings, f"{_DEF} || body || ')' || chr(10)", _LETS, path="0.3.2")
_rewritten("transpose-forward", C.bindings, "replace(text, '* width ' || k, '* ' || k || ' width')", _LETS, path="0.3.1.0.1.1")
_rewritten("kill", C.bindings, f"{_DEF} || '(let ((value (* width ' || k || ')))))' || chr(10)", _LETS, path="0.3.2")
_rewritten("slurp-forward", C.bindings, "replace(text, '((value (* width ' || k || ')))' || chr(10) || '    ' || body, '((value (* width ' || k || ')) ' || body || ')')", _LETS, path="0.3.1")
_rewritten("barf-forward", C.bindings, "replace(text, '(* width ' || k || ')', '(* width) ' || k)", _LETS, path="0.3.1.0.1")
_rewritten("wrap-function-calls", C.bindings, "replace(text, '(* width ' || k || ')', '(check (* width ' || k || '))')", _LETS, function="*", wrapper="check")
_rewritten("extract-constant", C.bindings, "replace(text, ' ' || k || ')', ' +key+)') || chr(10) || '(defconstant +key+ ' || k || ')' || chr(10)", _LETS, path="0.3.1.0.1.2", name="+key+")

add("apply_edits_orders", C.orders, lambda s: apply_edits(s, rewrite(s, "rename-symbol", from_="priority", to="rank").select("file_id", F.explode("edits").alias("e")).select("file_id", "e.*")).select("file_id", "text"),
    f"WITH {_ITEMS} SELECT k AS file_id, replace(text, 'priority', 'rank') AS text FROM texts")
add("preview_policy_orders", C.orders, lambda s: preview_policy(preview(s, "rename-symbol", from_="customer", to="client")).select("changed", "bad", "edits", "passed"),
    f"WITH {_ITEMS} SELECT count(*) AS changed, CAST(0 AS BIGINT) AS bad, count(*) AS edits, true AS passed FROM texts")
_MARKED = "list_aggregate(list_transform(lines[{}], lambda x: '{}' || {} || chr(10)), 'string_agg', '')"
_OLD, _NEW = [_MARKED.format("1:m", mark, line) for mark, line in (("-", "x"), ("+", "replace(x, 'width', 'w')"))]
add("diff_suppliers", C.bindings, lambda s: diff(preview(s, "rename-symbol", from_="width", to="w"), s),
    f"""WITH {_LETS}, split AS (SELECT k, CASE turn WHEN 2 THEN 3 ELSE 2 END AS m, string_split(rtrim(text, chr(10)), chr(10)) AS lines FROM texts)
        SELECT 'suppliers/' || k || '.lisp' AS path, '--- a/suppliers/' || k || '.lisp' || chr(10) || '+++ b/suppliers/' || k || '.lisp' || chr(10) || '@@ -1,3 +1,3 @@' || chr(10)
            || {_OLD} || {_NEW} || CASE m WHEN 3 THEN '' ELSE ' ' || lines[3] || chr(10) END AS diff FROM split""")  # fmt: skip
add("hash_suppliers", C.bindings, hashed,
    f"""WITH {_LETS}, steps AS (SELECT k, list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(text, ''), lambda x: ascii(x)::HUGEINT)) AS codes FROM texts)
        SELECT 'suppliers/' || k || '.lisp' AS path, 'fnv1a64:' || lower(lpad(to_hex((list_reduce(codes, lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT))::UBIGINT), 16, '0')) AS hash FROM steps""")  # fmt: skip
_ACCOUNT = """SELECT {all} AS possible, {pruned} AS pruned, CAST(0 AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS unprocessed, {all} - {pruned} AS evaluated, {matched} AS matched,
        CAST(0 AS BIGINT) AS suppressed, least({matched}, 10000) AS reported, {matched} > 10000 AS truncated, 'passed' AS decision, true AS passed
        FROM (SELECT count(*) AS n, count(*) FILTER (s_suppkey % 2 = 1) AS o, count(*) FILTER (s_suppkey % 2 = 0) AS e FROM supplier)"""
_ALL, _HALVES = "(n * (n - 1) // 2)", "(o * (o - 1) // 2 + e * (e - 1) // 2)"
add("similarity_summary_suppliers", C.bindings, lambda s: similarity_summary(s, 0.9, form_scope="top-level"), _ACCOUNT.format(all=_ALL, pruned="CAST(0 AS BIGINT)", matched=_ALL))
for kind, told in (("names", {"pruned": "CAST(0 AS BIGINT)", "matched": _ALL}), ("sizes", {"pruned": "o * e", "matched": _HALVES}), ("leaves", {"pruned": "CAST(0 AS BIGINT)", "matched": _HALVES})):
    add(f"similarity_summary_{kind}", lambda spark, sf_dir, kind=kind: C.measures(spark, sf_dir, kind), lambda s: similarity_summary(s, 0.9, min_node_count=2, form_scope="top-level"), _ACCOUNT.format(all=_ALL, **told))
# Calls of one name and as many arguments resemble each other where their
# arguments do: 3 tenths for each that differs, of 10 for each node.
add("similarity_classes_suppliers", C.bindings, lambda s: similarity_classes(s, 0.95, form_scope="top-level"),
    f"""WITH {_LETS}, pairs AS (SELECT a.k AS x, b.k AS y FROM lets a JOIN lets b ON a.k <> b.k WHERE 6 + CASE WHEN a.turn = b.turn THEN 0 WHEN a.turn + b.turn = 3 THEN 6 ELSE 3 END <= 9), n AS (SELECT x, count(*) AS n FROM pairs GROUP BY x)
        SELECT k AS file_id, '0' AS path, k AS class_file, '0' AS class_path, CAST(1 AS BIGINT) AS members, coalesce(n, 0) AS linked_classes, coalesce(n, 0) AS links FROM lets LEFT JOIN n ON k = x""")  # fmt: skip
add("signature_summary_shop", C.shop, R.signature_summary,
    f"""WITH {_ITEMS}, told AS (SELECT k, CASE WHEN library.p IS NULL THEN 'unknown-definition' WHEN args < 2 THEN 'missing-arguments' WHEN args > 2 THEN 'extra-arguments' ELSE 'exact' END AS status FROM items LEFT JOIN library ON items.p = library.p AND known
        UNION ALL SELECT -1 - p, 'unknown-definition' FROM library) SELECT status, count(*) AS count, count(DISTINCT k) AS files FROM told GROUP BY ROLLUP (status)""")  # fmt: skip
add("signature_policy_shop", C.shop, lambda s: R.signature_policy(R.signature(s), require_calls=1).select("report", "passed", F.array_join("violations", ",").alias("violations")),
    f"WITH {_ITEMS}, bad AS (SELECT count(*) AS n FROM items JOIN library ON items.p = library.p AND known WHERE args <> 2) SELECT 'signature' AS report, n = 0 AS passed, CASE WHEN n > 0 THEN 'mismatch' ELSE '' END AS violations FROM bad")
add("definition_summary_customers", C.customers, R.definition_summary,
    f"""WITH {_CUSTOMERS}, told AS (SELECT k, ['function', 'variable', 'function', 'function', 'function', 'function', 'other'][CAST(turn + 1 AS BIGINT)] AS category FROM files) SELECT category, count(*) AS count, count(DISTINCT k) AS files FROM told GROUP BY ROLLUP (category)""")
add("dependency_summary_nations", C.nations, R.dependency_summary,
    """WITH told AS (SELECT n_nationkey AS k, 'defpackage-use' AS dependency, '#:cl' AS target FROM nation UNION ALL SELECT n_nationkey, 'defpackage-use', '#:region-' || n_regionkey FROM nation UNION ALL SELECT n_nationkey, 'qualified-symbol', 'region-' || n_regionkey FROM nation)
        SELECT dependency, count(*) AS count, count(DISTINCT k) AS files, count(DISTINCT target) AS targets FROM told GROUP BY ROLLUP (dependency)""")  # fmt: skip
add("let_summary_suppliers", C.bindings, R.let_summary,
    f"""WITH {_LETS}, told AS (SELECT k, 'let' AS head, turn = 0 AS ok, CASE turn WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS refs FROM lets)
        SELECT head, count(*) AS count, count(DISTINCT k) AS files, count(*) FILTER (ok) AS inlineable, CAST(sum(refs) AS BIGINT) AS "references" FROM told GROUP BY ROLLUP (head)""")  # fmt: skip
add("lets_policy_suppliers", C.bindings, lambda s: R.lets_policy(R.lets(s), fail_on_duplicate_evaluation=True, require_inlineable=True).select("report", "passed", F.array_join("violations", ",").alias("violations")),
    f"WITH {_LETS}, tally AS (SELECT count(*) FILTER (turn = 1) AS d, count(*) FILTER (turn <> 0) AS n FROM lets) SELECT 'lets' AS report, d + n = 0 AS passed, concat_ws(',', CASE WHEN d > 0 THEN 'duplicate-evaluation' END, CASE WHEN n > 0 THEN 'inlineable' END) AS violations FROM tally")
add("unused_policy_shop", C.shop, lambda s: R.unused_policy(R.unused_definitions(s)).select("report", "passed", F.array_join("violations", ",").alias("violations")),
    f"WITH {_ITEMS} SELECT 'unused-definitions' AS report, count(*) = 0 AS passed, CASE WHEN count(*) > 0 THEN 'unused' ELSE '' END AS violations FROM texts")
add("graph_nodes_shop", C.shop, R.graph_nodes,
    f"""WITH {_ITEMS}, ends AS (SELECT 'ORDER-' || k AS name, 1 AS made, 0 AS received, true AS defined FROM items UNION ALL SELECT upper(name), 0, 1, library.p IS NOT NULL FROM items LEFT JOIN library ON items.p = library.p AND known
        UNION ALL SELECT 'PART-' || p, 1, 0, true FROM library UNION ALL SELECT 'LIST', 0, 1, false FROM library)
        SELECT name, CAST(sum(made) AS BIGINT) AS made, CAST(sum(received) AS BIGINT) AS received, bool_or(defined) AS defined FROM ends GROUP BY name""")  # fmt: skip
add("duplicate_summary_orders", C.orders, lambda s: R.duplicate_summary(s),
    f"""WITH {_ITEMS}, forms AS (SELECT k, '(paren head:' || name || repeat(' _atom', args) || ')' AS shape FROM items WHERE args >= 2
        UNION ALL SELECT k, '(paren head:defun _atom (paren _atom _atom) ' || string_agg('(paren _atom' || repeat(' _atom', args) || ')', ' ' ORDER BY i) || ')' FROM items GROUP BY k),
        shapes AS (SELECT shape, count(*) AS n FROM forms GROUP BY shape HAVING count(*) >= 2) SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS forms, max(n) AS largest FROM shapes""")  # fmt: skip
add("verify_after_rename_part", C.shop, lambda s: verify(s, "part-3", "piece-3", after=apply_edits(s, rewrite(R.holding(s, "part-3"), "rename-symbol", from_="part-3", to="piece-3").select("file_id", F.explode("edits").alias("e")).select("file_id", "e.*"))),
    f"""WITH {_ITEMS}, one AS (SELECT (SELECT count(*) FROM library WHERE p = 3) AS d, (SELECT count(*) FROM items WHERE p = 3 AND (args <> 2 OR NOT EXISTS (SELECT 1 FROM library WHERE p = 3))) AS m)
        SELECT 'old-symbol-gone' AS check, true AS passed UNION ALL SELECT 'new-symbol-present', d > 0 FROM one UNION ALL SELECT 'arity-compatible', m = 0 FROM one""")  # fmt: skip
add("manifest_check_orders", C.orders, lambda s: check_manifest(preview(s, "rename-symbol", from_="customer", to="client"), s).select("path", "status", "changed", "output_parse_ok"),
    f"WITH {_ITEMS} SELECT 'orders/' || k || '.lisp' AS path, 'fresh' AS status, true AS changed, true AS output_parse_ok FROM texts")
add("manifest_status_suppliers", C.bindings, lambda s: manifest_status(preview(s, "rename-symbol", from_="nothing", to="something"), s),
    "SELECT CAST(0 AS BIGINT) AS stale, CAST(0 AS BIGINT) AS bad, CAST(0 AS BIGINT) AS changed, 'nothing-to-do' AS action")
QUERIES["capabilities"] = lambda spark, sf_dir: R.capabilities(spark)
QUERIES |= commands.QUERIES
ORACLES |= commands.ORACLES

add("impact_references_part", C.shop, lambda s: R.impact_references(s, "part-3").select("file_id", "path", "context", "head"),
    f"""WITH {_ITEMS} SELECT k AS file_id, '0.' || (3 + i) || '.0' AS path, 'call' AS context, 'part-3' AS head FROM items WHERE name = 'part-3'
        UNION ALL SELECT -1 - p, '0.1', 'definition-name', 'defun' FROM library WHERE p = 3""")  # fmt: skip
add("impact_edges_part", C.shop, lambda s: R.impact_edges(s, "part-3").select("direction", "caller", "callee", "calls", "internal"),
    f"""WITH {_ITEMS} SELECT 'inbound' AS direction, 'order-' || k AS caller, 'PART-3' AS callee, count(*) AS calls, EXISTS (SELECT 1 FROM library WHERE p = 3) AS internal FROM items WHERE name = 'part-3' GROUP BY k
        UNION ALL SELECT 'outbound', 'part-3', 'LIST', 1, false FROM library WHERE p = 3""")  # fmt: skip
add("impact_statuses_part", C.shop, lambda s: R.impact_statuses(s, "part-3"),
    f"""WITH {_ITEMS}, told AS (SELECT k, CASE WHEN NOT EXISTS (SELECT 1 FROM library WHERE p = 3) THEN 'unknown-definition' WHEN args < 2 THEN 'missing-arguments' WHEN args > 2 THEN 'extra-arguments' ELSE 'exact' END AS status
        FROM items WHERE name = 'part-3') SELECT status, count(*) AS count, count(DISTINCT k) AS files FROM told GROUP BY ROLLUP (status)""")  # fmt: skip
add("signature_bounds_shop", C.shop, lambda s: R.signature(s, bounds=True).groupBy("head", "status", "min_parameter_count", "max_parameter_count").agg(F.count(F.lit(1)).alias("calls")),
    f"""WITH {_ITEMS}, told AS (SELECT name AS head, args, library.p IS NOT NULL AND known AS defined FROM items LEFT JOIN library ON items.p = library.p UNION ALL SELECT 'list', 2, false FROM library)
        SELECT head, CASE WHEN NOT defined THEN 'unknown-definition' WHEN args < 2 THEN 'missing-arguments' WHEN args > 2 THEN 'extra-arguments' ELSE 'exact' END AS status,
        CAST(CASE WHEN defined THEN 2 END AS BIGINT) AS min_parameter_count, CAST(CASE WHEN defined THEN 2 END AS BIGINT) AS max_parameter_count, count(*) AS calls FROM told GROUP BY ALL""")  # fmt: skip
add("dependency_targets_nations", C.nations, R.dependency_targets,
    """WITH told AS (SELECT n_nationkey AS k, 'defpackage-use' AS dependency, '#:cl' AS target FROM nation UNION ALL SELECT n_nationkey, 'defpackage-use', '#:region-' || n_regionkey FROM nation UNION ALL SELECT n_nationkey, 'qualified-symbol', 'region-' || n_regionkey FROM nation)
        SELECT target, count(*) AS count, count(DISTINCT k) AS files, count(DISTINCT dependency) AS kinds FROM told GROUP BY ROLLUP (target)""")  # fmt: skip
add("replacement_summary_orders", C.orders, lambda s: R.replacement_summary(s, keep_first=True),
    f"""WITH {_ITEMS}, batches AS (SELECT k, name, args, count(*) AS n FROM items WHERE args >= 2 GROUP BY k, name, args HAVING count(*) >= 2)
        SELECT count(*) AS batch_count, CAST(coalesce(sum(n), 0) AS BIGINT) AS candidate_form_count, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS form_count FROM batches""")  # fmt: skip
add("admitted_orders", C.orders, lambda s: C.admitted(s.select("file_id", "path", F.octet_length("text").cast("long").alias("bytes")), max_files=12_000, max_bytes=1_000_000).drop("path"),
    f"""WITH {_ITEMS}, run AS (SELECT k AS file_id, CAST(strlen(text) AS BIGINT) AS bytes, row_number() OVER w AS ordinal, CAST(sum(strlen(text)) OVER w AS BIGINT) AS total_bytes FROM texts WINDOW w AS (ORDER BY 'orders/' || k || '.lisp')),
        told AS (SELECT *, CASE WHEN ordinal > 12001 OR total_bytes - bytes > 1000000 THEN 'after-limit' WHEN ordinal > 12000 OR total_bytes > 1000000 THEN 'breaks-limit' ELSE 'admitted' END AS status FROM run)
        SELECT *, CASE WHEN status = 'breaks-limit' THEN CASE WHEN ordinal > 12000 THEN 'files' ELSE 'bytes' END END AS broken FROM told""")  # fmt: skip


def _kept_in_versions(sources: DataFrame) -> str:
    """The folder of a corpus with a rename in every other file, committed as a
    manifest, every tenth file removed, and a rollback of all that."""
    spark = sources.sparkSession
    root = f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}"
    versions.commit(sources, root, 0)
    first = versions.read(spark, root)
    commit_manifest(preview(first.filter("file_id % 2 = 1"), "rename-symbol", from_="priority", to="rank"), root, 1)
    versions.commit(first.limit(0), root, 2, removed=first.filter("file_id % 10 = 0").select("path"))
    versions.roll_back(spark, root, 1, 3)
    return root


add("versions_orders", C.orders, lambda s: versions.read(s.sparkSession, _kept_in_versions(s), 3).select("file_id", "path", "text"),
    f"WITH {_ITEMS} SELECT k AS file_id, 'orders/' || k || '.lisp' AS path, CASE WHEN k % 2 = 1 THEN replace(text, 'priority', 'rank') ELSE text END AS text FROM texts WHERE k % 10 <> 0")
add("version_history_orders", C.orders, lambda s: versions.history(s.sparkSession, _kept_in_versions(s)),
    f"""WITH {_ITEMS}, told AS (SELECT count(*) AS n, count(*) FILTER (k % 2 = 1) AS odd, count(*) FILTER (k % 10 = 0) AS gone FROM texts), none AS (SELECT CAST(0 AS BIGINT) AS z)
        SELECT CAST(1 AS BIGINT) AS version, n AS changed, z AS removed, 1 AS tables FROM told, none UNION ALL SELECT 2, odd, z, 2 FROM told, none UNION ALL SELECT 3, z, gone, 3 FROM told, none UNION ALL SELECT 4, n, z, 1 FROM told, none""")  # fmt: skip


def _walked(sources: DataFrame) -> tuple[str, DataFrame]:
    """A folder of files, some hidden, generated or excluded, and the walk of it."""
    spark = sources.sparkSession
    root = shared_folder(spark)
    if not root.startswith(("/", "file:/")):
        raise ValueError(f"{root} is no folder that files can be written to")
    root = f"/{root.removeprefix('file:').lstrip('/')}/workspace-{uuid.uuid4().hex}"
    number = F.col("file_id") % 11
    below = F.when(number == 0, ".cache/").when(number == 1, "src/build/").when(number == 2, "old/").otherwise("src/")
    walk.write_files(sources.withColumn("path", F.concat(below, "path")), root)
    return root, walk.walked(spark, [root], exclude=(f"{root}/old",), budget=500)


def _walked_files(sources: DataFrame) -> DataFrame:
    root, found = _walked(sources)
    texts = walk.contents(found).select(F.col("path").alias("_path"), "text")
    told = found.filter("kind = 'file' OR skipped IS NOT NULL").join(texts, F.col("path") == F.col("_path"), "left")
    return told.select(F.expr(f"substring(path, {len(root) + 2})").alias("path"), "kind", "dialect", "skipped", (F.col("bytes") == F.octet_length("text")).alias("whole"))


_WALK = f"""{_CUSTOMERS}, seen AS (SELECT 'src/customers/' || k || '.' || ext AS path, dialect, CASE WHEN dialect = 'unknown' THEN 'unknown' END AS skipped FROM files WHERE k % 11 > 2)"""
add("walked_customers", C.customers, _walked_files,
    f"""WITH {_WALK} SELECT path, 'file' AS kind, dialect, skipped, CASE WHEN skipped IS NULL THEN true END AS whole FROM seen
        UNION ALL SELECT ['.cache', 'src/build', 'old'][CAST(r + 1 AS BIGINT)], 'folder', NULL, ['hidden', 'generated', 'excluded'][CAST(r + 1 AS BIGINT)], NULL FROM (SELECT DISTINCT k % 11 AS r FROM files WHERE k % 11 <= 2)""")  # fmt: skip
add("walk_summary_customers", C.customers, lambda s: walk.walk_summary(_walked(s)[1]).drop("bytes"),
    f"""WITH {_WALK}, pruned AS (SELECT count(DISTINCT k % 11) FILTER (k % 11 = 0) AS hidden, count(DISTINCT k % 11) FILTER (k % 11 = 1) AS built, count(DISTINCT k % 11) FILTER (k % 11 = 2) AS excluded FROM files)
        SELECT (SELECT count(*) FROM seen WHERE skipped IS NULL) AS files, (SELECT count(*) FROM seen) + hidden + built + excluded + 2 AS entries, (SELECT count(*) FROM seen WHERE skipped = 'unknown') AS skipped_unknown,
        hidden AS skipped_hidden, built AS skipped_generated, CAST(0 AS BIGINT) AS skipped_symlink, excluded AS skipped_excluded FROM pruned""")  # fmt: skip
