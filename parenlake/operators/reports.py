"""The read-only reports, as joins and aggregations over ``nodes``.

Every report takes sources(file_id, path, dialect, text) and gives a DataFrame;
columns carry the report's field names in snake case, paths as dotted strings.
Files that can't be read have no rows, but in ``check`` and ``workspace``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parenlake.functions.dialects import KEPT, needle
from parenlake.operators.nodes import _parsed, by_name, errors, named, nodes, parsed, shaped, sites, staged

#: The family of each dialect.
FAMILY = {"common-lisp": "lisp", "emacs-lisp": "lisp", "scheme": "scheme", "clojure": "clojure", "janet": "janet", "fennel": "fennel", "unknown": "unknown"}
_CALLABLE = ("function", "macro", "generic-function", "method")


def dotted(path: Column) -> Column:
    return F.array_join(path.cast("array<string>"), ".")


def occurrence() -> Column:
    """Atoms that count as occurrences of a symbol."""
    return (F.col("kind") == "atom") & ~F.col("opaque_above") & ~F.array_contains("prefixes", "quote")


def quoted_designator() -> Column:
    return (F.col("kind") == "atom") & ~F.col("opaque_above") & F.array_contains("prefixes", "quote")


def holding(sources: DataFrame, *names: str) -> DataFrame:
    """The sources whose text may hold one of the symbols, so that no others
    need be parsed: a symbol without escapes is written as its needle, in
    letters of either case (ASCII), and texts with escapes all stay."""
    # A letter or digit at a symbol's end is followed by no other.
    spelled = "|".join(re.escape(k) + ("(?![A-Za-z0-9])" if k[-1:].isascii() and k[-1:].isalnum() else "") for k in map(needle, names))
    return sources.filter(F.col("text").rlike(rf"(?i){spelled}|[\\|]"))


def with_path(df: DataFrame, sources: DataFrame) -> DataFrame:
    return df.join(sources.select("file_id", F.col("path").alias("file")), "file_id")


def policy(report: DataFrame, name: str, **violations: Column) -> DataFrame:
    """One row: does the report pass? Each violation is an aggregate over the
    report that is true where it is violated; null counts as no."""
    said = report.agg(F.array_compact(F.array(*[F.when(broken, n.replace("_", "-")) for n, broken in violations.items()])).alias("violations"))
    return said.select(F.lit(name).alias("report"), (F.size("violations") == 0).alias("passed"), "violations")


def signature_policy(report: DataFrame, fail_on_mismatch: bool = True, require_calls: int = 0) -> DataFrame:
    """Calls that don't fit their definition, or fewer calls than required."""
    bad = F.count_if(F.col("status").isin("missing-arguments", "extra-arguments", "ambiguous-definition")) > 0
    return policy(report, "signature", mismatch=F.lit(fail_on_mismatch) & bad, calls=F.count(F.lit(1)) < require_calls)


def calls_policy(report: DataFrame, require_calls: int = 1) -> DataFrame:
    return policy(report, "calls", calls=F.count(F.lit(1)) < require_calls)


def unused_policy(report: DataFrame, fail_on_unused: bool = True) -> DataFrame:
    """Definitions that nothing refers to and that may be removed."""
    return policy(report, "unused-definitions", unused=F.lit(fail_on_unused) & (F.count_if(F.col("unused") & F.col("actionable")) > 0))


def impact_policy(report: DataFrame, fail_on_risk_level: str = "warning", require_definitions: int = 0) -> DataFrame:
    """Risk levels at or above the one named; info is below warning."""
    level = F.max(F.when(F.col("risk_level") == "warning", 1).otherwise(0))
    return policy(report, "impact", risk_level=level >= {"info": 0, "warning": 1}[fail_on_risk_level], definitions=F.min("definitions") < require_definitions)


def lets_policy(report: DataFrame, fail_on_duplicate_evaluation: bool = False, fail_on_unused_binding: bool = False, require_inlineable: bool = False) -> DataFrame:
    """Let bindings with risks that the policy names."""
    has = lambda risk: F.count_if(F.array_contains(F.split("risks", ","), risk)) > 0
    return policy(
        report, "lets", duplicate_evaluation=F.lit(fail_on_duplicate_evaluation) & has("duplicate-evaluation"), unused_binding=F.lit(fail_on_unused_binding) & has("unused-binding"),
        inlineable=F.lit(require_inlineable) & (F.count_if(~F.col("inlineable")) > 0),
    )


def duplicates_policy(report: DataFrame, max_groups: int = 0) -> DataFrame:
    """More groups of forms of one shape than allowed."""
    return policy(report, "duplicates", groups=F.count(F.lit(1)) > max_groups)


def counted(report: DataFrame, by: str, *more: Column) -> DataFrame:
    """A summary: a row for each value of a column, and one for all (null)."""
    return report.rollup(by).agg(F.count(F.lit(1)).alias("count"), F.count_distinct("file_id").alias("files"), *more)


def signature_summary(sources: DataFrame) -> DataFrame:
    """Calls by status, and all of them (null)."""
    return counted(signature(sources), "status")


def definition_summary(sources: DataFrame) -> DataFrame:
    """Definitions by category, and all of them (null)."""
    return counted(definitions(sources), "category")


def dependency_summary(sources: DataFrame) -> DataFrame:
    """Dependencies by kind, and all of them (null)."""
    return counted(dependencies(sources), "dependency", F.count_distinct("target").alias("targets"))


def dependency_targets(sources: DataFrame) -> DataFrame:
    """Dependencies by what they name, and all of them (null)."""
    return counted(dependencies(sources), "target", F.count_distinct("dependency").alias("kinds"))


def replacement_summary(sources: DataFrame, min_group_size: int = 2, min_node_count: int = 4, keep_first: bool = False) -> DataFrame:
    """One row: batches of forms of one shape in one file, the forms in them and
    those of them to be replaced."""
    batches = _shaped(sources, min_group_size, min_node_count).groupBy("file_id", "shape_hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_group_size)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return batches.agg(F.count(F.lit(1)).alias("batch_count"), total("n").alias("candidate_form_count"), total(F.col("n") - int(keep_first)).alias("form_count"))


def let_summary(sources: DataFrame) -> DataFrame:
    """Let bindings by head, and all of them (null)."""
    return counted(lets(sources), "head", F.count_if("inlineable").alias("inlineable"), F.sum("reference_count").alias("references"))


def duplicate_summary(sources: DataFrame, min_group_size: int = 2, min_node_count: int = 4) -> DataFrame:
    """One row: groups, the forms in them and the largest group."""
    return _shape_groups(sources, min_group_size, min_node_count).agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("count"), F.lit(0)).alias("forms"), F.max("count").alias("largest"))


def graph_nodes(sources: DataFrame) -> DataFrame:
    """The call graph's nodes: name, calls made and received, whether defined."""
    edges = call_graph(sources)
    ends = edges.select(F.upper("caller").alias("name"), F.col("calls").alias("made"), F.lit(0).cast("long").alias("received"), F.lit(True).alias("defined")).filter("name IS NOT NULL")
    ends = ends.unionByName(edges.select(F.col("callee").alias("name"), F.lit(0).cast("long").alias("made"), F.col("calls").alias("received"), F.col("internal").alias("defined")))
    return ends.groupBy("name").agg(F.sum("made").alias("made"), F.sum("received").alias("received"), F.max("defined").alias("defined"))


def check(sources: DataFrame) -> DataFrame:
    bad = errors(sources)
    joined = sources.select("file_id", F.col("path").alias("file")).join(bad, "file_id", "left")
    return joined.select("file_id", "file", F.when(F.col("code").isNull(), "ok").otherwise("error").alias("status"), F.col("code").alias("error_code"), F.col("position").alias("error_position"))


def dialect(sources: DataFrame) -> DataFrame:
    family = F.create_map(*[F.lit(x) for pair in FAMILY.items() for x in pair])
    readable = sources.join(errors(sources).select("file_id"), "file_id", "left_anti")
    return readable.select("file_id", F.col("path").alias("file"), "dialect", family[F.col("dialect")].alias("family"))


def stats(sources: DataFrame) -> DataFrame:
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return nodes(sources, "depth kind prefixes opaque_above").groupBy("file_id").agg(
        count(F.col("depth") == 1).alias("top_level_forms"), count((F.col("depth") == 1) & (F.col("kind") == "list")).alias("outline_entries"), count(occurrence()).alias("atom_occurrences")
    )


def outline(sources: DataFrame) -> DataFrame:
    return nodes(sources, "depth kind path span_start span_end head definition_like").filter("depth = 1 AND kind = 'list'").select("file_id", dotted(F.col("path")).alias("path"), F.col("span_start").alias("start"), F.col("span_end").alias("end"), "head", "definition_like")


def agent_report(sources: DataFrame) -> DataFrame:
    """Statistics, outline and atoms of each file in one row."""
    table = nodes(sources, "node_id depth kind path head definition_like text prefixes opaque_above")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    entry = F.when((F.col("depth") == 1) & (F.col("kind") == "list"), F.struct("node_id", dotted(F.col("path")).alias("path"), "head", "definition_like"))
    atom = F.when(occurrence(), F.struct("node_id", dotted(F.col("path")).alias("path"), "text"))
    return table.groupBy("file_id").agg(
        count(F.col("depth") == 1).alias("top_level_forms"), count((F.col("depth") == 1) & (F.col("kind") == "list")).alias("outline_entries"), count(occurrence()).alias("atom_occurrences"),
        F.array_sort(F.collect_list(entry)).alias("outline"), F.array_sort(F.collect_list(atom)).alias("atoms"),
    )


def select_node(table: DataFrame, path: str | None = None, at: int | None = None) -> DataFrame:
    """The node at a dotted path, or the smallest that holds a byte, by file."""
    if (path is None) == (at is None):
        raise ValueError("give either path or at")
    if path is not None:
        return table.filter(F.col("path") == F.array(*[F.lit(int(x)) for x in path.split(".") if x]).cast("array<int>"))
    inside = table.filter((F.col("span_start") <= at) & (F.col("span_end") > at))
    best = inside.groupBy("file_id").agg(F.min(F.struct(F.col("span_end") - F.col("span_start"), "node_id")).alias("b")).select("file_id", F.col("b.node_id").alias("node_id"))
    return table.join(best, ["file_id", "node_id"])


def form(sources: DataFrame, path: str | None = None, at: int | None = None) -> DataFrame:
    """Kind, head and counts of the selected form of each file."""
    table = parsed(sources, "node_id last_id depth kind head n_children path span_start span_end")
    root = select_node(table, path, at).select("file_id", F.col("node_id").alias("r"), F.col("last_id").alias("l"), F.col("depth").alias("d"), F.col("kind").alias("form_kind"), F.col("head").alias("form_head"), F.col("n_children").alias("children"))
    inside = table.join(root, (table["file_id"] == root["file_id"]) & table["node_id"].between(root["r"], root["l"])).drop(root["file_id"])
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return inside.groupBy("file_id", F.col("form_kind").alias("kind"), F.col("form_head").alias("head"), F.col("children").cast("long").alias("child_count")).agg(
        count(F.col("kind") == "atom").alias("atom_count"), count(F.col("kind") == "list").alias("list_count"), F.max(F.col("depth") - F.col("d")).cast("long").alias("max_depth")
    )


def form_symbols(sources: DataFrame, path: str | None = None, at: int | None = None) -> DataFrame:
    """How often each symbol occurs in the selected form, and where first."""
    table = parsed(sources, "node_id last_id kind path span_start span_end symbol text")
    root = select_node(table, path, at).select(F.col("file_id").alias("f"), F.col("node_id").alias("r"), F.col("last_id").alias("l"))
    inside = table.filter(F.col("kind") == "atom").filter(~F.col("symbol").startswith('"')).join(root, (F.col("file_id") == F.col("f")) & F.col("node_id").between(F.col("r"), F.col("l")))
    return inside.groupBy("file_id", "text").agg(F.count(F.lit(1)).alias("count"), F.min("span_start").alias("first_start"))


def symbols(sources: DataFrame, symbol: str) -> DataFrame:
    """Occurrences of a symbol and the head of the top-level form around."""
    table = parsed(holding(sources, symbol), "node_id depth kind prefixes opaque_above needle text path span_start span_end top_id head")
    found = table.filter((occurrence() | quoted_designator()) & (F.col("needle") == needle(symbol)))
    top = table.filter("depth = 1").select(F.col("file_id").alias("f"), F.col("node_id").alias("t"), F.col("head").alias("form_head"))
    joined = found.join(top, (F.col("file_id") == F.col("f")) & (F.col("top_id") == F.col("t")))
    return joined.select("file_id", dotted(F.col("path")).alias("path"), "span_start", "span_end", "text", F.array_contains("prefixes", "quote").alias("quoted"), "form_head")


find_symbol = symbols


def calls(sources: DataFrame, symbol: str | None = None, include_definitions: bool = False) -> DataFrame:
    found = sites(holding(sources, symbol) if symbol is not None else sources, "is_call category call_needle path span_start span_end head n_children enclosing").filter("is_call")
    if not include_definitions:
        found = found.filter("category IS NULL")
    if symbol is not None:
        found = found.filter(F.col("call_needle") == needle(symbol))
    return found.select("file_id", dotted(F.col("path")).alias("path"), "span_start", "span_end", "head", (F.col("n_children") - 1).cast("long").alias("argument_count"), "category", F.col("enclosing").alias("enclosing_definition"))


def definitions(sources: DataFrame) -> DataFrame:
    """Top-level definitions with the package they are in."""
    top = nodes(sources, "node_id parent_id depth sib_idx path kind head category def_name parameter_count body_forms text").filter("depth <= 2").select("file_id", "node_id", "parent_id", "depth", "sib_idx", "path", "kind", "head", "category", "def_name", "parameter_count", "body_forms", "text")
    forms = top.filter("depth = 1 AND kind = 'list' AND head IS NOT NULL")
    is_in = F.lower(F.regexp_extract("head", "([^:]*)$", 1)) == "in-package"
    along = Window.partitionBy("file_id").orderBy("sib_idx").rowsBetween(Window.unboundedPreceding, 0)
    carried = forms.withColumn("package", F.last(F.when(is_in, F.col("def_name")), ignorenulls=True).over(along))
    kept = carried.filter(F.col("category").isNotNull() & ~is_in)
    return kept.select("file_id", dotted(F.col("path")).alias("path"), "head", F.col("def_name").alias("name"), "category", F.col("parameter_count").cast("long").alias("parameter_count"), F.col("body_forms").cast("long").alias("body_form_count"), "package")


def _arities(table: DataFrame) -> DataFrame:
    rows = table.filter("depth = 1 AND has_lambda AND def_needle IS NOT NULL").filter(F.col("category").isin(*_CALLABLE))
    return rows.groupBy(F.col("def_needle").alias("n")).agg(F.count(F.lit(1)).alias("defined"), F.min("min_arity").alias("low"), F.max("max_arity").alias("high"), F.max(F.col("max_arity").isNull()).alias("open"))


#: What ``signature`` needs of the nodes.
_SIGNATURE = "depth has_lambda def_needle category min_arity max_arity is_call call_needle n_children path head"


def signature(sources: DataFrame, symbol: str | None = None, table: DataFrame | None = None, bounds: bool = False) -> DataFrame:
    """Each call against the sole definition of what it calls. ``table``: the
    sources' nodes, where they are parsed already. ``bounds`` adds the least and
    most parameters of all definitions of the name, null where there is none or
    no most."""
    table = staged(sites(holding(sources, symbol) if symbol is not None else sources, _SIGNATURE), "sites") if table is None else table
    found = table.filter("is_call AND category IS NULL")
    if symbol is not None:
        found = found.filter(F.col("call_needle") == needle(symbol))
    joined = found.join(_arities(table), F.col("call_needle") == F.col("n"), "left")
    given = F.col("n_children") - 1
    status = (
        F.when(F.col("defined").isNull(), "unknown-definition").when(F.col("defined") > 1, "ambiguous-definition").when(given < F.col("low"), "missing-arguments")
        .when(~F.col("open") & (given > F.col("high")), "extra-arguments").otherwise("exact")
    )
    known = ([F.col("low").cast("long").alias("min_parameter_count"), F.when(~F.col("open"), F.col("high")).cast("long").alias("max_parameter_count")] if bounds else [])
    return joined.select("file_id", dotted(F.col("path")).alias("path"), "head", given.cast("long").alias("argument_count"), status.alias("status"), *known)


def call_graph(sources: DataFrame, symbol: str | None = None, include_external: bool = True) -> DataFrame:
    """Edges caller -> callee with counts; internal if the callee is defined."""
    table = staged(sites(sources, "def_needle category is_call enclosing call_needle"), "sites")
    defined = table.filter("def_needle IS NOT NULL").groupBy(F.col("def_needle").alias("n")).agg(F.count(F.lit(1)).alias("definition_count"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
    edge = table.filter("is_call AND category IS NULL").groupBy(F.col("enclosing").alias("caller"), F.col("call_needle").alias("callee")).agg(F.count(F.lit(1)).alias("calls"))
    joined = edge.join(defined, F.col("callee") == F.col("n"), "left").withColumn("internal", F.col("definition_count").isNotNull()).drop("n")
    if symbol is not None:
        joined = joined.filter((F.col("callee") == needle(symbol)) | (F.upper("caller") == needle(symbol)))
    if not include_external:
        joined = joined.filter("internal")
    return joined.select("caller", "callee", "calls", "internal", F.coalesce("definition_count", F.lit(0)).cast("long").alias("definition_count"), F.coalesce("categories", F.lit("")).alias("callee_categories"))


def unused_named(table: DataFrame) -> DataFrame:
    """The definitions of staged ``named`` with what unused_definitions says of
    them, and whether a package exports the name.

    References outside = all of the name less those in its own form: names meet
    by equality once, and nothing is compared pair by pair."""
    total = table.groupBy("needle").agg(F.sum("uses").alias("all_uses"), F.max("exported").alias("public"))
    outside = F.col("all_uses") - F.col("uses")
    joined = table.filter("category IS NOT NULL").drop("exported").join(total, "needle").withColumn("reference_count", outside)
    return joined.withColumn("unused", F.col("reference_count") == 0).withColumn("actionable", F.col("unused") & ~F.col("category").isin(*KEPT))


def unused_definitions(sources: DataFrame, include_protected: bool = False) -> DataFrame:
    """Top-level definitions by how many references lie outside of them. Atoms
    that refer to a local binding of the same name are no references."""
    out = unused_named(staged(named(sources), "names")).select("file_id", "path", "name", "category", "reference_count", "unused", "actionable")
    return out if include_protected else out.filter("unused")


def dependencies(sources: DataFrame) -> DataFrame:
    """What files depend on: packages, systems, loads, qualified symbols. Quoted
    data, and what is evaluated as it is read, are no dependencies."""
    table = parsed(sources, "node_id last_id parent_id sib_idx kind head span_start text symbol live opaque_above in_defpackage prefixes")
    bare = F.lower(F.regexp_extract("head", "([^:]*)$", 1))
    parent = table.filter("kind = 'list'").select(F.col("file_id").alias("f"), F.col("node_id").alias("p"), bare.alias("phead"), F.col("parent_id").alias("gp"), F.lower("head").alias("rawhead"), F.col("live").alias("plive"))
    grand = parent.select(F.col("f").alias("gf"), F.col("p").alias("g"), F.col("phead").alias("ghead"))
    atoms = table.filter("kind = 'atom' AND NOT opaque_above")
    atom = atoms.join(parent, (F.col("file_id") == F.col("f")) & (F.col("parent_id") == F.col("p")), "left").join(grand, (F.col("file_id") == F.col("gf")) & (F.col("gp") == F.col("g")), "left")
    in_package = F.col("ghead") == "defpackage"
    kind = (
        F.when(in_package & (F.col("rawhead") == ":use") & (F.col("sib_idx") > 0), "defpackage-use")
        .when(in_package & (F.col("rawhead") == ":import-from") & (F.col("sib_idx") == 1), "defpackage-import-from")
        .when(F.col("phead").isin("require", "provide", "load", "load-file", "load-library", "use-package", "import") & (F.col("sib_idx") == 1) & ~F.coalesce(in_package, F.lit(False)), F.col("phead"))
    )
    # The form must be evaluated; its designator may be quoted, as in (require 'x).
    simple = atom.withColumn("dependency", kind).filter("dependency IS NOT NULL AND plive").select("file_id", "span_start", "dependency", F.col("symbol").alias("target"))
    # A system's dependencies follow :depends-on, also inside (:version "z" ..); its components are (:file "x").
    key = table.filter("kind = 'atom' AND lower(text) = ':depends-on'").select(F.col("file_id").alias("kf"), F.col("parent_id").alias("kp"), (F.col("sib_idx") + 1).alias("ks"))
    listed = table.join(key, (F.col("file_id") == F.col("kf")) & (F.col("parent_id") == F.col("kp")) & (F.col("sib_idx") == F.col("ks"))).select(F.col("file_id").alias("lf"), F.col("node_id").alias("lp"), F.col("last_id").alias("ll"))
    asdf = atoms.filter(~F.col("text").startswith(":")).join(listed, (F.col("file_id") == F.col("lf")) & F.col("node_id").between(F.col("lp"), F.col("ll"))).select("file_id", "span_start", F.lit("asdf-depends-on").alias("dependency"), F.col("symbol").alias("target"))
    component = atom.filter(F.col("rawhead").isin(":file", ":module") & (F.col("sib_idx") == 1)).select("file_id", "span_start", F.lit("asdf-component").alias("dependency"), F.col("symbol").alias("target"))
    qualified = atoms.filter("live AND NOT in_defpackage").filter(~F.array_contains("prefixes", "quote")).filter(F.col("symbol").rlike(r"^[^:\"#/\\]+::?[^:/\\]+$"))
    qualified = qualified.select("file_id", "span_start", F.lit("qualified-symbol").alias("dependency"), F.regexp_extract("symbol", "^([^:]+)::?", 1).alias("target"))
    return simple.unionByName(asdf).unionByName(component).unionByName(qualified)


def packages(sources: DataFrame) -> DataFrame:
    """Package declarations with their options."""
    table = parsed(sources, "node_id parent_id sib_idx kind head path def_name text")
    decl = table.filter("kind = 'list' AND lower(regexp_extract(head, '([^:]*)$', 1)) = 'defpackage'").select("file_id", F.col("node_id").alias("d"), dotted(F.col("path")).alias("path"), F.col("def_name").alias("package"))
    option = table.filter("kind = 'list' AND head IS NOT NULL").select(F.col("file_id").alias("f"), F.col("parent_id").alias("od"), F.col("node_id").alias("o"), F.lower(F.regexp_replace("head", "^:", "")).alias("option"))
    arg = table.filter("kind = 'atom' AND sib_idx > 0").select(F.col("file_id").alias("af"), F.col("parent_id").alias("ao"), "sib_idx", "node_id", "text")
    joined = decl.join(option, (F.col("file_id") == F.col("f")) & (F.col("d") == F.col("od")), "left").join(arg, (F.col("f") == F.col("af")) & (F.col("o") == F.col("ao")), "left")
    pick = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("option") == name) & (F.col("text").isNotNull() if name != "import-from" else F.col("sib_idx") == 1), F.struct("node_id", "text")))), lambda x: x["text"]), " ")
    return joined.groupBy("file_id", "path", "package").agg(pick("use").alias("uses"), pick("export").alias("exports"), pick("nicknames").alias("nicknames"), pick("import-from").alias("imports"), F.countDistinct("o").alias("option_count"))


def _shaped(sources: DataFrame, min_group_size: int, min_node_count: int, more: str = "") -> DataFrame:
    """Paren forms, large enough, with the digest of their shape."""
    if min_group_size < 1 or min_node_count < 1:
        raise ValueError("sizes must be 1 or more")
    return shaped(sources, min_node_count, "shape_hash subtree_nodes node_id" + more)


def _spelled(sources: DataFrame, groups: DataFrame) -> DataFrame:
    """shape_hash and shape, written out for one form of each group: ``groups``
    has shape_hash and place (file_id, node_id)."""
    from parenlake.functions.facts import shape
    from parenlake.functions.reader import Tree

    places = groups.groupBy(F.col("place.file_id").alias("file_id")).agg(F.collect_list(F.struct("place.node_id", "shape_hash")).alias("places"))
    named = lambda got, at: {"shape_hash": [x["shape_hash"] for x in at], "shape": [shape(got, x["node_id"]) for x in at]} if isinstance(got, Tree) else None
    return _parsed(sources.join(places, "file_id"), "file_id long, shape_hash string, shape string", named, also="places").drop("file_id")


def _shape_groups(sources: DataFrame, min_group_size: int, min_node_count: int) -> DataFrame:
    forms = _shaped(sources, min_group_size, min_node_count, " head")
    told = forms.groupBy("shape_hash").agg(F.count(F.lit(1)).alias("count"), F.countDistinct("file_id").alias("files"), F.first("head").alias("head"), F.min(F.struct("file_id", "node_id")).alias("place"))
    return told.filter(F.col("count") >= min_group_size)


def duplicates(sources: DataFrame, min_group_size: int = 2, min_node_count: int = 4) -> DataFrame:
    """Paren forms grouped by shape. Forms meet by digests, made bottom-up; the
    shape is spelled out for the first form of each group only, in a second
    pass over the files that these are in."""
    groups = staged(_shape_groups(sources, min_group_size, min_node_count), "shape-groups")
    return groups.join(_spelled(sources, groups), "shape_hash").select("shape", "count", "files", "head")


def replacement_plan(sources: DataFrame, min_group_size: int = 2, min_node_count: int = 4, keep_first: bool = False) -> DataFrame:
    """Batches of forms of one shape in one file."""
    forms = _shaped(sources, min_group_size, min_node_count, " path")
    batch = forms.groupBy("file_id", "shape_hash").agg(F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_list("path")).alias("paths"), F.min(F.struct("file_id", "node_id")).alias("place"))
    batch = staged(batch.filter(F.col("count") >= min_group_size), "batches")
    spelled = _spelled(sources, batch.groupBy("shape_hash").agg(F.min("place").alias("place")))
    paths = F.slice("paths", 2, 1 << 30) if keep_first else F.col("paths")
    kept = F.when(F.lit(keep_first), dotted(F.col("paths")[0])).alias("kept_form")
    return batch.join(spelled, "shape_hash").select("file_id", "shape", "count", kept, F.array_join(F.transform(paths, dotted), " ").alias("replaced"))


def lets(sources: DataFrame) -> DataFrame:
    """Let bindings with their references and what keeps them from inlining."""
    from parenlake.functions.reader import Tree
    from parenlake.functions.scope import lets as rows_of

    schema = "file_id long, path array<int>, head string, binding_index int, name string, value string, style string, reference_count int, inlineable boolean, risks array<string>"
    found = _parsed(sources, schema, lambda got: by_name(rows_of(got)) if isinstance(got, Tree) else None)
    return found.select("file_id", dotted(F.col("path")).alias("path"), "head", "binding_index", "name", "value", "style", F.col("reference_count").cast("long").alias("reference_count"), "inlineable", F.array_join("risks", ",").alias("risks"))


def workspace(sources: DataFrame) -> DataFrame:
    """Totals over all files, by dialect and by status."""
    facts = nodes(sources, "depth definition_like").groupBy("file_id").agg(F.sum(F.when(F.col("depth") == 1, 1).otherwise(0)).alias("forms"), F.sum(F.when((F.col("depth") == 1) & F.col("definition_like"), 1).otherwise(0)).alias("defs"))
    joined = sources.select("file_id", "dialect").join(facts, "file_id", "left").withColumn("status", F.when(F.col("forms").isNull(), "error").otherwise("ok"))
    return joined.groupingSets([[], ["dialect"], ["status"]], "dialect", "status").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("forms"), F.lit(0)).alias("top_level_forms"), F.coalesce(F.sum("defs"), F.lit(0)).alias("definitions"))


#: What ``_uses`` needs of the nodes.
_USES = "node_id parent_id sib_idx kind opaque_above needle head path is_call category span_start span_end"


def _uses(table: DataFrame, key: str) -> DataFrame:
    """The atoms of a name with their context: the name of a definition, the
    head of a call, or any other; and the head of the form they are in."""
    uses = table.filter((F.col("kind") == "atom") & ~F.col("opaque_above") & (F.col("needle") == key)).drop("head", "is_call", "category")
    around = table.filter("kind = 'list'").select(F.col("file_id").alias("f"), F.col("node_id").alias("p"), F.col("head").alias("around"), F.col("category").isNotNull().alias("is_def"), F.col("is_call").alias("calls"))
    used = uses.join(around, (F.col("file_id") == F.col("f")) & (F.col("parent_id") == F.col("p")), "left")
    context = F.when(F.col("is_def") & (F.col("sib_idx") == 1), "definition-name").when(~F.col("is_def") & F.col("calls") & (F.col("sib_idx") == 0), "call").otherwise("reference")
    return used.withColumn("context", context)


def impact_references(sources: DataFrame, symbol: str) -> DataFrame:
    """Each place of a symbol, with its context and the head around it."""
    found = _uses(parsed(holding(sources, symbol), _USES), needle(symbol))
    return found.select("file_id", dotted(F.col("path")).alias("path"), "span_start", "span_end", "context", F.col("around").alias("head"))


def impact_edges(sources: DataFrame, symbol: str) -> DataFrame:
    """The calls into (inbound) and out of (outbound) a symbol; what calls itself
    is both."""
    key = needle(symbol)
    ways = F.array_compact(F.array(F.when(F.col("callee") == key, "inbound"), F.when(F.upper("caller") == key, "outbound")))
    return call_graph(sources, symbol).select(F.explode(ways).alias("direction"), "caller", "callee", "calls", "internal", "definition_count", "callee_categories")


def impact_statuses(sources: DataFrame, symbol: str) -> DataFrame:
    """The calls of a symbol by status, and all of them (null)."""
    return counted(signature(sources, symbol), "status")


def impact(sources: DataFrame, symbol: str) -> DataFrame:
    """One row: what a change of a symbol touches, and how risky that is."""
    table, key = parsed(holding(sources, symbol), f"{_SIGNATURE} {_USES}"), needle(symbol)
    sig = signature(sources, symbol, table).agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum(F.when(F.col("status") != "exact", 1)), F.lit(0)).alias("signature_mismatches"))
    defs = table.filter((F.col("depth") == 1) & (F.col("def_needle") == key)).agg(F.count(F.lit(1)).alias("definitions"))
    used = _uses(table, key)
    naming, calling = F.col("context") == "definition-name", F.col("context") == "call"
    refs = used.agg(F.coalesce(F.sum(F.when(~naming, 1)), F.lit(0)).alias("references"), F.coalesce(F.sum(F.when(~naming & ~calling, 1)), F.lit(0)).alias("non_call_references"))
    out = defs.crossJoin(sig).crossJoin(refs)  # three rows of one
    risks = F.array_compact(F.array(
        F.when(F.col("definitions") == 0, "missing-definition"), F.when(F.col("definitions") > 1, "ambiguous-definition"), F.when(F.col("calls") > 0, "inbound-callers"),
        F.when(F.col("non_call_references") > 0, "non-call-references"), F.when(F.col("signature_mismatches") > 0, "signature-mismatch"),
    ))
    level = F.when(F.size(risks) == 0, "info").otherwise("warning")
    return out.select(F.lit(symbol).alias("symbol"), *[F.col(c).cast("long").alias(c) for c in ("definitions", "references", "calls", "non_call_references", "signature_mismatches")], F.array_join(risks, ",").alias("risks"), level.alias("risk_level"))


def capabilities(spark) -> DataFrame:
    """The catalog of reports and commands, from the functions themselves."""
    import inspect

    from parenlake.functions.edits import COMMANDS

    edit = "format repair-unclosed-lists select replace kill wrap splice raise transpose-forward transpose-backward slurp-forward slurp-backward barf-forward barf-backward".split()
    reports = (
        check, dialect, stats, agent_report, outline, form, form_symbols, symbols, calls, signature, call_graph, graph_nodes, impact, workspace, dependencies, packages, definitions, unused_definitions, duplicates, replacement_plan, lets,
        impact_references, impact_edges, impact_statuses, dependency_targets, replacement_summary, signature_summary, definition_summary, dependency_summary, duplicate_summary, let_summary, calls_policy, signature_policy, unused_policy, impact_policy, lets_policy, duplicates_policy,
    )
    said = lambda f, drop: ", ".join(str(p) for p in list(inspect.signature(f).parameters.values())[drop:])
    rows = [("inspect", f.__name__.replace("_", "-"), said(f, 1)) for f in reports] + [("inspect", "similarity", "threshold, min_node_count, min_line_span, comparison_scope, form_scope, overlap_policy, max_results")]
    rows += [("edit" if n in edit else "refactor", n, said(f, 1)) for n, f in COMMANDS.items()]
    rows += [("refactor", n, "") for n in ("plan", "verify", "preview", "check-manifest", "manifest-status", "apply-manifest", "diff", "workspace-execute", "remove-unused-definitions", "move-forms")]
    return spark.createDataFrame(sorted(rows), "namespace string, command string, parameters string")
