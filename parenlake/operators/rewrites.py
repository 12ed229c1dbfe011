"""Rewrites of a corpus: commands planned, gated, previewed and applied.

Sources are never changed in place; a rewrite is a new version of the corpus.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parenlake.functions.dialects import needle
from parenlake.operators.nodes import named, nodes, staged
from parenlake.operators.reports import dotted, holding, impact, unused_named
from parenlake.sources import versions
from parenlake.sources.corpus import discovered

REWRITTEN = "file_id long, path string, dialect string, rewritten string, changed boolean, output_parse_ok boolean, refused string, input_hash string, output_hash string, edits array<struct<start:bigint,end:bigint,replacement:string>>"


def rewrite(sources: DataFrame, command: str, hashes: bool = False, **args: object) -> DataFrame:
    """Run a command on every file. A refusal leaves the file as it is and is
    told in ``refused``; a file that can't be read refuses too."""
    from pyspark.sql.pandas.types import to_arrow_schema

    from parenlake.functions.edits import COMMANDS

    if command not in COMMANDS:
        raise ValueError(f"no command {command}")
    schema = to_arrow_schema(sources.sparkSession.createDataFrame([], REWRITTEN).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from parenlake.functions.edits import Refused, apply
        from parenlake.functions.hashing import fnv1a64_all
        from parenlake.functions.reader import Unreadable

        for batch in batches:
            rows = []
            for file, path, dialect, text in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                text = text or ""
                try:
                    done = apply(command, text, dialect, **args)
                    out, edits, why = done.text, [{"start": a, "end": b, "replacement": r} for a, b, r in done.edits], None
                except (Refused, Unreadable) as error:
                    out, edits, why = text, [], str(error)
                rows.append((file, path, dialect, out, out != text, why is None, why, text, None, edits))
            told = [fnv1a64_all([r[k].encode() for r in rows]) if hashes else [None] * len(rows) for k in (7, 3)]
            rows = [(*r[:7], *hashed_, r[9]) for r, *hashed_ in zip(rows, *told, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return sources.select(F.col("file_id").cast("long").alias("file_id"), "path", F.coalesce("dialect", F.lit("unknown")).alias("dialect"), "text").mapInArrow(run, REWRITTEN)


def apply_edits(sources: DataFrame, edits: DataFrame) -> DataFrame:
    """Splice edits(file_id, start, end, replacement) into texts on the JVM, in
    time linear in the text and its edits. A null replacement deletes;
    overlapping edits of a file raise an error."""
    lists = edits.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "replacement"))).alias("_edits"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,replacement:string>>")
    zero = F.lit(0).cast("long")

    def cut(whole: Column, start: Column, length: Column) -> Column:
        return F.substring(whole["bytes"], (start + 1).cast("int"), length.cast("int")).cast("string")

    def splice(whole: Column) -> Column:
        def piece(e: Column, i: Column) -> Column:
            done = F.coalesce(F.when(i > 0, F.get(whole["edits"], i - 1)["end"]), zero)
            gap = F.when(e["start"] < done, F.raise_error(F.lit("edits overlap")).cast("string")).otherwise(cut(whole, done, e["start"] - done))
            return F.concat(gap, F.coalesce(e["replacement"], F.lit("")))

        last = F.when(F.size(whole["edits"]) > 0, F.get(whole["edits"], F.size(whole["edits"]) - 1)["end"]).otherwise(zero)
        return F.concat(F.array_join(F.transform(whole["edits"], piece), ""), cut(whole, last, F.lit(1 << 30)))

    # As a lambda's variable, text and edits are held once and not copied for each edit.
    whole = F.array(F.struct(F.col("text").cast("binary").alias("bytes"), F.coalesce("_edits", none).alias("edits")))
    # Texts without edits, most of them, stay as they are.
    spliced = F.when(F.col("_edits").isNull(), F.col("text")).otherwise(F.get(F.transform(whole, splice), 0))
    return sources.join(lists, "file_id", "left").withColumn("text", spliced).select(*sources.columns)


def preview(sources: DataFrame, command: str = "rename-function", max_preview_bytes: int = 160, **args: object) -> DataFrame:
    """The manifest: what the command would do to each file, with hashes."""
    done = rewrite(sources, command, hashes=True, **args)
    return done.withColumn("preview", F.substring("rewritten", 1, max_preview_bytes))


def preview_policy(
    manifest: DataFrame, fail_on_no_change: bool = False, fail_on_parse_error: bool = True, require_changed_files: int | None = None, require_edits: int | None = None,
    target: str | None = None, sources: DataFrame | None = None,
) -> DataFrame:
    """One row: passed and violations. With ``target`` and the sources, a name
    that something has already is a violation too (target-conflict)."""
    facts = manifest.agg(F.count_if("changed").alias("changed"), F.count_if(~F.col("output_parse_ok")).alias("bad"), F.coalesce(F.sum(F.size("edits")), F.lit(0)).alias("edits"))
    if target is not None and sources is not None:
        taken = nodes(sources, "def_needle").agg(F.count_if(F.col("def_needle") == needle(target)).alias("taken"))
    else:
        taken = manifest.sparkSession.range(1).select(F.lit(0).alias("taken"))
    facts = facts.crossJoin(taken)  # one row by one row
    said = F.array_compact(F.array(
        F.when(F.lit(fail_on_no_change) & (F.col("changed") == 0), "no-change"),
        F.when(F.lit(fail_on_parse_error) & (F.col("bad") > 0), "parse-error"),
        F.when(F.col("taken") > 0, "target-conflict"),
        F.when(F.lit(require_changed_files is not None) & (F.col("changed") < (require_changed_files or 0)), "changed-files"),
        F.when(F.lit(require_edits is not None) & (F.col("edits") < (require_edits or 0)), "edits"),
    ))
    return facts.select("changed", "bad", "edits", said.alias("violations"), (F.size(said) == 0).alias("passed"))


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("errorifexists").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REWRITTEN + ", preview string").json(path)


def manifest_hash(manifest: DataFrame) -> str:
    """What a manifest says, in 16 digits, whatever the order of its files."""
    mark = manifest.agg(F.sum(F.xxhash64("path", "input_hash", "output_hash", "changed").cast("decimal(38,0)")).alias("s")).first()["s"]
    return f"{int(mark or 0) % (1 << 64):016x}"


def check_manifest(manifest: DataFrame, sources: DataFrame, expect_hash: str | None = None, root: str | None = None) -> DataFrame:
    """Each file of the manifest: fresh, stale (its text changed), missing, or
    outside of ``root``. A manifest that is not the expected one is an error."""
    if expect_hash is not None and manifest_hash(manifest) != expect_hash:
        raise ValueError("the manifest is not the one expected")
    now = hashed(sources).select("path", F.col("hash").alias("_now"))
    joined = manifest.join(now, "path", "left")
    outside = ~F.startswith(F.col("path"), F.lit(root.rstrip("/") + "/")) if root is not None else F.lit(False)
    status = F.when(outside, "outside").when(F.col("_now").isNull(), "missing").when(F.col("_now") != F.col("input_hash"), "stale").otherwise("fresh")
    return joined.select("path", status.alias("status"), "changed", "output_parse_ok", F.col("output_hash"))


def manifest_status(manifest: DataFrame, sources: DataFrame, **identity: object) -> DataFrame:
    """One row: the next safe action."""
    facts = check_manifest(manifest, sources, **identity).agg(F.count_if(F.col("status") != "fresh").alias("stale"), F.count_if(~F.col("output_parse_ok")).alias("bad"), F.count_if("changed").alias("changed"))
    action = F.when(F.col("stale") > 0, "preview-again").when(F.col("bad") > 0, "fix-refusals").when(F.col("changed") == 0, "nothing-to-do").otherwise("apply")
    return facts.withColumn("action", action)


def apply_manifest(manifest: DataFrame, sources: DataFrame, path: str, **identity: object) -> None:
    """Write the rewritten corpus as a new version, if nothing is stale or
    refused and the manifest is the one expected."""
    state = manifest_status(manifest, sources, **identity).first()
    if state["action"] != "apply":
        raise ValueError(f"not applied: {state['action']}")
    new = manifest.select("path", F.col("rewritten").alias("_new"))
    joined = sources.join(new, "path", "left").withColumn("text", F.coalesce("_new", "text"))
    joined.select(*sources.columns).write.mode("errorifexists").parquet(path)


def commit_manifest(manifest: DataFrame, root: str, base: int, **identity: object) -> int:
    """Commit the changed files of a manifest to the versioned corpus at ``root``
    (``sources.versions``), made against version ``base`` of it. What is checked
    is what is committed: the manifest is staged."""
    manifest = staged(manifest, "manifest")
    sources = versions.read(manifest.sparkSession, root, base)
    state = manifest_status(manifest, sources, **identity).first()
    if state["action"] != "apply":
        raise ValueError(f"not applied: {state['action']}")
    changed = manifest.filter("changed").select(F.col("path").alias("_path"), F.col("rewritten").alias("_new"))
    files = sources.join(changed, F.col("path") == F.col("_path")).withColumn("text", F.col("_new"))
    return versions.commit(files.select(*sources.columns), root, base)


def hashed(sources: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from parenlake.functions.hashing import fnv1a64_all

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fnv1a64_all([(t or "").encode() for t in batch.column(1).to_pylist()]), pa.string())], names=["path", "hash"])

    return sources.select("path", "text").mapInArrow(run, "path string, hash string")


def diff(manifest: DataFrame, sources: DataFrame) -> DataFrame:
    """Unified diffs of the changed files."""
    joined = manifest.filter("changed").select("path", "rewritten").join(sources.select("path", "text"), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ["".join(difflib.unified_diff(old.splitlines(True), new.splitlines(True), f"a/{p}", f"b/{p}")) for p, new, old in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["path", "diff"])

    return joined.select("path", "rewritten", "text").mapInArrow(run, "path string, diff string")


def plan(sources: DataFrame, symbol: str, operation: str = "rename", require_definitions: int = 1, require_references: int = 0) -> DataFrame:
    """Gates on the symbol's impact and whether the operation may be automated."""
    if operation not in ("rename", "remove", "move", "signature"):
        raise ValueError(f"no operation {operation}")
    facts = impact(sources, symbol)
    blocks = F.array_compact(F.array(
        F.when(F.col("definitions") < require_definitions, "definitions"), F.when(F.col("references") < require_references, "references"),
        F.when(F.col("definitions") > 1, "ambiguous"), F.when(F.lit(operation == "remove") & (F.col("references") > 0), "still-referenced"),
        F.when(F.lit(operation == "signature") & (F.col("signature_mismatches") > 0), "signature-mismatch"),
    ))
    steps = F.array(*[F.lit(x) for x in ("inspect impact", f"preview {operation}", f"apply {operation}", "verify")])
    return facts.select("symbol", "definitions", "references", F.lit(operation).alias("operation"), blocks.alias("blocking_gates"), steps.alias("steps"), F.when(F.size(blocks) == 0, "automatic").otherwise("manual").alias("decision"))


def verify(before: DataFrame, symbol: str, new_symbol: str | None = None, operation: str = "rename", after: DataFrame | None = None) -> DataFrame:
    """Checks before (gates) and, given ``after``, once the operation is done."""
    if after is None:
        return plan(before, symbol, operation).select(F.lit("gates").alias("check"), (F.col("decision") == "automatic").alias("passed"))
    # What may hold either name is made once, not for each check.
    after = staged(holding(after, symbol, *([] if new_symbol is None else [new_symbol])), "after")
    old = impact(after, symbol).select(F.lit("old-symbol-gone").alias("check"), ((F.col("definitions") + F.col("references")) == 0).alias("passed"))
    if new_symbol is None:
        return old
    new = impact(after, new_symbol)
    return old.unionByName(new.select(F.lit("new-symbol-present").alias("check"), (F.col("definitions") > 0).alias("passed"))).unionByName(new.select(F.lit("arity-compatible").alias("check"), (F.col("signature_mismatches") == 0).alias("passed")))


def workspace_plan(files: DataFrame, root: str, symbol: str, operation: str = "rename", require_definitions: int = 1, require_references: int = 0, **discovery: object) -> DataFrame:
    """``plan`` over the files that discovery keeps below a root."""
    return plan(discovered(files, root, **discovery), symbol, operation, require_definitions, require_references)


def workspace_preview(files: DataFrame, root: str, from_: str, to: str, mode: str = "function", max_preview_bytes: int = 160, **discovery: object) -> DataFrame:
    """``preview`` of a rename over the files that discovery keeps."""
    return preview(discovered(files, root, **discovery), _renaming(mode), max_preview_bytes, from_=from_, to=to)


def _renaming(mode: str) -> str:
    if mode not in ("symbol", "function"):
        raise ValueError(f"no mode {mode}")
    return f"rename-{mode}"


def workspace_execute(sources: DataFrame, from_: str, to: str, path: str | None = None, mode: str = "symbol", fail_on_target_conflict: bool = False, **policy: object) -> DataFrame:
    """Preview, gates, pre-check, write (with a path) and post-check: a row for
    each step. Without a path nothing is written. ``policy`` goes to
    ``preview_policy``."""
    manifest = preview(sources, _renaming(mode), from_=from_, to=to)
    more = {"target": to, "sources": sources} if fail_on_target_conflict else {}
    passed = preview_policy(manifest, **policy, **more).first()["passed"]
    ready = plan(sources, from_).first()["decision"] == "automatic"
    steps = [("preview", passed), ("pre-verify", ready)]
    if path is not None and passed and ready:
        apply_manifest(manifest, sources, path)
        after = sources.sparkSession.read.parquet(path)
        checks = verify(sources, from_, to, after=after).filter(F.col("check") != "arity-compatible").collect()
        steps += [("write", True), *[(r["check"], r["passed"]) for r in checks]]
    return sources.sparkSession.createDataFrame(steps, "step string, passed boolean")


def remove_unused(sources: DataFrame, include_protected: bool = False, include_exported: bool = False) -> DataFrame:
    """Edits that delete every unreferenced definition, and the rest with the
    reason for which it stays: exported first, then protected."""
    unused = unused_named(staged(named(sources), "names")).filter("unused")
    reason = F.when(F.col("public") & F.lit(not include_exported), "exported").when(~F.col("actionable") & F.lit(not include_protected), "protected")
    return unused.select("file_id", "path", "name", "category", reason.alias("skipped"), F.col("span_start").alias("start"), F.col("span_end").alias("end"), F.lit("").alias("replacement"))


def move_forms(
    sources: DataFrame, from_path: str, to_path: str, paths: list[str] | None = None, names: list[str] | None = None, categories: list[str] | None = None,
    insert: str = "append", anchor_path: str | None = None,
) -> DataFrame:
    """Sources with top-level forms of one file moved to another: move-definition,
    move-form and split-file. They are appended, or put before or after the
    top-level form at ``anchor_path``; without such a form nothing moves."""
    if insert not in ("append", "before", "after") or (insert == "append") != (anchor_path is None):
        raise ValueError("insert is append, or before or after an anchor_path")
    table = nodes(sources.filter(F.col("path") == from_path), "depth path def_name category span_start span_end").filter("depth = 1")
    wanted = F.lit(False)
    for column, some in ((dotted(F.col("path")), paths), (F.col("def_name"), names), (F.col("category"), categories)):
        if some:
            wanted = wanted | column.isin(*some)
    picked = table.filter(wanted).join(sources.select("file_id", F.col("text").cast("binary").alias("_b")), "file_id")
    picked = picked.withColumn("form", F.substring("_b", (F.col("span_start") + 1).cast("int"), (F.col("span_end") - F.col("span_start")).cast("int")).cast("string"))
    target = sources.filter(F.col("path") == to_path)
    if insert == "append":
        place = target.select("file_id", F.octet_length("text").cast("long").alias("at"))
        before, after = "\n", "\n"
    else:
        anchor = nodes(target, "depth path span_start span_end").filter((F.col("depth") == 1) & (dotted(F.col("path")) == anchor_path))
        place = anchor.select("file_id", F.col("span_start" if insert == "before" else "span_end").alias("at"))
        before, after = ("", "\n\n") if insert == "before" else ("\n\n", "")
    forms = picked.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_start", "form"))), lambda x: x["form"]), "\n\n").alias("forms"), F.count(F.lit(1)).alias("n")).filter("n > 0")
    put = place.crossJoin(forms).select("file_id", F.col("at").alias("start"), F.col("at").alias("end"), F.concat(F.lit(before), "forms", F.lit(after)).alias("replacement"))  # one row by one row
    cut = picked.select("file_id", F.col("span_start").alias("start"), F.col("span_end").alias("end"), F.lit("").alias("replacement"))
    cut = cut.join(put.select(F.lit(True).alias("_there")).limit(1), F.lit(True), "left_semi")  # a single row
    return apply_edits(sources, cut.unionByName(put))
