"""Sources parsed into tables: the relational encoding of syntax trees.

``nodes`` holds a row for each node. node_id counts in preorder and last_id is
the largest in the subtree, so A holds B exactly if both lie in one file and
A.node_id <= B.node_id <= A.last_id: containment is an equi-join with a range.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

_own_folder: list[str] = []

NODES = (
    "file_id long, node_id int, last_id int, parent_id int, sib_idx int, depth int, kind string, delimiter string, prefixes array<string>, "
    "span_start long, span_end long, content_start long, open_off long, close_off long, n_children int, subtree_nodes int, leaf_count int, path array<int>, "
    "text string, symbol string, needle string, head string, opaque boolean, opaque_above boolean, top_id int, in_defpackage boolean, qq_depth int, live boolean, definition_like boolean, "
    "category string, def_name string, def_needle string, parameter_count int, body_forms int, min_arity int, max_arity int, has_lambda boolean, "
    "is_call boolean, call_needle string, enclosing string, local boolean, line_span int, shape_hash string"
)
COMMENTS = "file_id long, span_start long, span_end long, own_line boolean, text string"
ERRORS = "file_id long, code string, position long, message string"


def _parsed(sources: DataFrame, schema: str, rows_of: Callable, also: str | None = None) -> DataFrame:
    """What ``rows_of(tree or Unreadable)`` gives for each source: columns by
    name, all but file_id. ``also``: a column whose value goes with the tree."""
    arrow = to_arrow_schema(sources.sparkSession.createDataFrame([], schema).schema)
    names = arrow.names[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from parenlake.functions.reader import Unreadable, read

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out: dict[str, list] = {n: [] for n in arrow.names}
                for file, dialect, text, *more in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    try:
                        got = read(text or "", dialect)
                    except Unreadable as error:
                        got = error
                    made = rows_of(got, *more)
                    if made:
                        for n in names:
                            out[n] += made[n]
                        out["file_id"] += [file] * (len(out[names[0]]) - len(out["file_id"]))
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return sources.select(F.col("file_id").cast("long").alias("file_id"), F.coalesce("dialect", F.lit("unknown")).alias("dialect"), "text", *([also] if also else [])).mapInArrow(run, schema)


def by_name(rows: list[dict]) -> dict[str, list]:
    """Rows as columns."""
    return {n: [r[n] for r in rows] for n in rows[0]} if rows else {}


def sites(sources: DataFrame, wanted: str) -> DataFrame:
    """The rows of ``nodes`` that are calls or definitions: no others are made."""
    from parenlake.functions.facts import SITES
    from parenlake.functions.facts import sites as rows_of
    from parenlake.functions.reader import Tree

    some = set(wanted.split())
    assert some <= SITES
    schema = ", ".join(c for c in NODES.split(", ") if c.split()[0] in some | {"file_id"})
    return _parsed(sources, schema, lambda got: rows_of(got, some) if isinstance(got, Tree) else None)


def shaped(sources: DataFrame, least: int, wanted: str) -> DataFrame:
    """The rows of ``nodes`` that are paren lists of at least so many nodes, with
    the digests of their shapes: no others are made."""
    from parenlake.functions.facts import shaped as rows_of
    from parenlake.functions.reader import Tree

    some = set(wanted.split())
    schema = ", ".join(c for c in NODES.split(", ") if c.split()[0] in some | {"file_id"})
    return _parsed(sources, schema, lambda got: rows_of(got, least, some) if isinstance(got, Tree) else None)


#: Names that a task counts before it hands them on.
COUNTED = 50_000
NAMED = "needle string, uses long, exported boolean, file_id long, path string, name string, category string, span_start long, span_end long"


def named(sources: DataFrame) -> DataFrame:
    """Rows of three kinds. Definitions at the top, with the uses of the name in
    the form itself; names with their uses elsewhere, summed over many files
    (the other columns null); and names that packages export."""
    schema = to_arrow_schema(sources.sparkSession.createDataFrame([], NAMED).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        from parenlake.functions.facts import named as names_of
        from parenlake.functions.reader import Unreadable, read

        uses: Counter[str] = Counter()
        exported: set[str] = set()

        def told() -> pa.RecordBatch:
            keys, n = [*uses, *exported], len(uses) + len(exported)
            columns = {"needle": keys, "uses": [*uses.values(), *[0] * len(exported)], "exported": [False] * len(uses) + [True] * len(exported)}
            made = pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)
            uses.clear()
            exported.clear()
            return made

        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                found: list[tuple] = []
                for file, dialect, text in zip(*[c.to_pylist() for c in whole.slice(at, 1024).columns], strict=True):
                    try:
                        made, used, public = names_of(read(text or "", dialect))
                    except Unreadable:
                        continue
                    uses.update(used)
                    exported.update(public)
                    found += [(key, own, False, file, *more) for key, own, *more in made]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)
                if len(uses) + len(exported) > COUNTED:
                    yield told()
        yield told()

    return sources.select(F.col("file_id").cast("long").alias("file_id"), F.coalesce("dialect", F.lit("unknown")).alias("dialect"), "text").mapInArrow(run, NAMED)


def nodes(sources: DataFrame, wanted: str | None = None) -> DataFrame:
    """The ``nodes`` table of sources(file_id, dialect, text), or of it the
    columns ``wanted`` (names separated by spaces; only what they need is worked
    out). Files that can't be read have no rows here; see ``errors``."""
    from parenlake.functions.facts import columns
    from parenlake.functions.reader import Tree

    some = None if wanted is None else set(wanted.split())
    schema = NODES if some is None else ", ".join(c for c in NODES.split(", ") if c.split()[0] in some | {"file_id"})
    return _parsed(sources, schema, lambda got: columns(got, some) if isinstance(got, Tree) else None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session's spark.checkpoint.dir names. Without that
    setting a local session has a folder of its own; any other has no place that
    all executors share, and is refused."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="parenlake-"))
            atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
        shared = f"file://{_own_folder[0]}"
    return f"{shared.rstrip('/')}/{spark.sparkContext.applicationId}"


def staged(table: DataFrame, name: str) -> DataFrame:
    """``table``, written once to the shared folder and read back."""
    spark = table.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    table.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def parsed(sources: DataFrame, wanted: str | None = None) -> DataFrame:
    """``nodes``, parsed once and staged: for reports that read the table
    several times."""
    return staged(nodes(sources, wanted), "nodes")


def comments(sources: DataFrame) -> DataFrame:
    """Comments and discarded forms, which lie outside the tree."""
    from parenlake.functions.reader import Tree

    def rows(got):
        return by_name([{"span_start": a, "span_end": b, "own_line": own, "text": got.source[a:b].decode("utf-8", "replace")} for a, b, own in got.comments]) if isinstance(got, Tree) else None

    return _parsed(sources, COMMENTS, rows)


def errors(sources: DataFrame) -> DataFrame:
    """One row for each file that can't be read."""
    from parenlake.functions.reader import Tree

    return _parsed(sources, ERRORS, lambda got: None if isinstance(got, Tree) else by_name([{"code": got.code, "position": got.position, "message": got.message}]))
