"""Discovery of a workspace by walking folders that all executors can see.

A walk takes turns: tasks list the folders they are given and what lies below,
each up to a budget of entries; folders left over are dealt out again for the
next turn, so no task walks a large tree on its own and a small tree takes one
turn. A folder that is skipped is never listed. Symbolic links are counted, not
followed, so what lies below a root has one path only.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parenlake.operators.nodes import staged
from parenlake.sources.corpus import GENERATED, dialect_column

#: kind is file, folder, symlink, or pending, a folder for the next turn.
FOUND = "path string, kind string, skipped string, bytes long, entries long, depth int"
#: Entries that a task lists at a time before it leaves the rest for others.
BUDGET = 10_000
#: Bytes of files that ``contents`` hands on at a time, and one file more.
HELD = 4 << 20
Trie = dict


def exclude_index(paths: tuple[str, ...]) -> Trie:
    """Excluded paths by their components; an empty node excludes all below."""
    index: Trie = {}
    for path in sorted(os.path.realpath(p) for p in paths):
        node, parts = index, [p for p in path.split("/") if p]
        for k, part in enumerate(parts):
            if part in node and not node[part]:
                break  # lies in an excluded folder
            node = node.setdefault(part, {})
            if k == len(parts) - 1:
                node.clear()
    return index


def excluded(index: Trie, path: str) -> bool:
    node = index
    for part in filter(None, path.split("/")):
        if part not in node:
            return False
        node = node[part]
        if not node:
            return True
    return False


def _lister(index: Trie, include_hidden: bool, include_generated: bool, max_depth: int | None, budget: int):
    def judged(path: str, name: str, mode: int, depth: int, size: int) -> tuple | None:
        """The row of an entry; None for what is neither file, folder nor link."""
        if excluded(index, path):
            return path, "folder" if stat.S_ISDIR(mode) else "file", "excluded", None, None, depth
        if stat.S_ISLNK(mode):
            return path, "symlink", "symlink", None, None, depth
        hidden = not include_hidden and name.startswith(".") and name not in (".", "..")
        if stat.S_ISDIR(mode):
            skipped = "hidden" if hidden else "generated" if not include_generated and name in GENERATED else None
            return path, "folder", skipped, None, None, depth
        if stat.S_ISREG(mode):
            return path, "file", "hidden" if hidden else None, size, None, depth
        return None

    def walk(asked: list[tuple[str, int, str]]) -> Iterator[tuple]:
        """asked: path, depth and, of a root, the name it was given by."""
        todo: list[tuple[str, int]] = []

        def met(row: tuple | None) -> Iterator[tuple]:
            if row is None:
                return
            if row[1] != "folder" or row[2]:
                yield row
            elif max_depth is None or row[5] < max_depth:
                todo.append((row[0], row[5]))

        for path, depth, name in asked:
            if name is None:
                todo.append((path, depth))
            else:
                about = os.lstat(path)
                yield from met(judged(path, name, about.st_mode, depth, about.st_size))
        listed = 0
        while todo and listed < budget:
            path, depth = todo.pop()
            entries = 0
            with os.scandir(path) as inside:
                for entry in inside:
                    entries += 1
                    about = entry.stat(follow_symlinks=False)
                    yield from met(judged(entry.path, entry.name, about.st_mode, depth + 1, about.st_size))
            listed += entries + 1
            yield path, "folder", None, None, entries, depth
        for path, depth in todo:
            yield path, "pending", None, None, None, depth

    return walk


def _roots(roots: list[str], nested: bool) -> list[tuple[str, int, str]]:
    """Roots to start from: path, depth, name; each place once, under a name
    that is no link where there is one. Roots in other roots go, unless
    ``nested``."""
    told: dict[str, tuple[bool, str]] = {}
    for root in roots:
        found = os.path.realpath(root, strict=True)
        told[found] = min(told.get(found, (True, "\U0010ffff")), (os.path.islink(root), root))
    folders = {p for p in told if os.path.isdir(p)}
    above = lambda p: any(p.startswith(f.rstrip("/") + "/") for f in folders)
    return [(os.path.abspath(root) if link else path, 0, os.path.basename(root.rstrip("/"))) for path, (link, root) in sorted(told.items()) if nested or not above(path)]


def walked(
    spark: SparkSession, roots: list[str], include_unknown: bool = False, include_hidden: bool = False, include_generated: bool = False,
    exclude: tuple[str, ...] = (), max_depth: int | None = None, budget: int = BUDGET,
) -> DataFrame:
    """path, kind, dialect, skipped, bytes, entries: each file found, each file,
    folder or link that is skipped, with the reason (excluded, symlink, hidden,
    generated or unknown), and each folder listed, with its number of entries.

    Files lie at most ``max_depth`` names below a root. A root that is missing
    or a folder that can't be listed is an error."""
    started = _roots(roots, nested=max_depth is not None)
    walk = _lister(exclude_index(exclude), include_hidden, include_generated, max_depth, budget)
    schema = pa.schema([("path", pa.string()), ("kind", pa.string()), ("skipped", pa.string()), ("bytes", pa.int64()), ("entries", pa.int64()), ("depth", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            for row in walk(list(zip(*[c.to_pylist() for c in batch.columns], strict=True))):
                held.append(row)
                if len(held) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    tasks = spark.sparkContext.defaultParallelism
    asked, turns = spark.createDataFrame(started, "path string, depth int, name string"), []
    while True:
        turns.append(staged(asked.mapInArrow(run, FOUND), "walked"))
        asked = turns[-1].filter("kind = 'pending'").select("path", "depth", F.lit(None).cast("string").alias("name"))
        if asked.isEmpty():
            break
        asked = asked.repartition(4 * tasks, "path")
    found = turns[0]
    for turn in turns[1:]:
        found = found.unionByName(turn)
    told = F.when(F.col("kind") == "file", dialect_column(F.col("path")))
    unknown = F.when((F.col("kind") == "file") & F.lit(not include_unknown) & (told == "unknown"), "unknown")
    rows = found.filter("kind <> 'pending'").select("path", "kind", told.alias("dialect"), F.coalesce("skipped", unknown).alias("skipped"), "bytes", "entries")
    # Where roots lie in each other, a file may be met below several.
    return rows.dropDuplicates(["path", "kind", "skipped"]) if max_depth is not None and len(started) > 1 else rows


def walk_summary(found: DataFrame) -> DataFrame:
    """One row: files and bytes that discovery keeps, entries listed, and how
    many files, folders and links are skipped for each reason."""
    kept = (F.col("kind") == "file") & F.col("skipped").isNull()
    none = F.lit(0).cast("long")
    reasons = ("unknown", "hidden", "generated", "symlink", "excluded")
    return found.agg(
        F.count_if(kept).alias("files"), F.coalesce(F.sum(F.when(kept, F.col("bytes"))), none).alias("bytes"), F.coalesce(F.sum("entries"), none).alias("entries"),
        *[F.count_if(F.col("skipped") == r).alias(f"skipped_{r}") for r in reasons],
    )


def contents(found: DataFrame, max_file_bytes: int = 16 << 20) -> DataFrame:
    """The files that a walk keeps as sources: file_id, path, dialect, text (null
    if it isn't UTF-8). A file above ``max_file_bytes`` is an error, and no more
    of it is read."""
    schema = pa.schema([("path", pa.string()), ("dialect", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            held: list[tuple] = []
            size = 0
            for path, dialect in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open(path, "rb") as file:
                    content = file.read(max_file_bytes + 1)
                if len(content) > max_file_bytes:
                    raise ValueError(f"{path} has more than {max_file_bytes} bytes")
                held.append((path, dialect, content))
                size += len(content)
                if size > HELD or len(held) == 1024:
                    yield told(held)
                    held, size = [], 0
            if held:
                yield told(held)

    # One task lists a large folder; many read its files.
    kept = found.filter("kind = 'file' AND skipped IS NULL").select("path", "dialect")
    kept = kept.repartition(4 * found.sparkSession.sparkContext.defaultParallelism, "path")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return kept.mapInArrow(run, "path string, dialect string, content binary").select(F.xxhash64("path").alias("file_id"), "path", "dialect", text.alias("text"))


def write_files(sources: DataFrame, folder: str) -> None:
    """Write each text to its path below a folder that all executors can see, by
    renaming a file of the task's own, so that a task may run again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there: set[str] = set()  # folders are made once a task
        top = os.path.normpath(folder) + "/"
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = os.path.normpath(os.path.join(folder, path))
                if not target.startswith(top):
                    raise ValueError(f"{path} lies outside of the folder")
                if (above := os.path.dirname(target)) not in there:
                    os.makedirs(above, exist_ok=True)
                    there.add(above)
                own = f"{target}.{os.getpid()}.tmp"
                with open(own, "w", encoding="utf-8", newline="") as file:
                    file.write(text or "")
                os.replace(own, target)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    # A small table of many files is one partition: its files are dealt out.
    dealt = sources.select("path", "text").repartition(4 * sources.sparkSession.sparkContext.defaultParallelism, "path")
    dealt.mapInArrow(run, "n long").agg(F.sum("n")).collect()
