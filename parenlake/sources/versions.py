"""A corpus as a sequence of versions in one folder.

``data`` holds Parquet tables, one for each commit, of the files that it changes
or removes; ``records`` a line of JSON for each version, which lists the tables
that make it up, the oldest first. A commit writes its table, then its record
under a name of its own, and publishes by renaming the record to the next
number, which fails if another writer has taken that number. Until then nobody
sees anything of it: a writer that is lost leaves the version before as it was.
The rename is one step on file systems with atomic renames, such as HDFS.
"""

from __future__ import annotations

import json
import uuid

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MARKS = "_removed boolean, _step long"


class Stale(ValueError):
    """Another writer has published since the version that a commit rests on."""


def _path(spark: SparkSession, name: str) -> tuple[JavaObject, JavaObject]:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _record(root: str, version: int) -> str:
    return f"{root}/records/{version:012d}"


def latest(spark: SparkSession, root: str) -> int:
    """The number of the last version, 0 where there is none."""
    path, files = _path(spark, f"{root}/records")
    names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
    return max((int(n) for n in names if n.isdigit()), default=0)


def _tables(spark: SparkSession, root: str, version: int) -> tuple[list[str], str]:
    """Names of the tables of a version, and the schema of its files."""
    path, files = _path(spark, _record(root, version))
    if not files.exists(path):
        raise ValueError(f"no version {version}")
    stream = files.open(path)
    try:
        found = json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()
    return found["tables"], found["schema"]


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The files of a version, the last one by default: of each path what the
    latest of its tables says. Only paths meet to find that out; a version of
    one table is just read."""
    tables, schema = _tables(spark, root, version or latest(spark, root))
    rows = spark.read.schema(f"{schema}, {_MARKS}").parquet(*[f"{root}/data/{t}" for t in tables])
    if len(tables) > 1:
        last = rows.groupBy(F.col("path").alias("_path")).agg(F.max("_step").alias("_last"))
        rows = rows.join(last, (F.col("path") == F.col("_path")) & (F.col("_step") == F.col("_last")), "left_semi")
    return rows.filter("NOT _removed").drop("_removed", "_step")


def _publish(spark: SparkSession, root: str, base: int, tables: list[str], schema: str) -> int:
    own, files = _path(spark, f"{root}/records/_{uuid.uuid4().hex}")
    stream = files.create(own, False)
    try:
        stream.write(json.dumps({"tables": tables, "schema": schema}).encode())
    finally:
        stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    how = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    how[0] = hadoop.Options.Rename.NONE
    target, _ = _path(spark, _record(root, base + 1))
    try:
        hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(own, target, how)
    except Py4JJavaError as error:
        files.delete(own, False)
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            raise Stale(f"version {base + 1} is there already") from error
        raise
    return base + 1


def commit(changed: DataFrame, root: str, base: int, removed: DataFrame | None = None, whole: bool = False) -> int:
    """Publish version ``base`` + 1 and return its number: ``base`` with the
    files ``changed`` put in by path and the paths ``removed`` taken out; with
    ``whole``, the files ``changed`` alone. Paths must differ and not be null.

    Raises ``Stale``, and leaves no table, if ``base`` isn't the last version:
    before anything is written where that is known, else on publishing."""
    spark = changed.sparkSession
    if (last := latest(spark, root)) != base:
        raise Stale(f"version {last} is there, the commit rests on {base}")
    before, schema = _tables(spark, root, base) if base else ([], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in changed.schema))
    rows = changed.withColumns({"_removed": F.lit(False), "_step": F.lit(base + 1).cast("long")})
    if removed is not None:
        rows = rows.unionByName(removed.select("path", F.lit(True).alias("_removed"), F.lit(base + 1).cast("long").alias("_step")), allowMissingColumns=True)
    table = uuid.uuid4().hex
    path, files = _path(spark, f"{root}/data/{table}")
    try:
        rows.write.option("compression", "zstd").parquet(f"{root}/data/{table}")
        twice = spark.read.parquet(f"{root}/data/{table}").groupBy("path").count().filter("path IS NULL OR count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"path {twice[0]['path']} is null or comes twice")
        return _publish(spark, root, base, [table] if whole else [*before, table], schema)
    except Exception:
        files.delete(path, True)
        raise


def roll_back(spark: SparkSession, root: str, to: int, base: int) -> int:
    """Publish version ``base`` + 1 with the files of version ``to``; nothing is
    copied, and what came between stays readable."""
    if (last := latest(spark, root)) != base:
        raise Stale(f"version {last} is there, the rollback rests on {base}")
    return _publish(spark, root, base, *_tables(spark, root, to))


def history(spark: SparkSession, root: str) -> DataFrame:
    """version, changed, removed, tables of each version: how many files its
    last table changes or removes, and of how many tables it is made."""
    rows = [(v, tables[-1], len(tables)) for v in range(1, latest(spark, root) + 1) for tables in [_tables(spark, root, v)[0]]]
    made = spark.createDataFrame(rows, "version long, table string, tables int")
    names = sorted({t for _, t, _ in rows})
    if not names:
        return made.select("version", F.lit(0).cast("long").alias("changed"), F.lit(0).cast("long").alias("removed"), "tables")
    seen = spark.read.schema(f"path string, {_MARKS}").parquet(*[f"{root}/data/{t}" for t in names])
    counts = seen.groupBy(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("table")).agg(F.count_if(~F.col("_removed")).alias("changed"), F.count_if("_removed").alias("removed"))
    none = F.lit(0).cast("long")
    return made.join(counts, "table", "left").select("version", F.coalesce("changed", none).alias("changed"), F.coalesce("removed", none).alias("removed"), "tables")
