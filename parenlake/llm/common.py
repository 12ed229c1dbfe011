"""Building blocks shared by the corpus operators.

* ``stage``     writes a table to the folder all executors share and reads it
                back: it cuts lineage, and a lost executor costs one reread.
* ``bounded``   bounds what Python workers are handed at a time.
* ``positions`` gives every row its exclusive running total inside its group,
                in a fixed order, without ever putting a whole group into one
                task.
* word and window hashing over numpy arrays for the Arrow-batched operators.
"""

from __future__ import annotations

import atexit
import gc
import math
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: the white space that separates words, as a character class.
SPACE = r"[\x20\x09-\x0D]"
#: Fixed value: a word.
WORD = r"[^\x20\x09-\x0D]+"

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; where a local session sets none (tests), one
    of our own. Any other session must set it."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="parenlake-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return f"file://{_own_folder[0]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing will read again."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are done."""
    gc.collect()
    spark._jvm.System.gc()


#: Bytes of an Arrow batch, where the session does not say.
BATCH_BYTES = 4 << 20


def bounded(df: DataFrame) -> DataFrame:
    """``df``; its session's Arrow batches are bounded by bytes, for texts may be
    long and both sides of a Python worker hold a batch. A bound that the
    session sets itself stays."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if conf.get(name, None) is None:
        conf.set(name, str(BATCH_BYTES))
    return df


def aside(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with its columns other than those ``used`` under names that clash
    with nothing, and what to select to have all columns back in their order."""
    names = [c if c in used else f"_aside{k}" for k, c in enumerate(docs.columns)]
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)])
    return renamed, [F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)]


def text_of(column: str | Column) -> Column:
    """The whole text; a null text counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words, on the JVM."""
    return F.size(F.array_remove(F.split(text, SPACE), "")).cast("long")


def equal_keys(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Null-safe equality of the named columns."""
    on = F.lit(True)
    for name in names:
        on = on & left[name].eqNullSafe(right[name])
    return on


def positions(df: DataFrame, group: list[str], order: list[str], weight: str | None = None, out: str = "start", copy: str | None = None, rows_per_bucket: int = 20_000) -> DataFrame:
    """Add ``out``: the sum of ``weight`` (1 if None) over the rows before this
    one in its group, gapless from 0.

    ``df`` should be a staged table of narrow rows. Rows that agree in every
    column are merged first and dealt out again at the end, so a key repeated
    any number of times never fills a task. Each group is cut by a hash of the
    order columns into buckets; buckets follow each other, rows inside one
    follow ``order``. Only bucket totals are seen together.

    ``copy`` names a column that numbers the equal rows.

    Nulls in group or order columns are values like any other; empty tables
    give empty results; order is fixed by values alone, so reruns agree.
    """
    size = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    buckets = max(64, math.ceil(df.count() / rows_per_bucket))
    columns = df.columns
    merged = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    merged = merged.withColumn("_bucket", F.pmod(F.xxhash64(*order, F.lit(17)), F.lit(buckets)).cast("int"))
    merged = merged.withColumn("_span", size * F.col("_copies"))
    rest = [c for c in columns if c not in group and c not in order]
    within = Window.partitionBy(*group, "_bucket").orderBy(*order, *rest)
    run = merged.withColumn("_run", F.sum("_span").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_span"))
    total = merged.groupBy(*group, "_bucket").agg(F.sum("_span").alias("_total"))
    across = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    total = total.withColumn("_base", F.sum("_total").over(across) - F.col("_total")).drop("_total")
    for name in group:
        total = total.withColumnRenamed(name, f"_g_{name}")
    total = total.withColumnRenamed("_bucket", "_b")
    on = run["_bucket"] == total["_b"]
    for name in group:
        on = on & run[name].eqNullSafe(total[f"_g_{name}"])
    placed = run.join(total, on, "inner").withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    named = [F.col("_copy").alias(copy)] if copy else []
    return placed.select(*columns, (F.col("_base") + F.col("_run") + F.col("_copy") * size).alias(out), *named)


# --- Arrow batches ---------------------------------------------------------


def arrow_map(df: DataFrame, make: Callable[[], Callable[[dict], dict | None]], schema: str) -> DataFrame:
    """``mapInArrow`` over column dictionaries. ``make()`` runs once a task and
    returns the function applied to each batch: name -> Arrow array in,
    name -> values out."""
    names = [part.strip().split()[0] for part in schema.split(",")]
    fields = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            made = work(dict(zip(batch.schema.names, batch.columns, strict=True)))
            if made is not None:
                yield pa.RecordBatch.from_arrays([as_arrow(made[n], arrow.field(n).type) for n in names], schema=arrow)

    return df.mapInArrow(run, schema)


def as_arrow(values: object, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def raw_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of the public splitmix64 generator."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered up to a bound."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 4096)
            steps = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
            steps[0][0] = steps[1][0] = 1
            self.up, self.down = np.multiply.accumulate(steps[0]), np.multiply.accumulate(steps[1])


_powers = Powers()


class Rolling:
    """Hashes of all windows of any length over a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        _powers.need(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _powers.up[:n], out=self.sums[1:])
        self.n = n

    def windows(self, k: int) -> np.ndarray:
        """Hash of each window of k values, by its start."""
        m = self.n - k + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        return mix64((self.sums[k:] - self.sums[:m]) * _powers.down[:m])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each span [start, end)."""
        return mix64((self.sums[end] - self.sums[start]) * _powers.down[start] + (end - start).astype(np.uint64) * _M1)


def sliding(values: np.ndarray, w: int, best: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) over every window of w values."""
    width, run = 1, values
    while 2 * width <= w:
        run = best(run[:-width], run[width:])
        width *= 2
    if width < w:
        run = best(run[: len(run) - (w - width)], run[w - width :])
    return run


def minimizers(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions of content-selected hashes: every w neighbours hold one.

    A position is kept when it is the least (ties all kept) of some w
    neighbours, which depends on those hashes alone."""
    if len(hashes) < w:
        return np.zeros(0, np.int64)
    least = sliding(hashes, w, np.minimum)
    edge = np.zeros(w - 1, np.uint64)
    most = sliding(np.concatenate([edge, least, edge]), w, np.maximum)
    return np.flatnonzero(most == hashes)


def runs_of(positions: np.ndarray, before: int, after: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Union of [p - before, p + after) over sorted positions, cut to [0, n)."""
    if not len(positions):
        return positions, positions
    start, end = np.maximum(positions - before, 0), np.minimum(positions + after, n)
    fresh = np.concatenate([[True], start[1:] > np.maximum.accumulate(end)[:-1]])
    first = np.flatnonzero(fresh)
    return start[first], np.maximum.reduceat(end, first)
