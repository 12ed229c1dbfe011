"""Sources: tables of file_id, path, dialect, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parenlake.functions.dialects import EXTENSIONS
from parenlake.operators.nodes import staged

#: Names of folders that hold generated files.
GENERATED = (".git", ".direnv", ".devenv", "build", "coverage", "dist", "node_modules", "result", "target", "vendor")


def dialect_column(path: Column) -> Column:
    """The dialect that a path's extension tells."""
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.regexp_extract(path, r"[^/]\.([^./]*)$", 1)), F.lit("unknown"))


def _binary(spark: SparkSession, paths: list[str], pattern: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(paths)


def from_files(spark: SparkSession, paths: list[str], pattern: str | None = None, last: str | None = None) -> DataFrame:
    """All files under the paths, each a row; text is null if it isn't UTF-8.
    ``ordinal`` is the place of a file named itself among the paths, null for
    files found in folders. Files behind ``last`` in the order of their
    addresses are pruned from the scan: they are never opened."""
    found = _binary(spark, paths, pattern)
    if last is not None:
        found = found.filter(F.col("_metadata.file_path") <= last)
    files = found.select("path", "content", F.col("length").alias("bytes"))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    bare = lambda path: F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    named = F.array_position(F.array(*[bare(F.lit(p)) for p in paths]), bare(F.col("path")))
    return files.select(F.xxhash64("path").alias("file_id"), "path", dialect_column(F.col("path")).alias("dialect"), text.alias("text"), "bytes", F.when(named > 0, named - 1).alias("ordinal"))


def workspace(files: DataFrame, root: str, include_unknown: bool = False, include_hidden: bool = False, include_generated: bool = False, exclude: tuple[str, ...] = (), max_depth: int | None = None, max_file_bytes: int | None = None) -> DataFrame:
    """Files with the reason for which discovery skips them (null: kept). Files
    lie at most ``max_depth`` names below the root."""
    relative = F.regexp_replace(F.expr(f"substring(path, {len(root) + 1})"), "^/", "")
    parts = F.split(relative, "/")
    out = F.lit(False)
    for prefix in exclude:
        out = out | (relative == prefix) | relative.startswith(prefix.rstrip("/") + "/")
    reason = (
        F.when(out, "excluded")
        .when(F.lit(max_file_bytes is not None) & (F.octet_length("text") > F.lit(max_file_bytes or 0)), "too-large")
        .when(F.lit(max_depth is not None) & (F.size(parts) > F.lit(max_depth or 0)), "too-deep")
        .when(F.lit(not include_hidden) & F.exists(parts, lambda p: p.startswith(".")), "hidden")
        .when(F.lit(not include_generated) & F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(g) for g in GENERATED])), "generated")
        .when(F.lit(not include_unknown) & (F.col("dialect") == "unknown"), "unknown")
    )
    return files.dropDuplicates(["path"]).withColumn("skipped", reason)


def discovered(files: DataFrame, root: str, **discovery: object) -> DataFrame:
    """The files that discovery keeps."""
    return workspace(files, root, **discovery).filter("skipped IS NULL").drop("skipped")


def skipped_summary(files: DataFrame) -> DataFrame:
    """How many files of ``workspace`` are kept (null) or skipped, by reason."""
    return files.groupBy("skipped").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes"))


def quota(files: DataFrame, max_files: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """One row: files and bytes that discovery keeps, and whether they lie within
    the limits; nothing is dropped."""
    facts = files.filter("skipped IS NULL").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes"))
    said = F.array_compact(F.array(
        F.when(F.lit(max_files is not None) & (F.col("files") > F.lit(max_files or 0)), "files"), F.when(F.lit(max_bytes is not None) & (F.col("bytes") > F.lit(max_bytes or 0)), "bytes")
    ))
    return facts.select("files", "bytes", said.alias("violations"), (F.size(said) == 0).alias("passed"))


def admitted(listing: DataFrame, max_files: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """``listing`` (path, bytes) with ordinal and total_bytes, both counted in
    the order of paths, and status: admitted; breaks-limit, the first file with
    which a limit is passed (``broken``: files or bytes); or after-limit.

    Ranges of paths are summed on their own, then shifted by what lies before
    them, of which there is one row a range."""
    ranged = staged(listing.repartitionByRange("path").withColumn("range", F.spark_partition_id()), "listing")
    within = Window.partitionBy("range").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    size = F.coalesce("bytes", F.lit(0))
    shifts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b"))
    none = F.lit(0).cast("long")
    shifts = shifts.select("range", F.coalesce(F.sum("n").over(before), none).alias("files_before"), F.coalesce(F.sum("b").over(before), none).alias("bytes_before"))
    run = ranged.withColumn("ordinal", F.row_number().over(within)).withColumn("total_bytes", F.sum(size).over(within)).join(F.broadcast(shifts), "range")
    run = run.withColumn("ordinal", F.col("ordinal") + F.col("files_before")).withColumn("total_bytes", F.col("total_bytes") + F.col("bytes_before"))
    most = lambda limit: F.lit((1 << 63) - 1 if limit is None else limit)
    files, total = F.col("ordinal") > most(max_files), F.col("total_bytes") > most(max_bytes)
    already = (F.col("ordinal") - 1 > most(max_files)) | (F.col("total_bytes") - size > most(max_bytes))
    status = F.when(already, "after-limit").when(files | total, "breaks-limit").otherwise("admitted")
    broken = F.when(F.col("status") == "breaks-limit", F.when(files, "files").otherwise("bytes"))
    return run.withColumn("status", status).withColumn("broken", broken).drop("range", "files_before", "bytes_before")


def read_within(spark: SparkSession, paths: list[str], max_files: int | None = None, max_bytes: int | None = None, pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The files that the limits admit, as ``from_files`` reads them, and the
    listing that says so: lengths are known before any file is opened."""
    listing = admitted(_binary(spark, paths, pattern).select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("bytes")), max_files, max_bytes)
    last = listing.filter("status = 'admitted'").agg(F.max("path")).first()[0]
    return from_files(spark, paths, pattern, last=last if last is not None else ""), listing


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Common Lisp file for each order: one function that calls a function for
    each of its items, which has a library file or, for spares, has none."""
    items = _table(spark, sf_dir, "lineitem")
    number = F.col("l_quantity").cast("long").cast("string")
    call = F.concat(F.when(F.col("l_partkey") % 10 < 7, "(part-").otherwise("(spare-"), F.col("l_partkey").cast("string"), F.array_join(F.transform(F.sequence(F.lit(0), F.col("l_linenumber") % 3), lambda i: F.concat(F.lit(" "), number)), ""), F.lit(")"))
    # Texts are small but costly to parse: keep all partitions of this shuffle.
    dealt = items.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    body = dealt.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", call.alias("call")))).alias("calls"))
    key = F.col("l_orderkey").cast("string")
    text = F.concat(F.lit("(defun order-"), key, F.lit(" (customer priority)\n  "), F.array_join(F.col("calls.call"), "\n  "), F.lit(")\n"))
    return body.select(F.col("l_orderkey").alias("file_id"), F.concat(F.lit("orders/"), key, F.lit(".lisp")).alias("path"), F.lit("common-lisp").alias("dialect"), text.alias("text"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library file for each part: a function, or a variable where its size is
    a multiple of five."""
    key = F.col("p_partkey").cast("string")
    text = F.when(F.col("p_size") % 5 != 0, F.concat(F.lit("(defun part-"), key, F.lit(" (x y)\n  (list x y))\n"))).otherwise(F.concat(F.lit("(defvar stock-"), key, F.lit(" 0)\n")))
    return _table(spark, sf_dir, "part").select((-1 - F.col("p_partkey")).alias("file_id"), F.concat(F.lit("parts/"), key, F.lit(".lisp")).alias("path"), F.lit("common-lisp").alias("dialect"), text.alias("text"))


def shop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders together with the library they call."""
    return orders(spark, sf_dir).unionByName(parts(spark, sf_dir))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package for each nation: it uses its region's and exports suppliers."""
    suppliers = _table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_suppkey")).alias("keys"))
    joined = _table(spark, sf_dir, "nation").join(suppliers, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    key, region = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    exports = F.array_join(F.transform(F.coalesce("keys", F.array().cast("array<bigint>")), lambda k: F.concat(F.lit(" #:supplier-"), k.cast("string"))), "")
    text = F.concat(
        F.lit("(defpackage #:nation-"), key, F.lit("\n  (:use #:cl #:region-"), region, F.lit(")\n  (:export"), exports, F.lit("))\n(in-package #:nation-"), key,
        F.lit(")\n(defvar *name* (region-"), region, F.lit("::lookup "), key, F.lit("))\n"),
    )
    return joined.select(F.col("n_nationkey").cast("long").alias("file_id"), F.concat(F.lit("nations/"), key, F.lit(".lisp")).alias("path"), F.lit("common-lisp").alias("dialect"), text.alias("text"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A definition for each customer, in the dialect of its nation's turn."""
    key = F.col("c_custkey").cast("string")
    say = lambda before, after: F.concat(F.lit(before), key, F.lit(after))
    turn = F.col("c_nationkey") % 7
    ext = F.element_at(F.array(*[F.lit(x) for x in ("lisp", "el", "scm", "clj", "janet", "fnl", "txt")]), (turn + 1).cast("int"))
    text = (
        F.when(turn == 0, say("(defun customer-", " (a &optional b)\n  (list a b))\n"))
        .when(turn == 1, say("(defvar customer-", " 1)\n"))
        .when(turn == 2, say("(define (customer-", " x)\n  x)\n"))
        .when(turn == 3, say("(defn customer-", " [x]\n  {:id x})\n"))
        .when(turn == 4, say("(defn customer-", " [x]\n  x)\n"))
        .when(turn == 5, say("(fn customer-", " [x]\n  x)\n"))
        .otherwise(say("(define-thing customer-", "\n  :on)\n"))
    )
    path = F.concat(F.lit("customers/"), key, F.lit("."), ext)
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id"), path.alias("path"), dialect_column(path).alias("dialect"), text.alias("text"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON properties of events, read by the permissive reader."""
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("file_id"), F.concat(F.lit("events/"), F.col("event_id").cast("string"), F.lit(".json")).alias("path"), F.lit("unknown").alias("dialect"), F.col("props").alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose, read by the permissive reader: mostly atoms, some errors."""
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.concat(F.lit("documents/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.lit("unknown").alias("dialect"), "text")


def bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A let form for each supplier: used once, twice or never by turns."""
    key = F.col("s_suppkey").cast("string")
    turn = F.col("s_suppkey") % 3
    text = F.concat(
        F.lit("(defun supplier-"), key, F.lit(" (width)\n  (let ((value (* width "), key, F.lit(")))\n    "),
        F.when(turn == 0, "(+ value 1)").when(turn == 1, "(+ value value)").otherwise("(+ width 1)"), F.lit("))\n"),
    )
    return _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file_id"), F.concat(F.lit("suppliers/"), key, F.lit(".lisp")).alias("path"), F.lit("common-lisp").alias("dialect"), text.alias("text"))


def measures(spark: SparkSession, sf_dir: str, kind: str = "names") -> DataFrame:
    """A form for each supplier, for counts of similar pairs: ``names`` alone
    differ; or, for odd keys, ``sizes`` (128 operands, not 4) or ``leaves``
    (as many nodes, but nested)."""
    key, odd = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 2 == 1
    body = {
        "names": F.lit("(+ x 1)"),
        "sizes": F.when(odd, "(+" + " x" * 128 + ")").otherwise("(+ x x x x)"),
        "leaves": F.when(odd, "(" * 9 + "x" + ")" * 9).otherwise("(+" + " x" * 8 + ")"),
    }[kind]
    text = F.concat(F.lit("(defun f"), key, F.lit(" (x) "), body, F.lit(")"))
    return _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file_id"), F.concat(F.lit("measures/"), key, F.lit(".lisp")).alias("path"), F.lit("common-lisp").alias("dialect"), text.alias("text"))


def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binding form for each customer, in the dialect of its nation's turn:
    slots, let*, let with lists or a vector, and do."""
    key = F.col("c_custkey").cast("string")
    turn = F.col("c_nationkey") % 7
    say = lambda text: F.replace(F.lit(text), F.lit("K"), key)
    ext = F.element_at(F.array(*[F.lit(x) for x in ("lisp", "el", "scm", "clj", "janet", "fnl", "txt")]), (turn + 1).cast("int"))
    text = (
        F.when(turn == 0, say("(with-slots ((a slot-K) b) (get-K) (use-K a b))"))
        .when(turn == 1, say("(let* ((a (get-K)) b) (use-K a b))"))
        .when(turn == 2, say("(let ((x (get-K))) (use-K x x))"))
        .when(turn == 6, say("(do ((i (get-K) (next-K i)) j) ((done-K i)) (use-K i j))"))
        .otherwise(say("(let [x (get-K) y 1] (use-K x y))"))
    )
    path = F.concat(F.lit("scopes/"), key, F.lit("."), ext)
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id"), path.alias("path"), dialect_column(path).alias("dialect"), text.alias("text"))
