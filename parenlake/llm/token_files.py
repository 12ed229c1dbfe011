"""Token ids as binary files with Elias-Fano document boundaries.

A corpus is a folder of token files, numbered so that documents ascend by
doc_id, and a manifest of one row a file. A token file is

    magic | ids | ends | names | footer

* ids: all documents' ids without gaps, 2 bytes each where the vocabulary
  allows it, else 4, little-endian;
* ends: where each document ends among the file's ids, an Elias-Fano list;
* names: doc_id of each document less the file's first, the same (nulls, which
  come first, are only counted);
* footer: counts, widths and the lengths of the lists.

Document k is found by two selects and one read of its own ids. Files are
written by the tasks that hold a range of documents, under a name that depends
on the range alone, and appear whole or not at all, so a task that runs again
writes the same files again.
"""

from __future__ import annotations

import struct
import sys
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parenlake.llm.common import bounded, shared_folder, text_of
from parenlake.llm.elias_fano import EliasFano
from parenlake.llm.tokens import library_tokens

MAGIC = b"IDSEFv1\n"
_FOOT = struct.Struct("<QQQqBII8s")  # documents, ids, null names, first name, id width, bytes of ends and of names, magic

MANIFEST = "file string, part int, seq int, documents long, tokens long, bytes long"


def packed_file(names: list[int | None], sizes: list[int], ids: bytes, width: int) -> bytes:
    """The bytes of a token file. ``ids``: unsigned 32-bit, of all documents."""
    ends = EliasFano.pack(np.cumsum(np.array(sizes, np.uint64), dtype=np.uint64))
    known = np.array([x for x in names if x is not None], np.int64)
    first = int(known[0]) if len(known) else 0
    named = EliasFano.pack(known.view(np.uint64) - np.array([first], np.int64).view(np.uint64))
    flat = np.frombuffer(ids, "<u4")
    foot = _FOOT.pack(len(sizes), len(flat), len(names) - len(known), first, width, len(ends), len(named), MAGIC)
    return b"".join([MAGIC, flat.astype(f"<u{width}").tobytes(), ends, named, foot])


class TokenFile:
    """Random access to the documents of one file.

    ``source`` is an open Arrow random-access file (of any store) or a buffer;
    only the footer and the two lists are read when it is opened.
    """

    def __init__(self, source: pa.NativeFile | bytes | memoryview | pa.Buffer) -> None:
        self.file = source if isinstance(source, pa.NativeFile) else pa.BufferReader(source)
        size = self.file.size()
        foot = self.file.read_at(_FOOT.size, size - _FOOT.size) if size >= _FOOT.size + len(MAGIC) else b""
        if foot[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a token file")
        self.documents, self.tokens, self.nulls, self.first, self.width, ends, names, _ = _FOOT.unpack(foot)
        if size != len(MAGIC) + self.tokens * self.width + ends + names + _FOOT.size:
            raise ValueError("token file of a wrong length")
        lists = self.file.read_at(ends + names, size - _FOOT.size - ends - names)
        self.ends, self.names = EliasFano(lists[:ends]), EliasFano(lists[ends:])

    def __len__(self) -> int:
        return self.documents

    def span(self, k: int) -> tuple[int, int]:
        """First id and id after the last of document k, among the file's ids."""
        return (self.ends[k - 1] if k else 0), self.ends[k]

    def name(self, k: int) -> int | None:
        return None if k < self.nulls else _signed(self.names[k - self.nulls] + self.first)

    def ids(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((end - start) * self.width, len(MAGIC) + start * self.width), f"<u{self.width}")

    def document(self, k: int) -> np.ndarray:
        """The ids of document k; nothing else is read."""
        return self.ids(*self.span(k))

    def all_names(self) -> list[int | None]:
        known = (self.names.values() + np.array([self.first], np.int64).view(np.uint64)).view(np.int64)
        return [*[None] * self.nulls, *known.tolist()]


def _signed(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


@dataclass
class _Open:
    """Documents of the file that a task is filling."""

    names: list
    sizes: list
    ids: list
    bytes: int = 0


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, file_bytes: int = 32 << 20, partitions: int | None = None) -> DataFrame:
    """Encode every whole text, append ``end_id``, and write token files into
    ``folder`` in ascending doc_id order; gives the manifest, one row a file.

    Null texts count as empty: ``end_id`` alone. Null doc_ids come first. Rows
    of one doc_id follow the hash of their text; ranges are cut between rows,
    not ids, so an id repeated any number of times fills no task. A file is
    closed when its ids reach ``file_bytes``; a longer document has a file of
    its own. An empty table gives an empty manifest. Other columns are ignored.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    keyed = keyed.select("doc_id", "text", F.xxhash64("text").alias("digest"), F.monotonically_increasing_id().alias("nth"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("nth")]
    ranged = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    columns = [part.split()[0] for part in MANIFEST.split(", ")]
    types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs

        store, base = pa.fs.FileSystem.from_uri(folder)
        tokens, part, seq = library_tokens(tokenizer), TaskContext.get().partitionId(), 0
        width = 2 if max(tokens.size - 1, end_id) < 1 << 16 else 4
        end = int(end_id).to_bytes(4, sys.byteorder)

        def close(now: _Open) -> pa.RecordBatch:
            name = f"tokens-{part:06d}-{seq:05d}.bin"
            made = packed_file(now.names, now.sizes, b"".join(now.ids), width)
            draft = f"{base}/.{name}-{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as out:
                out.write(made)
            store.move(draft, f"{base}/{name}")
            row = (name, part, seq, len(now.names), sum(now.sizes), len(made))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=columns)

        now = _Open([], [], [])
        for whole in batches:
            for at in range(0, whole.num_rows, 2_048):
                batch = whole.slice(at, 2_048)
                for doc, found in zip(batch.column(0).to_pylist(), tokens.of(batch.column(1)), strict=True):
                    size = len(found) // 4 + 1
                    if now.names and now.bytes + size * width > file_bytes:
                        yield close(now)
                        now, seq = _Open([], [], []), seq + 1
                    now.names.append(doc)
                    now.sizes.append(size)
                    now.ids += (found, end)
                    now.bytes += size * width
        if now.names:
            yield close(now)

    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    ranged.mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The files in order and, for each, the number of ids in the files before
    it (``base``). One row a file, so a window over all of them is small."""
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each document of the folder's token files, from the files
    alone: doc_id, start (ids of all documents before it), n_tokens, ids_crc32
    (of its ids as little-endian unsigned 32-bit integers), file, nth (its
    number in the file)."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "tokens-*.bin").load(folder)
    found = bounded(found).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    names = ["file", "nth", "doc_id", "local", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                opened = TokenFile(content.as_buffer())
                ends = opened.ends.values().astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                flat = memoryview(opened.ids(0, opened.tokens).astype("<u4").tobytes())
                crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                named = opened.all_names()
                for at in range(0, len(opened), 20_000):
                    some = slice(at, at + 20_000)
                    k = len(named[some])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file] * k), pa.array(np.arange(at, at + k)), pa.array(named[some], pa.int64()), pa.array(starts[some]), pa.array((ends - starts)[some]), pa.array(crc[some], pa.int64())],
                        names=names,
                    )

    rows = found.mapInArrow(run, "file string, nth long, doc_id long, local long, n_tokens long, ids_crc32 long")
    files = manifest(spark, folder).select(F.col("file").alias("_file"), "base")
    placed = rows.join(files, rows["file"] == files["_file"])
    return placed.select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "file", "nth")


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write all documents into a new folder of the shared one, then read it."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/token-files-{uuid.uuid4().hex}"
    write_tokens(docs, tokenizer, folder, end_id)
    return read_tokens(spark, folder)
