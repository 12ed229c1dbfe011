"""Common ground of the operators that look for repeated passages.

A row of the documents table is known by ``rid``, a hash of its id and text.
Sampled k-mers ("anchors") are minimizers: any stretch of k + w - 1 words holds
one, chosen by the words of the stretch alone, so a repeated stretch has the
same anchors everywhere. Only anchors met at least twice lead anywhere, and
only documents that hold such are looked at word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parenlake.llm.common import Rolling, WordHashes, bounded, drop_stage, minimizers, mix64, positions, raw_bytes, release, stage, text_of

#: Bits of a location that hold the word's place in its document.
PLACE = 28
#: Marks in column ``len``: one occurrence; a hash met again in the same batch.
ONE, AGAIN = 0, -1

MET = "h long, loc long, len int"
#: Occurrences that a task merges at a time, about.
MERGED = 500_000


def rows_of(docs: DataFrame) -> DataFrame:
    """rid, doc_id, text of each document; a null text is empty."""
    text = text_of("text")
    return bounded(docs).select(F.xxhash64(F.col("doc_id").cast("long"), text).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def opened(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rid, doc_id, n_words, kept_sha256, ord, spots, packed of every document:
    number and hash of all its words, and of a suspect also the text.

    Texts are shuffled once, compressed, to meet ``known``; staged, so that
    later steps read and move the texts of suspects alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            sizes, digests, packed = [], [], []
            for text in raw_bytes(batch.column(2)):
                words = text.split()
                sizes.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                packed.append(squeeze.compress(text))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(packed, pa.binary())], names=["rid", "doc_id", "n_words", "kept_sha256", "packed"])

    packed = rows.mapInArrow(run, "rid long, doc_id long, n_words long, kept_sha256 string, packed binary")
    joined = packed.join(known.withColumnRenamed("rid", "_rid"), F.col("rid") == F.col("_rid"), "left")
    return stage(joined.select("rid", "doc_id", "n_words", "kept_sha256", "ord", "spots", F.when(F.col("ord").isNotNull(), F.col("packed")).alias("packed")), "opened")


def without(documents: DataFrame, runs: DataFrame, spans: Callable[[list[dict]], list[tuple[int, int]]], extra: str | None = None, also: str | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of documents(``opened``) without
    the words of runs(rid, runs); ``spans`` gives the sorted stretches of words,
    none overlapping, of a document's runs. ``extra`` names a column for these,
    as start:end joined by commas; ``also`` a number in ``runs`` to pass on, 0
    for documents without runs."""
    more = [*([f"{also} long"] if also else []), *([f"{extra} string"] if extra else [])]
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *[x.split()[0] for x in more]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            removed, digests, texts = [], [], []
            for digest, packed, found in zip(*[batch.column(k).to_pylist() for k in range(2, 5)], strict=True):
                some = spans(found) if found else []
                if some:
                    words, kept, last = expand.decompress(packed).split(), [], 0
                    for start, end in some:
                        kept += words[last:start]
                        last = end
                    digest = hashlib.sha256(b" ".join([*kept, *words[last:]])).hexdigest()
                removed.append(sum(end - start for start, end in some))
                digests.append(digest)
                texts.append(",".join(f"{a}:{b}" for a, b in some))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(removed, pa.int64()), pa.array(digests, pa.string()), *batch.columns[5:], *([pa.array(texts, pa.string())] if extra else [])], names=names)

    joined = documents.join(runs.withColumnRenamed("rid", "_rid"), F.col("rid") == F.col("_rid"), "left")
    passed = [F.coalesce(F.col(also), F.lit(0)).cast("long").alias(also)] if also else []
    return joined.select("doc_id", "n_words", "kept_sha256", "packed", "runs", *passed).mapInArrow(run, ", ".join(["doc_id long, n_words long, n_removed long, kept_sha256 string", *more]))


def met_arrays(h: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences (hash, row, place) of a batch, merged before they travel.

    Hashes the batch holds more than once are known to repeat: they go on as
    runs of consecutive places, spread at random, with one ``AGAIN`` row for
    the rest of the corpus. So a passage that a third of all documents share
    makes a few rows for each batch, not one for each document.
    Returns h, row, place, len."""
    if not len(h):
        return h, row, place, np.zeros(0, np.int32)
    unique, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
    once = count[inverse] == 1
    r, p = row[~once], place[~once]
    fresh = np.concatenate([[True], (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)]) if len(r) else np.zeros(0, bool)
    first = np.flatnonzero(fresh)
    length = np.diff([*first, len(r)]).astype(np.int32)
    spread = mix64(r[first].view(np.uint64) ^ mix64(p[first].astype(np.uint64)))
    again = unique[count > 1]
    none = np.zeros(len(again), np.int64)
    return (
        np.concatenate([h[once], spread, again]),
        np.concatenate([row[once], r[first], none]),
        np.concatenate([place[once], p[first], none]),
        np.concatenate([np.full(int(once.sum()), ONE, np.int32), length, np.full(len(again), AGAIN, np.int32)]),
    )


def met_again(met: DataFrame, *key: str) -> DataFrame:
    """The occurrences whose hash (column h, or the columns named) is met at
    least twice, and the known runs."""
    key = key or ("h",)
    weight = F.when(F.col("len") == AGAIN, 2).when(F.col("len") == ONE, 1).otherwise(0)
    counted = met.withColumn("_c", F.sum(weight).over(Window.partitionBy(*key)))
    return counted.filter((F.col("len") > 0) | ((F.col("len") == ONE) & (F.col("_c") > 1))).drop("_c", *key)


def anchors(rows: DataFrame, k: int, w: int) -> DataFrame:
    """h, rid, place, len: the anchors of all documents of k + w - 1 words and
    more, merged by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        hs, rs, ps = [], [], []

        def merged() -> pa.RecordBatch:
            h, r, p, n = met_arrays(np.concatenate(hs), np.concatenate(rs), np.concatenate(ps))
            for some in (hs, rs, ps):
                some.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(r), pa.array(p.astype(np.int32)), pa.array(n)], names=["h", "rid", "place", "len"])

        for batch in batches:
            for rid, text in zip(batch.column(0).to_pylist(), raw_bytes(batch.column(1)), strict=True):
                words = text.split()
                if len(words) >> PLACE:
                    raise ValueError(f"a text has {len(words)} words; places are numbered up to {(1 << PLACE) - 1}")
                if len(words) >= k + w - 1:
                    kmers = Rolling(known.of(words)).windows(k)
                    at = minimizers(kmers, w)
                    hs.append(kmers[at])
                    rs.append(np.full(len(at), rid, np.int64))
                    ps.append(at.astype(np.int64))
            if sum(map(len, hs)) >= MERGED:
                yield merged()
        if hs:
            yield merged()

    return rows.select("rid", "text").mapInArrow(run, "h long, rid long, place int, len int")


def suspects(rows: DataFrame, k: int, w: int) -> DataFrame:
    """rid, ord, spots of the documents that hold a repeated anchor: ``spots``
    are (place, len) runs of such anchors, ``ord`` numbers the documents from 0.
    Staged."""
    found = met_again(anchors(rows, k, w)).withColumn("len", F.greatest("len", F.lit(1)))
    spots = stage(found.groupBy("rid").agg(F.collect_list(F.struct("place", "len")).alias("spots")), "spots")
    numbered = positions(stage(spots.select("rid"), "rids"), [], ["rid"], out="ord").withColumnRenamed("rid", "_rid")
    out = stage(spots.join(numbered, F.col("rid") == F.col("_rid")).select("rid", "ord", "spots"), "suspects")
    drop_stage(spots)
    release(rows.sparkSession)
    return out


def places(spots: list[dict]) -> np.ndarray:
    """Sorted places of the runs in a ``spots`` value."""
    if not spots:
        return np.zeros(0, np.int64)
    start = np.array([s["place"] for s in spots], np.int64)
    length = np.array([s["len"] for s in spots], np.int64)
    return np.unique(np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum()))


def paths(again: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """rid, runs [(place, len)]: the rows loc, len of a document joined to their
    neighbours, so that runs that touch or overlap become one. Staged."""
    split = again.select(F.shiftright("loc", PLACE).alias("_ord"), F.col("loc").bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int").alias("place"), F.greatest("len", F.lit(1)).alias("len"))
    along = Window.partitionBy("_ord").orderBy("place", "len")
    before = F.max(F.col("place") + F.col("len")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    headed = split.withColumn("_head", F.when(F.col("place") <= before, 0).otherwise(1))
    path = headed.withColumn("_path", F.sum("_head").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    joined = path.groupBy("_ord", "_path").agg(F.min("place").alias("place"), (F.max(F.col("place") + F.col("len")) - F.min("place")).alias("len"))
    lists = joined.groupBy("_ord").agg(F.collect_list(F.struct("place", "len")).alias("runs"))
    return stage(lists.join(known.select("rid", "ord"), F.col("_ord") == F.col("ord")).select("rid", "runs"), name)
