"""Substring deduplication on a De Bruijn graph of words.

A node is a (k-1)-mer of words, an edge a k-mer; an edge met at least twice
repeats. Occurrences of nodes are shuffled by node, with the words before and
after, which tells a node's degrees and how often each of its edges is met.

A text's repeated edges are compacted into segments: chains through nodes of in-
and outdegree one at which no text begins or ends. Every occurrence of an edge
then continues as all others do, so a segment is the same wherever it is found.
Segments that meet at a node where texts only begin or end are joined through
that node, and such links contract to nonbranching paths, in rounds of joins.

At last the words at each segment's source coordinates are looked up: a segment
counts as repeated if the words themselves are found there at least twice, by a
digest of 128 bits; hashes of windows only lead there.

Making a node of every (k-1)-mer of the corpus would move thirty bytes for each
word. So anchors, shorter k-mers of which every node holds one, are counted
first, and nodes are made only around anchors met twice: a node without one
can't repeat. Occurrences that a task holds more than once (same node, same
words before and after) travel once; the others follow as stretches that are
equal to a stretch of another document ("twins"), and get its segments later. So
a passage that a third of all documents share makes a row for each task and
word, not one for each document and word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parenlake.llm.common import Rolling, WordHashes, drop_stage, mix64, stage
from parenlake.llm.components import components
from parenlake.llm.repeats import MERGED, PLACE, opened, places, release, rows_of, suspects, without

#: Words of an anchor.
ANCHOR = 12
#: How a node ends a segment: not at all, as texts begin or end, as it branches.
INNER, BORDER, BRANCH = 0, 1, 2

NODES = "node long, before int, after int, loc long, copies int"


def met_nodes(node: np.ndarray, before: np.ndarray, after: np.ndarray, loc: np.ndarray) -> pa.RecordBatch:
    """Occurrences of a batch as NODES rows, merged.

    Equal occurrences become one row with their number; all but the first also
    give twins: rows with copies = -length and the first's loc as node."""
    key = mix64(node ^ mix64(before.astype(np.uint64) << np.uint64(32) | after.astype(np.uint64)))
    _, first, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    own, later = loc[first], np.flatnonzero(first[inverse] != np.arange(len(key)))
    there, here = loc[first[inverse[later]]], loc[later]
    fresh = np.concatenate([[True], (np.diff(here) != 1) | (np.diff(there) != 1)]) if len(later) else np.zeros(0, bool)
    begin = np.flatnonzero(fresh)
    zero = np.zeros(len(begin), np.int32)
    columns = (
        np.concatenate([node[first].view(np.int64), there[begin]]),
        np.concatenate([before[first].view(np.int32), zero]),
        np.concatenate([after[first].view(np.int32), zero]),
        np.concatenate([own, here[begin]]),
        np.concatenate([count, -np.diff([*begin, len(later)])]).astype(np.int32),
    )
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[part.split()[0] for part in NODES.split(", ")])


def occurrences(documents: DataFrame, k: int) -> DataFrame:
    """NODES rows of suspect documents around repeated anchors. ``before`` and
    ``after`` are hashes of the words next to the node, 0 where there is none."""
    reach = k - 1 - ANCHOR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, expand = WordHashes(), zstandard.ZstdDecompressor()
        held: list[tuple[np.ndarray, ...]] = []

        def merged() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            return met_nodes(*columns)

        for batch in batches:
            for packed, order, spots in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True):
                value = hashes.of(expand.decompress(packed).split())
                node = Rolling(value).windows(k - 1)
                near = np.zeros(len(node) + 1, np.int64)
                at = places(spots)
                np.add.at(near, np.clip(at - reach, 0, len(node)), 1)
                np.add.at(near, np.clip(at + 1, 0, len(node)), -1)
                start = np.flatnonzero(np.cumsum(near[:-1]) > 0)
                edge = np.zeros(len(value) + 2, np.uint32)
                edge[1:-1] = (value >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
                held.append((node[start], edge[start], edge[start + k], order << PLACE | start))
            if sum(len(x[0]) for x in held) >= MERGED:
                yield merged()
        if held:
            yield merged()

    return documents.filter("ord IS NOT NULL").select("packed", "ord", "spots").mapInArrow(run, NODES)


def graph(nodes: DataFrame) -> DataFrame:
    """loc, ends of the occurrences of nodes that a repeated edge leaves, and
    loc, len, twin of twins. Staged.

    ``ends`` tells INNER, BORDER and BRANCH apart, by the degrees that the node
    has in the graph of all edges."""
    real, at = F.col("copies") > 0, Window.partitionBy("node")
    one = lambda c, pick: pick(F.when(real & (F.col(c) != 0), F.col(c))).over(at)
    branch = (one("before", F.min) != one("before", F.max)) | (one("after", F.min) != one("after", F.max))
    border = F.max(real & ((F.col("before") == 0) | (F.col("after") == 0))).over(at)
    # One shuffle and one sort serve both windows.
    dealt = nodes.repartition("node").sortWithinPartitions("node", "after")
    met = dealt.withColumn("ends", F.when(F.coalesce(branch, F.lit(False)), BRANCH).when(border, BORDER).otherwise(INNER).cast("tinyint"))
    met = met.withColumn("_met", F.sum(F.when(real, F.col("copies")).otherwise(0)).over(Window.partitionBy("node", "after")))
    kept = met.filter(~real | ((F.col("after") != 0) & (F.col("_met") > 1)))
    return stage(kept.select("loc", "ends", F.when(~real, -F.col("copies")).alias("len"), F.when(~real, F.col("node")).alias("twin")), "graph")


def _chained(df: DataFrame, length: str) -> DataFrame:
    """ord, place, n, ends: neighbouring stretches (ord, place, ``length``, ends)
    joined unless the later one begins at a node that ends a segment."""
    along = Window.partitionBy("ord").orderBy("place")
    before = F.lag(F.col("place") + F.col(length)).over(along)
    head = df.withColumn("_head", F.when((before == F.col("place")) & (F.col("ends") == INNER), 0).otherwise(1))
    chain = head.withColumn("_chain", F.sum("_head").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return chain.groupBy("ord", "_chain").agg(F.min("place").alias("place"), F.sum(length).cast("int").alias("n"), F.min_by("ends", "place").alias("ends")).drop("_chain")


def segments(found: DataFrame) -> DataFrame:
    """ord, place, n, ends: every document's segments of n repeated edges, twins'
    included. Staged."""
    order = F.shiftright("loc", PLACE)
    place = F.col("loc").bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int")
    own = _chained(found.filter("twin IS NULL").select(order.alias("ord"), place.alias("place"), F.lit(1).alias("one"), "ends"), "one")
    own = stage(own, "chains")
    twins = found.filter("twin IS NOT NULL").select(
        order.alias("_ord"), place.alias("_place"), "len",
        F.shiftright("twin", PLACE).alias("_of"), F.col("twin").bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int").alias("_at"),
    )
    low, high = F.greatest("place", "_at"), F.least(F.col("place") + F.col("n"), F.col("_at") + F.col("len"))
    shared = own.join(twins, (F.col("ord") == F.col("_of")) & (low < high))
    # What begins inside a stretch of the other document goes on from before.
    ends = F.when(low == F.col("place"), F.col("ends")).otherwise(INNER).cast("tinyint")
    shared = shared.select(F.col("_ord").alias("ord"), (F.col("_place") + low - F.col("_at")).alias("place"), (high - low).alias("n"), ends.alias("ends"))
    out = stage(_chained(own.unionByName(shared), "n"), "segments")
    drop_stage(own)
    return out


def read_back(documents: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """ord, place, n, ends, digest, source, target of each segment: a digest of
    the words at its coordinates, and its first and last node. Staged."""
    names = ["ord", "place", "n", "ends", "digest", "source", "target"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, expand = WordHashes(), zstandard.ZstdDecompressor()
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                lists = batch.column(2)
                parts = lists.flatten()
                place, n = [parts.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1)]
                many = np.diff(lists.offsets.to_numpy())
                digests: list[bytes] = []
                source, target, at = [], [], 0
                for packed, m in zip(batch.column(1).to_pylist(), many.tolist(), strict=True):
                    words = expand.decompress(packed).split()
                    text = memoryview(b" ".join(words))
                    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                    node = Rolling(hashes.of(words)).windows(k - 1)
                    start, end = place[at : at + m], place[at : at + m] + n[at : at + m]
                    source.append(node[start])
                    target.append(node[end])
                    begins = np.where(start > 0, ends[start - 1], 0)
                    digests += [xxhash.xxh3_128_digest(text[a:b]) for a, b in zip(begins.tolist(), (ends[end + k - 2] - 1).tolist(), strict=True)]
                    at += m
                ord_ = np.repeat(batch.column(0).to_numpy(), many)
                flat = [pa.array(ord_), parts.field(0), parts.field(1), parts.field(2), pa.array(digests, pa.binary()), *[pa.array(np.concatenate(x).view(np.int64)) for x in (source, target)]]
                yield pa.RecordBatch.from_arrays(flat, names=names)

    lists = found.groupBy("ord").agg(F.collect_list(F.struct("place", "n", "ends")).alias("some")).withColumnRenamed("ord", "_ord")
    joined = documents.filter("ord IS NOT NULL").join(lists, F.col("ord") == F.col("_ord")).select("ord", "packed", "some")
    return stage(joined.mapInArrow(run, "ord long, place int, n int, ends tinyint, digest binary, source long, target long"), "verified")


def compacted(read: DataFrame) -> DataFrame:
    """digest, path of the segments whose words are met at least twice: the
    nonbranching path that each lies on, named by its least segment.

    Two segments are linked where one begins at the node at which the other ends
    and the node doesn't branch; links are contracted by joins, so paths of any
    length, and circles, take few rounds."""
    name = F.xxhash64("digest")
    met = read.groupBy("digest").agg(F.count(F.lit(1)).alias("c"), F.min("source").alias("source"), F.min("target").alias("target"), F.max("ends").alias("ends")).filter("c > 1")
    met = stage(met.withColumn("segment", name).drop("c"), "met")
    first = met.filter(F.col("ends") == BORDER).select(F.col("source").alias("_node"), F.col("segment").alias("b"))
    links = met.join(first, F.col("target") == F.col("_node")).select(F.col("segment").alias("a"), "b")
    joined = components(links).select(F.col("node").alias("_segment"), "component")
    return met.join(joined, F.col("segment") == F.col("_segment"), "left").select(F.col("digest").alias("_digest"), F.coalesce("component", "segment").alias("path"))


def covered(found: list[dict], k: int) -> list[tuple[int, int]]:
    """The stretches of words under a document's segments."""
    out: list[list[int]] = []
    for place, n in sorted((x["place"], x["n"]) for x in found):
        if out and place <= out[-1][1]:
            out[-1][1] = max(out[-1][1], place + n + k - 1)
        else:
            out.append([place, place + n + k - 1])
    return [(a, b) for a, b in out]


def dedupe(docs: DataFrame, k: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, n_paths of each document without
    the words that lie in a window of k words found anywhere else too, the same
    document included. n_paths counts the compacted paths these lie on.

    Windows are judged on the input. Null and empty texts have no words;
    texts of fewer than k words keep all; a repeated row repeats all its
    windows. Whole texts count; an empty table gives an empty result.
    """
    if k < ANCHOR + 2:
        raise ValueError(f"k must be {ANCHOR + 2} or more")
    spark = docs.sparkSession
    rows = rows_of(docs)
    known = suspects(rows, ANCHOR, k - ANCHOR)
    documents = opened(rows, known)
    release(spark)
    found = graph(occurrences(documents, k))
    release(spark)
    cut = segments(found)
    drop_stage(found)
    release(spark)
    read = read_back(documents, cut, k)
    drop_stage(cut)
    release(spark)
    again = read.join(compacted(read), F.col("digest") == F.col("_digest")).select("ord", "place", "n", "path")
    lists = again.groupBy("ord").agg(F.collect_list(F.struct("place", "n")).alias("runs"), F.size(F.collect_set("path")).alias("n_paths")).withColumnRenamed("ord", "_ord")
    runs = stage(lists.join(known.select("rid", "ord"), F.col("_ord") == F.col("ord")).select("rid", "runs", "n_paths"), "paths")
    drop_stage(read)
    release(spark)
    return without(documents, runs, lambda some: covered(some, k), also="n_paths")
