"""Substring deduplication with sparse suffix arrays.

Of all suffixes of the corpus, only those that start at content-selected
minimizer positions are retained: any ``least`` words hold one whose first
``HEAD`` words lie within. Two passages of ``least`` equal words therefore
retain equal suffixes. Suffixes equal in all the words around them that can
matter (by 128 bits of these) are copies, merged before anything is sorted. The
others are sorted, where their head stands in other surroundings too: by head
and what follows, and by head and what precedes. Neighbours in either order are
compared word by word, which gives how far each match extends to the right and
to the left; suffixes that share the first i words on one side are a stretch of
ranks that no shorter match of neighbours breaks. Two suffixes share a passage
of ``least`` words if they are in the same stretch of both orders, for as many
words as are due on either side. One order would not do: the suffix that shares
most after the head need not be the one that shares enough on both sides.

A suffix carries the words around its head as far as they can matter: with
``least - HEAD`` words on either side, every stretch of ``least`` words that
uses this suffix is decided; longer passages hold more retained suffixes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parenlake.llm.common import Rolling, WordHashes, drop_stage, mix64, stage
from parenlake.llm.repeats import AGAIN, MERGED, ONE, PLACE, met_again, opened, paths, places, release, rows_of, suspects, without

#: Words by which suffixes are matched before they are sorted and extended.
HEAD = 26
#: Stands for the location of a suffix whose copies are already marked.
NOWHERE = -1
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Turns the hashes of words into others, for a digest's second half.
_OTHER = np.uint64(0xD1B54A32D192ED03)
SUFFIX = "h long, g long, head long, loc long, len int, size int"
MET = "h long, g long, loc long, len int"
#: The two halves of a digest.
DIGEST = ["h", "g"]


def grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that agree in all keys: the first row of each group, the group of
    each row and how many rows each group has."""
    order = np.lexsort(keys[::-1])
    fresh = np.arange(len(order)) == 0
    for key in keys:
        sorted_ = key[order]
        fresh[1:] |= sorted_[1:] != sorted_[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    starts = np.flatnonzero(fresh)
    return order[starts], group, np.diff(np.append(starts, len(order)))


def suffixes(documents: DataFrame, least: int) -> DataFrame:
    """Retained suffixes of suspect documents: h and g are the digest of a
    suffix's head and all the words around it that can matter, size says how
    many words that is.

    A task gives suffixes it holds twice as stretches to mark (loc, len) and one
    ``AGAIN`` row for the rest of the corpus. ``loc`` is a head's place."""
    side = least - HEAD
    names = [part.split()[0] for part in SUFFIX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, expand = WordHashes(), zstandard.ZstdDecompressor()
        held: list[tuple[np.ndarray, ...]] = []

        def merged() -> pa.RecordBatch:
            h, g, head, loc, left, size = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            first, group, count = grouped(h, g)
            once, more = count[group] == 1, first[count > 1]
            again = ~once
            zero = np.zeros(int(again.sum()), np.int64)
            spread = mix64((loc[again] - left[again]).view(np.uint64))
            columns = (
                np.concatenate([h[once], spread, h[more]]).view(np.int64),
                np.concatenate([g[once].view(np.int64), zero, g[more].view(np.int64)]),
                np.concatenate([head[once].view(np.int64), zero, head[more].view(np.int64)]),
                np.concatenate([loc[once], loc[again] - left[again], loc[more]]),
                np.concatenate([np.full(int(once.sum()), ONE), size[again], np.full(len(more), AGAIN)]).astype(np.int32),
                np.concatenate([size[once], size[again], size[more]]).astype(np.int32),
            )
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

        for batch in batches:
            for packed, order, spots in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True):
                words = hashes.of(expand.decompress(packed).split())
                rolling, at = Rolling(words), places(spots)
                start, end = np.maximum(at - side, 0), np.minimum(at + least, rolling.n)
                around = [mix64(r.spans(start, end) + (at - start).astype(np.uint64) * _STEP) for r in (rolling, Rolling(mix64(words + _OTHER)))]
                held.append((*around, rolling.windows(HEAD)[at], order << PLACE | at, at - start, end - start))
            if sum(len(x[0]) for x in held) >= MERGED:
                yield merged()
        if held:
            yield merged()

    return documents.filter("ord IS NOT NULL").select("packed", "ord", "spots").mapInArrow(run, SUFFIX)


def with_contexts(documents: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """head, after, before, loc of the suffixes wanted(ord, some [(place, alone)]):
    the words after and before their heads, as 64 bits each. Those that are
    not alone are marked already, so they go without their place."""
    side = least - HEAD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, expand = WordHashes(), zstandard.ZstdDecompressor()
        for whole in batches:
            for first in range(0, whole.num_rows, 200):
                out: list[list] = [[], [], [], []]
                for packed, order, some in zip(*[whole.column(c).slice(first, 200).to_pylist() for c in range(3)], strict=True):
                    value = hashes.of(expand.decompress(packed).split())
                    heads = Rolling(value).windows(HEAD).view(np.int64)
                    word, back = value.astype(">u8").tobytes(), value[::-1].astype(">u8").tobytes()
                    n = len(value)
                    for x in some:
                        p = x["place"]
                        row = heads[p], word[8 * (p + HEAD) : 8 * (p + least)], back[8 * (n - p) : 8 * (n - p + side)], order << PLACE | p if x["alone"] else NOWHERE
                        for column, made in zip(out, row, strict=True):
                            column.append(made)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["head", "after", "before", "loc"])

    joined = documents.filter("ord IS NOT NULL").join(wanted.withColumnRenamed("ord", "_ord"), F.col("ord") == F.col("_ord"))
    return joined.select("packed", "ord", "some").mapInArrow(run, "head long, after binary, before binary, loc long")


def contexts(column: pa.Array, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of each context as a row of ``side`` numbers, and how many it has."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    known = np.diff(ends) // 8
    table = np.zeros((len(column), side), np.uint64)
    if known.any():
        table[np.arange(side) < known[:, None]] = np.frombuffer(column.buffers()[2], ">u8")[ends[0] // 8 : ends[-1] // 8]
    return table, known


class Side:
    """Suffixes in the order of their head and the words on one side of it, and
    how many of these each shares with its neighbour."""

    def __init__(self, head: np.ndarray, table: np.ndarray, known: np.ndarray) -> None:
        # A row cut short comes first among those that only its filling equals.
        self.order = np.lexsort([known, *table.T[::-1], head])
        head, table, known = head[self.order], table[self.order], known[self.order]
        #: Words shared with the row before; -1 if that has another head.
        self.shared = np.full(len(head), -1)
        at = np.flatnonzero(head[1:] == head[:-1])
        equal = table[at] == table[at + 1]
        length = np.where(equal.all(axis=1), table.shape[1], equal.argmin(axis=1))
        self.shared[at + 1] = np.minimum(length, np.minimum(known[at], known[at + 1]))

    def stretches(self, words: int) -> np.ndarray:
        """By row, which stretch of neighbours it lies in that share at least so
        many words (rows that have them)."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.shared < words)
        return out


class Digests:
    """Two hashes of a head with the first words on either side, for suffixes
    that must be told apart across blocks."""

    def __init__(self, head: np.ndarray, right: np.ndarray, left: np.ndarray) -> None:
        self.halves = [(mix64(head.view(np.uint64) + seed), self.prefixes(right, seed), self.prefixes(left, seed)) for seed in (np.uint64(0), _OTHER)]

    @staticmethod
    def prefixes(table: np.ndarray, seed: np.uint64) -> np.ndarray:
        """Hash of the first 0, 1, .. words of each row."""
        out = np.zeros((len(table), table.shape[1] + 1), np.uint64)
        for k in range(table.shape[1]):
            out[:, k + 1] = mix64(out[:, k] * _STEP + mix64(table[:, k] + seed) + np.uint64(1))
        return out

    def of(self, rows: np.ndarray, after: int, before: int) -> list[np.ndarray]:
        return [mix64(mix64(mix64(turned[rows] + np.uint64(after)) + right[rows, after]) * _STEP + left[rows, before]) for turned, right, left in self.halves]


def repeats(kept: DataFrame, parts: int, least: int, block: int = 50_000) -> DataFrame:
    """loc, len of every stretch of ``least`` words around a head that suffixes
    of that head share, wherever in the stretch it lies.

    Two suffixes share such a stretch if, for some i, they agree in the first i
    words after the head and in the first least - HEAD - i before, that is, if
    they lie in the same stretch of ranks on both sides (``Side``). Suffixes are
    range-partitioned by the whole sort key, so a head that a third of all
    documents share is spread over tasks. A head that lies within one block of
    a sorted task is decided there, for every i. Of the others, the first and the
    last of a block, one for each group goes on, and these meet by the digest of
    the words that they share."""
    side = least - HEAD
    names = [part.split()[0] for part in MET.split(", ")]

    def rows(h: np.ndarray, g: np.ndarray, loc: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array(loc), pa.array(length.astype(np.int32))], names=names)

    def decide(held: pa.Table) -> Iterator[pa.RecordBatch]:
        held = held.combine_chunks()
        head = held.column(0).to_numpy()
        edge = (head == head[0]) | (head == head[-1])
        same = np.concatenate([[False], head[1:] == head[:-1]])
        # A head met once within a block repeats nothing.
        some = np.flatnonzero(edge | same | np.concatenate([same[1:], [False]]))
        held, head, edge = held.take(pa.array(some)).combine_chunks(), head[some], edge[some]
        after, before = [held.column(k).combine_chunks() for k in (1, 2)]
        after, before = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (after, before)]
        loc = held.column(3).to_numpy()
        (right, most), (left, fewest) = contexts(after, side), contexts(before, side)
        onward, backward = Side(head, right, most), Side(head, left, fewest)
        digests, edges = Digests(head[edge], right[edge], left[edge]), np.cumsum(edge) - 1
        marked = np.zeros((len(head), side + 3), bool)
        for i in range(side + 1):
            has = np.flatnonzero((most >= i) & (fewest >= side - i))
            if not len(has):
                continue
            first, group, count = grouped(onward.stretches(i)[has], backward.stretches(side - i)[has])
            marked[has[count[group] > 1], i + 1] = True
            open_ = edge[has[first]]
            if open_.any():
                one, again = has[first[open_]], count[open_] > 1
                known = np.where(again | (loc[one] == NOWHERE), NOWHERE, loc[one] - (side - i))
                yield rows(*digests.of(edges[one], i, side - i), known, np.where(again, AGAIN, ONE))
        marked[loc == NOWHERE] = False
        change = np.diff(marked.astype(np.int8), axis=1)
        (who, start), (_, end) = np.nonzero(change == 1), np.nonzero(change == -1)
        none = np.zeros(len(who), np.uint64)
        yield rows(none, none, loc[who] - side + start, least - 1 + end - start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) >= block:
                yield from decide(pa.Table.from_batches(held))
                held = []
        if held:
            yield from decide(pa.Table.from_batches(held))

    order = ["head", "after", "before", "loc"]
    sorted_ = kept.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    made = stage(sorted_.mapInArrow(run, MET), "matches")
    met = met_again(made.filter("len <= 0"), *DIGEST).filter(F.col("loc") != NOWHERE).select("loc", F.lit(least).cast("int").alias("len"))
    return made.filter("len > 0").select("loc", "len").unionByName(met)


def passages(docs: DataFrame, least: int = 50) -> tuple[DataFrame, DataFrame]:
    """``opened`` documents, and rid, runs [(place, len)] of those with a
    repeated passage."""
    if least < HEAD + 2:
        raise ValueError(f"least must be {HEAD + 2} or more")
    spark = docs.sparkSession
    rows = rows_of(docs)
    known = suspects(rows, HEAD, least - HEAD + 1)
    documents = opened(rows, known)
    release(spark)

    # Suffixes met again with all that surrounds them need no comparison.
    weight = F.when(F.col("len") == AGAIN, 2).when(F.col("len") == ONE, 1).otherwise(0)
    same = Window.partitionBy(*DIGEST)
    met = suffixes(documents, least).withColumn("c", F.sum(weight).over(same)).withColumn("first", F.row_number().over(same.orderBy("len", "loc")) == 1)
    met = stage(met.drop(*DIGEST), "suffixes")
    release(spark)
    place = F.col("loc").bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int")
    left = F.least(place, F.lit(least - HEAD))
    full = met.filter("len > 0").select("loc", "len").unionByName(met.filter((F.col("len") == ONE) & (F.col("c") > 1)).select((F.col("loc") - left).alias("loc"), F.col("size").alias("len")))

    # The others are compared where their head stands in other surroundings too.
    distinct = met.filter(F.col("first") & (F.col("len") <= 0))
    open_ = distinct.groupBy("head").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select(F.col("head").alias("_head"))
    wanted = distinct.join(open_, F.col("head") == F.col("_head")).select(F.shiftright("loc", PLACE).alias("ord"), place.alias("place"), (F.col("c") == 1).alias("alone"))
    kept = stage(with_contexts(documents, wanted.groupBy("ord").agg(F.collect_list(F.struct("place", "alone")).alias("some")), least), "contexts")
    release(spark)
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(kept.count() / 50_000))
    partial = stage(repeats(kept, parts, least), "partial")
    drop_stage(kept)
    release(spark)
    runs = paths(full.unionByName(partial), known, "passages")
    for done in (met, partial):
        drop_stage(done)
    release(spark)
    return documents, runs


def dedupe(docs: DataFrame, least: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans of each document.

    ``spans`` lists the repeated passages of at least ``least`` words as
    start:end in words, joined by commas; n_removed counts their words and
    kept_sha256 is the hash of all others, joined by one space. Null and empty
    texts have no words; shorter texts keep all; a repeated row repeats all its
    passages; an empty table gives an empty result. Whole texts count.
    """
    documents, runs = passages(docs, least)
    return without(documents, runs, lambda found: sorted((x["place"], x["place"] + x["len"]) for x in found), "spans")
