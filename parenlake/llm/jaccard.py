"""N-gram Jaccard join by universe partition and the pigeonhole principle.

After "An efficient partition based method for exact set similarity joins"
(Deng, Li, Wen, Feng, VLDB 2016). Sets of word shingles are grouped in size
bands. A band's larger members bound the symmetric difference H of linked
pairs. Shingles are hashed into m segments; segment i tolerates a_i in {0, 1}
differences and weighs a_i + 1. If the weights sum to more than H, a linked
pair agrees, up to a_i, in some segment. Equal subsets share a key; subsets one
element apart share one through the one-deletion neighbourhood. How many
segments tolerate a difference is chosen for each band by its estimated cost.

Two refinements keep frequent keys from pairing everything, without losing a
link. Weights sum to H + 1 + e, so satisfied segments weigh e + 1 or more. A
set leaves out empty segments without tolerance if they weigh e0 or less (what
one set of a linked pair leaves out is equal in both, so it weighs too little to
hide all satisfied segments). And each set leaves out its most frequent keys, up
to a weight of e1 = e - e0: of more than e1 keys that two sets share, the least
frequent has at least e1 more frequent ones in either set, so both keep it.

Copies are one class and stand in once. Of the sets that share a key, all are
first verified against one of them and against one drawn at random; after that
only pairs in different components are, unless parity sketches show that they
differ too much (a sketch bit is the parity of the shingles hashed to it, so
sets differ in at least as many shingles as their sketches in bits). Sets of
more shingles than a sketch has bits get a second one as wide as they need.
Verification counts the intersections of whole texts, shingles taken as hashes
of 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parenlake.llm.common import WORD, WordHashes, aside, bounded, drop_stage, mix64, positions, raw_bytes, release, stage, text_of
from parenlake.llm.components import components

#: Stands for a null doc_id.
NO_ID = -(1 << 63)
#: Longs of 64 bits in a parity sketch.
SKETCH = 16


@dataclass(frozen=True)
class Band:
    """Sizes low..high of the larger set, and how such pairs are signed."""

    low: int
    high: int
    exact: int  # segments without tolerance
    loose: int  # segments that tolerate one difference
    empty_slack: int
    frequent_slack: int

    @property
    def segments(self) -> int:
        return self.exact + self.loose


@dataclass(frozen=True)
class Measure:
    """Shingles of ``words`` words; linked at ``part`` / ``whole`` and above."""

    words: int = 5
    part: int = 80
    whole: int = 100


def allocate(low: int, high: int, part: int, whole: int) -> Band | None:
    """The cheapest segments for a band; None if only equal sets link."""
    most = 2 * high * (whole - part) // (whole + part)
    if most == 0:
        return None
    best: tuple[float, Band] | None = None
    frequent = most // 8
    for loose in range((most + frequent) // 2 + 2):
        for empty in (0, max(4, most // 10)):
            exact = max(0, most + 1 + frequent + empty - 2 * loose)
            if exact + loose == 0:
                continue
            share = low / (exact + loose)
            if empty == 0 and share < 10 and exact + loose > 2:
                continue
            # Keys to write, and sets that meet by chance in thin segments.
            cost = exact + loose * (1 + high / (exact + loose)) + 20 * (exact + loose) * math.exp(-share) * (1 + share)
            if best is None or cost < best[0]:
                best = cost, Band(low, high, exact, loose, empty, frequent)
        if most > 64:
            break  # long sets: tolerance only adds keys
    return best[1]


@lru_cache(maxsize=8)
def bands(part: int, whole: int, largest: int = 1 << 31) -> tuple[Band | None, ...]:
    """Bands of sizes from 1 up; each is the square of the threshold wide."""
    out, low = [], 1
    while low <= largest:
        high = max(low, low * whole * whole // (part * part))
        out.append(allocate(low, high, part, whole))
        low = high + 1
    return tuple(out)


@lru_cache(maxsize=8)
def _starts(part: int, whole: int) -> np.ndarray:
    lows, low = [], 1
    for _ in bands(part, whole):
        lows.append(low)
        low = max(low, low * whole * whole // (part * part)) + 1
    return np.array(lows, np.int64)


def schemes(n: int, measure: Measure) -> list[int]:
    """Bands in which a set of n shingles meets partners: its own, for those
    not larger, and the next ones as far as larger partners can lie."""
    starts = _starts(measure.part, measure.whole)
    own = int(np.searchsorted(starts, n, side="right")) - 1
    last = int(np.searchsorted(starts, n * measure.whole // measure.part, side="right")) - 1
    return [b for b in range(own, last + 1) if bands(measure.part, measure.whole)[b]]


_SALT = np.uint64(0xD6E8FEB86659FD93)


def shingles(text: bytes, words: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text: A-Z lower-cased; the
    whole sequence where there are fewer words; none without words."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    hashes = known.of(found)
    width = min(words, len(hashes))
    m = len(hashes) - width + 1
    out = mix64(hashes[:m] + np.uint64(width))
    for k in range(1, width):
        out = mix64(out * _SALT + hashes[k : k + m])
    return np.unique(out)


def set_ids(sets: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    a = int(mix64(sets).sum(dtype=np.uint64)) if len(sets) else 0
    b = int(mix64(sets ^ _SALT).sum(dtype=np.uint64)) if len(sets) else 0
    return signed(a), signed(b)


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def keys_of(sets: np.ndarray, measure: Measure) -> np.ndarray:
    """Keys under which a set meets all it may link with."""
    out = []
    for b in schemes(len(sets), measure) if len(sets) else ():
        band = bands(measure.part, measure.whole)[b]
        m = band.segments
        spread = mix64(sets ^ np.uint64((b + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        segment = (spread % np.uint64(m)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        segment, value = segment[order], mix64(spread[order])
        first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        total, there = np.add.reduceat(value, first), segment[first]
        base = mix64(np.arange(m, dtype=np.uint64) + np.uint64(b << 32))
        made = [mix64(total ^ base[there])]
        loose = segment < band.loose
        if loose.any():
            size = np.diff([*first, len(segment)])
            made.append(mix64((np.repeat(total, size) - value)[loose] ^ base[segment[loose]]))
        empty = np.setdiff1d(np.arange(m), there, assume_unique=True)
        bare = empty[empty >= band.loose]
        made.append(mix64(base[empty if len(bare) > band.empty_slack else empty[empty < band.loose]]))
        out.extend(made)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def frequent_slack(n: int, measure: Measure) -> int:
    """Frequent keys a set may leave out: all its schemes taken together, each
    key at its segment's weight."""
    some = [bands(measure.part, measure.whole)[b] for b in schemes(n, measure)]
    return min((b.frequent_slack // (2 if b.loose else 1) for b in some), default=0)


def parities(sets: np.ndarray, bits: int) -> np.ndarray:
    """Parity sketch of a set, as bytes."""
    odd = np.bincount((sets & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8))


def wide_sketch(sets: np.ndarray) -> bytes | None:
    """For a set too large for the common sketch: a bit or two a shingle."""
    return parities(sets, 1 << (len(sets) - 1).bit_length()).tobytes() if len(sets) > 64 * SKETCH else None


def unlike(a: bytes, b: bytes) -> int:
    """In how many bits wide sketches differ; the wider is folded first."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


_WORDS = [f"s{k}" for k in range(SKETCH)]


def digest(docs: DataFrame, measure: Measure) -> DataFrame:
    """id, crc, n, h1, h2, s0.., wide, keys of each document: its id, text hash,
    set size, set name, sketches and keys. A task gives a set's keys once,
    however many copies it reads; at other copies they are null."""
    names = ["id", "crc", "n", "h1", "h2", *_WORDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, done = WordHashes(), set()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows, wide, keys, ends = [], [], [np.zeros(0, np.uint64)], [0]
                fresh = []
                for text in raw_bytes(batch.column(2)):
                    sets = shingles(text, measure.words, known)
                    name = set_ids(sets)
                    rows.append((len(sets), *name, *parities(sets, 64 * SKETCH).view(np.int64).tolist()))
                    wide.append(wide_sketch(sets))
                    fresh.append(name not in done)
                    if fresh[-1]:
                        if len(done) < 1_000_000:
                            done.add(name)
                        keys.append(keys_of(sets, measure))
                    ends.append(ends[-1] + (len(keys[-1]) if fresh[-1] else 0))
                flat = pa.array(np.concatenate(keys).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=pa.array([not x for x in fresh]))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array([r[k] for r in rows], pa.int64()) for k in range(3 + SKETCH)], pa.array(wide, pa.binary()), lists], names=[*names, "wide", "keys"])

    return bounded(docs).mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", wide binary, keys array<long>")


def screened(pairs: DataFrame, wide: DataFrame, measure: Measure) -> DataFrame:
    """Of pairs(a, b), those that wide(node, n, wide) leaves room for. Pairs with
    a member that has no wide sketch stay."""
    one, two = (wide.select(F.col("node").alias(f"_{m}"), F.col("n").alias(f"n{m}"), F.col("wide").alias(f"w{m}")) for m in "ab")
    both = pairs.join(two, F.col("b") == F.col("_b"), "left").drop("_b").join(one, F.col("a") == F.col("_a"), "left").select("a", "b", "na", "nb", "wa", "wb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [wa is None or wb is None or (measure.whole + measure.part) * unlike(wa, wb) <= (measure.whole - measure.part) * (na + nb) for na, nb, wa, wb in zip(*[batch.column(k).to_pylist() for k in range(2, 6)], strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return stage(both.mapInArrow(run, "a long, b long"), "screened")


def verify(pairs: DataFrame, wide: DataFrame, texts: DataFrame, measure: Measure) -> DataFrame:
    """Of pairs(a, b) of classes, those that link; wide(node, n, wide) and
    texts(node, packed)."""
    pairs = screened(pairs, wide, measure)
    left = pairs.join(texts.select(F.col("node").alias("_b"), F.col("packed").alias("pb")), F.col("b") == F.col("_b")).drop("_b")
    both = left.join(texts.select(F.col("node").alias("_a"), F.col("packed").alias("pa")), F.col("a") == F.col("_a")).select("a", "b", "pa", "pb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, expand = WordHashes(), zstandard.ZstdDecompressor()
        held: dict[int, np.ndarray] = {}

        def of(node: int, packed: bytes) -> np.ndarray:
            if node not in held:
                if len(held) >= 64:
                    held.clear()
                held[node] = shingles(expand.decompress(packed), measure.words, known)
            return held[node]

        for batch in batches:
            linked = []
            for a, b, packed_a, packed_b in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                one, other = of(a, packed_a), shingles(expand.decompress(packed_b), measure.words, known)
                common = len(np.intersect1d(one, other, assume_unique=True))
                if measure.whole * common >= measure.part * (len(one) + len(other) - common):
                    linked.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in linked], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def class_texts(read: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, packed: one compressed text of each class in ``nodes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([squeeze.compress(t) for t in raw_bytes(batch.column(2))], pa.binary())], names=["id", "crc", "packed"])

    packed = read.mapInArrow(run, "id long, crc long, packed binary")
    wanted = classes.join(nodes, "node", "left_semi").select(F.col("rep.id").alias("_id"), F.col("rep.crc").alias("_crc"), "node")
    return packed.join(wanted, (F.col("id") == F.col("_id")) & (F.col("crc") == F.col("_crc"))).groupBy("node").agg(F.min("packed").alias("packed"))


def candidates(signed: DataFrame, classes: DataFrame, measure: Measure) -> DataFrame:
    """key, node, n, hub, hub_n: classes that share a key, with its least one."""
    by_key, whole = Window.partitionBy("key").orderBy("h1"), Window.partitionBy("key")
    met = signed.filter("keys IS NOT NULL").select(F.explode("keys").alias("key"), "h1").withColumn("_twin", F.coalesce(F.lag("h1").over(by_key) == F.col("h1"), F.lit(False)))
    met = met.withColumn("c", F.sum(F.when(F.col("_twin"), 0).otherwise(1)).over(whole)).filter("c > 1 AND NOT _twin").select("key", "h1", "c")
    met = stage(met, "met")
    drop_stage(signed)
    release(signed.sparkSession)

    # Of its keys that others share, each set leaves out the most frequent.
    named = classes.select(F.col("h1").alias("_h"), "node", "n")
    table = F.array(*[F.lit(frequent_slack(n, measure)) for n in range(1, 4096)])
    longer = F.floor(F.col("n") * (measure.whole - measure.part) / (4.0 * (measure.whole + measure.part))) - 2
    allowed = F.when(F.col("n") < 4096, F.get(table, (F.col("n") - 1).cast("int")).cast("long")).otherwise(longer)
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.col("c").desc(), "key"))
    kept = met.join(named, F.col("h1") == F.col("_h")).withColumn("_rank", rank).filter(F.col("_rank") > allowed).select("key", "node", "n")
    kept = stage(kept, "kept")
    drop_stage(met)
    least = kept.groupBy("key").agg(F.min(F.struct("node", "n")).alias("_hub"), F.max("node").alias("_top")).filter("_hub.node != _top")
    least = least.select(F.col("key").alias("_k"), F.col("_hub.node").alias("hub"), F.col("_hub.n").alias("hub_n"))
    out = stage(kept.join(least, F.col("key") == F.col("_k")).select("key", "node", "n", "hub", "hub_n"), "candidates")
    drop_stage(kept)
    release(signed.sparkSession)
    return out


def link(docs: DataFrame, measure: Measure = Measure(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of each document.

    component_id is the smallest doc_id reachable by links, the document itself
    included. Null and empty texts, and texts without words, have no shingles
    and link with nothing. Rows with equal shingles share a class; rows may
    repeat an id with other texts; a null doc_id counts as the smallest and is
    given back as null. Whole texts count; an empty table gives an empty
    result.
    """
    back = lambda c: F.when(c != NO_ID, c)
    done = grouped(docs, measure, doc_id, text)
    return done.select(back(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), back(F.coalesce("first.id", "id")).alias("component_id"))


def keep_one(docs: DataFrame, measure: Measure = Measure(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group of linked
    documents, the one with the smallest id stays (of equal ids, one text).
    Documents without words all stay."""
    done = stage(grouped(docs, measure, doc_id, text), "groups")
    gone = done.filter(F.col("first").isNotNull() & (F.struct("id", "crc") != F.col("first"))).select(F.col("id").alias("_id"), F.col("crc").alias("_crc")).distinct()
    rows, back = aside(docs, doc_id, text)
    keyed = rows.withColumn("_key", F.struct(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text_of(text)).alias("crc")))
    kept = keyed.join(gone, (F.col("_key.id") == F.col("_id")) & (F.col("_key.crc") == F.col("_crc")), "left_anti")
    twice = done.filter("n > 0").groupBy("id", "crc").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    if not twice.isEmpty():  # some row is there twice
        worded = text_of(text).rlike(WORD)
        kept = kept.filter(worded).dropDuplicates(["_key"]).unionByName(kept.filter(~worded))
    return kept.select(*back)


def _near(measure: Measure) -> Column:
    """Whether sketches s0.. and _s0.. of sets of n and _n shingles leave room
    for a link."""
    bits = reduce(lambda x, y: x + y, [F.bit_count(F.col(w).bitwiseXOR(F.col(f"_{w}"))) for w in _WORDS])
    return (measure.whole + measure.part) * bits <= (measure.whole - measure.part) * (F.col("n") + F.col("_n"))


def _open(found: DataFrame, parts: DataFrame, classes: DataFrame, sketches: DataFrame) -> DataFrame:
    """key, node, n, part, c and sketch of the members of keys whose c members lie
    in different components. Staged."""
    labelled = found.join(parts.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("key", "node", F.coalesce("component", "node").alias("part"))
    mixed = labelled.groupBy("key").agg(F.min("part").alias("_low"), F.max("part").alias("_high"), F.count(F.lit(1)).alias("c")).filter("_low != _high").select(F.col("key").alias("_k"), "c")
    named = classes.join(sketches, ["h1", "h2", "n"]).select(F.col("node").alias("_node"), "n", *_WORDS)
    return stage(labelled.join(mixed, F.col("key") == F.col("_k")).drop("_k").join(named, F.col("node") == F.col("_node")).drop("_node"), "open")


#: Members of a key that are compared with each other in one piece of work.
BLOCK = 2048
#: Bytes of the sketches by which long sets are compared within a key.
MIDDLE = 512
#: Pairs of members that are made at a time, and bytes of sketches fetched for them.
PAIRS, GATHERED = 1 << 17, 1 << 21


def folded(wide: DataFrame) -> DataFrame:
    """node, middle: wide sketches folded to MIDDLE bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for bits in batch.column(1).to_pylist():
                x = np.frombuffer(bits, np.uint8)
                while len(x) > MIDDLE:
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["_m", "middle"])

    # Narrower sketches can't be told from folded ones by width; those stay out.
    return wide.filter(F.octet_length("wide") >= MIDDLE).select("node", "wide").mapInArrow(run, "_m long, middle binary")


def close_members(held: pa.Table, measure: Measure) -> Iterator[pa.RecordBatch]:
    """a, b: of the members that lie together in ``held``, by key and blocks,
    those that ``close_pairs`` gives. Pairs are made PAIRS at a time and their
    sketches fetched GATHERED bytes at a time, so few megabytes are in use."""
    held = held.combine_chunks()
    key, low, high, own, node, n, part = [held.column(k).to_numpy() for k in range(7)]
    narrow = held.column(7).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), SKETCH)
    there = held.column(8).is_valid().to_numpy()
    middle = np.zeros((len(node), MIDDLE // 8), np.uint64)
    if there.any():
        middle[there] = np.frombuffer(b"".join(held.column(8).drop_null().to_pylist()), np.uint64).reshape(-1, MIDDLE // 8)
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
    ends = np.append(np.flatnonzero(fresh)[1:], len(node))[np.cumsum(fresh) - 1]
    later = ends - np.arange(len(node)) - 1
    done = np.cumsum(later)
    start = 0
    while start < len(node):
        # As many rows as give about PAIRS pairs.
        stop = max(start + 1, int(np.searchsorted(done, (done[start - 1] if start else 0) + PAIRS, side="right")))
        many = later[start:stop]
        x = np.repeat(np.arange(start, stop), many)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many)
        start = stop
        fit = (part[x] != part[y]) & ((low[x] == high[x]) | (own[x] != own[y])) & (measure.whole * np.minimum(n[x], n[y]) >= measure.part * np.maximum(n[x], n[y]))
        x, y = x[fit], y[fit]
        for table, some in ((narrow, None), (middle, there)):
            keep = np.ones(len(x), bool)
            both = np.arange(len(x)) if some is None else np.flatnonzero(some[x] & some[y])
            step = GATHERED // (8 * table.shape[1])
            for at in range(0, len(both), step):
                i = both[at : at + step]
                bits = np.bitwise_count(table[x[i]] ^ table[y[i]]).sum(axis=1, dtype=np.int64)
                keep[i] = (measure.whole + measure.part) * bits <= (measure.whole - measure.part) * (n[x[i]] + n[y[i]])
            x, y = x[keep], y[keep]
        if len(x):
            found = np.unique(np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["a", "b"])


def close_pairs(open_: DataFrame, wide: DataFrame, measure: Measure) -> DataFrame:
    """a, b: members of a key in different components whose sizes and sketches
    leave room for a link. Pairs that don't never become rows.

    A key of many members is cut into blocks, and every two of its blocks meet
    in a group of their own, so no task holds more than two blocks at a time."""
    cut = open_.withColumn("_g", F.ceil(F.col("c") / BLOCK)).withColumn("own", F.pmod(F.xxhash64("node"), F.col("_g")).cast("int"))
    cut = cut.join(folded(wide), F.col("node") == F.col("_m"), "left").withColumn("_other", F.explode(F.sequence(F.lit(0), (F.col("_g") - 1).cast("int"))))
    group = ["key", "low", "high"]
    rows = cut.select("key", F.least("own", "_other").alias("low"), F.greatest("own", "_other").alias("high"), "own", "node", "n", "part", F.array(*_WORDS).alias("sketch"), "middle")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch.column(k)[batch.num_rows - 1] for k in range(3)]
            same = np.logical_and.reduce([batch.column(k).to_numpy() == last[k].as_py() for k in range(3)])
            first = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if first:
                yield from close_members(pa.Table.from_batches([*rest, batch.slice(0, first)]), measure)
                rest = [batch.slice(first)]
            else:
                if rest and [rest[-1].column(k)[0].as_py() for k in range(3)] != [x.as_py() for x in last]:
                    yield from close_members(pa.Table.from_batches(rest), measure)
                    rest = []
                rest.append(batch)
        if rest:
            yield from close_members(pa.Table.from_batches(rest), measure)

    dealt = rows.repartition(*group).sortWithinPartitions(*group)
    return dealt.mapInArrow(run, "a long, b long").distinct()


def grouped(docs: DataFrame, measure: Measure, doc_id: str, text: str) -> DataFrame:
    """id, crc, n, first of each document: ``first`` is the (id, crc) of the
    least member of its group, null without shingles."""
    content = text_of(text)
    read = bounded(docs).select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(content).alias("crc"), content.alias("text"))
    spark = docs.sparkSession
    signed = stage(digest(read, measure), "signed")
    digests = stage(signed.select("id", "crc", "n", "h1", "h2"), "digests")
    sets = stage(signed.filter("n > 0").groupBy("h1", "h2", "n").agg(F.min(F.struct("id", "crc")).alias("rep"), *[F.min(w).alias(w) for w in (*_WORDS, "wide")]), "sets")
    sketches = sets.select("h1", "h2", "n", *_WORDS, "wide")
    classes = stage(positions(sets.drop(*_WORDS, "wide"), [], ["h1", "h2", "n"], out="node"), "classes")
    release(spark)
    found = candidates(signed, classes, measure)
    fits = lambda x, y: measure.whole * F.least(x, y) >= measure.part * F.greatest(x, y)

    star = found.filter((F.col("node") != F.col("hub")) & fits(F.col("n"), F.col("hub_n")))
    bits_of = classes.join(sketches, ["h1", "h2", "n"]).select("node", "n", *_WORDS)
    one, two = (bits_of.select(*[F.col(c).alias(f"{mark}{c}") for c in bits_of.columns]) for mark in ("", "_"))
    star = star.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    star = star.join(one, F.col("a") == F.col("node")).join(two, F.col("b") == F.col("_node"))
    star = stage(star.filter(_near(measure)).select("a", "b"), "pairs")
    texts = stage(class_texts(read, classes, found.select("node").distinct()), "texts")
    wide = stage(classes.join(sketches.filter("wide IS NOT NULL"), ["h1", "h2", "n"]).select("node", "n", "wide"), "wide")
    links = stage(verify(star, wide, texts, measure), "links")
    release(spark)

    # What lies in different components of a key is compared with a member of
    # the key drawn at random, for each key another one; the rest in full.
    tried, parts = star, components(links)
    for draw in (True, False):
        open_ = _open(found, parts, classes, sketches)
        if draw:
            other = open_.groupBy("key").agg(F.min_by(F.struct("node", "n", "part", *_WORDS), F.xxhash64("node", "key")).alias("o")).select("key", "o.*")
            other = other.select(*[F.col(c).alias(f"_{c}") for c in ("key", "node", "n", "part", *_WORDS)])
            met = open_.join(other, (F.col("key") == F.col("_key")) & (F.col("node") != F.col("_node")) & (F.col("part") != F.col("_part")) & fits(F.col("n"), F.col("_n")) & _near(measure))
            pairs = met.select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")).distinct()
        else:
            pairs = close_pairs(open_, wide, measure)
        pairs = stage(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        links = links.unionByName(stage(verify(pairs, wide, texts, measure), "links"))
        tried = tried.unionByName(pairs)
        drop_stage(open_)
        release(spark)
        if draw:
            parts = components(links)
    parts = components(links).withColumnRenamed("node", "_n")
    for done in (found, texts, wide):
        drop_stage(done)
    release(spark)

    owned = classes.join(parts, F.col("node") == F.col("_n"), "left").withColumn("_part", F.coalesce("component", "node"))
    least = owned.groupBy("_part").agg(F.min("rep").alias("first")).withColumnRenamed("_part", "_p")
    own = owned.join(least, F.col("_part") == F.col("_p")).select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("n").alias("_n"), "first")
    done = digests.join(own, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & (F.col("n") == F.col("_n")), "left")
    return done.select("id", "crc", "n", "first")
