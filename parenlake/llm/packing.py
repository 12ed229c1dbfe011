"""Harmonic packing of documents into fixed-length training sequences.

Piece lengths fall into reciprocal-capacity classes: class k holds lengths in
(C / (k + 1), C / k], and each of its bins takes exactly k pieces, whichever
they are. Knowing only how many pieces of a class come before its own, a worker
fills bins without seeing any other's.

Documents may be cut, so lengths are brought close to C / k first: whole
sequences are cut off, then the rest is kept if a bin of its class would waste
no more than ``slack`` tokens, or else cut at the next smaller reciprocal.
There are at most 2 sqrt(C) classes, so at most C H(sqrt(C)) pieces (fewer than
8 C) remain over all classes; those alone are packed by first-fit decreasing.
"""

from __future__ import annotations

import json
import os
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parenlake.llm.common import bounded, positions, stage, text_of

PIECE = "doc_id long, text_hash long, start long, length long, ids_crc32 long, doc_tokens long, class int"


@lru_cache(maxsize=8)
def cuts(capacity: int, slack: int) -> tuple[tuple[int, ...], ...]:
    """For every length below the capacity, the lengths it is cut into."""

    def waste(length: int) -> int:
        return capacity - capacity // length * length

    table: list[tuple[int, ...]] = [()]
    for length in range(1, capacity):
        k = capacity // length
        piece = capacity // (k + 1)
        if waste(length) <= slack or piece < 1:
            table.append((length,))
        else:
            table.append((piece, *table[length - piece]))
    return tuple(table)


#: Fixed value: how the byte-level tokenizers split a text, as published.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def ranked_encoder(path: str):
    """The same tokenizer as a rank table, which is several times faster on
    short stretches. Only for byte-level BPE whose ids follow the order of its
    merges, so that ids are ranks; None for any other."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, before = told.get("model", {}), told.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or told.get("normalizer"):
        return None
    vocabulary = model["vocab"]
    merged = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    if None in merged or merged != sorted(merged) or sys.byteorder != "little":
        return None
    # Byte-level vocabularies write bytes that don't print as later characters.
    shown = [b for b in range(256) if chr(b).isprintable() and b != 32 and b != 173]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    special = {x["content"] for x in told.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): k for token, k in vocabulary.items() if token not in special}
    return tiktoken.Encoding("ranked", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


class SegmentTokens:
    """Token ids of texts as little-endian unsigned 32-bit integers.

    The tokenizer splits a text in front of a space that follows a non-space
    character; so, unless two white-space characters touch, the stretches
    between single spaces can be tokenized alone, and frequent ones remembered.
    Other texts go through the tokenizer whole.
    """

    LIMIT = 800_000

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.ranked = ranked_encoder(path)
        self.known: dict[str, bytes] = {}
        self.touching = re.compile(r"\s\s")

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.ranked:
            found = map(self.ranked.encode_ordinary, texts)
        else:
            found = (x.ids for x in self.tokenizer.encode_batch(texts, add_special_tokens=False))
        return [array("I", x).tobytes() for x in found]

    def of(self, texts: list[str]) -> list[bytes]:
        split: list[list[str] | None] = []
        whole: list[str] = []
        for text in texts:
            if self.touching.search(text) or text[:1].isspace() or text[-1:].isspace():
                split.append(None)
                whole.append(text)
            else:
                head, *rest = text.split(" ")
                split.append([head, *[" " + x for x in rest]])
        if len(self.known) > self.LIMIT:
            self.known.clear()
        missing = list(set().union(*[x for x in split if x]) - self.known.keys())
        self.known.update(zip(missing, self.encode(missing), strict=True))
        others = iter(self.encode(whole) if whole else [])
        get = self.known.__getitem__
        return [next(others) if x is None else b"".join(map(get, x)) for x in split]


_tokens: dict[str, SegmentTokens] = {}


def tokens_of(path: str) -> SegmentTokens:
    """One tokenizer for each worker process, whatever the number of tasks."""
    if path not in _tokens:
        _tokens[path] = SegmentTokens(path)
    return _tokens[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, slack: int = 16) -> DataFrame:
    """Tokenize whole documents and cut them; a row for each piece."""
    plan = cuts(capacity, slack)
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"), F.xxhash64(text_of("text")).alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                out: list[list] = [[] for _ in range(7)]
                ids = tokens.of(batch.column(1).to_pylist())
                for doc, digest, found in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), ids, strict=True):
                    found += b"\0\0\0\0"
                    total = len(found) // 4
                    start = 0
                    for length in (capacity,) * (total // capacity) + plan[total % capacity]:
                        crc = zlib.crc32(found[4 * start : 4 * (start + length)])
                        for column, value in zip(out, (doc, digest, start, length, crc, total, capacity // length), strict=True):
                            column.append(value)
                        start += length
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 6 else pa.int64()) for k, c in enumerate(out)], names=[x.split()[0] for x in PIECE.split(", ")])

    return rows.mapInArrow(run, PIECE)


def fit_rest(capacity: int):
    """First-fit decreasing over the few pieces left, for applyInPandas."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "text_hash", "start", "nth"], ascending=[False, True, True, True, True], na_position="first")
        free: list[int] = []
        bins, offsets = [], []
        for length in rows["length"]:
            k = next((k for k, room in enumerate(free) if room >= length), len(free))
            if k == len(free):
                free.append(capacity)
            bins.append(k)
            offsets.append(capacity - free[k])
            free[k] -= length
        return rows.assign(bin=bins, offset=offsets)

    return fit


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, slack: int = 16) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, text_hash, class.

    Null and empty texts are one token (the final id 0). Repeated rows are
    packed once for each row. Null ids sort first. An empty table gives an
    empty result. Only digests of pieces are shuffled, never texts or ids.
    """
    spark = docs.sparkSession
    cut = stage(pieces(docs, tokenizer, capacity, slack), "pieces")
    # At most 2 sqrt(capacity) rows.
    counts = {r["class"]: r["n"] for r in cut.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    full, base, first = {}, {}, 0
    for k in sorted(counts):
        full[k], base[k] = counts[k] // k, first
        first += full[k]
    table = spark.createDataFrame([(k, full[k], base[k]) for k in sorted(counts)], "k int, full long, base long")
    nth = positions(cut, ["class"], ["doc_id", "text_hash", "start"], out="nth")
    placed = nth.join(F.broadcast(table), nth["class"] == table["k"]).withColumn("bin", F.floor(F.col("nth") / F.col("k")))
    inside = Window.partitionBy("class", "bin").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "text_hash", "class"]
    filled = placed.filter("bin < full").withColumn("sequence_id", F.col("base") + F.col("bin")).withColumn("offset", F.sum("length").over(inside) - F.col("length"))
    rest = placed.filter("bin >= full").select(*PIECE.replace(" long", "").replace(" int", "").split(", "), "nth")
    fitted = rest.groupBy(F.lit(0).alias("one")).applyInPandas(fit_rest(capacity), PIECE + ", nth long, bin long, offset long")
    return filled.select(columns).unionByName(fitted.withColumn("sequence_id", F.lit(first) + F.col("bin")).select(columns))
