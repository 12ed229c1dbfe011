"""Lempel-Ziv phrase fingerprints.

A text is parsed into the phrases of an LZ78 dictionary: each phrase is the
longest known one plus a character. The set of phrases is hashed and its
smallest hashes are the fingerprint (a bottom-k signature); the share of common
hashes among the smallest of two fingerprints estimates the Jaccard likeness of
the phrase sets, which follows how well one text compresses the other. Sets of
up to k phrases are compared exactly.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parenlake.llm.common import Rolling, bounded, mix64, text_of

#: Hashes in a signature.
KEPT = 96


def parse(text: str, known: set[str], at: int, limit: int, ends: list[int]) -> int:
    """LZ78 phrases of text[at:limit]; those that end by ``limit`` are added to
    ``known`` and their ends to ``ends``. Returns where the open phrase starts.

    A dictionary holds every prefix of its phrases, so the search for the
    shortest unknown one may start at a guess and walk from there.
    """
    add, push = known.add, ends.append
    while at < limit - 64:
        end = at + 4
        phrase = text[at:end]
        if phrase in known:
            while phrase in known:
                end += 1
                phrase = text[at:end]
                if end > limit:
                    return at
        else:
            shorter = text[at : end - 1]
            while shorter not in known:
                phrase, end = shorter, end - 1
                if end == at + 1:
                    break
                shorter = text[at : end - 1]
        add(phrase)
        push(end)
        at = end
    while at < limit:
        end = at + 1
        while end <= limit and text[at:end] in known:
            end += 1
        if end > limit:
            break
        add(text[at:end])
        push(end)
        at = end
    return at


def signature(text: str, ends: list[int]) -> np.ndarray:
    """The smallest hashes of the phrases that end at ``ends`` (and of an
    unfinished last one), sorted."""
    if not text:
        return np.zeros(0, np.uint32)
    stops = np.array(ends if ends and ends[-1] == len(text) else [*ends, len(text)], np.int64)
    starts = np.concatenate([[0], stops[:-1]])
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    hashes = np.unique((Rolling(mix64(points + np.uint64(0x5851F42D4C957F2D))).spans(starts, stops) >> np.uint64(32)).astype(np.uint32))
    return hashes[:KEPT]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard likeness of the phrase sets behind two signatures."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:KEPT]
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def printed(sig: np.ndarray) -> str:
    return base64.b64encode(sig.astype(">u4").tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ">u4").astype(np.uint32)


def fingerprint(text: str) -> np.ndarray:
    ends: list[int] = []
    parse(text, set(), 0, len(text), ends)
    return signature(text, ends)


def with_edit(text: str, following: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Signatures of a text and of its edit, whose last quarter comes from the
    following text. What both have in common is parsed once."""
    n = len(text)
    stay = n - n // 4
    edited = text[:stay] + following[: n // 4]
    known: set[str] = set()
    ends: list[int] = []
    at = parse(text, known, 0, stay, ends)
    if edited == text:
        parse(text, known, at, n, ends)
        found = signature(text, ends)
        return found, found, edited
    known_too, ends_too = set(known), list(ends)
    parse(text, known, at, n, ends)
    parse(edited, known_too, at, len(edited), ends_too)
    return signature(text, ends), signature(edited, ends_too), edited


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each whole text; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [printed(fingerprint(t or "")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(made, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def edit_table(docs: DataFrame, rows_per_range: int = 1000, most_ranges: int = 20_000) -> DataFrame:
    """Each document against its edit and against the next one by doc_id.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. The last document is followed by the first. Null
    texts are empty; rows of one doc_id follow each other in the order of their
    compressed texts; null ids come first; an empty table gives an empty result; a single row follows itself.

    Documents are dealt into ranges of doc_id whose bounds are ids of the
    table. The row at a bound also goes to the range before it, so each range
    holds what follows its last row. Texts are shuffled once, compressed.
    """
    import hashlib

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    ids = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    facts = base.agg(F.count(F.lit(1)).alias("n"), F.min(ids).alias("low")).first()
    spread = max(1, min(most_ranges, math.ceil(facts["n"] / rows_per_range)))
    shares = [k / spread for k in range(1, spread)]
    cut = base.agg(F.percentile_approx(ids, shares, max(10_000, 4 * spread)).alias("b")).first()["b"] if shares and facts["n"] else []
    bounds = np.array(sorted({b for b in cut or [] if b > facts["low"]}), np.int64)
    ranges, low = len(bounds) + 1, facts["low"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            doc = batch.column(0).cast(pa.int64()).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            text = pa.array([squeeze.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()], pa.binary())
            home = np.searchsorted(bounds, doc, side="right").astype(np.int32)
            ahead = np.flatnonzero(np.isin(doc, bounds) | (doc == low))
            take = np.concatenate([np.arange(len(doc)), ahead])
            part = np.concatenate([home, (home[ahead] - 1) % ranges]).astype(np.int32)
            flag = np.concatenate([np.zeros(len(doc), np.int32), np.ones(len(ahead), np.int32)])
            # In its own range a row is first by id, at the end of the one before it last.
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(flag), batch.column(0).cast(pa.int64()).take(pa.array(take)), text.take(pa.array(take))], names=["part", "ahead", "doc_id", "packed"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        now: tuple | None = None  # the row whose successor comes next
        open_: tuple | None = None  # a row that lacks its successor's signature
        for batch in batches:
            out: list[list] = [[] for _ in names]

            def close(row: tuple, sig: np.ndarray, out: list[list] = out) -> None:
                for column, value in zip(out, (*row[:6], likeness(row[6], sig)), strict=True):
                    column.append(value)

            for part, ahead, doc, packed in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                if ahead and (now is None or now[0] != part):
                    continue
                text = expand.decompress(packed).decode("utf-8", "surrogatepass")
                if now and now[0] == part:
                    _, before, own = now
                    sig, other, edited = with_edit(own, text)
                    if open_:
                        close(open_, sig)
                    open_ = (before, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), printed(sig), printed(other), likeness(sig, other), sig)
                if ahead:
                    close(open_, fingerprint(text))
                    now = open_ = None
                else:
                    now = (part, doc, text)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    dealt = bounded(docs).select("doc_id", text_of("text").alias("text")).mapInArrow(deal, "part int, ahead int, doc_id long, packed binary")
    sorted_ = dealt.repartitionById(ranges, F.col("part")).sortWithinPartitions("part", "ahead", F.col("doc_id").asc_nulls_first(), "packed")
    return sorted_.mapInArrow(walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
