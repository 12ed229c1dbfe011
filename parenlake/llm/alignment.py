"""Alignment of two tokenizers' ids over the same bytes.

Tokenizer A is byte-level BPE; B is a sentencepiece model that adds a space in
front, so A encodes space+text. A dangling-suffix transducer reads both lists of
tokens: its state is the side that leads and the bytes by which it leads, the
next token comes from the side that trails, and a group closes whenever no byte
is left over. Transitions are memoised by state and token.

At every space after a non-space both tokenizers end a token, so the residual is
empty there; stretches between single spaces are aligned once and remembered.
Texts that can't be cut there go through the transducer whole.

An A token and a B token can end together only if the bytes of one are a suffix
of the other's. The pairs that can ever be linked are therefore fewer than the
bytes of both vocabularies together (about half a million here), whatever the
corpus: they are numbered beforehand, and their counts are small enough to be
sent to every task.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parenlake.llm.common import bounded, stage, text_of
from parenlake.llm.tokens import Recent, byte_values, library_tokens, words_of

ALIGNED = "doc_id long, n_a long, n_b long, groups string, links array<int>"


def bytes_of_a(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary; special tokens are never
    met in a text and have none."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    special = {x["content"] for x in told.get("added_tokens", [])}
    byte = byte_values()
    found = {k: bytes(byte[c] for c in token) for token, k in told["model"]["vocab"].items() if token not in special}
    return [found.get(k, b"") for k in range(max(found) + 1)]


def bytes_of_b(path: str) -> list[bytes]:
    """Bytes of each id of a sentencepiece model; unknown and control ids have
    none."""
    model = sentencepiece_model(path)

    def spelled(k: int) -> bytes:
        if model.is_byte(k):
            return bytes([int(model.id_to_piece(k)[3:5], 16)])
        return b"" if model.is_control(k) or model.is_unknown(k) else model.id_to_piece(k).replace("▁", " ").encode()

    return [spelled(k) for k in range(model.get_piece_size())]


@lru_cache(maxsize=4)
def sentencepiece_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@dataclass(frozen=True)
class Pairs:
    """All pairs of ids that can end together, numbered by (a, b)."""

    a: np.ndarray
    b: np.ndarray
    number: dict[int, int]

    def __len__(self) -> int:
        return len(self.a)


@lru_cache(maxsize=2)
def possible_pairs(a_path: str, b_path: str) -> Pairs:
    a_bytes, b_bytes = bytes_of_a(a_path), bytes_of_b(b_path)
    ids: tuple[dict[bytes, list[int]], dict[bytes, list[int]]] = ({}, {})
    for side, spelled in zip(ids, (a_bytes, b_bytes), strict=True):
        for k, x in enumerate(spelled):
            if x:
                side.setdefault(x, []).append(k)
    found = {(a, b) for a, x in enumerate(a_bytes) for at in range(len(x)) for b in ids[1].get(x[at:], ())}
    found |= {(a, b) for b, x in enumerate(b_bytes) for at in range(1, len(x)) for a in ids[0].get(x[at:], ())}
    ordered = np.array(sorted(found), np.int64).reshape(-1, 2)
    number = {a << 32 | b: k for k, (a, b) in enumerate(ordered.tolist())}
    return Pairs(ordered[:, 0], ordered[:, 1], number)


class Transducer:
    """States are numbered as they are met: 0 has no residual; of the others
    the side that leads and its unmatched bytes are known."""

    LIMIT = 2_000_000

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]) -> None:
        self.bytes = a_bytes, b_bytes
        self.clear()

    def clear(self) -> None:
        self.state_of: dict[tuple[int, bytes], int] = {(0, b""): 0}
        self.residual: list[bytes] = [b""]
        #: Side from which the next token is taken: the one that trails.
        self.next_side: list[int] = [0]
        self.moves: dict[int, int] = {}

    def move(self, state: int, token: int) -> int:
        """The state after ``token`` of the trailing side; -1 if bytes differ."""
        side, left, came = self.next_side[state], self.residual[state], self.bytes[self.next_side[state]][token]
        if left.startswith(came) and state:
            leads, rest = 1 - side, left[len(came) :]
        elif came.startswith(left):
            leads, rest = side, came[len(left) :]
        else:
            return -1
        key = (leads, rest) if rest else (0, b"")
        if key not in self.state_of:
            self.state_of[key] = len(self.residual)
            self.residual.append(rest)
            self.next_side.append(1 - leads)
        return self.state_of[key]

    def groups(self, a: list[int], b: list[int]) -> list[tuple[int, int]] | None:
        """Numbers of A and B tokens up to the end of each group; None if the
        bytes differ."""
        if len(self.moves) > self.LIMIT:
            self.clear()
        moves, next_side, out = self.moves, self.next_side, []
        lists, at, ends, state = (a, b), [0, 0], (len(a), len(b)), 0
        while True:
            side = next_side[state]
            if at[side] == ends[side]:
                return out if state == 0 and at[1] == ends[1] else None
            token = lists[side][at[side]]
            at[side] += 1
            key = state << 20 | token
            state = moves.get(key, -2)
            if state == -2:
                state = moves[key] = self.move(key >> 20, token)
            if state == 0:
                out.append((at[0], at[1]))
            elif state == -1:
                return None


class Aligner:
    """Aligns texts; what it has found for stretches is remembered."""

    LIMIT = 200_000
    NOTHING = ("", b"", 0, 0)

    def __init__(self, a_path: str, b_path: str) -> None:
        self.tokens, self.model = library_tokens(a_path), sentencepiece_model(b_path)
        self.transducer = Transducer(bytes_of_a(a_path), bytes_of_b(b_path))
        self.pairs = possible_pairs(a_path, b_path).number
        self.shown = [str(k) for k in range(max(map(len, self.transducer.bytes)))]
        #: No piece reaches over a space that follows a non-space.
        self.cuts = self.tokens.splits and not any(re.search("[^▁]▁", self.model.id_to_piece(k)) for k in range(self.model.get_piece_size()))
        #: word -> groups, links, numbers of A and B tokens; () if bytes differ
        self.known = Recent(self.learn, self.LIMIT)

    def joined(self, text: str, a: list[int], b: list[int]) -> tuple[str, bytes, int, int] | None:
        """Groups and links of one stretch (without its space); None if the
        tokens of a side don't spell space+text."""
        of_a = self.transducer.bytes[0]
        if b"".join([of_a[k] for k in a]) != b" " + text.encode():
            return None
        ends = self.transducer.groups(a, b)  # None unless B spells what A does
        if ends is None:
            return None
        shown, pairs, said, links, i, j = self.shown, self.pairs, [], array("i"), 0, 0
        for p, q in ends:
            left = shown[a[i]] if p == i + 1 else ",".join([shown[k] for k in a[i:p]])
            right = shown[b[j]] if q == j + 1 else ",".join([shown[k] for k in b[j:q]])
            said.append(f"{left}|{right}")
            links.append(pairs[a[p - 1] << 32 | b[q - 1]])
            i, j = p, q
        return ";".join(said), links.tobytes(), len(a), len(b)

    def learn(self, words: list[str]) -> Iterator[tuple]:
        for word, a, b in zip(words, self.tokens.word_ids(words), self.model.encode(words, num_threads=1), strict=True):
            yield self.joined(word, array("I", a).tolist(), b) or ()

    def whole(self, text: str) -> tuple[str, bytes, int, int]:
        a = array("I", self.tokens.library([" " + text])[0]).tolist()
        return self.joined(text, a, self.model.encode(text, num_threads=1)) or self.NOTHING

    def of(self, texts: list[str]) -> list[tuple[str, bytes, int, int]]:
        split = [words_of(x) if self.cuts and x else None for x in texts]
        known, out = iter(self.known.of([x for x in split if x])), []
        for text, words in zip(texts, split, strict=True):
            found = next(known) if words else [()]
            if () in found:
                out.append(self.whole(text) if text else self.NOTHING)
            else:
                said, links, n_a, n_b = zip(*found, strict=True)
                out.append((";".join(said), b"".join(links), sum(n_a), sum(n_b)))
        return out


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each worker process, whatever the number of tasks."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, groups (``a1,a2|b1;a3|b2,b3``) and links (the number,
    among ``possible_pairs``, of the pair that ends each group) of every row.

    Null and empty texts, and texts that either tokenizer doesn't spell as they
    are (a model that rewrites characters), have no tokens: zeros, '' and no
    links. Repeated rows are aligned each; null ids stay; other columns are
    ignored; an empty table gives an empty result. There is no shuffle.
    """
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    names = [part.split()[0] for part in ALIGNED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = aligner(a_path, b_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                said, links, n_a, n_b = zip(*work.of(batch.column(1).to_pylist()), strict=True)
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in links])]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(links), np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(pa.int64()), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(said, pa.string()), pa.ListArray.from_arrays(pa.array(ends), flat)],
                    names=names,
                )

    return rows.mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame, n_pairs: int) -> DataFrame:
    """pair, n: how many links of all documents hold each pair. A task adds its
    own links up first, so it sends at most ``n_pairs`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_pairs, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_pairs)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["pair", "n"])

    return aligned.select("links").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def id_map(aligned: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """a, b, n, best: the linked ids of the corpus, how often each pair is
    linked, and whether no other A id is linked with that B id more often."""
    pairs = possible_pairs(a_path, b_path)
    spark = aligned.sparkSession
    ids = spark.createDataFrame(pa.table({"_pair": np.arange(len(pairs), dtype=np.int32), "a": pairs.a, "b": pairs.b}))
    counted = pair_counts(aligned, len(pairs)).join(ids, F.col("pair") == F.col("_pair"))
    most = counted.groupBy(F.col("b").alias("_b")).agg(F.max("n").alias("most"))
    return counted.join(most, F.col("b") == F.col("_b")).select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment_table(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Counts of pairs are those of all documents; they go to the tasks as two
    arrays whose length the vocabularies bound (``possible_pairs``)."""
    spark = docs.sparkSession
    pairs = possible_pairs(a_path, b_path)
    aligned = stage(align(docs, a_path, b_path), "aligned")
    count = np.zeros(len(pairs), np.int64)
    found = pair_counts(aligned, len(pairs)).toArrow()
    count[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    most = np.zeros(int(pairs.b.max()) + 1, np.int64)
    np.maximum.at(most, pairs.b, count)
    sent = spark.sparkContext.broadcast((count, (count == most[pairs.b]).astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = sent.value
        for batch in batches:
            links = batch.column(3)
            flat, ends = links.flatten().to_numpy(), np.concatenate([[0], np.cumsum(links.value_lengths().to_numpy())])
            sums = [np.concatenate([[0], np.cumsum(x[flat])]) for x in (best, counts)]
            n = pa.array(np.diff(ends).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in range(3)], n, n, *[pa.array(s[ends[1:]] - s[ends[:-1]]) for s in sums], batch.column(4)],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )

    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    rows = aligned.select("doc_id", "n_a", "n_b", "links", digest.alias("groups_sha256"))
    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
