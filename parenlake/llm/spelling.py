"""Spelling variants of a corpus's words.

Words one error apart agree exactly in one half: with the longer word cut in two,
the error lies in the second half (the first is matched forward) or in the first
(the second is matched backward). So words meet in Spark by an exact half; a task
builds a minimal automaton of the words it is given, and one of their reversals,
walks each word's exact half through it, completes with one error, and gets the
near words by their perfect-hash numbers. Every pair is found once: where the
two words part decides which half may report it.

A half that very many words share is cut in two again, as often as needed, so a
group is bounded: beyond its error, words of a last group agree in all places.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parenlake.llm.automaton import Automaton
from parenlake.llm.common import bounded, drop_stage, raw_bytes, stage

#: Fixed value: letters of a run once A-Z are lower case.
LETTERS = "a-zÀ-ÿ"
#: A run loses a letter where this divides its hash.
NOISE = 31


def corpus_words(docs: DataFrame, least_length: int = 7, least_count: int = 2, noise: int = NOISE, held: int = 300_000) -> DataFrame:
    """word, n: the words of at least ``least_length`` code points, and how
    often each occurs in all texts, if at least ``least_count`` times.

    A run whose crc32 with its document's id is divisible by ``noise`` loses one
    letter first. Null texts have no words; a null doc_id is written as nothing;
    repeated rows count each. Tasks add up their own words, at most ``held`` at
    a time, before anything is shuffled.
    """
    rows = bounded(docs).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    # Shorter runs can't become words. A run is taken whole: the match is greedy.
    pattern = f"[{LETTERS}]{{{least_length},}}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, total = re.compile(pattern).findall, Counter()
        spelled: dict[str, bytes] = {}

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            spelled.clear()
            return made

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), raw_bytes(batch.column(1)), strict=True):
                seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                # lower() of bytes changes A-Z alone.
                for word, n in Counter(runs(text.lower().decode())).items():
                    raw = spelled.get(word)
                    if raw is None:
                        raw = spelled[word] = word.encode()
                    h = zlib.crc32(raw, seed)
                    if h % noise == 0:
                        if len(word) == least_length:
                            continue
                        gone = h % len(word)
                        word = word[:gone] + word[gone + 1 :]
                    total[word] += n
                if len(total) > held or len(spelled) > held:
                    yield flush()
        if total:
            yield flush()

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def key_of(word: Column, length: Column, i: Column, j: Column) -> Column:
    """What a word agrees in with those that may differ from it in [i, j) of
    the longer one's ``length`` places."""
    right = F.substr(word, F.char_length(word) - (length - j) + 1, length)
    return F.xxhash64(length, i, j, F.substr(word, F.lit(1), i), right)


def halved(rows: DataFrame) -> DataFrame:
    """Each interval [i, j) as its two halves, with the key of each."""
    middle = F.floor((F.col("i") + F.col("j")) / 2).cast("int")
    parts = F.explode(F.array(F.struct(F.col("i").alias("i"), middle.alias("j")), F.struct(middle.alias("i"), F.col("j").alias("j"))))
    made = rows.select("word", "n", "length", parts.alias("part")).select("word", "n", "length", "part.i", "part.j").filter("i < j")
    return made.withColumn("key", key_of(F.col("word"), F.col("length"), F.col("i"), F.col("j")))


def near_in(rows: list[tuple[str, int, int, int, int]]) -> Iterator[tuple[str, int, str, int]]:
    """word, its n, near word, its n, both ways, of rows (word, n, length, i, j)
    that hold whole groups. A word asks where ``length`` is its own."""
    counts = {r[0]: r[1] for r in rows}
    for backward in (False, True):
        some = [r for r in rows if (r[3] == 0) is backward]
        words = sorted({r[0][::-1] if backward else r[0] for r in some})
        automaton = Automaton(words)
        for word, n, length, i, j in some:
            if len(word) != length:
                continue
            asked, exact = (word[::-1], length - j) if backward else (word, i)
            for k in automaton.shorter_or_equal(asked, exact):
                near = words[k][::-1] if backward else words[k]
                # Of two words of one length, either asks; one of them reports.
                if i <= len(commonprefix((word, near))) < j and (len(near) < length or word < near):
                    yield word, n, near, counts[near]
                    yield near, counts[near], word, n


def near_words(words: DataFrame, most: int = 20_000, chunk: int = 20_000) -> DataFrame:
    """word, n, near, near_n for all words that differ by exactly one code point
    inserted, deleted or replaced. ``words``: word, n, distinct and staged.

    Words of a key with over ``most`` words are keyed again by halves of what
    may differ. Tasks take whole keys, ``chunk`` words and more at a time."""
    lengths = F.explode(F.array(F.char_length("word"), F.char_length("word") + 1))
    rows = words.select("word", "n", lengths.alias("length")).select("word", "n", "length", F.lit(0).alias("i"), F.col("length").alias("j"))
    found: list[DataFrame] = []
    while True:
        keyed = halved(rows)
        # Few or none: each stands for over ``most`` rows.
        heavy = stage(keyed.groupBy("key", (F.col("j") - F.col("i") > 1).alias("wide")).count().filter(F.col("wide") & (F.col("count") > most)).select("key"), "heavy-halves")
        last = heavy.isEmpty()
        found.append(matched(keyed if last else keyed.join(heavy, "key", "left_anti"), chunk))
        if last:
            break
        rows = stage(keyed.join(heavy, "key", "left_semi").drop("key"), "halves")
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def matched(keyed: DataFrame, chunk: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(rows: list) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            for pair in near_in(rows):
                out.append(pair)
                if len(out) >= 20_000:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["word", "n", "near", "near_n"])

        held: list[tuple] = []
        last = None
        for batch in batches:
            for key, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != last and len(held) >= chunk:
                    yield from pairs(held)
                    held = []
                held.append(tuple(row))
                last = key
        if held:
            yield from pairs(held)

    dealt = keyed.select("key", "word", "n", "length", "i", "j").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "word string, n long, near string, near_n long")


def forms(words: DataFrame, near: DataFrame, ratio: int = 10) -> DataFrame:
    """word, form, n, n_near, form_n: a word's form is its near word of largest
    n (ties: smallest in code-point order), if that is ``ratio`` times its own."""
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("_best"))
    joined = words.join(best.withColumnRenamed("word", "_word"), F.col("word") == F.col("_word"), "left")
    better = -F.col("_best.n") >= ratio * F.col("n")
    return joined.select("word", F.when(better, F.col("_best.word")).alias("form"), "n", F.coalesce("_near", F.lit(0)).cast("long").alias("n_near"), F.when(better, -F.col("_best.n")).alias("form_n"))


def with_roots(formed: DataFrame, ratio: int = 10) -> DataFrame:
    """``root``: the word at the end of a word's forms, itself if it has none.

    Pointers are doubled by joins. A chain has at most log(largest n) steps, as
    each step multiplies n by ``ratio``."""
    most = formed.agg(F.max("n")).first()[0] or 1
    rounds = math.ceil(math.log2(max(1.0, math.log(max(most, 1), ratio)))) + 1
    roots = stage(formed.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    for _ in range(rounds):
        before = roots
        on = roots.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        roots = stage(roots.join(on, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root")), "roots")
        drop_stage(before)
    roots = roots.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
    return formed.join(roots, F.col("word") == F.col("_w"), "left").select("word", "form", F.coalesce("_r", "word").alias("root"), "n", "n_near", "form_n")


def variant_table(docs: DataFrame, least_length: int = 7, least_count: int = 2, ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the corpus.

    An empty table, and texts without words, give an empty result. See
    ``corpus_words`` for nulls and repeated rows; ties are settled by the word.
    """
    words = stage(corpus_words(docs, least_length, least_count), "words")
    formed = stage(forms(words, near_words(words), ratio), "forms")
    drop_stage(words)
    return with_roots(formed, ratio)
