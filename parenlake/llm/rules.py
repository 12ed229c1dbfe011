"""Quality rules: a table of thresholds compiled into one Spark projection.

Each rule bounds one ratio of lengths, symbols, stop words or lines. The
compiler turns the table into boolean columns over measures that the same
projection computes from the text, all of them built-in functions: no user
function, no shuffle, a row in and a row out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parenlake.llm.common import SPACE, text_of

#: Frequent function words of English, French, German, Spanish.
STOP_WORDS = (
    "a an and are as at be by for from he in is it its of on or that the this to was were which with "
    "au aux avec ce de des du elle en est et il la le les ne ou par pas pour que qui se sur un une "
    "als auch auf das dem den der die ein eine es für im ist mit nicht sich sie und von zu "
    "al como con del el lo los las más no para por su una y"
).split()

#: Fixed value: characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``low`` <= measure <= ``high``; None leaves a side open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The default table.
RULES = (
    Rule("word_length", "chars_per_word", 2.0, 15.0),
    Rule("symbols", "symbols_per_word", None, 0.5),
    Rule("stop_words", "stop_share", 0.02, None),
    Rule("repeated_lines", "dup_line_share", None, 0.3),
    Rule("line_length", "words_per_line", 1.5, None),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where lambdas read it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(keys: Column, width: int) -> Column:
    """Positions covered by windows (one hash each) found more than once."""

    def of_pairs(pairs: Column) -> Column:
        same = lambda j, x: F.coalesce(F.get(pairs, j)["key"] == x, F.lit(False))
        again = F.filter(pairs, lambda p, j: same(j - 1, p["key"]) | same(j + 1, p["key"]))
        return let(F.sort_array(F.transform(again, lambda p: p["at"])), gaps)

    def gaps(starts: Column) -> Column:
        steps = F.transform(starts, lambda at, j: F.least(F.lit(width), F.coalesce(F.get(starts, j + 1) - at, F.lit(width))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

    ordered = F.sort_array(F.transform(keys, lambda x, i: F.struct(x.alias("key"), i.alias("at"))))
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("long")).otherwise(let(ordered, of_pairs))


def repeat_words(words: Column, width: int = 5) -> Column:
    """Words inside windows of ``width`` words that the text holds twice or more."""

    def of_hashes(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashes) - width)
        keys = F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))
        return let(keys, lambda found: _covered(found, width))

    some = let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)
    return F.when(F.size(words) > width, some).otherwise(F.lit(0).cast("long"))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole)


def measures() -> dict[str, Column]:
    """What a rule can bound. A measure of nothing (no words) is null, and a
    rule on a null measure passes: the base rules judge such texts."""
    return {
        "chars_per_word": ratio(F.col("word_chars"), F.col("n_words")),
        "symbols_per_word": ratio(F.col("n_symbols"), F.col("n_words")),
        # A few words may well hold no function word.
        "stop_share": F.when(F.col("n_words") >= 50, F.col("n_stop_words").cast("double") / F.col("n_words")),
        "dup_line_share": ratio(F.col("n_dup_lines"), F.col("n_lines")),
        "words_per_line": ratio(F.col("n_words"), F.col("n_lines")),
    }


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """The table's verdict as one boolean column."""
    known, verdict = measures(), F.lit(True)
    for rule in rules:
        if rule.measure not in known:
            raise ValueError(f"rule {rule.name}: no measure {rule.measure}")
        for bound, holds in ((rule.low, lambda m, b: m >= b), (rule.high, lambda m, b: m <= b)):
            if bound is not None:
                verdict = verdict & F.coalesce(holds(known[rule.measure], F.lit(float(bound))), F.lit(True))
    return verdict


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, n_lines, n_stop_words; a row for each document.

    Whole texts are read. A null or empty text has no words and fails the base
    rule of 10 words. Repeated rows are judged alike; an empty table gives an
    empty result; columns of the input but doc_id and text play no part.
    """
    read = docs.select("doc_id", text_of("text").alias("text"))
    cut = read.select("doc_id", "text", F.array_remove(F.split("text", SPACE), "").alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    stop = F.transform(F.col("words"), lambda w: F.lower(w))
    counted = cut.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter(stop, lambda w: w.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & compile_rules(rules)).alias("kept"), "n_lines", "n_stop_words")
