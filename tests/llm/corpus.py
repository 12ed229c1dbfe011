"""Small fixtures: odd rows of every kind, and brute-force versions."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, copies, repeated rows."""
    base, passage = words(1, 120), words(2, 60)
    near = base.split()
    near[60] = "changed"
    rows = [
        (0, base, "en", "a", len(base)),
        (1, base, "en", "b", len(base)),
        (2, " ".join(near), None, "a", None),
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (5, " \t\n", "en", "c", 3),
        (6, "one two", "en", "c", 7),
        (7, "ONE two", "en", None, 7),
        (8, words(3, 50) + " " + passage + " " + words(4, 40), "en", "a", 900),
        (9, words(5, 30) + " " + passage, "en", "b", 500),
        (10, "same " * 300, "en", "c", 1500),
        (11, words(6, 6000, 5000), "en", "a", 30000),
        (12, "é日本😀 " * 20, "ja", "ü", 100),
        (None, words(7, 80), "en", "a", 300),
        (14, base, "en", "a", len(base)),
        (14, base, "en", "a", len(base)),
        (15, words(8, 90), "en", "b", 300),
        (15, words(9, 90), "en", "b", 300),
    ]
    return rows


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(spark):
    """Extra columns named like the operators' own."""
    df = odd(spark)
    from pyspark.sql import functions as F

    for name in ("id", "key", "h", "start", "size", "shard", "slot", "rid", "node", "_key", "n", "crc", "words", "score", "target"):
        df = df.withColumn(name, F.lit("x"))
    return df
