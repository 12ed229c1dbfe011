"""The corpus pipeline: from raw documents to packed training sequences.

Each stage works on all that the one before it kept and, but for the last,
gives the columns of the documents table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parenlake.llm.common import stage
from parenlake.llm.jaccard import Measure, keep_one
from parenlake.llm.mixing import apply_mix
from parenlake.llm.packing import pack
from parenlake.llm.pii import replace
from parenlake.llm.quality import fit, score

#: Training, hashing and tokenizing can't be said in SQL.
ORACLE_SQL = None


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine rates below 0.5 go."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = score(docs, model, keep=True).filter("predicted = 1")
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at 0.8 stays."""
    return keep_one(docs, Measure(words=5, part=80, whole=100))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities give way to surrogates; n_chars follows the text."""
    done = replace(docs, counts=False)
    return done.withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, documents repeated or left out."""
    return apply_mix(docs, weights=(3, 1, 2), share=1.5, most=2)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and the sequences they go to."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024)


STAGES = [
    ("quality classifier", reject_low_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("surrogates", replace_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents table, each written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, work in STAGES[:-1]:
        docs = stage(work(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
