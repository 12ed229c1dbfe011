"""Registered queries of the corpus operators, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parenlake.llm.pii import surrogate_table

    return surrogate_table(table(spark, sf_dir, "documents"))


def op2_jump_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parenlake.llm.sharding import shard_table

    return shard_table(table(spark, sf_dir, "documents"), shards=16)


def op3_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from parenlake.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024)


def op5_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parenlake.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2)


def op4_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parenlake.llm.quality import quality_table

    return quality_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_lempel_ziv_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parenlake.llm.lzprint import edit_table

    return edit_table(table(spark, sf_dir, "documents"))


def op7_universe_partition_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parenlake.llm.jaccard import Measure, link

    return link(table(spark, sf_dir, "documents"), Measure(words=4, part=85, whole=100))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parenlake.llm.rules import judge

    return judge(table(spark, sf_dir, "documents"))


#: The rules' measures and default thresholds again, in SQL.
_OP8_SQL = """
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS (
    SELECT doc_id, text,
           list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]'), lambda x: x <> '') AS words,
           list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
    FROM t
), windows AS (
    SELECT doc_id, unnest(range(1, len(words) - 3)) AS i,
           unnest(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) AS key
    FROM w WHERE len(words) >= 5
), again AS (
    SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, key) > 1
), covered AS (
    SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM again) GROUP BY doc_id
), counted AS (
    SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
           CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
           CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
           CAST(len(lines) AS BIGINT) AS n_lines,
           CAST(len(list_filter(words, lambda x: lower(x) IN (%STOP%))) AS BIGINT) AS n_stop_words
    FROM w LEFT JOIN covered ON w.doc_id = covered.doc_id
), judged AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
       AND CAST(word_chars AS DOUBLE) / n_words >= 2.0 AND CAST(word_chars AS DOUBLE) / n_words <= 15.0
       AND CAST(n_symbols AS DOUBLE) / n_words <= 0.5
       AND (n_words < 50 OR CAST(n_stop_words AS DOUBLE) / n_words >= 0.02)
       AND CAST(n_dup_lines AS DOUBLE) / n_lines <= 0.3
       AND CAST(n_words AS DOUBLE) / n_lines >= 1.5 AS kept,
       n_lines, n_stop_words
FROM judged
"""


def op8_sql() -> str:
    from parenlake.llm.rules import STOP_WORDS

    return _OP8_SQL.replace("%STOP%", ", ".join(f"'{w}'" for w in STOP_WORDS))


def op9_de_bruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parenlake.llm.debruijn import dedupe

    return dedupe(table(spark, sf_dir, "documents"), k=35)


def op10_sparse_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parenlake.llm.sparse_suffix import dedupe

    return dedupe(table(spark, sf_dir, "documents"), least=50)


def op11_dangling_suffix_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from parenlake.llm.alignment import alignment_table

    return alignment_table(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_elias_fano_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from parenlake.llm.token_files import token_table

    return token_table(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parenlake.llm.spelling import variant_table

    return variant_table(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_jump_hash_shards": op2_jump_hash_shards,
    "op3_harmonic_packing": op3_harmonic_packing,
    "op4_factorisation_machine": op4_factorisation_machine,
    "op5_sainte_lague_mix": op5_sainte_lague_mix,
    "op6_lempel_ziv_fingerprints": op6_lempel_ziv_fingerprints,
    "op7_universe_partition_join": op7_universe_partition_join,
    "op8_quality_rules": op8_quality_rules,
    "op9_de_bruijn_dedup": op9_de_bruijn_dedup,
    "op10_sparse_suffix_dedup": op10_sparse_suffix_dedup,
    "op11_dangling_suffix_alignment": op11_dangling_suffix_alignment,
    "op12_elias_fano_token_files": op12_elias_fano_token_files,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES: dict[str, str] = {"op8_quality_rules": op8_sql()}
