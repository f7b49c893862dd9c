"""The registered queries of the text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import exact_dedup, fingerprints, kneser_ney, licenses, mixing, packing, search, secrets_scan, sharding, simhash, spelling, token_files, toxicity


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


#: Target token shares: good text by language, and what is labelled as of low quality.
SHARES = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.12, "low": 0.03}


def domain() -> Column:
    """A labelled row's domain: its language, or "low" where its quality is 0."""
    return F.when(F.col("quality") == 1, F.col("lang")).when(F.col("quality") == 0, F.lit("low"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(documents(spark, sf_dir), labels(spark, sf_dir), domain(), SHARES)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(documents(spark, sf_dir), labels(spark, sf_dir))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbour_fingerprints(documents(spark, sf_dir))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.secret_digests(documents(spark, sf_dir))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(documents(spark, sf_dir), shards=40)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.language_scores(documents(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), words=3)


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digests(documents(spark, sf_dir))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=20)


QUERIES = {f.__name__: f for f in (op1_mixing, op2_packing, op3_toxicity, op4_fingerprints, op5_secrets, op6_sharding, op7_exact_dedup, op8_token_files, op9_language_model, op10_simhash, op11_licenses, op12_spelling, op13_search)}

ORACLES = {
    "op7_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
            FROM documents
        ), g AS (
            SELECT doc_id, t,
                   first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY t) AS group_size
            FROM n
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
    """,
    "op11_licenses": licenses.oracle(),
    "op13_search": search.ORACLE,
}
