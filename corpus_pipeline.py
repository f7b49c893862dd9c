"""From raw documents to packed training sequences, in five stages.

Each stage works on all that the one before kept. A stage's rows are written as Parquet
in the shared folder and read again, so that a lost executor costs at most a stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import exact_dedup, mixing, near_copies, packing, toxicity
from ledgerloom.llm.common import written

#: Target token shares of the languages.
SHARES = {"en": 0.60, "de": 0.14, "fr": 0.14, "es": 0.12}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar doesn't find toxic."""
    return toxicity.without_toxic(docs, _labels(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: of five-word shingles, four fifths are the same."""
    return near_copies.drop_near_copies(docs, words=5, bound=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated until the languages have their shares of the tokens, at most four times; none goes."""
    settings = mixing.Settings(floor=1.0, ceiling=4.0, size="floor")
    return mixing.mixed(docs, _labels(spark, sf_dir), F.col("lang"), SHARES, settings)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of the documents, with their ids, in sequences of 2048 tokens."""
    return packing.sequences(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: Most stages are beyond SQL; tests/llm/test_pipeline.py looks at the ids that each stage keeps, at whole copies, and at packed ids against the tokenizer's.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
