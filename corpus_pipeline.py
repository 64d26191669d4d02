"""From raw documents to packed training sequences.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` over all that the stage before it kept.
``run`` writes every stage's result to the shared folder and hands on what it reads back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import packing, quality, simhash, substring, surrogates
from gleaner.llm.common import quoted, release, table
from gleaner.session import cut_lineage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood-ratio threshold."""
    row = docs.select("doc_id", "text", F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"))
    kept = quality.quality_rules(row, table(spark, sf_dir, "labels")).filter("kept")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints: 3-word shingles, at most 2 bits apart."""
    return simhash.keep_one(docs, shingle=3, max_bits=2)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 13 words or more that an earlier one has."""
    return substring.drop_repeats(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data and secrets."""
    return surrogates.replace_entities(docs, surrogates.SAMPLE_KEY)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2,048 tokens, with their ids."""
    return packing.pack(docs, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("pii_surrogates", pii_stage),
    ("packing", packing_stage),
]

#: Hashed n-grams, fingerprints, surrogates and token ids cannot be written as SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark)
    return docs
