"""Corpus pipeline: quality rules, exact copies, near copies, source mix, token ids.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but the
last return the columns of ``documents``; the last adds the token ids of each text and whether they
decode to the text again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfield.llm import bpe, exact_dedup, mixing, parity_join, quality_rules
from emberfield.llm.queries import bpe_vocabulary_path, show_package_to_workers
from emberfield.session import materialize

#: Near copies of whole documents: five-word shingles, similarity of 0.8 or more.
NEAR_COPIES = parity_join.Similarity(width=5, share=80, whole=100)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base conditions and every quality rule."""
    return quality_rules.keep_good(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    return parity_join.drop_near_copies(docs, NEAR_COPIES)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: a row for each pass that takes words of a document."""
    return mixing.mix_documents(docs, mixing.plan_mix(docs))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids, their number, and whether they decode to the text."""
    path = bpe_vocabulary_path()
    coded = bpe.bpe_encode(docs.withColumn("coded_text", F.col("text")), path, "coded_text")
    decoded = bpe.bpe_decode(coded, path)
    return decoded.select(*docs.columns, "ids", F.size("ids").cast("long").alias("n_tokens"),
                          (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("source_mixing", mixing_stage),
    ("bpe_tokens", bpe_stage),
]

#: Pseudorandom permutations and token ids have no SQL; ``tests/llm/test_pipeline.py`` compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    show_package_to_workers(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
