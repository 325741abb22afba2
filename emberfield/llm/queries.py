"""Registered queries of the text operators: each on its whole intended table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfield.llm import (
    bpe, conversation_trie, exact_dedup, html_blocks, licences, minhash_join, mixing, oracle, parity_join, periodic_runs, pii,
    quality_knn, quality_rules, toxicity)
from emberfield.llm.labelled import fold, labelled_sample

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def show_package_to_workers(spark: SparkSession) -> None:
    """Let Python workers import this package where the driver found it by its own path only.

    A cluster installs the package or gets it with ``--py-files``; a folder that is not there does no harm.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        show_package_to_workers(spark)
        return build(spark, folder)

    QUERIES[build.__name__] = run
    return build


def read(spark: SparkSession, folder: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet").select(*columns)


def bpe_vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_chunk_recipes(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents that are equal after white space is normalised."""
    return exact_dedup.exact_groups(read(spark, folder, "documents", "doc_id", "text"))


@query
def op2_parity_sketch_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose three-word shingle sets have a similarity of at least 0.9."""
    found = parity_join.near_groups(read(spark, folder, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


@query
def op3_block_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of each document the mix of all sources takes."""
    mix = mixing.plan_mix(read(spark, folder, "documents", "doc_id", "text", "source"))
    return mix.taken().select("doc_id", "size", "source_size", "target", "taken")


@query
def op4_rule_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Base statistics and the verdict of the quality rules."""
    docs = read(spark, folder, "documents", "doc_id", "text")
    return quality_rules.apply_quality_rules(docs, keep_text=False)


@query
def op5_block_labeller(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page, chosen block by block."""
    pages = read(spark, folder, "pages", "page_id", "url", "html")
    labeller = html_blocks.train_labeller(html_blocks.training_pages(pages))
    return html_blocks.extract_text(pages, labeller).withColumn("n_chars", F.length("text").cast("long"))


def scored(scores: DataFrame, folds: int, held_out: int) -> DataFrame:
    return scores.select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query
def op6_toxicity_weak_supervision(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every text by a classifier trained on the posterior of many voters."""
    docs = read(spark, folder, "documents", "doc_id", "text")
    sample, counts = labelled_sample(docs, read(spark, folder, "labels", "doc_id", "toxic"), "toxic", 5, 0,
                                     toxicity.SAMPLE_PER_CLASS, "toxicity_sample")
    return scored(toxicity.score_toxicity(docs, toxicity.fit_toxicity(sample, counts)), 5, 0)


@query
def op7_quality_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every text by similarity-weighted votes of labelled texts."""
    docs = read(spark, folder, "documents", "doc_id", "text")
    sample, counts = labelled_sample(docs, read(spark, folder, "labels", "doc_id", "quality"), "quality", 3, 1,
                                     quality_knn.SAMPLE_PER_CLASS, "quality_sample")
    model = quality_knn.fit_neighbours(quality_knn.collect_terms(sample), counts)
    return scored(quality_knn.score_quality(docs, model), 3, 1)


@query
def op8_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, places and digest of the personal data in every text."""
    found = pii.find_pii(read(spark, folder, "documents", "doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    counts = [pii.count_of("spans", k).alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"),
                        pii.listed(F.col("spans")).alias("spans"))


@query
def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts and digests of encoding every text and decoding it again."""
    path = bpe_vocabulary_path()
    coded = bpe.bpe_encode(read(spark, folder, "documents", "doc_id", "text"), path)
    return bpe.bpe_decode(coded, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op10_licence_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Licence families that the paragraphs of each document state."""
    docs = read(spark, folder, "documents", "doc_id", "text")
    return licences.licences_of_documents(docs, licences.fit_licences(docs))


@query
def op11_coordinate_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose two-word shingle sets have a similarity of at least 0.8."""
    found = minhash_join.near_components(read(spark, folder, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query
def op12_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the prefix trie of the conversations, rebuilt with shared first turns."""
    turns = read(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    return conversation_trie.prefix_trie(conversation_trie.sequences(turns, shared=4, family=20))


@query
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of words of every text, after repetitions were planted into some."""
    docs = read(spark, folder, "documents", "doc_id", "text")
    planted = docs.withColumn("text", periodic_runs.plant_repetition(F.col("doc_id"), F.col("text")))
    return periodic_runs.find_runs(planted, texts=False, keep=["doc_id"])


ORACLE |= {"op11_coordinate_join": oracle.OP11, "op12_conversation_trie": oracle.OP12, "op13_periodic_runs": oracle.OP13}
ORACLE |= {"op1_chunk_recipes": oracle.OP1, "op2_parity_sketch_join": oracle.OP2,
           "op4_rule_cascade": oracle.OP4, "op8_personal_data": oracle.OP8}
