"""Registered queries of the subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm import bpe, decontaminate, exact_dedup, html_text, language_id, ngram_join, quality_crf, suffix_dedup, token_histogram, toxicity
from evenkeel.llm.sample import remainder
from evenkeel.sources.tables import table


def ranks() -> dict[bytes, int]:
    return bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again: counts and digests."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks(), public_tokenizers.PATTERN)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated strings of 100 bytes cover, by document."""
    return suffix_dedup.report(table(spark, sf_dir, "documents")).drop("spans")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of encoded lengths, with suffix sums."""
    return token_histogram.suffix_sums(token_histogram.histogram(table(spark, sf_dir, "documents"), ranks(), public_tokenizers.PATTERN))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts, by document."""
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of benchmark items, by document."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of linked documents."""
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def held_out(of: int, is_: int):
    return F.coalesce(remainder(F.col("doc_id"), of) == is_, F.lit(False)).alias("held_out")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = quality_crf.learned(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 3) != 1)
    scored = quality_crf.scores(docs, model)
    return scored.select("doc_id", held_out(3, 1), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.learned(docs, remainder(F.col("doc_id"), 3) != 1)
    return language_id.predict(docs, model).select("doc_id", held_out(3, 1), "lang_pred", "score")


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Model:
    return toxicity.learned(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.scores(docs, toxicity_model(spark, sf_dir, docs))
    return scored.select("doc_id", held_out(5, 0), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_token_counts": op3_token_counts,
        "op4_html_text": op4_html_text,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_ngram_jaccard": op6_ngram_jaccard,
        "op7_quality": op7_quality,
        "op8_language_id": op8_language_id,
        "op9_decontamination": op9_decontamination,
        "op10_toxicity": op10_toxicity,
    }
