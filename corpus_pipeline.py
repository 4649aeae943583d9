"""A training corpus from the documents: toxic ones go, copies go, near copies go, contaminated ones go, the rest is encoded."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm import bpe, decontaminate, exact_dedup, ngram_join, toxicity
from evenkeel.llm.sample import remainder
from evenkeel.sources.scratch import materialise
from evenkeel.sources.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 stay, with a model of the labelled rows that op10 learns from; null and empty texts are scored like others."""
    model = toxicity.learned(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0)
    return toxicity.keep_civil(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal up to white space the row with the smallest id stays; null is empty, of rows with one id one stays."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets of five words and a Jaccard of 0.8, unlike op6, whose contract is four words and 0.85."""
    return ngram_join.keep_one(docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a benchmark item's windows cover a twentieth of the words or more go; texts without words stay."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document; null and empty texts have none."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: The toxicity model and the encoding are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
