"""Token counts as an exact length histogram with suffix sums.

Documents are aggregated by encoded length; from then on only the histogram is worked on, one row per
distinct length. Suffix sums over it answer totals, quantiles and truncated totals for every limit.

The sums run in two levels, so that no task holds the whole histogram: within blocks of
``BLOCK`` lengths, and over the blocks (a row for each ``BLOCK`` tokens of the longest document).
Null and empty texts have length 0. An empty table gives an empty histogram, zero totals and null
quantiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm import bpe
from evenkeel.sources.scratch import materialise

BLOCK = 1024


def histogram(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """length, n_docs: how many documents encode to that many tokens."""
    counts = bpe.token_counts(docs, ranks, pattern, id_col, text_col)
    return counts.groupBy(F.col("n_tokens").alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """A row per length: length, n_docs, docs_at_least, tokens_at_least, truncated_total, docs_total, tokens_total.

    docs_at_least and tokens_at_least count the documents of that length or more and their tokens;
    truncated_total is the sum over all documents of min(their length, this length).
    """
    hist = materialise(hist)  # it is read twice
    rows = hist.withColumn("_block", F.floor(F.col("length") / BLOCK))
    sums = rows.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum(F.col("n_docs") * F.col("length")).alias("_t"))
    later = Window.orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select(
        F.col("_block").alias("_of"),
        F.coalesce(F.sum("_d").over(later), F.lit(0)).alias("_later_docs"),
        F.coalesce(F.sum("_t").over(later), F.lit(0)).alias("_later_tokens"),
        F.sum("_d").over(every).alias("docs_total"),
        F.sum("_t").over(every).alias("tokens_total"),
    )
    inner = Window.partitionBy("_block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_in_docs": F.sum("n_docs").over(inner), "_in_tokens": F.sum(F.col("n_docs") * F.col("length")).over(inner)})
    rows = rows.join(sums, rows["_block"] == sums["_of"]).withColumns(
        {"docs_at_least": F.col("_in_docs") + F.col("_later_docs"), "tokens_at_least": F.col("_in_tokens") + F.col("_later_tokens")}
    )
    cut = F.col("tokens_total") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")
    return rows.select("length", "n_docs", "docs_at_least", "tokens_at_least", cut.alias("truncated_total"), "docs_total", "tokens_total")


def totals(sums: DataFrame) -> DataFrame:
    """One row: docs, tokens."""
    first = sums.agg(F.max("docs_total").alias("d"), F.max("tokens_total").alias("t"))
    return first.select(F.coalesce("d", F.lit(0)).alias("docs"), F.coalesce("t", F.lit(0)).alias("tokens"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row, length: the least length that at least a share ``q`` of the documents don't exceed."""
    up_to = F.col("docs_total") - F.col("docs_at_least") + F.col("n_docs")
    return sums.filter(up_to >= F.ceil(F.lit(q) * F.col("docs_total"))).agg(F.min("length").alias("length"))


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row, tokens: what remains when every document is cut to ``limit`` tokens, for any limit."""
    longer = F.sum(F.when(F.col("length") > limit, F.col("n_docs")).otherwise(0)) * limit
    shorter = F.sum(F.when(F.col("length") <= limit, F.col("n_docs") * F.col("length")).otherwise(0))
    return sums.agg(F.coalesce(longer + shorter, F.lit(0)).alias("tokens"))
