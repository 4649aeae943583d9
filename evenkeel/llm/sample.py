"""Bounded labelled samples for the classifiers, which are the only thing fitted on a sample.

The rows are those with the smallest hash of their id, so that a sample is the same on each run. They are
bounded in number and in bytes together, never by their own length: texts are learned from whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a sample, and bytes of its texts together.
ROWS, BYTES = 4000, 12 << 20


def remainder(id_col: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null for null ids."""
    return F.crc32(id_col.cast("string").cast("binary")) % of


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, learn: Column, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, object]]:
    """(text, label) of the rows of ``labelled_rows``, on the driver."""
    got = labelled_rows(docs, labels, label_col, learn, rows, id_col, text_col).toArrow()
    return list(zip(got["text"].to_pylist(), got["label"].to_pylist()))


def labelled_rows(docs: DataFrame, labels: DataFrame, label_col: str, learn: Column, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text, label of at most ``rows`` documents, in one partition, in the order of the hash of their id, up to ``BYTES`` of text together.

    ``learn`` says which ids of ``labels`` may be used. Of several labels of one id the largest counts; null
    ids, labels and texts are left out. A text that has more than ``BYTES`` alone can't be learned from.
    """
    known = labels.filter(learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(F.octet_length("_text") <= BYTES)
    ids = known.join(texts.select("_id").distinct(), "_id", "left_semi")
    chosen = F.broadcast(ids.orderBy(F.xxhash64("_id"), "_id").limit(rows))  # at most ``rows`` rows
    sizes = texts.select("_id", F.octet_length("_text").alias("_size"), F.xxhash64("_text").alias("_hash")).join(chosen, "_id")
    sizes = sizes.orderBy(F.xxhash64("_id"), "_id", "_hash").limit(rows)  # at most ``rows`` rows, without their texts
    order = Window.orderBy(F.xxhash64("_id"), "_id", "_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = sizes.withColumn("_total", F.sum("_size").over(order)).filter(F.col("_total") <= BYTES).select("_id", "_hash", "_label").distinct()
    got = texts.withColumn("_hash", F.xxhash64("_text")).join(F.broadcast(within), ["_id", "_hash"])
    got = got.select(F.xxhash64("_id").alias("_order"), "_id", "_hash", "_label", "_text").orderBy("_order", "_id", "_hash").limit(rows)
    return got.select(F.col("_text").alias("text"), F.col("_label").alias("label"))
