"""Exact dedup by content sort, in DataFrame operations only.

Sampled splitters range-partition the normalised bytes, the external sort of each partition places
equal texts next to each other, and the window compares each text in full with its neighbour.

* The splitters are drawn from (first 64 characters, 64-bit hash, salt), so that the sample that
  Spark keeps on the driver has short rows whatever the length of the texts.
* A text held by more rows than ``hot_share`` of the input (and than ``hot_rows``) is hot: its rows
  are dealt over salts, each about the size of that threshold. The heads of the salted runs, one row
  each, are then merged. There are at most ``1 / hot_share`` hot texts, which bounds the broadcast.

Null and empty texts are equal to each other (the empty text). Repeated rows with one id: exactly
one row of a group is kept, also when its rows share their id. Rows whose id is null count as
largest. Further columns are ignored by ``groups`` and carried on by ``keep_first``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.sources.scratch import materialise


def normalised(text: Column) -> Column:
    r"""Each run of ``[\x20\x09-\x0D]`` as one space; null as empty.

    The pattern only matches runs that change, which is much less work than matching every space.
    """
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _sorted(docs: DataFrame, id_col: str, text_col: str, hot_rows: int, hot_share: float, carried: list[str]) -> DataFrame:
    """A row per input row: _id, _kept, _keep_id, _total, _sha, and the columns ``carried`` as _row."""
    rows = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_norm"), *([F.struct(*carried).alias("_row")] if carried else []))
    more = ["_row"] if carried else []
    rows = rows.withColumn("_hash", F.xxhash64("_norm"))
    hot_rows = max(hot_rows, int(docs.count() * hot_share))
    hot = rows.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    hot = hot.select("_hash", F.ceil(F.col("_n") / hot_rows).alias("_salts"))
    salted = rows.join(F.broadcast(hot), "_hash", "left").select(
        F.substring("_norm", 1, 64).alias("_start"),
        "_hash",
        F.when(F.col("_salts").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("_id", F.lit(17)), F.col("_salts"))).cast("int").alias("_salt"),
        "_norm",
        "_id",
        *more,
    )
    run = Window.partitionBy("_start", "_hash", "_salt", "_norm")
    ordered = run.orderBy(F.col("_id").asc_nulls_last())
    runs = salted.repartitionByRange("_start", "_hash", "_salt").select(
        "_id",
        "_salt",
        F.row_number().over(ordered).alias("_rank"),
        F.first("_id").over(ordered).alias("_first"),
        F.count(F.lit(1)).over(run).alias("_size"),
        F.sha2(F.col("_norm").cast("binary"), 256).alias("_sha"),
        *more,
    )
    runs = materialise(runs)
    heads = runs.filter((F.col("_salt") >= 0) & (F.col("_rank") == 1)).groupBy("_sha").agg(
        F.min(F.struct(F.col("_first").isNull().alias("none"), F.col("_first").alias("id"), F.col("_salt").alias("salt"))).alias("_head"),
        F.sum("_size").alias("_total"),
    )
    # As the hot texts, the heads are at most 1 / hot_share rows.
    out = runs.join(F.broadcast(heads), "_sha", "left")
    is_hot = F.col("_salt") >= 0
    return out.select(
        "_id",
        F.when(is_hot, F.col("_head.id")).otherwise(F.col("_first")).alias("_keep_id"),
        F.when(is_hot, F.col("_total")).otherwise(F.col("_size")).cast("long").alias("_total"),
        ((F.col("_rank") == 1) & (~is_hot | (F.col("_salt") == F.col("_head.salt")))).alias("_kept"),
        "_sha",
        *more,
    )


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = 1000, hot_share: float = 1e-4) -> DataFrame:
    """A row per input row: ``id_col``, keep_id, group_size, kept, text_sha256."""
    out = _sorted(docs, id_col, text_col, hot_rows, hot_share, [])
    return out.select(F.col("_id").alias(id_col), F.col("_keep_id").alias("keep_id"), F.col("_total").alias("group_size"), F.col("_kept").alias("kept"), F.col("_sha").alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = 1000, hot_share: float = 1e-4) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns; these go through the sort."""
    return _sorted(docs, id_col, text_col, hot_rows, hot_share, docs.columns).filter("_kept").select("_row.*")
