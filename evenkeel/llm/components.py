"""Connected components by alternating large stars and small stars; edges never leave the executors.

Once no more than ``FEW`` edges are left to work on, a bound that is counted, one task joins them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.arrow import trimmed
from evenkeel.sources.scratch import materialise

FEW = 200_000


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, component of the edges of one task."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            u, v = root(u), root(v)
            up[max(u, v)] = min(u, v)
    yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([root(x) for x in up], pa.int64())], ["node", "component"])


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, component (its smallest node) of each node in ``edges`` (columns u and v, integers, no nulls)."""
    kind = edges.schema["u"].dataType
    edges = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(most):
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        if now[0] <= FEW:
            found = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(trimmed(joined), "node long, component long")
            return materialise(found.select(F.col("node").cast(kind), F.col("component").cast(kind)))
        state = now
        both = edges.select("u", "v").union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = materialise(small)
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return edges.select(F.col("u").cast(kind).alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
