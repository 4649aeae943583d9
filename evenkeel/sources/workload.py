"""Generated updates and packet records: the inputs of benchmarks and case studies."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the SplitMix64 generator.
GAMMA, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def splitmix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64(GAMMA)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_1)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_2)
        return z ^ (z >> np.uint64(31))


def key_bytes(index: np.ndarray, seed: int = 0, length: int = 16) -> list[bytes]:
    """The keys of the indexes: SplitMix64 chains, little end first."""
    state, words = index.astype(np.uint64) ^ np.uint64(seed), []
    for _ in range(-(-length // 8)):
        state = splitmix64(state)
        words.append(state)
    raw = np.stack(words, axis=1).astype("<u8")
    return [r.tobytes()[:length] for r in raw]


def zipf(spark: SparkSession, n: int, domain: int, exponent: float, seed: int = 0) -> DataFrame:
    """idx: ``n`` draws from 0 to domain - 1 with weights 1 / (idx + 1)^exponent (0: uniform)."""
    if exponent == 0:
        return spark.range(n).select(F.floor(F.rand(seed) * domain).cast("bigint").alias("idx"))
    weights = np.cumsum(1.0 / np.arange(1, domain + 1) ** exponent)
    shared = spark.sparkContext.broadcast(weights / weights[-1])

    def draw(batches):
        for b in batches:
            b["idx"] = np.searchsorted(shared.value, b["u"].to_numpy()).clip(0, domain - 1).astype("int64")
            yield b[["idx"]]

    return spark.range(n).select(F.rand(seed).alias("u")).mapInPandas(draw, "idx bigint")


def quadratic(spark: SparkSession, n: int, width: int, seed: int = 0) -> DataFrame:
    """idx: floor(width * u^2), a skewed workload."""
    u = F.rand(seed)
    return spark.range(n).select(F.floor(F.lit(width) * u * u).cast("bigint").alias("idx"))


def address(index: Column) -> Column:
    """The address text of an index; only 16 bits survive."""
    return F.concat(F.lit("10.0."), F.shiftright(index, 8).bitwiseAND(F.lit(255)).cast("string"), F.lit("."), index.bitwiseAND(F.lit(255)).cast("string"))


def ipv4_key(source: str, target: str) -> Column:
    """Source, target, eight zero bytes: each direction has its own key."""
    return F.expr(f"rpad(concat({source}, {target}), 16, x'0000000000000000')")


def ipv6_key(source: str, target: str) -> Column:
    """Byte-wise exclusive or of both, the same for either direction."""
    byte = lambda c, i: F.conv(F.substring(F.hex(F.col(c)), 2 * i + 1, 2), 16, 10).cast("int")
    joined = F.concat(*(F.lpad(F.hex(byte(source, i).bitwiseXOR(byte(target, i))), 2, "0") for i in range(16)))
    return F.unhex(joined)


def replayed(rows: DataFrame, passes: int, times: list[str], gap_us: int = 100_000_000) -> DataFrame:
    """``rows`` once for each pass, with the pass's offset on the columns ``times``."""
    many = rows.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    return many.withColumns({t: F.col(t) + F.col("pass") * gap_us for t in times})
