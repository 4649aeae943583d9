"""Named experiments: generated updates into each kind of histogram, timed; a row per run for a CSV trace.

``python -m evenkeel.plans.experiments NAME [FOLDER] [SCALE]`` runs one and writes FOLDER/NAME.csv. SCALE (1) multiplies
keys, capacities and updates. Cores are the session's: runs over several numbers of cores are several calls.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions.values import ValueSpec, counter
from evenkeel.operators.aggregate import group
from evenkeel.operators.histogram import Histogram
from evenkeel.operators.sharded import ShardedHistogram
from evenkeel.sources import workload
from evenkeel.sources.scratch import materialise

SECRET = bytes(range(16))


@dataclass(frozen=True)
class Run:
    """One run: ``kind`` is plain (a group-by), fixed, growing or sharded."""

    kind: str
    keys: int
    updates: int
    skew: float = 0.0
    capacity: int = 0  # 0: as many as keys
    z: int = 16
    interval: int = 20
    shards: int = 16
    batch: int = 4096


def _each(run: Run, **choices: list) -> list[Run]:
    runs = [run]
    for name, values in choices.items():
        runs = [replace(r, **{name: v}) for r in runs for v in values]
    return runs


M = 1_000_000
#: Sizes of the experiments.
EXPERIMENTS: dict[str, list[Run]] = {
    "query_scaling": _each(Run("fixed", 4 * M, 0, capacity=1 << 21), skew=[0, 1.3], updates=[1000, 10_000, 100_000, M, 2 * M], kind=["plain", "fixed"])
    + _each(Run("growing", 4 * M, 0, capacity=1 << 16), skew=[0, 1.3], updates=[1000, 10_000, 100_000, M, 2 * M]),
    "fixed_scaling": [Run("fixed", c // 2, 100_000, capacity=c) for c in (1 << n for n in range(16, 27, 2))],
    "resize_vs_fixed": _each(Run("growing", 4 * M, 500_000, capacity=1 << 16), skew=[0, 1.3]) + _each(Run("fixed", 4 * M, 500_000, capacity=1 << 22), skew=[0, 1.3]),
    "resize_amortized": [Run("growing", 1 << 24, 10 * M, 1.3, 1 << 16), Run("fixed", 1 << 24, 10 * M, 1.3, 1 << 25)],
    "z_a_sweep": _each(Run("fixed", 1 << 17, 2 * M, capacity=1 << 18), z=[4, 8, 16, 32], interval=[2, 8, 20, 40], skew=[0, 1.0]),
    "state_of_the_art": _each(Run("plain", 0, M), keys=[1 << 18, 1 << 22], kind=["plain", "fixed", "sharded"]),
    "quick_sota": _each(Run("plain", 1 << 18, 100_000), kind=["plain", "fixed", "sharded"]),
    "batch_size_sweep": [Run("sharded", 1 << 16, 10 * b, batch=b) for b in range(4096, 65_537, 8192)] + [Run("sharded", 1 << 16, 10 << 16, batch=1 << 16)],
    "auto_tuner": [Run("sharded", 1 << 16, 10 * b, shards=s, batch=b) for s in (16, 32, 64) for b in (1 << 14, 1 << 15, 1 << 16)],
    "ddos_telemetry": _each(Run("sharded", 1 << 17, 500_000), skew=[1.2, 2.5], kind=["plain", "sharded"]),
}


def scaled(run: Run, scale: float) -> Run:
    """Keys, updates and capacity times ``scale``; batches stay, as quotas depend on them."""
    times = lambda n: max(1, int(n * scale))
    return replace(run, keys=times(run.keys), updates=times(run.updates), capacity=max(run.z, times(run.capacity)) if run.capacity else 0)


def updates(spark: SparkSession, run: Run, seed: int = 0) -> DataFrame:
    """key, value: one row per update, of ``keys`` keys with Zipf weights."""
    drawn = workload.zipf(spark, run.updates, run.keys, run.skew, seed)
    return drawn.select(F.unhex(F.lpad(F.hex("idx"), 32, "0")).alias("key"), F.lit(1).cast("bigint").alias("value"))


def _histogram(spark: SparkSession, run: Run, spec: ValueSpec) -> Histogram | ShardedHistogram:
    capacity = run.capacity or max(run.z, run.keys)
    if run.kind == "sharded":
        return ShardedHistogram(spark, run.shards, capacity, run.batch, spec=spec, z=run.z, interval=run.interval, secret=SECRET, prf="sha")
    h = Histogram(spark, capacity, spec, run.z, interval=run.interval, secret=SECRET, prf="sha")
    if run.kind == "growing":
        h.enable_auto_resize(max(1, capacity // 2))
    return h


def measure(spark: SparkSession, name: str, run: Run, seed: int = 0) -> dict:
    """The run's parameters, seconds, microseconds an update, keys and growths; the sum of all values is checked."""
    rows = materialise(updates(spark, run, seed))
    start, grown = time.time(), 0
    if run.kind == "plain":
        state = materialise(group(rows, counter()))
    else:
        h = _histogram(spark, run, counter())
        h.append(rows)
        h.flush()
        state = h._all.commit() if isinstance(h, ShardedHistogram) else h.commit()
        grown = 0 if isinstance(h, ShardedHistogram) else h.grown
    seconds = time.time() - start
    found = state.agg(F.count(F.lit(1)).alias("keys"), F.sum("value").alias("total")).first()
    if found.total != run.updates:
        raise AssertionError(f"{name}: {found.total} updates counted of {run.updates}")
    return {"experiment": name} | asdict(run) | {"seconds": seconds, "us_per_update": 1e6 * seconds / run.updates, "found": found["keys"], "grown": grown}


def trace(spark: SparkSession, name: str, scale: float = 1.0) -> Iterator[dict]:
    """A row per run of the experiment, each when it is done."""
    if name not in EXPERIMENTS:
        raise ValueError(f"{name}: not one of {sorted(EXPERIMENTS)}")
    for run in EXPERIMENTS[name]:
        yield measure(spark, name, scaled(run, scale))


def write_csv(spark: SparkSession, rows: list[dict], folder: str, name: str) -> None:
    """One CSV file with a header below folder/name.csv, a row per run."""
    spark.createDataFrame(rows).select(*rows[0]).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder.rstrip('/')}/{name}.csv")


def main(name: str, folder: str = "benchmark_results", scale: str = "1") -> None:
    spark = SparkSession.builder.appName(name).getOrCreate()
    rows = []
    for row in trace(spark, name, float(scale)):
        print(row, flush=True)
        rows.append(row)
    write_csv(spark, rows, folder, name)


if __name__ == "__main__":
    main(*sys.argv[1:])
