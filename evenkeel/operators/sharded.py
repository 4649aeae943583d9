"""The sharded histogram: keys are dealt to shards by tag, batches have fixed quotas.

A flush is one aggregation: partial by input partition, exchange by batch and key, final; a frame of many
batches is flushed at once, with the quota checked for each. Shards are a column, so
readouts by shard are padded per group, and partitions by shard only where files per shard are asked for.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions import keys, sizing
from evenkeel.functions.values import ValueSpec, counter
from evenkeel.operators import shape
from evenkeel.operators.aggregate import group
from evenkeel.operators.histogram import Histogram
from evenkeel.operators.resize import Controller
from evenkeel.sources.scratch import materialise


class PendingRows(RuntimeError):
    """A histogram was left with updates that weren't flushed."""


@dataclass
class ShardedHistogram:
    spark: SparkSession
    shards: int = 4
    capacity: int = 4096
    batch: int = 1024
    quota: int | None = None
    frontends: int = sizing.FRONTENDS
    spec: ValueSpec = field(default_factory=counter)
    z: int = 16
    stash: int = 64
    interval: int = 20
    key_bytes: int = keys.KEY_BYTES
    secret: bytes | None = None
    prf: str = "aes"
    #: What a flush does with its merged rows (key, value fields, shard, _batch) before they are kept: rows of the same columns.
    step: Callable[[DataFrame], DataFrame] | None = None

    def __post_init__(self):
        if self.shards < 1 or self.shards & (self.shards - 1):
            raise ValueError("the number of shards must be a power of two")
        if self.quota is None:
            self.quota = sizing.suggested_per_shard_quota(self.batch, self.shards, 80, self.frontends)
        self._all = Histogram(self.spark, max(1, self.capacity // self.shards), self.spec, self.z, self.stash, self.interval, self.key_bytes, self.secret, self.prf)
        self._waiting: list[DataFrame] = []
        self._rows = 0
        self._start = self.capacity
        self.last_loads: DataFrame | None = None

    # Updates

    def append(self, updates: DataFrame) -> None:
        """Adds updates, in the order of the frame; each full batch is flushed, whatever the frames' sizes."""
        rows = keys.checked(updates.select("key", *self.spec.names), "key", self.key_bytes).withColumn("key", keys.pad("key", self.key_bytes))
        rows = shape.numbered(rows, "_row").withColumn("_row", F.col("_row") + self._rows)
        n = rows.count()
        if n:
            self._waiting.append(rows)
            self._rows += n
        if self._rows >= self.batch:
            self._flush(self._rows // self.batch * self.batch)

    def increment_blocks(self, blocks: DataFrame) -> None:
        """Adds prepared rows, such as those of another histogram's export."""
        self.append(blocks.select("key", *self.spec.names))

    def flush(self) -> None:
        """Merges what waits, also where it isn't a full batch."""
        if self._waiting:
            self._flush(self._rows)

    def _flush(self, n: int) -> None:
        """Merges the first ``n`` updates, batch by batch in one aggregation, checks each batch's quota, then resizes if due."""
        rows = functools.reduce(DataFrame.unionByName, self._waiting)
        now = rows.filter(F.col("_row") < n) if n < self._rows else rows
        batches = -(-n // self.batch)
        batch = F.floor(F.col("_row") / self.batch).cast("bigint") if batches > 1 else F.lit(0).cast("bigint")
        merged = now.withColumn("_batch", batch).groupBy("_batch", "key").agg(*self.spec.aggregates())
        routed = materialise(merged.withColumn("shard", keys.shard(self._all.tag(), self.shards)))
        if self.step is not None:
            routed = materialise(self.step(routed))
        self.last_loads = shape.loads(routed.filter(F.col("_batch") == batches - 1), "shard", self.shards)
        load = routed.groupBy("_batch", "shard").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if load > self.quota:
            raise shape.QuotaOverflow(load, self.quota)
        # A key has a row for each batch here; the commit merges them.
        self._all.append(routed, n)
        self._all.commit()
        self.capacity = self._start << self._all.grown
        self._rows -= n
        self._waiting = [rows.filter(F.col("_row") >= n).withColumn("_row", F.col("_row") - n)] if self._rows else []

    def fixed_batch(self, updates: DataFrame, sends: int | None = 1) -> DataFrame:
        """What ``sends`` flushes would send: exactly ``quota`` slots for each shard and send, after merging. None: as many as the largest shard needs."""
        rows = group(keys.checked(updates, "key", self.key_bytes).withColumn("key", keys.pad("key", self.key_bytes)), self.spec)
        routed = rows.withColumn("tag", self._all.tag()).withColumn("shard", keys.shard(F.col("tag"), self.shards))
        if sends is None:
            routed = materialise(routed)
        load = shape.max_load(routed, "shard")
        if sends is None:
            sends = shape.pages(load, self.quota)
        if load > self.quota * sends:
            raise shape.QuotaOverflow(load, self.quota)
        fill = shape.padded_groups if sends == 1 else shape.long_groups
        return fill(routed, "shard", self.shards, self.quota * sends, [keys.unsigned_order(F.col("tag")), F.col("key")])

    # Growth: shard 0 decides for all.

    def enable_auto_resize(self, t_capacity: int, eps: float = 1.0, alpha: float = 0.05, seed: int = 0) -> None:
        target = sizing.deflated_per_shard_resize_target(t_capacity, self.shards, self.z)
        self._all.enable_auto_resize(target, eps, alpha, seed)
        self._all.watched = self.shards

    @property
    def controller(self) -> Controller | None:
        return self._all.controller

    def grow(self) -> None:
        self._all.grow()
        self.capacity = self._start << self._all.grown

    # Lookups

    def peek_total(self, key: bytes) -> DataFrame:
        self.flush()
        return self._all.peek_total(key)

    def pop_total(self, key: bytes) -> DataFrame:
        self.flush()
        return self._all.pop_total(key)

    # Readouts

    def routed(self) -> DataFrame:
        rows = self._all.tagged()
        return rows.withColumn("shard", keys.shard(F.col("tag"), self.shards))

    @property
    def shard_readout_len(self) -> int:
        return self._all.readout_len

    @property
    def readout_len(self) -> int:
        return self.shards * self.shard_readout_len

    def _by_shard(self, order: list) -> DataFrame:
        self.flush()
        rows = self.routed()
        load = shape.max_load(rows, "shard")
        if load > self.shard_readout_len:
            raise shape.CapacityExceeded(f"a shard has {load} keys, its readout {self.shard_readout_len} slots")
        return shape.padded_groups(rows, "shard", self.shards, self.shard_readout_len, order)

    def readout(self) -> DataFrame:
        """``readout_len`` rows: real ones first, shard by shard, within a shard by key; the rest after them."""
        rows = self._by_shard([F.col("key")]).withColumnRenamed("slot", "shard_slot")
        return shape.ranks(rows, [~F.col("is_real"), F.col("shard"), F.col("shard_slot")])

    def readout_tree_aware(self) -> DataFrame:
        """Each shard's rows in routing order, padded to one length for all."""
        return self._by_shard([keys.routing_bits(F.col("tag")), F.shiftrightunsigned("tag", 32), F.col("key")])

    def into_readout_subtree_partitioned(self, local_height: int, emit: Callable[[int, DataFrame], None], security_bits: int = 80) -> None:
        """Calls ``emit(shard, rows)`` for one shard after the other; the state is empty afterwards."""
        self.flush()
        rows = materialise(self.routed())
        cut = self._all.height - local_height
        if cut > 0:
            count, inbox, chunk = sizing.subtree_sizes(self._all.height, local_height, self.z, self.stash, security_bits)
        else:
            count, inbox, chunk, cut = 1, 0, self.shard_readout_len, 0
        of = rows.withColumn("subtree", keys.subtree(F.col("tag"), cut) if cut else F.lit(0))
        load = of.groupBy("shard", "subtree").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if load > chunk:
            raise shape.SubtreeReadoutOverflow(load, inbox, count)
        order = [keys.routing_bits(F.col("tag")), F.shiftrightunsigned("tag", 32), F.col("key")]
        for s in range(self.shards):
            emit(s, shape.padded_groups(of.filter(F.col("shard") == s).drop("shard"), "subtree", count, chunk, order))
        self._all._state = self._all._empty()

    def export_entries(self) -> DataFrame:
        self.flush()
        return self._all.export_entries()

    def write_by_shard(self, path: str) -> None:
        """One file for each shard, in a folder of its own."""
        self.flush()
        shape.dealt_by_shard(self.routed(), self.shards).write.partitionBy("shard").parquet(path)

    # Guard and figures

    def __enter__(self) -> ShardedHistogram:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None:
            self.flush()
        elif self._waiting:
            raise PendingRows(f"{self._rows} updates weren't flushed") from error

    @property
    def pending(self) -> int:
        return self._rows

    @property
    def total_capacity(self) -> int:
        return self.shards * self._all.total_capacity

    @property
    def shard_capacity(self) -> int:
        return self._all.total_capacity

    def occupancy(self) -> int:
        return self._all.occupancy()
