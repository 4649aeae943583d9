"""A keyed histogram: append, lookups with and without removal, and readouts of fixed length.

State is a table of merged rows (key, value fields, epoch) in the shared folder, one version per commit; a
commit merges the pending updates in one aggregation. Files are ordered by key, so that a lookup reads the
row groups around its key only. Keys that were taken out are left out by a filter until the next commit
writes the state anyway. Tags are computed on merged rows only.

With a controller a commit checks for growth as often as its updates would have, while they came in: its
new keys are taken in pieces of the target size, which doubles as the histogram does, and keys that come
after a growth are of the next epoch. However large a frame, that is some checks and one new version of the state.

Fixed lengths bound what is returned, not what memory is touched: this is no side-channel protection.
"""

from __future__ import annotations

import functools
import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions import keys, sizing
from evenkeel.functions.values import ValueSpec, counter
from evenkeel.operators import shape
from evenkeel.operators.aggregate import group
from evenkeel.operators.resize import Controller
from evenkeel.sources.scratch import materialise


#: Keys taken out that are left out by a filter; then the state is written anew.
MOST_GONE = 100


@dataclass
class Histogram:
    """A single histogram of capacity 2^height * z; updates have a column ``key`` and the fields of ``spec``."""

    spark: SparkSession
    capacity: int = 1024
    spec: ValueSpec = field(default_factory=counter)
    z: int = 16
    stash: int = 64
    interval: int = 20
    key_bytes: int = keys.KEY_BYTES
    secret: bytes | None = None
    prf: str = "aes"
    epoch: int = 0
    controller: Controller | None = None
    grown: int = 0
    watched: int = 1  # the controller looks at the first of so many shards

    def __post_init__(self):
        self.secret = self.secret or keys.new_key()
        self.height = sizing.tree_height(self.capacity, self.z)
        self._pending: list[DataFrame] = []
        self._state: DataFrame | None = None
        self._stand_for: list[int | None] = []
        self._gone: list[bytes] = []  # keys that are left out of what the state's files hold

    # Updates

    def append(self, updates: DataFrame, stands_for: int | None = None) -> None:
        """Adds updates; they are merged at the next commit. Null or overlong keys make that fail.

        Merged rows stand for more updates, which the controller counts.
        """
        rows = keys.checked(updates.select("key", *self.spec.names), "key", self.key_bytes)
        self._pending.append(rows.withColumn("key", keys.pad("key", self.key_bytes)).withColumn("epoch", F.lit(self.epoch).cast("smallint")))
        self._stand_for.append(stands_for)

    def flush(self) -> None:
        """Nothing: a single histogram has no batches."""

    def commit(self) -> DataFrame:
        """Merges what is pending; the state: key, value fields, epoch, one row per key."""
        if self._state is None and not self._pending:
            return self._empty()
        if self._pending:
            self._state = materialise(self.merged())
            self._pending, self._stand_for, self._gone = [], [], []
        return self._state

    def merged(self) -> DataFrame:
        """The state with what is pending, not written yet; growth that is due is made."""
        rows = functools.reduce(DataFrame.unionByName, self._pending)
        if self.controller is not None:
            rows = self._staged(rows)
        if self._state is not None:
            rows = rows.unionByName(self._state)
        return group(rows, self.spec, "key", "epoch").sortWithinPartitions("key")

    # State that others keep

    def save(self) -> dict:
        """What is beside the rows of the state: height, epoch, growth and the controller."""
        return {"height": self.height, "epoch": self.epoch, "grown": self.grown, "controller": self.controller.save() if self.controller else None}

    def restore(self, state: DataFrame, saved: dict) -> None:
        """Takes over rows of a state and what ``save`` gave with them; the other parameters must be the same, the secret too."""
        self._state, self._pending, self._stand_for, self._gone = state, [], [], []
        self.height, self.epoch, self.grown = saved["height"], saved["epoch"], saved["grown"]
        if (self.controller is None) != (saved["controller"] is None):
            raise ValueError("the state was kept with another setting of auto resize")
        if self.controller:
            self.controller.restore(saved["controller"])

    def _staged(self, rows: DataFrame) -> DataFrame:
        """``rows`` merged, with the epochs that they get if the histogram grows while they come in."""
        merged = rows.groupBy("key").agg(*self.spec.aggregates(), F.min("epoch").alias("epoch"), F.count(F.lit(1)).alias("_updates"))
        merged = materialise(merged.withColumns({"tag": self.tag(), "_deal": (F.pmod(F.xxhash64("key"), F.lit(1 << 30)) + 1) / (1 << 30)}))
        updates = sum(self._stand_for) if None not in self._stand_for else merged.agg(F.sum("_updates")).first()[0] or 0
        self.controller.waiting += updates // self.watched
        new = merged if self._state is None else merged.join(self._state.select("key"), "key", "left_anti")
        watch = keys.shard(F.col("tag"), self.watched) == 0
        new = materialise(new.filter(watch).select("tag", "_deal"))
        keys_new, since, came, failed, epochs = max(1, new.count()), 0.0, 0, 0, []
        while self.controller.due and came < keys_new:
            came = min(keys_new, came + (self.controller.t_capacity << max(0, failed - 1)))
            upto, failed = came / keys_new, failed + 1
            seen = new.filter((F.col("_deal") > since) & (F.col("_deal") <= upto)).select("tag")
            if not epochs and self._state is not None:
                seen = seen.unionByName(self._state.filter(F.col("epoch") == self.epoch).select(self.tag().alias("tag")).filter(watch))
            if self.controller.check(seen, self.height):
                epochs.append((upto, self.epoch))
                since, failed = upto, 0
                self._double()
        epoch = F.lit(self.epoch) if epochs else F.col("epoch")
        for upto, e in reversed(epochs):
            epoch = F.when(F.col("_deal") <= upto, F.lit(e)).otherwise(epoch)
        # All keys are in: what is left of the updates would be checked on the same rows again.
        self.controller.waiting %= self.controller.k * self.controller.interval
        return merged.withColumn("epoch", epoch.cast("smallint")).drop("tag", "_deal", "_updates")

    def _empty(self) -> DataFrame:
        kinds = ", ".join(f"{f.name} {'decimal(20,0)' if f.merge == 'wrap64' else f.type}" for f in self.spec.fields)
        return self.spark.createDataFrame([], f"key binary, {kinds}, epoch smallint")

    def tagged(self) -> DataFrame:
        rows = self.commit()
        # Only merged rows are tagged. A key is padded to whole blocks before, which leaves its tag as it is.
        return rows.withColumn("tag", self.tag())

    def tag(self):
        """The tag of the column ``key`` of padded keys: keyed (aes), or one that other engines compute too (sha)."""
        return keys.sha_tag(F.col("key")) if self.prf == "sha" else keys.aes_tag("key", self.secret, self.key_bytes)

    # Lookups

    def _wanted(self, key: bytes) -> bytes:
        if len(key) > self.key_bytes:
            raise ValueError(f"key of more than {self.key_bytes} bytes")
        return key.ljust(self.key_bytes, b"\0")

    def peek_total(self, key: bytes) -> DataFrame:
        """One row with the value fields; the defaults if the key is absent."""
        found = self.commit().filter(F.col("key") == F.lit(self._wanted(key)))
        one = self.spark.range(1).select(F.lit(self._wanted(key)).alias("key"))
        return one.join(found, "key", "left").select(*self.spec.or_default())

    def pop_total(self, key: bytes) -> DataFrame:
        """As ``peek_total``; the key is gone afterwards."""
        value = materialise(self.peek_total(key))
        self._gone.append(self._wanted(key))
        self._state = self.commit().filter(F.col("key") != F.lit(self._wanted(key)))
        if len(self._gone) >= MOST_GONE:
            self._state, self._gone = materialise(self._state), []
        return value

    # Readouts

    @property
    def readout_len(self) -> int:
        return sizing.readout_len(self.height, self.z, self.stash)

    def _padded(self, order: list, page: int | None = None) -> DataFrame:
        rows = self.tagged()
        n = rows.count()
        if page is None and n > self.readout_len:
            raise shape.CapacityExceeded(f"{n} keys, the readout has {self.readout_len} slots")
        if page is not None and n > self.readout_len:
            warnings.warn(f"{n} keys take {shape.pages(n, self.readout_len)} pages of {self.readout_len} slots; this is page {page}", stacklevel=3)
        return shape.page_of(shape.ranks(rows, order), self.readout_len, page or 0, n)

    @property
    def _route_order(self) -> list:
        return [keys.routing_bits(F.col("tag")), F.shiftrightunsigned("tag", 32), F.col("key")]

    def readout(self, page: int | None = None) -> DataFrame:
        """``readout_len`` rows, the real ones first, ordered by key: slot, is_real, tag, epoch, key, value fields.

        More keys than slots are an error; with a ``page`` (from 0 on), that page of all keys, with a warning that there are more.
        """
        return self._padded([F.col("key")], page)

    def readout_tree_aware(self, page: int | None = None) -> DataFrame:
        """The same rows in the order of routing bits, tag and key."""
        return self._padded(self._route_order, page)

    def readout_pages(self, tree_aware: bool = False) -> DataFrame:
        """All pages, with a column ``page``: every key, in as many readouts of ``readout_len`` slots as that takes. Their number shows the number of keys in pages."""
        rows = self.tagged()
        n, length = rows.count(), self.readout_len
        every = shape.padded(shape.ranks(rows, self._route_order if tree_aware else [F.col("key")]), shape.pages(n, length) * length, n)
        return every.withColumns({"page": F.expr(f"slot div {length}"), "slot": F.col("slot") % length})

    def into_readout_tree_aware(self, paged: bool = False) -> DataFrame:
        """As ``readout_tree_aware``; the state is empty afterwards.

        ``paged``: the first page of it; keys that it doesn't hold stay in the state, for the next call.
        """
        if not paged:
            rows = materialise(self.readout_tree_aware())
            self._state = self._empty()
            return rows
        rows = materialise(self.readout_tree_aware(0))
        left = self.commit().join(rows.filter("is_real").select("key"), "key", "left_anti").select(self.commit().columns)
        self._state = materialise(left.repartitionByRange("key").sortWithinPartitions("key"))
        return rows

    def readout_subtree_partitioned(self, local_height: int, security_bits: int = 80, chunks: int | None = 1) -> DataFrame:
        """``chunks`` chunks of fixed length for each subtree; ``SubtreeReadoutOverflow`` if one holds more. None: as many as the largest needs."""
        if local_height >= self.height:
            rows = self.readout_tree_aware() if chunks == 1 else self._one_subtree(chunks)
            return rows.withColumn("subtree", F.lit(0))
        count, inbox, chunk = sizing.subtree_sizes(self.height, local_height, self.z, self.stash, security_bits)
        rows = self.tagged().withColumn("subtree", keys.subtree(F.col("tag"), self.height - local_height))
        load = shape.max_load(rows, "subtree")
        if chunks is None:
            chunks = shape.pages(load, chunk)
        if load > chunk * chunks:
            raise shape.SubtreeReadoutOverflow(load, inbox, count)
        fill = shape.padded_groups if chunks == 1 else shape.long_groups
        return fill(rows, "subtree", count, chunk * chunks, self._route_order)

    def _one_subtree(self, chunks: int | None) -> DataFrame:
        rows = self.tagged()
        n = rows.count()
        length = self.readout_len * (shape.pages(n, self.readout_len) if chunks is None else chunks)
        return shape.padded(shape.ranks(rows, self._route_order), length, n)

    def export_entries(self) -> DataFrame:
        """Only real rows, ordered by key; shows how many keys there are."""
        return self.tagged().select("tag", "key", *self.spec.names).orderBy("key")

    # Capacity

    def grow(self) -> None:
        """Doubles the capacity; rows stay as they are, later ones are of the next epoch."""
        self.commit()
        self._double()

    def _double(self) -> None:
        self.height += 1
        self.grown += 1
        self.epoch = min(self.epoch + 1, 255)
        if self.controller:
            self.controller.on_grown(self.height)

    def enable_auto_resize(self, t_capacity: int, eps: float = 1.0, alpha: float = 0.05, seed: int = 0) -> None:
        self.controller = Controller(t_capacity, self.z, self.interval, self.height, eps, alpha, seed)

    def resize_if_due(self) -> bool:
        """One check of the controller on the committed state, whatever it stands for; a commit makes those that are due."""
        if self.controller is None:
            return False
        rows = self.tagged().filter(keys.shard(F.col("tag"), self.watched) == 0)
        grow = self.controller.check(rows.filter(F.col("epoch") == self.epoch), self.height)
        if grow:
            self.grow()
        return grow

    @property
    def total_capacity(self) -> int:
        return sizing.tree_capacity(self.height, self.z)

    def occupancy(self) -> int:
        return self.commit().count()
