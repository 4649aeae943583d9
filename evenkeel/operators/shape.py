"""Outputs whose number of rows is fixed by public parameters.

Padding is a union of ranked rows with the slots that are left, made by ``range``, so it is spread over
tasks at any length and shuffles nothing. Global ranks come from ``ranks``: a count per range partition,
then places within each, so no task sees all rows. Nothing is cut to fit: more rows than slots is an error,
or goes to further pages of the same length where the caller asks for pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.sources.scratch import materialise


class CapacityExceeded(ValueError):
    """More real rows than the fixed length holds."""


class QuotaOverflow(ValueError):
    """A shard's load is over its quota."""

    def __init__(self, max_load: int, quota: int):
        super().__init__(f"a shard has {max_load} rows, its quota is {quota}")
        self.max_load, self.quota = max_load, quota


class SubtreeReadoutOverflow(ValueError):
    """A subtree's load is over its inbox."""

    def __init__(self, max_load: int, inbox_len: int, subtree_count: int):
        super().__init__(f"a subtree has {max_load} rows, inboxes have {inbox_len}, of {subtree_count}")
        self.max_load, self.inbox_len, self.subtree_count = max_load, inbox_len, subtree_count


def numbered(rows: DataFrame, out: str) -> DataFrame:
    """``rows``, written once, with their number from 0 on: partition after partition, in the order within each.

    The partitions' sizes are summed, a row per partition; nothing is shuffled.
    """
    held = materialise(rows.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    size = held.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    size = F.broadcast(size.select("_p", before.alias("_before")))  # a row per partition
    return held.join(size, part == F.col("_p")).withColumn(out, F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_p", "_before")


def ranks(rows: DataFrame, order: list[Column], out: str = "slot") -> DataFrame:
    """``rows`` with their number from 0 on in the order of ``order``: one shuffle, by range, and a sort in each partition."""
    names = [f"_o{i}" for i in range(len(order))]
    dealt = rows.withColumns(dict(zip(names, order))).repartitionByRange(*names).sortWithinPartitions(*names)
    return numbered(dealt.drop(*names), out)


def prefix_marks(rows: DataFrame, flag: Column, order: list[Column], out: str = "mark") -> DataFrame:
    """``rows`` with the number of flagged rows before each, in order: where a flagged row goes when compacted."""
    numbered = ranks(rows, order, "_at").withColumn("_block", F.floor(F.col("_at") / 65536))
    counts = numbered.groupBy("_block").agg(F.count_if(flag).alias("_c"))
    earlier = F.coalesce(F.sum("_c").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("_block").alias("_b"), earlier.alias("_earlier"))
    own = F.coalesce(F.sum(F.when(flag, 1).otherwise(0)).over(Window.partitionBy("_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return numbered.withColumn("_own", own).join(counts, F.col("_block") == F.col("_b")).withColumn(out, (F.col("_own") + F.col("_earlier")).cast("bigint")).drop("_at", "_block", "_b", "_own", "_earlier")


def padded(rows: DataFrame, length: int, n: int | None = None, slot: str = "slot", real: str = "is_real") -> DataFrame:
    """Exactly ``length`` rows, slots 0 to length - 1, for ranked ``rows`` (``n`` if known): the slots after theirs have nulls and ``is_real`` false."""
    n = rows.count() if n is None else n
    if n > length:
        raise CapacityExceeded(f"{n} rows, {length} slots")
    return _with_empty(rows, rows.sparkSession.range(n, length).select(F.col("id").alias(slot)), real)


def _with_empty(rows: DataFrame, slots: DataFrame, real: str) -> DataFrame:
    """``rows`` and, with nulls in all other columns, ``slots``: a union, nothing is shuffled."""
    return rows.withColumn(real, F.lit(True)).unionByName(slots.withColumn(real, F.lit(False)), allowMissingColumns=True)


def padded_groups(rows: DataFrame, group: str, groups: int, length: int, order: list[Column], slot: str = "slot", real: str = "is_real") -> DataFrame:
    """``length`` rows for each of ``groups`` groups, real ones first, in ``order``.

    ``length`` is the caller's fixed quota, so no group's window holds more than that.
    """
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    placed = rows.withColumns({group: F.col(group).cast("int"), slot: place.cast("bigint")})
    # The empty slots follow from the groups' sizes, a row per group.
    span = F.explode(F.sequence(F.col("load"), F.lit(length - 1)))
    empty = loads(rows, group, groups).filter(F.col("load") < length).select(group, span.alias(slot))
    return _with_empty(placed, empty, real)


def page_of(ranked: DataFrame, length: int, page: int, n: int, slot: str = "slot", real: str = "is_real") -> DataFrame:
    """Page ``page`` (from 0 on) of ``n`` ranked rows, ``length`` slots from 0 on each: what doesn't fit one page is on the next ones."""
    at = F.col(slot) - page * length
    return padded(ranked.filter((at >= 0) & (at < length)).withColumn(slot, at), length, min(max(n - page * length, 0), length), slot, real)


def pages(n: int, length: int) -> int:
    """Pages of ``length`` slots that ``n`` rows take, one at least."""
    return max(1, -(-n // length))


def long_groups(rows: DataFrame, group: str, groups: int, length: int, order: list[Column], slot: str = "slot", real: str = "is_real") -> DataFrame:
    """As ``padded_groups``, for a ``length`` that follows from the rows: places come from one ranking by group and ``order``, so no task sees a whole group."""
    ranked = ranks(rows.withColumn(group, F.col(group).cast("int")), [F.col(group), *order], "_at")
    size = loads(ranked, group, groups)
    before = F.coalesce(F.sum("load").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    size = F.broadcast(size.select(group, "load", before.alias("_before")))  # a row per group
    placed = ranked.join(size, group).withColumn(slot, F.col("_at") - F.col("_before")).drop("_at", "_before", "load")
    every = rows.sparkSession.range(groups * length).select((F.expr(f"id div {length}")).cast("int").alias(group), (F.col("id") % length).alias(slot))
    empty = every.join(size, group).filter(F.col(slot) >= F.col("load")).select(group, slot)
    return _with_empty(placed, empty, real)


def loads(rows: DataFrame, group: str, groups: int, out: str = "load") -> DataFrame:
    """Rows of each group, zeros kept."""
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias(out))
    every = rows.sparkSession.range(groups).select(F.col("id").cast("int").alias(group))
    return every.join(counts.withColumn(group, F.col(group).cast("int")), group, "left").withColumn(out, F.coalesce(out, F.lit(0)).cast("bigint"))


def max_load(rows: DataFrame, group: str) -> int:
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def marks(load: list[int], quota: int) -> list[int]:
    """Running number of real rows before each slot when each group has ``quota`` slots; the total at the end."""
    out, seen = [], 0
    for n in load:
        for i in range(quota):
            out.append(seen + min(i, n))
        seen += n
    return [*out, seen]


def distributed(rows: DataFrame, slots: DataFrame, by: str = "rank") -> DataFrame:
    """Each row at the slot that ``slots`` (rank, slot) gives for its rank."""
    return rows.join(slots, by).drop(by)


def topk(rows: DataFrame, by: str, tie: list[str], k: int = 10) -> DataFrame:
    return rows.orderBy(F.col(by).desc(), *tie).limit(k)


def dealt_by_shard(rows: DataFrame, shards: int, shard: str = "shard") -> DataFrame:
    """One partition, and one file when written, for each shard."""
    return rows.repartitionById(shards, F.col(shard))
