"""The group-by itself: partial aggregate, exchange by key, final aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions.values import ValueSpec


def group(updates: DataFrame, spec: ValueSpec, key: str = "key", epoch: str | None = None) -> DataFrame:
    """One row per key; equal keys are merged on the map side first, so a hot key shuffles as a row per task."""
    more = [F.min(epoch).alias(epoch)] if epoch else []
    return updates.groupBy(key).agg(*spec.aggregates(), *more)


def merge(state: DataFrame, batch: DataFrame, spec: ValueSpec, key: str = "key", epoch: str | None = None) -> DataFrame:
    """The state after ``batch``: merged rows merge again, in any order and any split."""
    return group(state.unionByName(batch), spec, key, epoch)


def sorted_group(updates: DataFrame, spec: ValueSpec, key: str = "key") -> DataFrame:
    """As ``group``, ordered by key."""
    return group(updates, spec, key).orderBy(key)


def last_of_run(updates: DataFrame, key: str, totals: dict[str, Column]) -> DataFrame:
    """What the last row of each run of equal keys has when ``totals`` run over it: aggregates, merged on the map side first."""
    return updates.groupBy(key).agg(*(c.alias(n) for n, c in totals.items()))


def last_of_run_in_order(updates: DataFrame, key: str, order: list[str], totals: dict[str, Column]) -> DataFrame:
    """The window form, for totals that depend on the order: a key's rows meet in one task."""
    run = Window.partitionBy(key).orderBy(*order)
    back = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))
    rows = updates.withColumns({n: c.over(run) for n, c in totals.items()} | {"_back": F.row_number().over(back)})
    return rows.filter("_back = 1").select(key, *totals)


def count_matching(state: DataFrame, leaf: Column, leaves: list[int], epoch: int | None = None) -> DataFrame:
    """One row, matching: how many keys lie on one of ``leaves`` and are of ``epoch``."""
    match = leaf.isin(leaves)
    if epoch is not None:
        match = match & (F.col("epoch") == epoch)
    return state.agg(F.count_if(match).alias("matching"))


def count_where(state: DataFrame, predicate: Column) -> DataFrame:
    return state.agg(F.count_if(predicate).alias("matching"))


def occupancy(state: DataFrame) -> DataFrame:
    return state.agg(F.count(F.lit(1)).alias("occupancy"))
