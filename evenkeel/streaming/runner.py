"""Streams of updates: a histogram as state of a Structured Streaming query.

``run`` merges each micro-batch into a versioned Parquet state: a version is written before its log entry
is, and a batch that is replayed after a failure starts from the version of the batch before it, with the
height, epoch and controller that this one was left with: totals are exact and growth is drawn the same
again. ``restored`` is the histogram for readouts and lookups. ``running_totals`` is the built-in
alternative: state in Spark's own store, no readouts.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evenkeel.functions import keys
from evenkeel.functions.values import ValueSpec
from evenkeel.operators.aggregate import group
from evenkeel.operators.histogram import Histogram
from evenkeel.sources.scratch import delete, materialise


class StateTable:
    """Versions of a state below one folder, of the last ``keep`` batches; a version is valid once its log entry is written.

    Frames that read a version fail once it is deleted: keep as many as the slowest reader needs.
    """

    def __init__(self, spark: SparkSession, folder: str, keep: int = 2):
        if keep < 2:
            raise ValueError("a replayed batch needs the version before it: keep two at least")
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep

    def entries(self) -> list[dict]:
        """The log, oldest first: the entries of ``keep`` batches, or somewhat more after a failure."""
        try:
            lines = self.spark.read.text(f"{self.folder}/log/*").collect()
        except Exception as e:  # there's none before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []
        return sorted((json.loads(r.value) for r in lines), key=lambda e: (e["batch"], e["turn"]))

    def entry(self, before: int | None = None) -> dict | None:
        """The latest entry, or the latest one of a batch before ``before``."""
        found = [e for e in self.entries() if before is None or e["batch"] < before]
        return found[-1] if found else None

    def read(self, before: int | None = None) -> DataFrame | None:
        e = self.entry(before)
        return self.spark.read.parquet(e["path"]) if e else None

    def write(self, batch: int, rows: DataFrame, saved: Callable[[], dict] = dict) -> None:
        """A version after ``batch``, beside earlier ones of the same batch; ``saved`` is called when its rows are written."""
        known = self.entries()
        turn = 1 + max((e["turn"] for e in known if e["batch"] == batch), default=-1)
        name = f"{batch:012d}-{turn:06d}"
        path = f"{self.folder}/version-{name}"
        rows.write.mode("overwrite").parquet(path)  # what a writer that failed has left
        entry = json.dumps(saved() | {"batch": batch, "turn": turn, "path": path, "log": f"{self.folder}/log/{name}"})
        self.spark.createDataFrame([(entry,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/log/{name}")
        kept = sorted({e["batch"] for e in known} | {batch})[-self.keep :]
        for old in known:
            if old["batch"] < kept[0]:
                delete(self.spark, old["log"])
                delete(self.spark, old["path"])


def run(updates: DataFrame, make: Callable[[], Histogram], state: StateTable, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts the query: ``updates`` is a streaming frame of key and value fields.

    ``make`` gives an empty histogram, each time with the same parameters and the same secret; with a
    controller it grows as batches come in.
    """

    def commit(batch: DataFrame, number: int) -> None:
        h = restored(state, make, number)
        h.append(batch)
        state.write(number, h.merged(), h.save)

    writer = updates.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def restored(state: StateTable, make: Callable[[], Histogram], before: int | None = None) -> Histogram:
    """The histogram of the latest version (of a batch before ``before``); an empty one if there is none."""
    h, entry = make(), state.entry(before)
    if entry:
        h.restore(state.spark.read.parquet(entry["path"]), entry)
    return h


def running_totals(updates: DataFrame, spec: ValueSpec, key: str = "key") -> DataFrame:
    """The streaming aggregate for output mode update or complete."""
    return group(updates, spec, key)


def pop(state: StateTable, key: bytes) -> DataFrame | None:
    """Removes a key while the query is stopped: its row (none if absent); the state goes on without it."""
    entry = state.entry()
    if entry is None:
        return None
    rows = state.spark.read.parquet(entry["path"])
    wanted = F.lit(key.ljust(keys.KEY_BYTES, b"\0"))
    out = materialise(rows.filter(F.col("key") == wanted))
    state.write(entry["batch"], rows.filter(F.col("key") != wanted), lambda: entry)
    return out
