"""File changes as a stream: moves split, bursts debounced, the latest operation of each path kept as state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType
from ..operators.state import manifest_diff

ATTEMPTS = 3
QUEUE = "path string, op string, seq long, attempts int"
ADMITTED = "root string, kind string, path string, dest string, ts timestamp, dropped long"
ADMITTED_COLUMNS = ["root", "kind", "path", "dest", "ts", "dropped"]


def operations(events: DataFrame) -> DataFrame:
    """(path, op, ts): created, modified and deleted files; a move deletes its source and upserts its destination."""
    move = F.array(F.struct(F.col("path"), F.lit("delete").alias("op")), F.struct(F.col("dest").alias("path"), F.lit("upsert").alias("op")))
    one = F.array(F.struct(F.col("path"), F.when(F.col("kind") == "deleted", "delete").otherwise("upsert").alias("op")))
    return events.select("ts", F.explode(F.when(F.col("kind") == "moved", move).otherwise(one)).alias("o")).select("o.path", "o.op", "ts")


def debounced(ops: DataFrame, gap: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """(path, ended, op, events): one row after each burst with its last operation; later events than ``late`` are left to the full diff."""
    burst = F.session_window("ts", gap)
    out = ops.withWatermark("ts", late).groupBy("path", burst.alias("w")).agg(F.max_by("op", "ts").alias("op"), F.count(F.lit(1)).alias("events"))
    return out.select("path", F.col("w.end").alias("ended"), "op", "events")


def with_subtrees(ops: DataFrame, manifest: DataFrame) -> DataFrame:
    """``ops`` (path, op, ..) and, for each deleted folder, a delete of every file of the manifest (path) below it.

    Files name all their folders, so a stream of operations meets the table in an equi-join.
    """
    parts = F.split(F.lower("path"), r"[/\\]")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    below = manifest.select(F.col("path").alias("__file"), F.explode(above).alias("__dir"))
    gone = ops.where("op = 'delete'").withColumn("__dir", F.regexp_replace(F.lower("path"), r"\\", "/")).join(below, "__dir")
    return ops.unionByName(gone.withColumn("path", F.col("__file")).select(ops.columns))


def overflow(events: DataFrame, per_second: int = 400, late: str = "10 seconds") -> DataFrame:
    """(second, events, dropped) of the seconds with more events than are taken: what is dropped calls for a full diff."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", "1 second").alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return counted.where(F.col("events") > per_second).select(F.col("w.start").alias("second"), "events", (F.col("events") - per_second).alias("dropped"))


class Admission(StatefulProcessor):
    """Per watched root: when its window began and how many events it has taken.

    A window is not bound to the clock: the first event a second or more after the last one's begin opens the next.
    """

    def __init__(self, per_second: int):
        self.most = per_second

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", StructType([StructField("began", LongType()), StructField("taken", LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        began, taken = self.window.get() if self.window.exists() else (None, 0)
        dropped, last = 0, None
        for batch in rows:
            batch = batch.sort_values(["ts", "path"], kind="stable")
            keep = []
            for at in batch["ts"].astype("datetime64[us]").astype("int64"):
                if began is None or at - began >= 1_000_000:
                    began, taken = int(at), 0
                taken += 1
                keep.append(taken <= self.most)
            out = batch.loc[keep, ["kind", "path", "dest", "ts"]]
            if len(out):
                yield out.assign(root=key[0], dropped=0)[ADMITTED_COLUMNS]
            if len(out) < len(batch):
                dropped += len(batch) - len(out)
                newest = batch["ts"].max()
                last = newest if last is None else max(last, newest)
        if began is not None:
            self.window.update((began, taken))
        if dropped:
            yield pd.DataFrame({"root": [key[0]], "kind": ["reconcile"], "path": [key[0]], "dest": [None], "ts": [last], "dropped": [dropped]})

    def close(self) -> None:
        pass


def admitted(events: DataFrame, per_second: int = 400) -> DataFrame:
    """(root, kind, path, dest, ts, dropped): the events of (root, kind, path, dest, ts) that are taken, and reconcile requests.

    Of each root at most ``per_second`` events a window are taken; windows open with an event, not with a second of the
    clock. A micro-batch that drops some gives one row of kind ``reconcile`` for the root with their number; its full diff
    finds what they were about. Late events count in the running window. Rows without a root, path or time are left
    out. Needs the RocksDB state store provider.
    """
    keyed = events.select("root", "kind", "path", "dest", "ts").where("root IS NOT NULL AND path IS NOT NULL AND ts IS NOT NULL")
    return keyed.groupBy("root").transformWithStateInPandas(Admission(per_second), outputStructType=ADMITTED, outputMode="Append", timeMode="None")


def reconciled(taken: DataFrame, disk: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, op) of a micro-batch of ``admitted``: its operations, and for roots with a request the full diff below them.

    ``disk`` and ``manifest`` have (path, mtime, size). A path that both name comes once, with the diff's operation, which is
    the newer. Files meet requests by their folders in an equi-join; without a request neither table is read.
    ``taken`` is read several times, so persist the micro-batch first.
    """
    requests = taken.where("kind = 'reconcile'")
    ops = operations(taken.where("kind <> 'reconcile'")).groupBy("path").agg(F.max_by("op", F.struct("ts", "op")).alias("op"))
    if requests.isEmpty():
        return ops
    tidy = lambda c: F.regexp_replace(F.lower(F.regexp_replace(c, r"\\", "/")), "(?<=.)/+$", "")
    roots = requests.select(tidy(F.col("root")).alias("__dir")).distinct()

    def below(files: DataFrame) -> DataFrame:
        parts = F.split(tidy(F.col("path")), "/")
        above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
        return files.select("path", "mtime", "size", F.explode(above).alias("__dir")).join(roots, "__dir", "left_semi").drop("__dir").distinct()

    diff = manifest_diff(below(disk), below(manifest)).select("path", "op")
    key = lambda d: d.withColumn("__key", tidy(F.col("path")))
    return diff.unionByName(key(ops).join(key(diff).select("__key"), "__key", "left_anti").select("path", "op"))


class Queue(StatefulProcessor):
    """Per path the latest operation. A ``done`` or ``fail`` of an older number changes nothing; three failures give up.

    With a pause, a failed item is due again after ``wait`` seconds and a deferred one after ``defer`` seconds, which a timer
    tells; deferring counts as no attempt.
    """

    def __init__(self, wait: float | None = None, defer: float = 600):
        self.wait, self.pause = wait, defer

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [StructField("op", StringType()), StructField("seq", LongType()), StructField("attempts", LongType())]
        self.handle, self.item = handle, handle.getValueState("item", StructType(fields))

    def _again(self, timers: Any, seconds: float) -> None:
        if self.wait is not None:
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + int(seconds * 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state, due = self.item.get() if self.item.exists() else None, True
        for batch in rows:
            for r in batch.sort_values("seq", kind="stable").itertuples():
                if r.op in ("upsert", "delete"):
                    state, due = (r.op, int(r.seq), 0), True
                elif state and r.seq == state[1] and r.op == "defer":
                    due = False
                    self._again(timerValues, self.pause)
                elif state and r.seq == state[1]:
                    state = None if r.op == "done" else (state[0], state[1], state[2] + 1)
                    due = self.wait is None
                    if state and state[2] < ATTEMPTS:
                        self._again(timerValues, self.wait or 0)
        if state is None:
            self.item.clear()
            yield self._row(key, "done", -1, 0)
        else:
            self.item.update(state)
            yield self._row(key, "failed" if state[2] >= ATTEMPTS else state[0] if due else "waiting", state[1], state[2])

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        state = self.item.get() if self.item.exists() else None
        if state and state[2] < ATTEMPTS:
            yield self._row(key, state[0], state[1], state[2])

    @staticmethod
    def _row(key: tuple, op: str, seq: int, attempts: int) -> pd.DataFrame:
        return pd.DataFrame({"path": [key[0]], "op": [op], "seq": [seq], "attempts": [attempts]})

    def close(self) -> None:
        pass


def queue(ops: DataFrame, *, wait: float | None = None, defer: float = 600) -> DataFrame:
    """(path, op, seq, attempts): the queue's state after each batch of (path, op, seq); op upsert, delete, done, fail or defer.

    With ``wait`` failed and deferred items are ``waiting`` and come again when their pause is over. Needs the RocksDB state
    store provider.
    """
    keyed = ops.withColumn("path", F.lower("path"))
    return keyed.groupBy("path").transformWithStateInPandas(Queue(wait, defer), outputStructType=QUEUE, outputMode="Update", timeMode="None" if wait is None else "ProcessingTime")


def drain(stream: DataFrame, index: Callable[[DataFrame, int], None], failed: Callable[[DataFrame, int, Exception], None], checkpoint: str):
    """Starts the indexing of each micro-batch; a batch that raises is handed to ``failed`` and the stream goes on.

    Batches may come twice after a crash, so ``index`` must replace by key.
    """

    def each(batch: DataFrame, number: int) -> None:
        try:
            index(batch, number)
        except Exception as e:  # one poison batch must not stop the rest
            failed(batch, number, e)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
