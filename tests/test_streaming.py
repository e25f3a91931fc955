import time
from datetime import datetime, timedelta

from corvane.streaming import changes


def test_operations_and_queue(spark, tmp_path):
    at = datetime(2026, 1, 1)
    events = spark.createDataFrame([("moved", "a", "b", at), ("created", "c", None, at), ("deleted", "d", None, at)], "kind string, path string, dest string, ts timestamp")
    assert sorted((r.path, r.op) for r in changes.operations(events).collect()) == [("a", "delete"), ("b", "upsert"), ("c", "upsert"), ("d", "delete")]
    rows = [("A", "upsert", 1), ("a", "upsert", 2), ("a", "done", 1), ("b", "upsert", 3), ("b", "done", 3), ("c", "delete", 4), ("c", "fail", 4), ("c", "fail", 4), ("c", "fail", 4)]
    spark.createDataFrame(rows, "path string, op string, seq long").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, op string, seq long").json(str(tmp_path / "in"))
    out = changes.queue(stream).writeStream.format("memory").queryName("queue").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    out.awaitTermination()
    got = {r.path: (r.op, r.seq, r.attempts) for r in spark.table("queue").collect()}
    assert got == {"a": ("upsert", 2, 0), "b": ("done", -1, 0), "c": ("failed", 4, 3)}


def test_debounce_and_drain(spark, tmp_path):
    at = datetime(2026, 1, 1)
    rows = [("a", "upsert", at), ("a", "delete", at + timedelta(seconds=20)), ("a", "upsert", at + timedelta(seconds=100)), ("z", "upsert", at + timedelta(hours=2))]
    spark.createDataFrame(rows, "path string, op string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, op string, ts timestamp").parquet(str(tmp_path / "in"))
    got, bad = [], []

    def index(batch, number):
        got.extend((r.path, r.op, r.events) for r in batch.collect())
        if number == 0:
            raise ValueError("poison")

    changes.drain(changes.debounced(stream), index, lambda b, n, e: bad.append(str(e)), str(tmp_path / "cp")).awaitTermination()
    assert sorted(got) == [("a", "delete", 2), ("a", "upsert", 1)] and bad == ["poison"]


def test_pauses_and_subtrees(spark, tmp_path):
    rows = [("a", "upsert", 1), ("a", "fail", 1), ("b", "upsert", 2), ("b", "defer", 2), ("c", "upsert", 3)]
    spark.createDataFrame(rows, "path string, op string, seq long").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, op string, seq long").json(str(tmp_path / "in"))
    out = changes.queue(stream, wait=1, defer=1).writeStream.format("memory").queryName("paused").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        until, got = time.time() + 40, []
        while len(got) < 5 and time.time() < until and out.isActive:
            time.sleep(1)
            got = [(r.path, r.op, r.attempts) for r in spark.table("paused").collect()]
    finally:
        out.stop()
    # both come again after their pause, the deferred one without an attempt
    assert sorted(got) == [("a", "upsert", 1), ("a", "waiting", 1), ("b", "upsert", 0), ("b", "waiting", 0), ("c", "upsert", 0)]
    manifest = spark.createDataFrame([("/P/sub/x.txt",), ("/p/sub/deep/y.txt",), ("/p/sub2/z.txt",)], "path string")
    ops = spark.createDataFrame([("/p/sub", "delete"), ("/p/a", "upsert")], "path string, op string")
    assert {(r.path, r.op) for r in changes.with_subtrees(ops, manifest).collect()} == {("/p/sub", "delete"), ("/p/a", "upsert"), ("/P/sub/x.txt", "delete"), ("/p/sub/deep/y.txt", "delete")}
