from datetime import datetime, timedelta

from corvane.streaming import changes

SCHEMA = "root string, kind string, path string, dest string, ts timestamp"
AT = datetime(2026, 1, 1, 0, 0, 0, 700_000)


def brute(times, most):
    """Which of one root's events are taken, in order of time."""
    began, taken, out = None, 0, []
    for t in times:
        if began is None or t - began >= timedelta(seconds=1):
            began, taken = t, 0
        taken += 1
        out.append(taken <= most)
    return out


def test_bursts_across_clock_seconds_ask_for_a_full_diff(spark, tmp_path):
    # a burst from 0.7 s to 1.6 s is one window although the clock's second changes within it
    burst = [("/p/a", "created", f"/p/a/{i:03}.md", None, AT + timedelta(milliseconds=90 * i)) for i in range(11)]
    calm = [("/p/b", "modified", f"/p/b/{i}.md", None, AT + timedelta(seconds=2 * i)) for i in range(8)] + [("/p/b", "moved", "/p/b/x.md", "/p/b/y.md", AT + timedelta(seconds=40))]
    odd = [(None, "created", "/p/a/none.md", None, AT), ("/p/a", "created", None, None, AT), ("/p/a", "created", "/p/a/none.md", None, None)]
    # the window that the first file opened goes on in the second one
    later = [("/p/a", "created", f"/p/a/1{i:02}.md", None, AT + timedelta(milliseconds=950 + 30 * i)) for i in range(6)]
    for n, rows in enumerate((burst + calm + odd, later)):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        disk = spark.createDataFrame([("/P/a/new.md", 1, 1), ("/p/a/000.md", 1, 1), ("/p/b/other.md", 1, 1), ("/p/ab/no.md", 1, 1)], "path string, mtime long, size long")
        manifest = spark.createDataFrame([("/p/a/gone.md", 1, 1), ("/p/b/gone.md", 1, 1)], "path string, mtime long, size long")
        got, ops = [], []

        def each(batch, number, got=got, ops=ops, disk=disk, manifest=manifest):
            batch = batch.persist()
            got.extend(batch.collect())
            ops.extend((r.path, r.op) for r in changes.reconciled(batch, disk, manifest).collect())
            batch.unpersist()

        stream = changes.admitted(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), per_second=5)
        stream.writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        times = sorted(r[4] for r in (burst if n == 0 else burst + later) if r[0] == "/p/a")
        # the second run's events come after all of the first run's, so its windows go on from there
        want = brute([r[4] for r in burst] + ([r[4] for r in later] if n else []), 5)
        own = want[len(burst) :] if n else want
        mine = [r for r in got if r.root == "/p/a"]
        assert len(times) == len(want) and sum(r.kind != "reconcile" for r in mine) == sum(own)
        assert [(r.kind, r.path, r.dropped) for r in mine if r.kind == "reconcile"] == ([("reconcile", "/p/a", len(own) - sum(own))] if not all(own) else [])
        assert all(r.dropped == 0 for r in got if r.kind != "reconcile")
        if n == 0:
            assert sum(r.root == "/p/b" for r in got) == 9 and not any(r.kind == "reconcile" and r.root == "/p/b" for r in got)
            assert len(ops) == len({p for p, _ in ops}) and {("/P/a/new.md", "upsert"), ("/p/a/000.md", "upsert"), ("/p/a/gone.md", "delete"), ("/p/b/x.md", "delete"), ("/p/b/y.md", "upsert")} <= set(ops)
            assert not {p for p, _ in ops} & {"/p/b/gone.md", "/p/b/other.md", "/p/ab/no.md"}


def test_no_request_no_diff(spark):
    rows = [("/p", "created", "/p/a", None, AT, 0), ("/p", "deleted", "/p/a", None, AT + timedelta(seconds=1), 0)]
    batch = spark.createDataFrame(rows, changes.ADMITTED)
    assert [(r.path, r.op) for r in changes.reconciled(batch, None, None).collect()] == [("/p/a", "delete")]
