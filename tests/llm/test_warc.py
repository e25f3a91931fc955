import hashlib

from pyspark.sql import functions as F

from corvane.llm.queries import ORACLE, QUERIES
from corvane.llm import warc
from corvane.llm.warc import ShardReader, look_up, read_captures, url_key, write_archives
from corvane.scratch import Scratch

from ..oracle import check


def test_equals_sql(spark):
    check(spark, QUERIES["op8_warc"], ORACLE["op8_warc"])


def test_round_trip_and_edges(spark):
    big = "é" * 600
    rows = [(1, "http://a.org/x", big), (7, "http://b.org/\r\nX: y", big), (3, "http://a.org/x", big), (7, "http://b.org/", big), (4, None, None), (None, "http://c.org/", big), (5, "http://a.org/y#f", "small"), (6, "http://a.org/y", "small")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x")).withColumn("key", F.lit(1))
    shards = write_archives(df, root := Scratch(spark, "w").root)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read_captures(shards).collect()), key=str)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = len(raw) >= 1000 and i is not None and i != 7
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 7 if revisit else None))
    assert got == sorted(want, key=str)
    assert sorted(map(tuple, look_up(df.select(url_key(F.col("url")).alias("key")), root).collect()), key=str) == got
    assert sorted(r.page_id for r in read_captures(shards, "org,a)/y", "org,a)/y").collect()) == [5, 6]
    assert read_captures(shards, "zz", "zzz").count() == 0
    empty = write_archives(df.limit(0), root := Scratch(spark, "w").root)
    assert empty.count() == 0 and read_captures(empty).count() == 0 and look_up(spark.createDataFrame([("x",)], "key string"), root).count() == 0


def test_blocks(spark):
    df = spark.range(1500).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), (F.col("id") % 3).cast("string"), F.lit(".org/"), F.lpad(F.floor(F.col("id") / 3).cast("string"), 4, "0")).alias("url"), F.lit("x").alias("html"))
    shards = write_archives(df.coalesce(1), Scratch(spark, "w").root).collect()
    found = 0
    for s in shards:
        reader = ShardReader(s.archive)
        everything = list(reader.captures("", "\U0010ffff"))
        assert [c[0] for c in everything] == sorted(c[0] for c in everything) and len(everything) == s.captures
        for lo, hi in (("org,h1)/0100", "org,h1)/0199"), ("org,h2)/0499", "org,h2)/0499")):
            own = [c for c in everything if lo <= c[0] <= hi]
            assert list(reader.captures(lo, hi)) == own
            found += len(own)
        if everything:
            (_, (header, http, payload)), = reader.read(iter(everything[-1:]))
            assert [c for c, _ in reader.read(iter(everything[::2]))] == everything[::2]
            assert payload == b"x" and http["Content-Length"] == "1" and header["WARC-Type"] == "response"
    assert found == 101
    assert spark.range(1).select(url_key(F.lit("http://B.a.org/p?q#f"))).first()[0] == "org,a,b)/p?q"


def test_look_ups_open_only_what_holds_a_key(spark, monkeypatch):
    df = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), (F.col("id") % 7).cast("string"), F.lit(".org/"), F.lpad(F.floor(F.col("id") / 14).cast("string"), 4, "0")).alias("url"), F.lit("x").alias("html"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shards = write_archives(df, root := Scratch(spark, "w").root)
        assert shards.count() > 2
        wanted = [f"org,h{h})/{n:04d}" for h in (0, 1, 6) for n in (3, 200, 201, 428)] + ["org,h3)/x", None]
        got = [r.page_id for r in look_up(spark.createDataFrame([(k,) for k in wanted], "key string"), root).collect()]
        rows = df.select("page_id", url_key(F.col("url")).alias("key")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(got) == sorted(r.page_id for r in rows if r.key in wanted) and len(got) == 22
    # one look-up in this process: the archives, blocks and ranges that it opens
    opened, blocks = [], []
    was, read = ShardReader.__init__, ShardReader.block
    monkeypatch.setattr(ShardReader, "__init__", lambda self, uri: (opened.append(uri), was(self, uri))[1])
    monkeypatch.setattr(ShardReader, "block", lambda self, i: (blocks.append(i), read(self, i))[1])
    import pyarrow as pa

    key = sorted(r.key for r in rows)[3000]
    out = list(warc._look_up(root)(iter([pa.RecordBatch.from_arrays([pa.array([key])], ["key"])])))
    assert sum(b.num_rows for b in out) == 2 and len(opened) <= 2 and len(blocks) <= 2


def test_files_of_failed_attempts_go(spark):
    from pyarrow import fs

    root = Scratch(spark, "w").root
    store, path = fs.FileSystem.from_uri(root)
    batch = spark.createDataFrame([("k", 1, "u", "d", None, bytearray(b"x")), ("k", 2, "u", "d", None, None)], "key string, page_id long, url string, digest string, refers_to long, payload binary").toArrow().to_batches()
    try:
        list(warc._write(root)(iter(batch)))
        raise AssertionError("a record without a payload must fail")
    except TypeError:
        assert not store.get_file_info(fs.FileSelector(path))
    writer = warc.ShardWriter(root)  # an attempt that never ends
    writer.warc.close()
    writer.index.close()
    shards = write_archives(spark.createDataFrame([(1, "http://a.org", "x")], "page_id long, url string, html string"), root)
    files = {f.base_name for f in store.get_file_info(fs.FileSelector(path)) if f.is_file}
    name = shards.first().archive.rsplit("/", 1)[1]
    assert files == {f"{name}.warc.gz", f"{name}.idx"}
