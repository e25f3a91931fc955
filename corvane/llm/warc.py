"""WARC archives with a two-level capture index.

Captures are sorted by reversed-host URL key. Each task writes one archive (a
gzip member per record) and, beside it, its captures in sorted, compressed
blocks followed by a sparse directory: the first key of every block and where
it lies. A look-up finds the archives whose key range covers a key in the list of
archives, binary-searches their directory, opens the one or few blocks and reads
the records by range, neighbours in one read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..scratch import Scratch, delete
from .urls import parts

LEAST_REVISIT, BLOCK, DATE = 1000, 256, "2026-01-01T00:00:00Z"
#: Bytes that one range read may take, unless a single record is larger.
READ = 4 << 20
TAIL = 16  # bytes at the end of an index file: place and size of its directory
SHARDS = "archive string, lo string, lo_id long, hi string, hi_id long, captures long"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: Column) -> Column:
    """``com,example,www)/path?query``: the host's labels from the last to the first, then the rest without a fragment."""
    host, _ = parts(url)
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _clean(value: str | None) -> str:
    """A header's value: control characters are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the HTTP header of the full payload but not the payload."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Target-URI: {_clean(url)}", f"WARC-Date: {DATE}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Page-ID: {'' if page_id is None else page_id}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    header = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(header["Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a record doesn't end where its length says")
    http, _, payload = body.partition(b"\r\n\r\n")
    return header, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


class ShardWriter:
    """One archive and its index; captures come in order of (key, page_id)."""

    def __init__(self, root: str):
        self.uri = f"{root}/{uuid.uuid4().hex}"
        self.fs, path = _store(self.uri)
        self.path = path
        self.fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.warc = self.fs.open_output_stream(path + ".warc.gz", compression=None)
        self.index = self.fs.open_output_stream(path + ".idx", compression=None)
        self.at = self.index_at = self.captures = 0
        self.block: list[list] = []
        self.directory: list[list] = []
        self.first = self.last = None

    def add(self, key: str, page_id: int | None, data: bytes) -> None:
        packed = gzip.compress(data, 6, mtime=0)
        self.warc.write(packed)
        self.block.append([key, page_id, self.at, len(packed)])
        self.at += len(packed)
        self.captures += 1
        self.first = self.first or (key, page_id)
        self.last = (key, page_id)
        if len(self.block) == BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.block:
            packed = zlib.compress(json.dumps(self.block, ensure_ascii=False).encode("utf-8", "surrogatepass"))
            self.directory.append([self.block[0][0], self.index_at, len(packed)])
            self.index.write(packed)
            self.index_at += len(packed)
            self.block = []

    def abort(self) -> None:
        """Closes and deletes both files after a failure."""
        for stream, end in ((self.warc, ".warc.gz"), (self.index, ".idx")):
            stream.close()
            self.fs.delete_file(self.path + end)

    def close(self) -> tuple:
        self.flush()
        packed = zlib.compress(json.dumps(self.directory, ensure_ascii=False).encode("utf-8", "surrogatepass"))
        self.index.write(packed + self.index_at.to_bytes(8, "little") + len(packed).to_bytes(8, "little"))
        self.index.close()
        self.warc.close()
        return (self.uri, *self.first, *self.last, self.captures)


class ShardReader:
    """Range reads of one archive through its index."""

    def __init__(self, uri: str):
        self.fs, path = _store(uri)
        self.warc, self.index = self.fs.open_input_file(path + ".warc.gz"), self.fs.open_input_file(path + ".idx")
        size = self.index.size()
        tail = self.index.read_at(TAIL, size - TAIL)
        at, n = int.from_bytes(tail[:8], "little"), int.from_bytes(tail[8:], "little")
        self.directory = json.loads(zlib.decompress(self.index.read_at(n, at)))
        self.firsts = [x[0] for x in self.directory]

    def block(self, i: int) -> list[list]:
        _, at, n = self.directory[i]
        return json.loads(zlib.decompress(self.index.read_at(n, at)))

    def captures(self, lo: str, hi: str) -> Iterator[list]:
        """[key, page_id, offset, size] of the captures with lo <= key <= hi, in order."""
        # the first block that may hold lo: equal keys may have begun before the first one that starts with it
        for i in range(max(0, bisect_left(self.firsts, lo) - 1), bisect_right(self.firsts, hi)):
            for c in self.block(i):
                if c[0] > hi:
                    return
                if c[0] >= lo:
                    yield c

    def of_keys(self, keys: list[str]) -> Iterator[list]:
        """The captures of sorted keys, in order; each block is opened once."""
        done, block, names = -1, [], []
        for key in keys:
            for i in range(max(0, bisect_left(self.firsts, key) - 1), bisect_right(self.firsts, key)):
                if i != done:
                    done, block = i, self.block(i)
                    names = [c[0] for c in block]
                yield from block[bisect_left(names, key) : bisect_right(names, key)]

    def read(self, captures: Iterator[list]) -> Iterator[tuple[list, tuple[dict[str, str], dict[str, str], bytes]]]:
        """Each capture with its record; captures that lie one after another are read in one range."""
        run: list[list] = []

        def records() -> Iterator[tuple[list, tuple[dict[str, str], dict[str, str], bytes]]]:
            data = self.warc.read_at(run[-1][2] + run[-1][3] - run[0][2], run[0][2]) if run else b""
            for c in run:
                yield c, parse(gzip.decompress(data[c[2] - run[0][2] : c[2] - run[0][2] + c[3]]))
            run.clear()

        for c in captures:
            if run and (c[2] != run[-1][2] + run[-1][3] or c[2] + c[3] - run[0][2] > READ):
                yield from records()
            run.append(c)
        yield from records()

    def close(self) -> None:
        self.warc.close()
        self.index.close()


def _write(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        try:
            for batch in batches:
                key, page_id, url, digest, refers_to = (batch.column(x).to_pylist() for x in ("key", "page_id", "url", "digest", "refers_to"))
                for i, payload in enumerate(batch.column("payload")):
                    shard = shard or ShardWriter(root)
                    shard.add(key[i], page_id[i], record(page_id[i], url[i], payload.as_py(), digest[i], refers_to[i]))
            row = shard.close() if shard else None
        except BaseException:
            if shard:
                shard.abort()
            raise
        if row:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["archive", "lo", "lo_id", "hi", "hi_id", "captures"])

    return run


def write_archives(pages: DataFrame, root: str, *, least: int = LEAST_REVISIT) -> DataFrame:
    """Writes a WARC record for each row of ``pages`` (page_id, url, html) below ``root``; a table of the archives and their key ranges.

    Of rows with equal payloads of ``least`` bytes or more that with the largest page_id is a
    response, repeats of that row too, and the others revisit it; a row with a null page_id is a
    response. ``root`` is a folder that all executors share, in a store that pyarrow opens. The table is kept there
    too, as ``archives``. A task that is run again writes new files; those of an attempt that did not finish are deleted.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    large = rows.where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest")
    last = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    last = scratch.save(last, "last")  # written, so that AQE can split a payload that most pages share
    revisits = scratch.save(large.join(last, "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct(), "revisits")
    typed = rows.join(revisits, ["page_id", "digest"], "left").withColumn("key", url_key(F.col("url")))
    ordered = typed.repartitionByRange(F.col("key"), F.col("page_id")).sortWithinPartitions("key", "page_id")
    shards = scratch.save(ordered.select("key", "page_id", "url", "digest", "refers_to", "payload").mapInArrow(_write(root), SHARDS), "shards")
    shards.repartitionByRange("lo").sortWithinPartitions("lo").write.parquet(f"{root}/archives")
    scratch.keep_only()
    shards = pages.sparkSession.read.schema(SHARDS).parquet(f"{root}/archives")
    sweep(shards, root)
    return shards


def sweep(shards: DataFrame, root: str) -> None:
    """Deletes files below ``root`` that are of no archive in the table: of attempts whose executor was lost."""
    from pyarrow import fs

    store, path = _store(root)
    found = {f.base_name.split(".")[0] for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.is_file}
    if len(found) > shards.count():  # as many names as tasks
        for name in found - {r.archive.rsplit("/", 1)[1] for r in shards.select("archive").toLocalIterator()}:
            for end in (".warc.gz", ".idx"):
                delete(shards.sparkSession, f"{root}/{name}{end}")


def _checked(uri: str, shard: ShardReader, captures: Iterator[list]) -> Iterator[pa.RecordBatch]:
    """Result rows of captures, their payloads checked against digest and length."""
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    for capture, (header, http, payload) in shard.read(captures):
        digest = header["WARC-Payload-Digest"].removeprefix("sha1:")
        kind, to = header["WARC-Type"], header.get("WARC-Refers-To-Page")
        if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(http["Content-Length"])):
            raise ValueError(f"a payload in {uri} differs from its digest or length")
        out.append((capture[1], int(http["Content-Length"]), digest, kind, None if to is None else int(to)))
        if len(out) == 4096:
            yield flush()
    if out:
        yield flush()


def _read(lo: str, hi: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                shard = ShardReader(uri)
                try:
                    yield from _checked(uri, shard, shard.captures(lo, hi))
                finally:
                    shard.close()

    return run


def _look_up(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        store, path = _store(f"{root}/archives")
        archives = None
        for batch in batches:
            keys = batch.column(0).to_pylist()
            if not keys:
                continue
            archives = archives or ds.dataset(path, filesystem=store, format="parquet")
            # of the list of archives only what may hold one of these sorted keys
            lo, hi = ds.field("lo"), ds.field("hi")
            near = archives.to_table(columns=["archive", "lo", "hi"], filter=(lo <= keys[-1]) & (hi >= keys[0])).sort_by("lo").to_pylist()
            for a in near:
                own = keys[bisect_left(keys, a["lo"]) : bisect_right(keys, a["hi"])]
                if own:
                    shard = ShardReader(a["archive"])
                    try:
                        yield from _checked(a["archive"], shard, shard.of_keys(own))
                    finally:
                        shard.close()

    return run


def look_up(keys: DataFrame, root: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all captures of the distinct ``keys`` (key) in the archives of ``root``.

    Keys are dealt out by range and sorted, so each task opens a few neighbouring archives and each of their blocks once;
    an archive, a block and a record are read only if a key lies there. Keys without a capture and null keys give no row.
    """
    sought = keys.select("key").where("key IS NOT NULL").distinct().repartitionByRange("key").sortWithinPartitions("key")
    return sought.mapInArrow(_look_up(root), RESULT)


def read_captures(shards: DataFrame, lo: str = "", hi: str = "\U0010ffff") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the captures whose key lies from ``lo`` to ``hi``.

    Archives out of range are pruned by their key range, the others' directories binary-searched. Payloads are
    checked against their digests; a revisit's size is that of the full payload.
    """
    within = shards.where((F.col("hi") >= lo) & (F.col("lo") <= hi)).select("archive")
    # a row stands for a whole archive: a given number keeps Spark from joining the small partitions
    return within.repartition(max(1, within.count())).mapInArrow(_read(lo, hi), RESULT)
