"""Tables that change in place: numbered states of a folder, and rows replaced by key within hash buckets."""

from __future__ import annotations

import json
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..scratch import Scratch


class Conflict(RuntimeError):
    """Another writer published the same state first."""


class Folder:
    """A folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self.path = self._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str = "") -> list[str]:
        at = self.path(f"{self.root}/{folder}".rstrip("/"))
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(f"{self.root}/{name}"))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Writes a file whole or not at all; ``Conflict`` if it exists."""
        draft = self.path(f"{self.root}/.{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        never = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self.fs.makeQualified(draft), self.fs.makeQualified(self.path(f"{self.root}/{name}")), never)
        except Py4JJavaError as e:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(name) from e
            raise

    def drop(self, name: str) -> None:
        self.fs.delete(self.path(f"{self.root}/{name}"), True)


class Versions:
    """The numbered states of a folder, each a small JSON file; readers take the last one that is whole."""

    def __init__(self, spark: SparkSession, root: str):
        self.folder = Folder(spark, root)

    def numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.folder.names("states") if not n.startswith("."))

    def latest(self) -> tuple[int, dict[str, Any]]:
        numbers = self.numbers()
        return (numbers[-1], self.at(numbers[-1])) if numbers else (0, {})

    def at(self, number: int) -> dict[str, Any]:
        return json.loads(self.folder.read(f"states/{number:09d}.json"))

    def publish(self, number: int, state: dict[str, Any]) -> None:
        states = self.folder.path(f"{self.folder.root}/states")
        self.folder.fs.mkdirs(states)
        self.folder.publish(f"states/{number:09d}.json", json.dumps(state))


class KeyedTable:
    """A Parquet table in ``buckets`` by the hash of ``key``; a batch rewrites the buckets that its keys fall in, and no other.

    A state names each bucket's folder, so a batch shows whole or not at all, readers keep the state they began with, and
    of two writers of one state one must start again. A batch with a number that was taken already changes nothing. The
    driver holds one entry a bucket. Rows of a null key are a key of their own.
    """

    MOST_BATCHES = 1000

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = 64):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self.versions = Versions(spark, root)

    def _bucketed(self, rows: DataFrame, buckets: int) -> DataFrame:
        return rows.withColumn("__bucket", F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int"))

    def _rows(self, state: dict[str, Any], buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(state["schema"])
        places = [f"{self.root}/data/{p}" for b, p in state["places"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The table as it is now, or was at a version."""
        state = self.versions.latest()[1] if version is None else self.versions.at(version)
        if not state:
            raise ValueError(f"no table at {self.root}")
        return self._rows(state)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some ``keys``; only their buckets are read."""
        state = self.versions.latest()[1]
        keys = keys.select(self.key).distinct()
        touched = [r["__bucket"] for r in self._bucketed(keys, state["buckets"]).select("__bucket").distinct().collect()]
        return self._rows(state, touched).join(keys, self.key, "left_semi")

    def upsert(self, rows: DataFrame, *, gone: DataFrame | None = None, batch: int | str | None = None, tries: int = 5) -> list[int]:
        """``rows`` in place of all rows of their keys, and the keys of ``gone`` deleted; the buckets that were rewritten."""
        scratch = Scratch(self.spark, "batch")
        rows = scratch.save(rows, "rows")
        keys = rows.select(self.key) if gone is None else rows.select(self.key).union(gone.select(self.key))
        keys = scratch.save(keys.distinct(), "keys")
        try:
            for left in range(tries - 1, -1, -1):
                number, state = self.versions.latest()
                if batch is not None and batch in state.get("batches", []):
                    return []
                try:
                    return self._write(rows, keys, number, state, batch)
                except Conflict:
                    if not left:
                        raise
            return []
        finally:
            scratch.drop("rows", "keys")

    def _write(self, rows: DataFrame, keys: DataFrame, number: int, state: dict[str, Any], batch: int | str | None) -> list[int]:
        buckets = state.get("buckets", self.buckets)
        touched = sorted(r["__bucket"] for r in self._bucketed(keys, buckets).select("__bucket").distinct().collect())
        name, places = uuid.uuid4().hex, dict(state.get("places", {}))
        new = rows
        if state:
            old = self._rows(state, touched).alias("o").join(keys.alias("k"), F.col(f"o.{self.key}").eqNullSafe(F.col(f"k.{self.key}")), "left_anti")
            new = old.unionByName(rows)
        # a bucket of many rows is split over tasks, small ones are put together
        self._bucketed(new, buckets).hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(f"{self.root}/data/{name}")
        written = {n.removeprefix("__bucket="): f"{name}/{n}" for n in self.versions.folder.names(f"data/{name}") if n.startswith("__bucket=")}
        for b in map(str, touched):
            places.pop(b, None)
            if b in written:
                places[b] = written[b]
        batches = state.get("batches", []) + ([batch] if batch is not None else [])
        schema = state.get("schema") or rows.schema.jsonValue()
        self.versions.publish(number + 1, {"buckets": buckets, "schema": schema, "places": places, "batches": batches[-self.MOST_BATCHES :]})
        return touched

    def vacuum(self, keep: int = 2) -> int:
        """Deletes bucket folders that none of the last ``keep`` states names, and older states; the number of folders deleted."""
        numbers, folder = self.versions.numbers(), self.versions.folder
        used = {p for n in numbers[-keep:] for p in self.versions.at(n)["places"].values()}
        old = [f"{n}/{b}" for n in folder.names("data") for b in folder.names(f"data/{n}") if b.startswith("__bucket=") and f"{n}/{b}" not in used]
        for n in old:
            folder.drop(f"data/{n}")
        for n in numbers[:-keep]:
            folder.drop(f"states/{n:09d}.json")
        return len(old)
