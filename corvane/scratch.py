"""Written tables that cut lineage, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark drops the shuffle files of a plan as soon as its rows are written, so they don't pile up over an operator's steps.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}  # application -> its temporary folder, in local mode
_roots: list[str] = []  # of all scratch tables of this process, in order


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where it is unset, one of our own in local mode, an error elsewhere."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if not context.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="corvane-")
    return _own[context.applicationId]


def delete(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mark() -> int:
    """A point for ``clear``: what is written from now on comes after it."""
    return len(_roots)


def clear(spark: SparkSession, since: int = 0) -> None:
    """Deletes all scratch tables and archives written after ``mark`` gave ``since``.

    Operators return lazy DataFrames over such tables, so they delete only those that their result doesn't read;
    call this when results are written or no longer needed.
    """
    while len(_roots) > since:
        delete(spark, _roots.pop())


class Scratch:
    """Tables of one operator run: ``save`` writes Parquet and reads it back."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        _roots.append(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.names.add(name)
        conf = self.spark.conf
        before = conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            if before is None:
                conf.unset(CLEANUP)
            else:
                conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that no later plan reads."""
        for name in names:
            self.names.discard(name)
            delete(self.spark, self.path(name))

    def keep_only(self, *names: str) -> None:
        self.drop(*(self.names - {*names}))
