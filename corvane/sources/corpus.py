"""The given tables as files, chunks and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

FIRST_MTIME = 1704067200


#: Tables of less than the second number of bytes can come as one row group, which is one task; from the first number on they are dealt over all cores.
SPREAD = 1 << 20, 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table over all cores; a large one has row groups enough and is never shuffled for that."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if SPREAD[0] <= size < SPREAD[1] else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, project, ext, kind, mtime, text): every document as one text file."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("/corpus/"), "source", F.lit("/doc_"), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit(".txt")).alias("path"),
        F.col("source").alias("project"),
        F.lit(".txt").alias("ext"),
        F.lit("doc").alias("kind"),
        (FIRST_MTIME + 60 * F.col("doc_id")).alias("mtime"),
        "text",
    )
