"""Search results refined, recalled documents chosen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..settings import MATCH, Match


def extension_of(ext: Column, path: Column) -> Column:
    found = T.extension(T.base_name(path))
    return F.lower(F.coalesce(F.nullif(ext, F.lit("")), F.when(found != "", F.concat(F.lit("."), found)).otherwise("")))


def extension_counts(results: DataFrame) -> DataFrame:
    """(ext, n) of results (ext, path), the most frequent first."""
    return results.groupBy(extension_of(F.col("ext"), F.col("path")).alias("ext")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ext")


def refine(results: DataFrame, ext: str | None = None, order: str = "relevance") -> DataFrame:
    """Results (path, ext, position, indexed_at) of one extension with ``shown``: their place by relevance, date or name; ties keep the search's order."""
    kept = results if ext is None else results.where(extension_of(F.col("ext"), F.col("path")) == ext.lower())
    keys = {"relevance": [], "date": [F.desc("indexed_at")], "name": [T.file_name(F.col("path")), F.lower("path")]}[order]
    return kept.withColumn("shown", F.row_number().over(Window.partitionBy("qid").orderBy(*keys, "position")).cast("int"))


def recall(candidates: DataFrame, sizes: DataFrame, *, old_versions: bool = False, cfg: Match = MATCH) -> DataFrame:
    """The best documents of each query, one version of each group.

    ``candidates`` (qid, path, similarity, modified_at, version_group, pos); ``sizes`` (version_group, versions). A group's
    newest candidate is its latest, of equals the first. ``selected``: latest and similar enough.
    """
    grouped = F.col("version_group") != ""
    by = Window.partitionBy("qid", F.when(grouped, F.col("version_group")).otherwise(F.concat(F.lit("\0"), "path"))).orderBy(F.desc("modified_at"), "pos")
    marked = candidates.withColumn("is_latest", F.row_number().over(by) == 1).join(sizes, "version_group", "left").withColumn("versions", F.when(grouped, F.coalesce("versions", F.lit(1))).otherwise(1))
    kept = marked if old_versions else marked.where("is_latest")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("similarity"), "pos")).cast("int")).where(F.col("rank") <= cfg.recall_k)
    return ranked.withColumn("selected", F.col("is_latest") & (F.col("similarity") >= cfg.threshold))


def match_order() -> list[Column]:
    return [F.desc("score"), F.desc("met_must"), F.desc("similarity")]
