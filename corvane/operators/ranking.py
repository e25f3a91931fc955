"""From ranked chunks to ranked files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..settings import SEARCH, Search


def file_evidence(chunks: DataFrame) -> DataFrame:
    """Per (qid, path): best and second fused score (0 if none), best similarity, best coverage, chunks."""
    order = Window.partitionBy("qid", "path").orderBy(F.desc_nulls_last("score"))
    numbered = chunks.withColumn("__n", F.row_number().over(order))
    nth = lambda i: F.greatest(F.coalesce(F.max(F.when(F.col("__n") == i, F.col("score"))), F.lit(0.0)), F.lit(0.0))
    return numbered.groupBy("qid", "path").agg(nth(1).alias("best"), nth(2).alias("second"), F.max("similarity").alias("similarity"), F.max(F.coalesce("coverage", F.lit(0.0))).alias("coverage"), F.count(F.lit(1)).alias("chunks"))


def file_score(cfg: Search = SEARCH) -> Column:
    base = F.col("best") + cfg.multi_hit_bonus * F.col("second") + cfg.filename_weight * F.col("share") + F.when(F.col("exact"), cfg.filename_exact_bonus).otherwise(0.0)
    return F.round(F.when(F.col("in_project"), base * cfg.current_project_boost).otherwise(base), 8)


def vouched(floor: float, cfg: Search = SEARCH) -> Column:
    return F.coalesce(F.col("similarity") >= floor, F.lit(False)) | (F.col("coverage") >= cfg.min_term_coverage) | (F.col("share") >= cfg.min_term_coverage)


def rank_files(files: DataFrame, floor: float, cfg: Search = SEARCH) -> DataFrame:
    """(qid, path, score, weak, position, relevance): strong files by score, then weak ones; relevance never rises down the list."""
    whole = Window.partitionBy("qid")
    scored = files.withColumn("score", file_score(cfg)).withColumn("vouched", vouched(floor, cfg))
    cutoff = (1 - cfg.relative_gap) * F.coalesce(F.max(F.when(F.col("vouched"), F.col("score"))).over(whole), F.lit(0.0))
    tiered = scored.withColumn("weak", ~F.col("vouched") | (F.col("score") < cutoff))
    down = whole.orderBy(F.asc("weak"), F.desc("score"), F.asc("path"))
    shown = F.bround(100 * F.least("score", F.lit(1.0))).cast("int")
    return tiered.select("qid", "path", "score", "weak", F.row_number().over(down).alias("position"), F.min(shown).over(down.rowsBetween(Window.unboundedPreceding, 0)).alias("relevance"))
