"""Ranking quality: results (qid, path, rank, strong), expected and forbidden patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

K, TOP = 10, 5
SPEC = "qid long, q string, expect array<string>, forbidden array<string>, expect_none boolean"


def read_spec(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Evaluation queries as a table from parsed entries: ``q`` and either ``expect`` or ``expect_none``, and ``not``."""
    out = []
    for i, row in enumerate(rows):
        lists = {}
        for name in ("expect", "not"):
            value = row.get(name) or []
            if not isinstance(value, list):
                raise ValueError(f"query {i}: {name} is no list")
            lists[name] = [str(v) for v in value]
        none = bool(row.get("expect_none"))
        if not row.get("q"):
            raise ValueError(f"query {i} has no q")
        if bool(lists["expect"]) == none:
            raise ValueError(f"query {i} needs expect or expect_none, and not both")
        out.append((i, str(row["q"]), lists["expect"], lists["not"], none))
    if not out:
        raise ValueError("there are no queries")
    return spark.createDataFrame(out, SPEC)


def patterns(spec: DataFrame, column: str) -> DataFrame:
    return spec.select("qid", F.explode(column).alias("pattern"))


def _norm(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"\\", "/"))


def hits(results: DataFrame, patterns: DataFrame) -> DataFrame:
    """(qid, pattern, rank, strong) of the results whose path contains a pattern of the query, whatever the case."""
    return results.join(patterns, "qid").where(F.contains(_norm(F.col("path")), _norm(F.col("pattern")))).select("qid", "pattern", "path", "rank", "strong")


def gains(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(qid, dcg): every pattern counts once; a result takes the first expected pattern that it contains and no earlier one has taken.

    Patterns may compete for a path, so a query's ten results are folded in order, over its patterns (qid, pattern, pos) that are left.
    """
    top = results.where(F.col("rank") <= K).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", _norm(F.col("path")).alias("path")))).alias("rows"))
    left = expected.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", _norm(F.col("pattern")).alias("p")))), lambda x: x["p"]).alias("left"))
    start = F.struct(F.col("left").alias("left"), F.lit(0.0).alias("dcg"))

    def step(state: Column, row: Column) -> Column:
        at = F.array_position(F.transform(state["left"], lambda p: F.contains(row["path"], p)), True).cast("int")
        rest = F.concat(F.slice(state["left"], 1, F.greatest(at - 1, F.lit(0))), F.slice(state["left"], at + 1, F.size(state["left"]) + 1))
        return F.when(at > 0, F.struct(rest.alias("left"), (state["dcg"] + 1 / F.log2(row["rank"] + 1)).alias("dcg"))).otherwise(state)

    return top.join(left, "qid").select("qid", F.aggregate("rows", start, step)["dcg"].alias("dcg"))


def query_metrics(queries: DataFrame, results: DataFrame, expected: DataFrame) -> DataFrame:
    """Per query with expectations (qid, pattern[, pos]): first rank within 10, reciprocal rank, nDCG@10 and precision@5."""
    if "pos" not in expected.columns:
        expected = expected.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("pattern")))
    hit = hits(results, expected).where(F.col("rank") <= K)
    first = hit.groupBy("qid").agg(F.min("rank").alias("first"), F.min(F.when(F.col("strong"), F.col("rank"))).alias("strong_first"))
    wanted = expected.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(K)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    precise = hit.where(F.col("rank") <= TOP).select("qid", "rank").distinct().groupBy("qid").agg((F.count(F.lit(1)) / TOP).alias("p_at_5"))
    joined = queries.join(wanted, "qid").join(first, "qid", "left").join(gains(results, expected), "qid", "left").join(precise, "qid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return joined.select(
        "qid", F.col("first").isNotNull().cast("double").alias("recall"), F.col("strong_first").isNotNull().cast("double").alias("strong_recall"),
        zero(1 / F.col("first")).alias("mrr"), zero(F.col("dcg") / ideal).alias("ndcg"), zero(F.col("p_at_5")).alias("p_at_5"),
    )


def leg_score(metrics: DataFrame) -> DataFrame:
    return metrics.agg(*(F.round(F.avg(c), 6).alias(c) for c in ("recall", "strong_recall", "mrr", "ndcg", "p_at_5")))


def false_positives(spec: DataFrame, results: DataFrame) -> DataFrame:
    """(qid, false_positive) of the queries that nothing answers or that have forbidden patterns: a strong result where there should be none, or a forbidden path among the first five strong ones."""
    judged = spec.where(F.col("expect_none") | (F.size("forbidden") > 0))
    strong = results.where("strong").withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where(F.col("nth") <= TOP)
    bad = hits(strong, patterns(judged, "forbidden")).select("qid").distinct().withColumn("bad", F.lit(True))
    some = strong.select("qid").distinct().withColumn("some", F.lit(True))
    said = lambda c: F.coalesce(F.col(c), F.lit(False))
    return judged.join(bad, "qid", "left").join(some, "qid", "left").select("qid", ((F.col("expect_none") & said("some")) | said("bad")).alias("false_positive"))


def false_positive_rate(spec: DataFrame, results: DataFrame) -> DataFrame:
    return false_positives(spec, results).agg(F.round(F.coalesce(F.avg(F.col("false_positive").cast("double")), F.lit(0.0)), 6).alias("fp_rate"))


def calibration(spec: DataFrame, nearest: DataFrame) -> DataFrame:
    """(qid, path, similarity, true_hit) of the vector leg's first ten files (qid, path, similarity, rank): relevant files of positive queries, and all others."""
    first = nearest.where(F.col("rank") <= K)
    true = hits(first.withColumn("strong", F.lit(True)), patterns(spec, "expect")).select("qid", "path").distinct().withColumn("true_hit", F.lit(True))
    return first.join(true, ["qid", "path"], "left").select("qid", "path", "similarity", F.coalesce("true_hit", F.lit(False)).alias("true_hit"))


def percentiles(rows: DataFrame, value: str, by: str, points: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """(by, p05, ..): linear percentiles of each group."""
    return rows.groupBy(by).agg(*(F.round(F.percentile(value, p), 6).alias(f"p{round(p * 100):02d}") for p in points))


def median(rows: DataFrame, value: str) -> DataFrame:
    return rows.agg(F.median(value).alias("median"))


def compare_models(spec: DataFrame, runs: dict[str, DataFrame], vectors: dict[str, DataFrame]) -> DataFrame:
    """(model, leg, recall, .., fp_rate) of each model's full search and of its vector leg alone, both as (qid, path, rank, strong)."""
    expected = spec.select("qid", F.posexplode("expect").alias("pos", "pattern"))
    out = None
    for leg, of in (("full", runs), ("vector", vectors)):
        for model, results in of.items():
            row = leg_score(query_metrics(spec.select("qid"), results, expected)).join(F.broadcast(false_positive_rate(spec, results)))  # one row each
            row = row.select(F.lit(model).alias("model"), F.lit(leg).alias("leg"), "*")
            out = row if out is None else out.unionByName(row)
    return out
