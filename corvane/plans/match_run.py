"""Documents scored against a description: recalled, judged requirement by requirement, ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..operators import match, results, retrieval
from ..operators.rag import without_private
from ..providers import chat, json_answers
from ..scratch import Scratch
from ..settings import MATCH, SEARCH, Match

#: Candidates of each request that are looked at for each one that is kept.
FANOUT = 3
VERDICTS = "array<struct<requirement_id:int,status:string,evidence:string>>"


def candidates(docs: DataFrame, requests: DataFrame, *, old_versions: bool = False, cfg: Match = MATCH) -> DataFrame:
    """The documents recalled for each of ``requests`` (qid, text, doc_type: null for all), as ``results.recall`` gives them.

    ``docs`` has (doc_id, path, doc_type, modified_at, version_group, text). Words and vectors of a request meet those of the
    documents of its type; the vector alone says how similar a document is.
    """
    scratch = Scratch(docs.sparkSession, "match")
    text = F.col("text")
    bags = scratch.save(retrieval.bags(retrieval.slots(docs, "doc_id", text), "doc_id"), "bags")
    asked = retrieval.bags(retrieval.slots(requests, "qid", F.substring("text", 1, 8000)), "qid")
    terms = requests.select("qid", F.explode(T.keyword_query(F.col("text"))).alias("w")).select("qid", T.stem(F.col("w")).alias("term"))
    posts = scratch.save(retrieval.postings(docs, "doc_id", text, terms), "postings")
    found = None
    for (kind,) in requests.select("doc_type").distinct().toLocalIterator():  # as many as there are document types
        of = docs if kind is None else docs.where(F.col("doc_type") == kind)
        mine = requests.where(F.col("doc_type").isNull() if kind is None else F.col("doc_type") == kind).select("qid")
        ids = of.select("doc_id")
        q, d = asked.join(mine, "qid", "left_semi"), bags.join(ids, "doc_id", "left_semi")
        fused = retrieval.fuse(retrieval.vector_leg(q, d, SEARCH.candidates), retrieval.bm25_leg(terms.join(mine, "qid", "left_semi"), posts.join(ids, "doc_id", "left_semi"), SEARCH.candidates))
        found = fused if found is None else found.union(fused)
    best = retrieval.top(found, "qid", cfg.recall_k * FANOUT, F.desc("score"), retrieval.fused_order(F.col("similarity")).desc(), F.asc("doc_id"), rank="pos").select("qid", "doc_id", "pos")
    both = best.join(bags, "doc_id").join(asked.withColumnRenamed("vector", "query"), "qid").select("qid", "doc_id", "pos", F.round(T.cosine(F.col("vector"), F.col("query")), 6).alias("similarity"))
    named = both.join(docs.select("doc_id", "path", "modified_at", F.coalesce("version_group", F.lit("")).alias("version_group"), T.estimate_tokens(text).alias("tokens")), "doc_id")
    sizes = docs.where("version_group IS NOT NULL").groupBy("version_group").agg(F.count(F.lit(1)).alias("versions"))
    return results.recall(named, sizes, old_versions=old_versions, cfg=cfg)


def judge_prompt(requirements: Column, text: Column) -> Column:
    """Requirements, numbered, and the document that they are judged by."""
    lines = F.array_join(F.transform(requirements, lambda r: F.concat(r["requirement_id"].cast("string"), F.lit(". "), r["text"])), "\n")
    return F.concat(F.lit("Requirements:\n"), lines, F.lit("\n\nDocument:\n"), text)


def judged(chosen: DataFrame, requirements: DataFrame, docs: DataFrame, answer) -> DataFrame:
    """(qid, doc_id, requirement_id, status, pos): what a chat model says of each selected document, its quotes verified.

    ``requirements`` has (qid, requirement_id, text, kind, weight, enabled); ``answer`` takes a prompt and gives JSON.
    """
    lists = requirements.where("enabled").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("requirement_id", "text"))).alias("requirements"))
    prompts = chosen.where("selected").select("qid", "doc_id").join(lists, "qid").join(docs.select("doc_id", "text"), "doc_id")
    said = json_answers(chat(prompts.withColumn("prompt", judge_prompt(F.col("requirements"), F.col("text"))), answer), f"verdicts {VERDICTS}")
    rows = said.select("qid", "doc_id", "text", F.posexplode("parsed.verdicts").alias("pos", "v")).select("qid", "doc_id", "text", "pos", "v.requirement_id", match.sanitise_status(F.col("v.status")).alias("status"), F.coalesce("v.evidence", F.lit("")).alias("quote"))
    terms = requirements.select("qid", "requirement_id", match.key_terms(F.col("text")).alias("all"))
    # numbers and short names among the terms must stand in a near quote
    needed = F.filter("all", lambda w: w.rlike("[0-9]") | (F.length(w) <= 3))
    checked = match.quote_found(rows.join(terms, ["qid", "requirement_id"]).withColumn("terms", needed).drop("all"))
    return checked.select("qid", "doc_id", "requirement_id", match.verified(F.col("status"), F.col("found")).alias("status"), "pos")


def match_run(docs: DataFrame, requests: DataFrame, requirements: DataFrame, answer, blocked: DataFrame | None = None, *, cfg: Match = MATCH) -> DataFrame:
    """(qid, doc_id, path, similarity, score, met_must, total_must, met_nice, total_nice, unverified, place): the selected documents of each request in order of their score.

    Documents whose paths are ``blocked`` (path) are not shown to the model and have no score.
    """
    scratch = Scratch(docs.sparkSession, "run")
    recalled = scratch.save(candidates(docs, requests, cfg=cfg), "recalled")
    shown = recalled if blocked is None else without_private(recalled, blocked)[0]
    said = scratch.save(judged(shown, requirements, docs, answer), "judged")
    pairs = shown.where("selected").select("qid", "doc_id")
    key = F.concat_ws(":", "qid", "doc_id")
    scores = match.checklist(requirements.join(pairs, "qid").withColumn("doc_id", key), said.withColumn("doc_id", key), cfg)
    scored = shown.where("selected").withColumn("__k", key).join(scores.withColumnRenamed("doc_id", "__k"), "__k").drop("__k")
    ranked = retrieval.top(scored, "qid", 1 << 30, *results.match_order(), F.asc("path"), rank="place")
    return ranked.select("qid", "doc_id", "path", "similarity", "score", "met_must", "total_must", "met_nice", "total_nice", "unverified", "place")
