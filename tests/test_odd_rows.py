"""Rows that a query once answered otherwise than its SQL."""

import os

import pytest

from pyspark.sql import functions as F

from corvane import queries_more  # noqa: F401
from corvane.functions import text as T
from corvane.operators import retrieval, state
from corvane.plans import search as S
from corvane.queries import ORACLE, QUERIES

from .oracle import SF, TABLES, check


@pytest.fixture
def world(spark, tmp_path):
    """The smallest tables, some of them put in place by ``put``."""

    def put(**tables):
        for t in TABLES:
            if t not in tables:
                os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
        for t, df in tables.items():
            df.toPandas().to_parquet(tmp_path / f"{t}.parquet")
        return str(tmp_path)

    return put


DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def test_title_keeps_zeros_and_drops_blanks(spark, world):
    rows = [(0, "call 0170", "en", "src1", 9), (1, "  0 of 10\n1101", "en", "src1", 14), (2, " \n 1 left 1 ", "en", "src1", 12), (3, "", "en", "src1", 0)]
    check(spark, QUERIES["shown_texts"], ORACLE["shown_texts"], world(documents=spark.createDataFrame(rows, DOCUMENT)))


@pytest.mark.parametrize("name", ["search_flagship", "search_filtered"])
def test_short_documents_are_searched(spark, world, name):
    words = "barley harvest river stone".split()
    rows = [(i, f"{words[i % 4]} {words[i % 3]}" if i % 2 else f"{words[i % 4]} with many more words than twenty letters", "en", "src3", 1) for i in range(12)]
    items = spark.createDataFrame([(0, "barley harvest in autumn"), (1, "river stone")], "item_id long, text string")
    check(spark, QUERIES[name], ORACLE[name], world(documents=spark.createDataFrame(rows, DOCUMENT), benchmark=items))


NAMES = ["/a/Cats.txt", "/b/cats.txt", "/b/cat.txt", "/a/doc_01.txts", "/a/docsTides.csv", "/a/.hidden", "/a/tide tides.md", "/a/", "E:\\sea\\tides.csv", "/a/docs", "/c/x.docs"]
ASKED = ["cats", "cat", "cats cats cat", "docs tides txt", "txt", "csv tides", "  TIDES  ", "doc_01", "doc_01.txts", ".hidden", "", "the", "docs", "doc docs txts", "md tide tides", "x.docs"]


def test_names_are_judged_as_pair_by_pair(spark):
    queries = spark.createDataFrame(list(enumerate(ASKED)), "qid long, query string")
    files = spark.createDataFrame([(n,) for n in [*NAMES, *NAMES]], "path string")
    pairs = queries.crossJoin(files.distinct()).select("qid", "path", T.name_share(F.col("path"), F.col("query")).alias("share"), T.name_exact(F.col("path"), F.col("query")).alias("exact")).where("share > 0 OR exact")
    assert sorted(map(tuple, retrieval.name_leg(queries, files).select("qid", "path", "share", "exact").collect())) == sorted(map(tuple, pairs.collect()))


def test_a_word_of_every_name_is_spread_over_tasks(spark):
    files = spark.range(2000).select(F.concat(F.lit("/c/doc_"), "id", F.lit(".txt")).alias("path"))
    queries = spark.range(5).select(F.col("id").alias("qid"), F.lit("reports of doc").alias("query"))
    found = retrieval.name_leg(queries, files).withColumn("task", F.spark_partition_id())
    assert found.count() == 10000
    assert found.groupBy("task").count().agg(F.max("count")).first()[0] < 5000


def test_asked_terms_alone_are_shuffled_and_scored_alike(spark):
    texts = ["barley barley wheat and oats", "the and of", "", "oats", "rye wheat barley stones", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame([(0, "barley"), (0, "oat"), (1, "wheat"), (1, "wheat")], "qid long, term string")
    every, few = (retrieval.postings(docs, "doc_id", F.col("text"), a) for a in (None, asked))
    assert few.where("term IS NULL").count() == 1 and few.count() < every.count()
    assert sorted(map(tuple, few.groupBy("doc_id").agg(F.sum("tf"), F.max("dl")).collect())) == sorted(map(tuple, every.groupBy("doc_id").agg(F.sum("tf"), F.max("dl")).collect()))
    assert sorted(map(tuple, retrieval.bm25_leg(asked, few, 9).collect())) == sorted(map(tuple, retrieval.bm25_leg(asked, every, 9).collect()))


def test_rows_stay_where_they_are_for_prices(spark):
    usage = spark.range(1000).select(F.lit("m").alias("model"), F.col("id").alias("prompt_tokens"), F.lit(0).alias("completion_tokens"))
    priced = state.with_cost(usage, spark.createDataFrame([("M:latest", 1e6, 0.0)], "model string, price_in double, price_out double"))
    assert "hashpartitioning" not in priced._jdf.queryExecution().executedPlan().toString()
    assert priced.agg(F.sum("cost_usd")).first()[0] == sum(range(1000))


def test_search_without_vectors_makes_no_bags(spark):
    files = spark.createDataFrame([(1, "/a/x.txt", "p", "barley harvest"), (2, "/a/y.txt", "p", "river")], "doc_id long, path string, project string, text string")
    queries = spark.createDataFrame([(7, "barley")], "qid long, query string")
    index = S.prepare(files, vectors=False)
    assert index.bags is None
    for given in (None, index):
        assert [(r.qid, r.path) for r in S.search(files, queries, vectors=False, index=given).collect()] == [(7, "/a/x.txt")]


def test_similarities_at_a_half_are_rounded_as_in_sql(spark):
    rows = [(1, [1.0, 127.0, 15.0, 5.0, 2.0]), (2, [-1.0, 127.0, 15.0, 5.0, 2.0])]  # of length 128: a cosine of 0.0078125
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0, 0.0])], "qid long, query array<double>")
    assert [(r.vec_id, r.similarity) for r in retrieval.nearest(queries, vectors, 2).orderBy("rank").collect()] == [(1, 0.007813), (2, -0.007813)]


def test_names_are_judged_by_class_before_pairs_are_made(spark):
    """Pairs of files and queries are made last: nothing groups, sorts or joins them."""
    files = spark.range(300).select(F.concat(F.lit("/c/doc_"), "id", F.lit(".txt")).alias("path"))
    queries = spark.range(300).select(F.col("id").alias("qid"), F.concat(F.lit("report doc "), "id").alias("query"))
    found = retrieval.name_leg(queries, files)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(found" in plan and not {"Aggregate", "Join", "Window", "Sort"} & set(plan[: plan.index("explode(found")].split())
    # a number of three digits or more is a term
    assert found.count() == 90000 and found.where("share > 0.5").count() == 200
