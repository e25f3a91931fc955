import random

import pytest
from pyspark.sql import functions as F

from corvane.llm.decontam import contamination, without_contaminated
from corvane.llm.queries import ORACLE, QUERIES

from ..oracle import SF, check

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_equals_sql(spark, sf):
    check(spark, QUERIES["op1_decontamination"], ORACLE["op1_decontamination"], sf)


def test_planted(spark):
    rng = random.Random(6)
    word = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    items = {k: word(n) for k, n in enumerate([5, 7, 12, 30, 59, 200])}
    docs, want = [], set()
    for k, item in items.items():
        docs.append((10 * k, " ".join(word(3000) + item + word(2000))))
        docs.append((10 * k + 1, " ".join(word(9)) + "\n" + ", ".join(w.upper() for w in item) + "."))
        docs.append((10 * k + 2, " ".join(word(50) + item[: len(item) // 2] + word(50))))
        want |= {(10 * k, k), (10 * k + 1, k)}
    changed = list(items[4])
    changed[3] = "other"  # four of 55 shingles are lost
    docs.append((99, " ".join(word(40) + changed)))
    df = spark.createDataFrame(docs, DOCS)
    found = contamination(df, spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], ITEMS))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want | {(99, 4)}
    assert without_contaminated(df, found).count() == len(docs) - len(want) - 1


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "two words"), (3, "two words"), (None, "a b c d e f"), (4, "A, b c d E f! " * 30000)], DOCS).withColumn("item_id", F.lit("x")).withColumn("s", F.lit(1))
    items = spark.createDataFrame([(1, None), (2, " !"), (3, "Two words."), (4, "a b c d e f"), (4, "a b c d e f"), (None, "two words")], ITEMS)
    assert sorted(map(tuple, contamination(docs, items).collect())) == [(3, 3, 1, 1), (4, 4, 2, 2)]
    assert contamination(docs.limit(0), items).count() == 0 and contamination(docs, items.limit(0)).count() == 0
    assert without_contaminated(docs, contamination(docs, items)).count() == 3


def test_a_very_long_text(spark):
    item = " ".join(f"item{i}" for i in range(30))
    long = " ".join(f"w{i}" for i in range(200_000))
    docs = spark.createDataFrame([(1, long[:500_000] + " " + item + " " + long[500_000:]), (2, long)], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in contamination(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()] == [(1, 7)]
