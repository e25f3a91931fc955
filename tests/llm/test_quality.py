import re
from collections import Counter

import numpy as np

from corvane.llm.quality import IsolationForest, judge, rule_counts, threshold
from corvane.llm.queries import QUERIES

from ..oracle import SF


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    three = list(zip(w, w[1:], w[2:], strict=False))
    n = Counter(three)
    covered = {k + j for k, g in enumerate(three) if n[g] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)]


def test_base_counts(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [None, "", " \n\t", "a a a a", "a b\na b\n\na b ", "é#\x1cß", "x " * 100000]
    assert rule_counts(texts)[:, :5].tolist() == [brute(t) for t in texts]


def test_forest_isolates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3))
    x[0] = 9
    scores = IsolationForest(x, 64, 128, 1).scores(x)
    assert scores.argmax() == 0 and 0 < scores.min() < scores.max() < 1
    assert threshold({10: (5, 0), 20: (0, 4), 15: (1, 2)}, 0.9) == 20 and threshold({}, 0.9) > 1000


def test_query(spark):
    got = QUERIES["op4_quality_rules"](spark, SF)
    rows = got.collect()
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in rows)
    good = got.join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id").where("NOT base_failed")
    assert good.where("kept").count() >= 0.97 * good.count()


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (None, "w " * 60), (2, " ".join(f"w{i}" for i in range(60))), (2, " ".join(f"w{i}" for i in range(60)))], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = sorted(((r.doc_id, r.base_failed, r.kept) for r in judge(docs, none).collect()), key=str)
    assert got == sorted([(1, True, False), (None, True, False), (2, False, True), (2, False, True)], key=str)
    assert judge(docs.limit(0), none).count() == 0


def test_verdict_on_rows_whose_labels_it_has_not_seen(spark):
    from corvane.llm.quality import judge

    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    seen = labels.where("doc_id % 2 = 0")
    judged = judge(docs, seen).where("NOT base_failed").join(labels.where("doc_id % 2 = 1").groupBy("doc_id").agg({"quality": "min"}).toDF("doc_id", "quality"), "doc_id")
    share = {r.quality: r.kept for r in judged.selectExpr("quality", "cast(kept AS int) AS kept").groupBy("quality").avg("kept").toDF("quality", "kept").collect()}
    assert share[1] >= 0.98 and share[0] <= 0.75
