import random

import numpy as np
from pyspark.sql import functions as F

from corvane.llm import langid
from corvane.llm.queries import QUERIES

from ..oracle import SF

SCHEMA = "doc_id long, text string, lang string"


def brute_bits(order, train, text):
    """Code length by method C with exclusions, symbol by symbol."""
    counts = {}
    for t in train:
        data = b" " * order + langid.letters(t) + b" "
        for i in range(order, len(data)):
            for k in range(order + 1):
                counts.setdefault(data[i - k : i], {}).setdefault(data[i], 0)
                counts[data[i - k : i]][data[i]] += 1
    data, bits = b" " * order + langid.letters(text) + b" ", 0.0
    for i in range(order, len(data)):
        out = set()
        for k in range(order, -1, -1):
            seen = {s: n for s, n in counts.get(data[i - k : i], {}).items() if s not in out}
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if data[i] in seen:
                bits -= np.log2(seen[data[i]] / total)
                break
            bits -= np.log2(len(seen) / total)
            out |= seen.keys()
        else:
            bits += np.log2(256 - len(out))
    return bits


def test_code_lengths(spark):
    train = {"aa": ["the cat sat on the mat", "that hat"], "bb": ["der hund saß auf", "die maus lief"]}
    rows = [(i, t, k) for k, ts in train.items() for i, t in enumerate(ts)]
    model = langid.fit(spark.createDataFrame(rows, SCHEMA), order=2)
    trees = langid.ContextTrees(*model)
    for text in ("the maus", "zzz", "saß ß", "hat on der", "日本"):
        want = [brute_bits(2, train[k], text) for k in trees.langs]
        assert np.allclose(trees.bits([langid.letters(text)])[0], want, atol=1e-3)


def test_held_out_accuracy(spark):
    got = QUERIES["op2_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    row = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert row.a >= 0.98 and 0 <= row.lo <= row.hi <= 1


def test_edges(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["le", "chat", "vert"]) for _ in range(30)), "fr") for i in range(5)] + [(i, " ".join(rng.choice(["the", "green", "cat"]) for _ in range(30)), "en") for i in range(5, 10)]
    df = spark.createDataFrame(rows + [(10, None, "en"), (11, "123 !!", None), (12, "chat vert " * 50000, None), (None, "the cat", None), (12, "the", "")], SCHEMA)
    got = {(r.doc_id, r.lang_pred): r.score for r in langid.predict(df, langid.fit(df)).collect()}
    assert got[10, "und"] == got[11, "und"] == 0 and (12, "fr") in got and (12, "en") in got and (None, "en") in got
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.fit(empty) is None and langid.predict(empty, None).count() == 0
    assert langid.predict(df.limit(1), None).first().lang_pred == "und"


def test_too_many_languages_are_an_error(spark):
    import pytest

    df = spark.createDataFrame([(f"l{i}", "some words") for i in range(4)], "lang string, text string")
    assert langid.fit(df, max_langs=4) is not None
    with pytest.raises(ValueError, match="more than 3"):
        langid.fit(df, max_langs=3)


def test_the_sample_stays_bounded_when_one_text_fills_the_table(spark):
    same = spark.range(3000).selectExpr("id AS doc_id", "'the same words' AS text", "'en' AS lang")
    other = spark.range(50).selectExpr("id + 5000 AS doc_id", "concat('der satz ', id) AS text", "'de' AS lang")
    read = lambda model: dict(zip(model[1], (sum(n for n, k, l in zip(model[5], model[2], model[4]) if k == 0 and l == i) for i in range(len(model[1])))))  # noqa: E731, E741
    size = len(langid.letters("the same words")) + 1
    got = read(langid.fit(same.union(other), sample_per_lang=100))
    # copies under different ids are drawn each, about a hundred of 3,000; rows equal in all three columns count once
    assert 50 * size <= got["en"] <= 200 * size and got["de"] > 0
    alike = same.selectExpr("7L AS doc_id", "text", "lang")
    assert read(langid.fit(alike.union(other), sample_per_lang=3000))["en"] == size
