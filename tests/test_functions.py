import pytest
from pyspark.sql import functions as F

from corvane.functions import checks, text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("query, terms", [("Which of the barley harvests were wet?", ["barley", "harvests", "wet"]), ("ship_order late late", ["ship_order", "late", "late"]), ("", []), ("an ox", [])])
def test_query_terms(spark, query, terms):
    assert one(spark, T.query_terms(F.col("q")), q=query) == terms


@pytest.mark.parametrize("terms, text, share", [(["swimming"], "swims", 0.0), (["carried", "boxes"], "carry two boxes home", 1.0), (["carry", "nothing"], "carry", 0.5)])
def test_term_coverage(spark, terms, text, share):
    assert one(spark, T.term_coverage(F.col("t"), F.col("x")), t=terms, x=text) == share


@pytest.mark.parametrize(
    "path, query, share",
    [("boatyard.go", "boat", 0.0), ("boat_yard.go", "boat", 1.0), ("sailMakers.go", "sail maker", 1.0), ("sailMakers.go", "sail anchors", 0.5), ("tides.csv", "csv", 0.0), ("tides.csv", "tide moon", 0.5), ("hats.csv", "hat", 0.0), ("E:\\sea\\tides.csv", " TIDES ", 1.0)],
)
def test_name_share(spark, path, query, share):
    assert one(spark, T.name_share(F.col("p"), F.col("q")), p=path, q=query) == share


@pytest.mark.parametrize("path, words", [("sailMakers.go", "sail makers"), ("Tide_Table-north.v3.XLS", "tide table north v3"), ("XMLReader.rs", "xmlreader"), ("CHANGES", "changes"), ("E:\\sea\\low_tide.py", "low tide")])
def test_name_words(spark, path, words):
    assert one(spark, T.name_words(F.col("p")), p=path) == words


def test_body_and_content_chars(spark):
    assert one(spark, T.body(F.col("t")), t="head line\nfirst\nsecond") == "first\nsecond" and one(spark, T.body(F.col("t")), t="only") == "only"
    assert one(spark, T.content_chars(F.col("t")), t="Été: 3 œufs!") == 8
    assert one(spark, T.content_chars(F.col("t")), t=" ?! -- ") == 0


def test_scaled_similarity(spark):
    for s, floor, want in ((0.7, 0.4, 0.5), (0.3, 0.4, 0.0), (1.0, 1.0, 0.0), (1.2, 0.0, 1.0)):
        assert abs(one(spark, T.scaled_similarity(F.col("s"), floor), s=s) - want) < 1e-9


@pytest.mark.parametrize("text, quality", [("", 0.0), ("7/11 9,99", 1.0), ("zzzz || aaaa", 0.0), ("three sound words", 1.0), ("naïf #", 0.5), ("bcd aabe", 0.5), ("aaabb x", 0.0)])
def test_ocr_quality(spark, text, quality):
    assert one(spark, T.ocr_quality(F.col("t")), t=text) == quality


@pytest.mark.parametrize(
    "check, good, bad",
    [(checks.luhn, "79927398713", ["79927398710", "0", "", "x"]), (checks.iban, "DE89 3704 0044 0532 0130 00", ["DE89 3704 0044 0532 0130 01", "DE89"]), (checks.aba, "111000025", ["111000026", "11100002"]), (checks.verhoeff, "123451", ["123456", ""])],
)
def test_check_digits(spark, check, good, bad):
    assert one(spark, check(F.col("v")), v=good) is True
    for v in bad:
        assert one(spark, check(F.col("v")), v=v) is False


def test_small_functions(spark):
    assert one(spark, T.says_little(F.col("c"), F.col("t")), c="", t="~~ ||") is True and one(spark, T.says_little(F.col("c"), F.col("t")), c="a lake", t="") is False
    assert one(spark, T.over_budget(F.col("t"), F.lit(2)), t="123456789") is True and one(spark, T.fit_to_budget(F.col("t"), F.lit(2)), t="123456789") == "12345678"
    assert one(spark, T.fenced(F.col("t"), "k"), t="x") == "<<<k\nx\nk>>>"


def test_plain_words_are_told_at_one_look(spark, monkeypatch):
    tokens = ["word", "«Été»", "aba", "ababa", "abab", "ababab", "aab", "bcd", "bcd—", "bcdé", "e", "éé", "ao", "(tide),", "it's", "a1b", "12", "1,5%", "--", "aaab", "abacad", "aXa", "Aa", "xyx", "Ünü", "lllla", "b.c.a", "x" * 40, "ab" * 20, "\U00010400\U00010401a"]
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    fast = {r.t: (r.k, r.p) for r in df.select("t", T.token_kind(F.col("t")).alias("k"), T.plain_word(F.col("t")).alias("p")).collect()}
    monkeypatch.setattr(T, "plain_word", lambda raw: F.lit(False))
    slow = {r.t: r.k for r in df.select("t", T.token_kind(F.col("t")).alias("k")).collect()}
    assert {t: k for t, (k, _) in fast.items()} == slow
    assert {t for t, (_, p) in fast.items() if p} >= {"word", "«Été»", "ao", "(tide),", "abacad", "bcdé"}
