import difflib
import math
import random

import pytest
import re

from pyspark.sql import functions as F

from corvane.operators import evaluate, match, rag, redact
from corvane.plans import search as S
from corvane.providers import resolve_models, speed_test


def reduced(text, wanted, budget):
    """Paragraphs by wanted words, each taken if it fits what is left."""
    cost = lambda t: math.ceil(len(t) / 4)
    if cost(text) <= budget:
        return text, False
    parts = [p for p in re.split(r"\n\s*\n", text) if p.strip()]
    ranked = sorted(enumerate(parts), key=lambda p: (-len(wanted & set(re.findall(r"[a-z0-9+#.]{2,}", p[1].lower()))), p[0]))
    kept, left = [], budget
    for i, p in ranked:
        if cost(p) <= left:
            kept.append(i)
            left -= cost(p)
    return ("\n\n".join(parts[i] for i in sorted(kept)) or (parts or [text])[0][: 4 * budget]), True


def test_paragraphs_by_brute_force(spark):
    rng = random.Random(2)
    words = ["oak", "Elm", "ash", "c++", "x", "fir", "yew.", " "]
    texts = ["", "\n\n \n\n", "a" * 400] + ["\n\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    rows = [(i, t, rng.randint(1, 40)) for i, t in enumerate(texts)]
    got = {r.i: (r.kept, r.cut) for r in rag.reduce_texts(spark.createDataFrame(rows, "i int, text string, budget int"), "Elm C++ yew. none").collect()}
    assert got == {i: reduced(t, {"elm", "c++", "yew.", "none"}, b) for i, t, b in rows}


def test_packing_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(q, rng.randint(1, 10), f"f{rng.randint(1, 6)}", i, i + 3, "w" * rng.randint(0, 900)) for q in range(6) for i in range(rng.randint(0, 14))]
    got = {}
    for r in rag.pack_sources(spark.createDataFrame(rows, "qid long, file_rank int, path string, start_line int, end_line int, text string"), 300).collect():
        got.setdefault(r.qid, []).append((r.n, r.path, r.start_line, r.text))
    want = {}
    for q in range(6):
        used = 0
        for _, rank, path, start, _, text in sorted((x for x in rows if x[0] == q and x[1] <= 8), key=lambda x: (x[1], x[3], x[2])):
            cost = math.ceil(len(text) / 4) + 20
            if used + cost > 300:
                if want.get(q):
                    continue
                text = text[: 4 * 280]
                cost = math.ceil(len(text) / 4) + 20
            used += cost
            want.setdefault(q, []).append((len(want.get(q, [])) + 1, path, start, text))
    assert {q: sorted(v) for q, v in got.items()} == want


def test_neighbours_are_one_text(spark):
    rows = [
        (1, "a", 1, 3, 0, "code", "f", "head\nl1\nl2\nl3"), (1, "a", 3, 5, 0, "code", "g", "head\nl3\nl4\nl5"), (1, "a", 6, 6, 0, "code", "g", "head\nl6"), (1, "a", 9, 9, 0, "code", "", "head\nl9"), (1, "a", 1, 9, 0, "outline", "", "head\nsummary"),
        (1, "b", 0, 0, 2, "doc", "", "head\np2a"), (1, "b", 0, 0, 2, "doc", "", "head\np2b"), (1, "b", 0, 0, 3, "doc", "", "head\np3"),
    ]
    got = rag.merge_pieces(spark.createDataFrame(rows, "qid int, path string, start_line int, end_line int, page int, kind string, symbol string, text string")).collect()
    assert sorted((r.path, r.page, r.start_line, r.end_line, r.symbol, r.text) for r in got if r.path == "a") == [("a", 0, 1, 6, "f, g", "l1\nl2\nl3\nl4\nl5\nl6"), ("a", 0, 1, 9, "", "summary"), ("a", 0, 9, 9, "", "l9")]
    assert sorted((r.page, sorted(r.text.split("\n"))) for r in got if r.path == "b") == [(2, ["p2a", "p2b"]), (3, ["p3"])]


def test_answer_sources(spark):
    rows = [(1, r, f"/p/{n}.py", "p", k, "", 0, 1, 9, f"head\nbody {n}") for r, n, k in ((1, "a", "code"), (2, "b", "doc"), (3, "c", "code"))]
    df = spark.createDataFrame(rows, "qid long, file_rank int, path string, project string, kind string, symbol string, page int, start_line int, end_line int, text string")
    got = rag.answer_sources(df, spark.createDataFrame([("/p/a.py",)], "path string"), 500, "k").orderBy("n").collect()
    assert [(r.n, r.path, r.role, r.withheld) for r in got] == [(1, "/p/b.py", "chat", 1), (2, "/p/c.py", "chat", 1)] and got[0].block == "[1] b.py (lines 1-9)\n/p/b.py\n<<<k\nbody b\nk>>>"
    token = rag.fence_token(df)
    assert len(token) == 12
    pinned = rag.pinned(spark.createDataFrame([(1, "a", "alpha\n\n" + "beta " * 400), (1, "b", "short")], "s int, path string, text string"), "s", "beta", 100, "k").collect()
    assert [(r.path, r.cut, "truncated" in r.block) for r in sorted(pinned, key=lambda r: r.path)] == [("a", True, True), ("b", False, False)]


def near(wanted, hay, threshold):
    """Any stretch, a word longer than the quote, that shares half of its words and is alike enough."""
    quote, words = wanted.split(), hay.split()
    for i in range(max(1, len(words) - len(quote) + 1)):
        part = words[i : i + len(quote) + 1]
        if len(set(part) & set(quote)) >= max(1, len(set(quote)) // 2) and difflib.SequenceMatcher(None, " ".join(part), wanted, autojunk=False).ratio() >= threshold:
            return True
    return False


@pytest.mark.parametrize("longest,length,kinds", [(80, 9, 300), (400, 40, 60), (300, 90, 1000)])
def test_near_quotes_by_brute_force(spark, longest, length, kinds):
    rng = random.Random(7)
    words = [f"word{i}" for i in range(kinds)]
    texts = [[rng.choice(words) for _ in range(rng.randint(5, longest))] for _ in range(40 if longest < 100 else 14)]
    quotes = []
    for i in range(30):
        t = rng.choice(texts)
        at = rng.randrange(max(1, len(t) - length + 1))
        q = t[at : at + rng.randint(1, length)]
        for _ in range(rng.randint(0, 2 + length // 12)):
            q[rng.randrange(len(q))] = rng.choice(words + ["other"])
        quotes.append((i, " ".join(q)))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id int, text string")
    got = {(r.item_id, r.doc_id) for r in match.near_quotes(spark.createDataFrame([(i, q, []) for i, q in quotes], "item_id int, quote string, terms array<string>"), docs).collect()}
    want = {(i, d) for i, q in quotes for d, t in enumerate(texts) if len(q) < 8 and f" {q} " in f" {' '.join(t)} " or len(q) >= 8 and (q in " ".join(t) or near(q, " ".join(t), 0.85))}
    assert got == want and len(want) > 20


def test_patterns_compete_for_a_path(spark):
    results = spark.createDataFrame([(1, "X\\ab.txt", 1, True), (1, "x/ab.md", 2, True), (1, "x/b.txt", 3, False)], "qid long, path string, rank int, strong boolean")
    expected = spark.createDataFrame([(1, 0, "ab"), (1, 1, "b")], "qid long, pos int, pattern string")
    m = evaluate.query_metrics(spark.createDataFrame([(1,)], "qid long"), results, expected).first()
    # the first file takes "ab", the second one "b"
    assert abs(m.ndcg - 1) < 1e-12 and m.p_at_5 == 0.6 and m.mrr == 1
    spec = evaluate.read_spec(spark, [{"q": "a", "expect": ["x"]}, {"q": "b", "expect_none": True, "not": ["y"]}])
    assert [r.expect_none for r in spec.orderBy("qid").collect()] == [False, True]
    for bad in ([], [{"q": "a"}], [{"expect": ["x"]}], [{"q": "a", "expect": ["x"], "expect_none": True}], [{"q": "a", "expect": "x"}]):
        try:
            evaluate.read_spec(spark, bad)
            raise AssertionError(bad)
        except ValueError:
            pass


FILES = "doc_id long, path string, project string, ext string, kind string, source string, mtime long, text string"


def test_search_as_typed(spark):
    rows = [
        (1, "/p/pay_run.py", "Billing", ".py", "code", "", 10, "head\nretry the failed payment with a longer pause between tries"), (2, "/p/notes.md", "Billing", ".md", "doc", "", 20, "head\npayment retries are described here in some detail for all"), (3, "/q/retry.txt", "Other", ".txt", "doc", "", 30, "head\nnothing of that kind stands in this text at all, only words"),
        (4, "/q/plan.md", "Other", ".md", "ai-note", "claude-plan", 40, "head\na plan without the wanted words but with many others in it"),
    ]
    files = spark.createDataFrame(rows, FILES)
    got = [r.path for r in S.search_text(files, "retry payment").orderBy("position").collect()]
    assert set(got[:2]) == {"/p/pay_run.py", "/p/notes.md"} and "/q/retry.txt" in got  # the last by its name
    assert [r.path for r in S.search_text(files, "retry payment type:code proj:billing").collect()] == ["/p/pay_run.py"]
    assert [r.path for r in S.search_text(files, "type:doc,plan").orderBy("position").collect()] == ["/q/plan.md", "/q/retry.txt", "/p/notes.md"]
    words = S.search_text(files, "retry payment", vectors=False).collect()
    assert {r.path for r in words} >= {"/p/pay_run.py", "/p/notes.md"} and all(r.snippet and r.reference == r.path for r in words)


def test_outbound_and_restored_in_parts(spark):
    rows = [(1, 1, "Name: Jane Doe\ncard 4111 1111 1111 1111, github.com/jdoe"), (1, 2, "jane doe's number is 212-555-0100-77 at 5 Elm Park Place")]
    got = redact.outbound(spark.createDataFrame(rows, "request int, n int, text string")).orderBy("n").collect()
    assert got[0].redacted == "Name: [NAME_1]\ncard [CARD REMOVED], [URL_1]" and got[0].masked == 1 and got[1].redacted == "[NAME_1]'s number is [PHONE_1] at [ADDRESS_1]"
    assert got[0].redacted_values == 4 and got[0].names["[NAME_1]"] == "Jane Doe"
    cut = spark.createDataFrame([("see [NAME_", 4), ("see [NAME_1]", 12), ("a [ b", 5), ("", 0)], "t string, want int").select(redact.held_back(F.col("t")).alias("at"), "want").collect()
    assert all(r.at == r.want for r in cut)


def test_models(spark):
    roles = spark.createDataFrame([("chat",), ("judge",), ("embed",)], "role string")
    wishes = spark.createDataFrame([("chat", "Big", "catalog", 1), ("chat", "mid:latest", "catalog", 2), ("judge", "big", "pinned", 9), ("embed", "none", "pinned", 1)], "role string, model string, rule string, place int")
    have = spark.createDataFrame([("big:latest", False, 70), ("mid", True, 30), ("small", True, 3)], "model string, fits boolean, size int")
    assert {(r.role, r.model, r.rule) for r in resolve_models(roles, wishes, have).collect()} == {("chat", "mid", "catalog"), ("judge", "big:latest", "pinned"), ("embed", "mid", "largest")}
    assert speed_test(lambda t: [[0.0]] * len(t), lambda p: "x" * 400)["fast"]
