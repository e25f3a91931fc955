import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from corvane.llm.periodic import names, periodic_runs, runs
from corvane.llm.queries import QUERIES

from ..oracle import SF


def brute(w, least=24, times=3):
    """Every stretch with its smallest period, by comparing each word with the one q words on."""
    found = {}
    for q in range(1, len(w) // times + 1):
        s = 0
        while s + q < len(w):
            e = s
            while e + q < len(w) and w[e] == w[e + q]:
                e += 1
            if e - s + q >= max(least, times * q):
                found.setdefault((s, e + q), q)
            s = e + 1
    return sorted((s, e, q) for (s, e), q in found.items())


def planted(doc_id, w):
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=70), max_size=4), st.integers(2, 12))
def test_equals_brute_force(texts, least):
    got = runs(texts, least)
    assert [[tuple(r[1:]) for r in got.tolist() if r[0] == i] for i in range(len(texts))] == [sorted(brute(t, least)) for t in texts]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), min_size=1, max_size=9), st.integers(1, 9)), min_size=1, max_size=6))
def test_equals_brute_force_on_repeats(parts):
    text = [w for unit, n in parts for w in unit * n]
    assert [tuple(r[1:]) for r in runs([text]).tolist()] == brute(text)


def test_names_stop_where_nothing_repeats():
    assert len(names(np.arange(1000))) == 0
    assert len(names(np.array([0, 1, 2, 0, 1, 3]))) == 2
    assert len(names(np.zeros(1024, dtype=np.int64))) == 10


def test_query_equals_brute_force(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, SF).collect()}
    assert got.keys() == rows.keys()
    for i, text in rows.items():
        w = planted(i, (text or "").encode().split())
        found = brute(w)
        gone = {k for s, e, q in found for k in range(s + q, e)}
        best = min(found, key=lambda r: (-(r[1] - r[0]) / r[2], r[0], r[2]), default=None)
        r = got[i]
        assert r.n_runs == len(found)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{e - s},{q}\n" for s, e, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()
        assert (r.start, r.length, r.period, r.exponent_milli) == ((best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4)


def test_edges(spark):
    again = "one two three " * 8
    rows = [(1, None, "x"), (None, again, "y"), (2, "", None), (3, " \t\n", "z"), (4, again, "a"), (4, again, "a"), (5, "w\x0b" * 200_000, "b"), (6, "é\x1cé " * 24, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = periodic_runs(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, len(r.runs), r.text) for r in got) == sorted(
        [("1", 0, 0, ""), ("None", 24, 1, "one two three"), ("2", 0, 0, ""), ("3", 0, 0, ""), ("4", 24, 1, "one two three"), ("4", 24, 1, "one two three"), ("5", 200_000, 1, "w"), ("6", 24, 1, "é\x1cé")]
    )
    assert periodic_runs(docs.limit(0)).count() == 0


def test_long_text_of_one_document():
    rng = np.random.default_rng(1)
    text = [b"%d" % x for x in rng.integers(0, 50_000, 300_000)]
    text[1000:200_000] = (text[1000:41_000] * 5)[:199_000]
    assert [tuple(r[1:]) for r in runs([text]).tolist()] == [(1000, 200_000, 40_000)]


@pytest.mark.parametrize("least,times", [(1, 2), (6, 2), (10, 4)])
def test_other_thresholds(least, times):
    rng = np.random.default_rng(3)
    text = [b"%d" % x for x in rng.integers(0, 2, 400)]
    assert [tuple(r[1:]) for r in runs([text], max(least, times), times).tolist()] == brute(text, max(least, times), times)
