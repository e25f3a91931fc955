import fnmatch

import pytest
from hypothesis import given, settings, strategies as st

from corvane.llm.queries import ORACLE, QUERIES, URL_BLOCKED, URL_RULES
from corvane.llm.urls import Wildcards, canonical, judge_urls

from ..oracle import check


def test_equals_sql(spark):
    check(spark, QUERIES["op5_url_filters"], ORACLE["op5_url_filters"])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab*", max_size=9), min_size=1, max_size=40), st.lists(st.text("abc", max_size=12), min_size=1, max_size=8))
def test_automaton(rules, hosts):
    got = Wildcards([r + "\n" for r in rules]).match(hosts, [""] * len(hosts))
    assert got.tolist() == [[fnmatch.fnmatchcase(h, r) for r in rules] for h in hosts]


def test_edges(spark):
    rows = [
        (1, None, "", "", None, "allow"), (2, "no scheme.com/", "", "", None, "allow"), (3, "http://WWW.Example.COM/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"), (4, "http://x.example.com/en/", "x.example.com", "/en/", "example.com/en/", "block"),
        (5, "http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"), (6, "http://a.net", "a.net", "", None, "allow"), (7, "http://a.net/fr/", "a.net", "/fr/", "net/fr/", "block"), (8, "x://casino.org/?u=http://b", "casino.org", "/", None, "block"),
        (9, "http://ok.org/x.example.com\n/en/", "ok.org", "/x.example.com\n/en/", None, "allow"), (None, "http://é.com/" + "p" * 3000, "é.com", "/" + "p" * 3000, "com/", "allow"),
    ]
    df = spark.createDataFrame([r[:2] + ("x",) for r in rows], "page_id long, url string, host string")
    assert sorted(map(tuple, judge_urls(df, URL_RULES, URL_BLOCKED).collect()), key=str) == sorted([(r[0], *r[2:]) for r in rows], key=str)
    assert judge_urls(df.limit(0), URL_RULES).count() == 0
    assert judge_urls(df.limit(1), []).first().verdict == "allow"


def test_canonical_form():
    for given, want in {
        ("u:p@a.org:8080", "/x/./y/../z//w", ""): ("a.org", "/x/z/w"), ("a.org.", "", ""): ("a.org", "/"), ("a.org:", "/%7euser/%2f%e9", "q=%41&r=%3d"): ("a.org", "/~user/%2F%E9?q=A&r=%3D"), ("[::1]:80", "/../..", ""): ("[::1]", "/"), ("a", "/b/.", ""): ("a", "/b/"),
    }.items():
        assert canonical(*given) == want
        assert canonical(*want, "")[0] == want[0]


def test_globs_see_the_canonical_url(spark):
    bad = ["http://x.casino.org/", "http://free-bets.org", "http://u@ads.x.org:80/", "http://ok.org/a/%77p-login.php", "http://ok.org/b/../cart/1", "http://ok.org/x?PHPSESSID=1&phpsessid=2", "http://ok.org/f/tool.exe#x", "http://spam-farm.org/y"]
    good = ["http://roads-today.org/", "http://uploads-x.org/", "http://casinos.org/", "http://ok.org/cartoon/", "http://ok.org/exe", "http://ok.org/ads/x", "http://a.org/?u=http://casino.org/", "http://ok.org/a.exe?x", None, "casino.org/"]
    rows = [(i, u) for i, u in enumerate(bad + good)]
    got = {r.page_id: r.verdict for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string"), [], URL_BLOCKED).collect()}
    assert [u for i, u in rows if (got[i] == "block") != (u in bad)] == []


def test_a_huge_url():
    import time

    began = time.time()
    w = Wildcards(URL_BLOCKED)
    assert w.match(["a.org"] * 3, ["/" + "p" * 2_000_000 + ".exe", "/" + "q" * 2_000_000, "/"]).any(axis=1).tolist() == [True, False, False]
    assert time.time() - began < 20


@pytest.mark.parametrize("n", [1, 63, 64, 65, 200])
def test_words_of_masks(n):
    w = Wildcards(["a" * n + "\n", "*" + "a" * n + "b\n**"])
    assert w.match(["a" * n, "a" * (n + 3) + "b", "b"], ["", "x", ""]).tolist() == [[True, False], [False, True], [False, False]]
