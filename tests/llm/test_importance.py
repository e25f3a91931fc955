import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings, strategies as st

from corvane.llm.importance import crc32, feature_buckets, resample
from corvane.llm.queries import QUERIES

from ..oracle import SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def features(text, longest=1):
    w = WORD.findall((text or "").translate(UPPER))
    return w, [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, longest=1, least=20, percent=10, buckets=10_000):
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s = Counter(bucket(x) for _, t in docs for x in features(t, longest)[1])
    t = Counter(bucket(x) for y in target for x in features(y, longest)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for i, text in docs:
        w, f = features(text, longest)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((len(w) >= least, i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in rows if r[0]), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2], r[3]))
    drawn = order[: percent * len(order) // 100]
    out = [(*r[1:], n) for n, r in enumerate(drawn, 1)]
    rest = Counter(rows) - Counter(drawn)
    return sorted([*out, *((*r[1:], None) for r in rest.elements())], key=str)


def plain(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in df.collect()), key=str)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=120), max_size=8), st.lists(st.integers(0, 2**32 - 1), min_size=8, max_size=8))
def test_check_sums(parts, before):
    buf = np.frombuffer(b"".join(parts) + b"\0", dtype=np.uint8)
    ends = np.cumsum([0, *map(len, parts)])
    got = crc32(buf, ends[:-1], ends[1:], np.array(before[: len(parts)], dtype=np.uint32))
    assert got.tolist() == [zlib.crc32(p, b) for p, b in zip(parts, before, strict=False)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAzZ09 é\n-_[`{\x7f€", max_size=40)), max_size=5), st.integers(1, 3))
def test_features(texts, longest):
    packed, offsets, words = feature_buckets(texts, longest)
    for i, t in enumerate(texts):
        w, f = features(t, longest)
        assert words[i] == len(w) and packed[offsets[i] : offsets[i + 1]].tolist() == [zlib.crc32(x.encode()) % 10_000 for x in f]


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = plain(QUERIES["op12_importance_resampling"](spark, SF))
    assert got == brute(docs, target) and sum(r[4] is not None for r in got) > 5


def test_edges(spark):
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(1, None, "x"), (None, text, "y"), (None, text, "y"), (2, "", None), (3, "- _ -", "z"), *[(4, text, "a")] * 40, (5, "W" * 300_000 + " " + text, "b"), (6, "w1 w2 zoé " * 9, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank string")
    target = spark.createDataFrame([("zoé w1",), (None,)], "text string")
    for longest in (1, 2):
        got = plain(resample(docs, target, longest=longest))
        assert got == brute([r[:2] for r in rows], ["zoé w1", None], longest)
    assert plain(resample(docs, target.limit(0))) == brute([r[:2] for r in rows], [])
    assert resample(docs.limit(0), target).count() == 0
    assert plain(resample(docs, target, percent=100)) == brute([r[:2] for r in rows], ["zoé w1", None], percent=100)
    assert plain(resample(docs, target, least_words=10**9)) == brute([r[:2] for r in rows], ["zoé w1", None], least=10**9)


def test_ids_of_text(spark):
    docs = spark.createDataFrame([(f"d{i:03d}", f"w{i % 7} " * 30) for i in range(100)], "doc_id string, text string")
    got = resample(docs, docs.where("doc_id < 'd010'").select("text"))
    assert sorted(r.rank for r in got.where("rank IS NOT NULL").collect()) == list(range(1, 11)) and got.count() == 100
