import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from corvane.llm.mixing import Mix, _keys, permuted, plan, targets
from corvane.llm.queries import QUERIES

from ..oracle import SF


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 5000), st.integers(0, 50), st.integers(0, 3))
def test_permutation_and_its_inverse(n, source, epoch):
    keys = _keys(source, epoch, 7)
    to = permuted(np.arange(n), n, keys)
    assert sorted(to.tolist()) == list(range(n)) and permuted(to, n, keys, back=True).tolist() == list(range(n))


def water(sizes, weights):
    """Targets by sharing the excess again and again."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    rest = float(sum(sizes))
    while open_:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if rest * weights[i] / w > 3 * sizes[i] * (1 + 1e-12)}
        for i in over or open_:
            out[i] = 3.0 * sizes[i] if over else rest * weights[i] / w
        rest -= sum(out[i] for i in over)
        open_ = open_ - over if over else set()
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=12))
def test_targets(sizes):
    weights = [i % 3 + 1 for i in range(len(sizes))]
    got = targets(sizes, weights, 3)
    assert got == pytest.approx(water(sizes, weights)) and sum(got) == pytest.approx(sum(sizes))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3000), min_size=1, max_size=6), st.integers(1, 200))
def test_slots_make_up_the_quota(sizes, block):
    p = plan({f"s{i:02d}": n for i, n in enumerate(sizes)}, (1, 2, 3), 3, block, 5)
    for i, n in enumerate(sizes):
        at = np.arange(p.slots[i])
        long = 0
        for k in at.tolist():
            e, place = divmod(k, int(p.blocks[i]))
            b = int(permuted(np.array([place]), int(p.blocks[i]), _keys(i, e, 5))[0])
            long += min(p.last[i] if k == p.slots[i] - 1 else block, n - b * block if b == p.blocks[i] - 1 else block)
        assert long == p.quota[i] == round(p.target[i])


def check(docs, got, cap=3):
    """Sizes, targets and bounds by brute force; what each source gives is its target."""
    size = Counter()
    for _, t, s in docs:
        size[s] += words(t)
    names = sorted(x for x in size if x is not None) + [None] * (None in size)
    want = dict(zip(names, water([size[x] for x in names], [i % 3 + 1 for i in range(len(names))]), strict=True))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, words(t)) for i, t, _ in docs)
    by_target = Counter()
    for r in got:
        assert 0 <= r.taken <= cap * r.size
        by_target[r.source_size, round(r.target, 3)] += r.taken
    merged = Counter()
    for x in names:
        merged[size[x], round(want[x], 3)] += want[x]
    assert by_target.keys() == merged.keys() and all(abs(by_target[k] - v) <= len(names) for k, v in merged.items())


def test_query(spark):
    got = QUERIES["op11_source_mixing"](spark, SF).collect()
    check([(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()], got)
    assert sorted(got) == sorted(QUERIES["op11_source_mixing"](spark, SF.replace("0.001", "0.001/")).repartition(3).collect())
    assert len({r.taken / r.size for r in got if r.size}) > 3


ROWS = [(1, None, "b", 1), (2, "", None, 2), (None, "one two three " * 50, "a", 3), (3, "w " * 3_000, "c", 4), *[(4, "x y z", "a", 5)] * 9, *[(i, "hot hot hot", "hot", 6) for i in range(100, 900)], (5, " \t", "z", 7), (6, "é\x1cé é", None, 8)]


@pytest.mark.parametrize("block,shard", [(1024, 4096), (7, 16), (1, 50)])
def test_edges(spark, block, shard):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string, size int")
    mix = Mix(docs, block=block, shard=shard)
    got = mix.taken().collect()
    check([r[:3] for r in ROWS], got)
    parts = Mix(docs, block=block, shard=shard).samples().collect()
    # the mix itself is what the counts say, in shards of equal slots
    assert Counter({k: v for k, v in Counter({i: sum(r.taken for r in got if r.doc_id == i) for i in {r.doc_id for r in got}}).items() if v}) == sum((Counter({p.doc_id: p.length}) for p in parts), Counter())
    assert all(0 <= p.start and p.length > 0 for p in parts)
    slots = Counter((p.shard, p.turn) for p in parts)
    per_shard = Counter(s for s, _ in slots)
    assert set(per_shard) == set(range(len(per_shard))) and all(n == shard for s, n in per_shard.items() if s != len(per_shard) - 1)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert Mix(docs).taken().count() == 0 and Mix(docs).samples().count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in Mix(blank).taken().collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_shards_differ_and_hold_all_sources(spark):
    docs = spark.createDataFrame([(i, "w " * 50, f"s{i % 4}") for i in range(400)], "doc_id long, text string, source string")
    parts = Mix(docs, block=10, shard=100).samples().groupBy("shard", "source").sum("length").collect()
    by = Counter(p.shard for p in parts)
    assert len(by) in (20, 21) and all(by[k] == 4 for k in range(19)) and len({p["sum(length)"] for p in parts if p.source == "s0"}) > 1
