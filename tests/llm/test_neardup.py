import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.llm.neardup import near_duplicates
from corvane.llm.queries import ORACLE, QUERIES

from ..oracle import check

SCHEMA = "doc_id long, text string"


def brute(rows, width, percent):
    """Components over all pairs."""
    sets = []
    for _, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if either and 100 * both >= percent * either and comp[i] != comp[j]:
                comp = [comp[j] if c == comp[i] else c for c in comp]
    return {rows[i][0]: (len(sets[i]), min(rows[k][0] for k in range(len(rows)) if comp[k] == comp[i])) for i in range(len(rows))}


def test_equals_sql(spark):
    check(spark, QUERIES["op9_near_dedup"], ORACLE["op9_near_dedup"])


def test_near_copies(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([6, 20, 120, 400]))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 60))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n, ""), (n + 1, " \n"), (n + 2, "Two WORDS"), (n + 3, "two words")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows, 5, 80)


def test_edges(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None), (None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, "x " * 200000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("kept", F.lit(3)).withColumn("node", F.lit("x"))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 0, 1, True), (None, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (7, 1, 7, True)], key=str)


def test_text_ids_and_rows_that_share_an_id(spark):
    same, other = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [("x", same), ("y", same), ("y", other), ("z", other), ("z", other), ("y", None)]
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()))
    # of the rows of y that with the least text counts
    assert got == [("x", 36, "x", True)] + [("y", 36, "x", False)] * 3 + [("z", 36, "z", True)] * 2


def test_families_within_a_hot_template(spark):
    # all texts share most of a template, so they meet in the same buckets; families lie just over the threshold
    rng = random.Random(13)
    template = [f"t{i}" for i in range(100)]
    rows, n = [], 0
    for _ in range(60):
        base = list(template)
        for i in rng.sample(range(100), 4):
            base[i] = f"f{rng.randrange(10**6)}"
        for _ in range(rng.choice([1, 1, 2, 3])):
            copy = list(base)
            for i in rng.sample(range(100), rng.randint(0, 2)):
                copy[i] = f"c{rng.randrange(10**6)}"
            rows.append((n, " ".join(copy)))
            n += 1
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute(rows, 5, 80)
    assert got == want and 5 < len({c for _, c in want.values()}) < len(rows) - 5


@pytest.mark.parametrize("edits,wrong,n", [(10, 0, 600), (7, 4, 200)])
def test_links_in_a_hot_template(spark, edits, wrong, n):
    """Texts of one template of 400 words; a tenth of them were made from another one, just within the threshold.

    With 7 edits some texts are also linked by chance, by nothing but the template's words, which only the rounds can find.
    """
    import numpy as np

    rng = random.Random(edits)
    made = []
    for i in range(n):
        words = list(range(400)) if i < n * 9 // 10 else list(made[rng.randrange(n * 9 // 10)])
        for at in rng.sample(range(400), edits if i < n * 9 // 10 else rng.randint(7, 9)):
            words[at] = rng.randrange(10**6, 10**9)
        made.append(words)
    order = rng.sample(range(n), n)
    # every word has its place, so shingles are equal at equal places only
    w = np.array([made[i] for i in order])
    sh = w[:, :396] * 3 + w[:, 1:397] * 5 + w[:, 2:398] * 7 + w[:, 3:399] * 11 + w[:, 4:] * 13
    parent = list(range(n))
    links = 0
    for a in range(n):
        both = (sh[a] == sh).sum(axis=1)
        for b in np.flatnonzero(100 * both >= 80 * (792 - both)).tolist():
            if b > a:
                links += 1
                x, y = a, b
                while parent[x] != x:
                    x = parent[x]
                while parent[y] != y:
                    y = parent[y]
                parent[max(x, y)] = min(x, y)
    root = lambda x: x if parent[x] == x else root(parent[x])
    rows = [(i, " ".join(f"w{x}" for x in words)) for i, words in enumerate(w.tolist())]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert links > 5 and sum(got[i] != root(i) for i in range(n)) <= wrong


@pytest.mark.parametrize("n", [1, 3, 30])
def test_signature_of_small_sets(n):
    import numpy as np

    from corvane.llm.neardup import OnePermutation
    from corvane.llm.words import seeds

    s = np.sort(seeds(n, 99))
    assert set(OnePermutation(5, 40).signature(s).tolist()) <= set(s.tolist())


def test_rounds_are_for_sets_that_share_frequent_shingles(spark, monkeypatch):
    """Forty texts of one template, most too different to be linked: the prefix filter settles them all."""
    from corvane.llm import neardup

    rng = random.Random(5)
    base, rows = [f"b{i}" for i in range(120)], []
    for n in range(40):
        own = rng.sample(range(120), 1 if n % 10 == 0 else 6)
        rows.append((n, " ".join(f"own{n}x{i}" if i in own else w for i, w in enumerate(base))))
    met, confirmed = [], neardup._confirmed
    monkeypatch.setattr(neardup, "_confirmed", lambda pairs, *a: met.append(pairs.count()) or confirmed(pairs, *a))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows, 5, 80)
    assert len(set(c for _, c in got.values())) > 20
    assert len(met) == 2  # the stars and the prefix filter, no round


@pytest.mark.parametrize("family,rounds", [(1 << 14, 0), (50, 1)])
def test_families_of_frequent_shingles_are_tested_pair_by_pair(spark, monkeypatch, family, rounds):
    """Ninety texts of one template that share nothing rare: blocks settle them without a round, larger families go on."""
    from corvane.llm import neardup

    rng = random.Random(8)
    rows = []
    for n in range(90):
        own = rng.sample(range(120), rng.choice([2, 3, 4]))
        rows.append((n, " ".join(f"own{n}x{i}" if i in own else f"b{i}" for i in range(120))))
    steps, fresh = [], neardup._fresh
    monkeypatch.setattr(neardup, "FAMILY", family)
    monkeypatch.setattr(neardup, "BLOCK", 20)
    monkeypatch.setattr(neardup, "COLUMNS", 64)
    monkeypatch.setattr(neardup, "_fresh", lambda *a: steps.append(a[4]) or fresh(*a))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert bool(steps) == bool(rounds)
    wanted = brute(rows, 5, 80)
    assert len(set(c for _, c in wanted.values())) > 5
    assert rounds or got == wanted


@pytest.mark.parametrize("quiet", [0, 1])
def test_families_of_any_size_are_tested_whole(spark, monkeypatch, quiet):
    """Ninety texts of one template, a family that is too large to be tested at once: rounds that end early leave links, which blocks find in several turns."""
    from corvane.llm import neardup

    rng = random.Random(8)
    rows = []
    for n in range(90):
        own = rng.sample(range(120), rng.choice([2, 3, 4]))
        rows.append((n, " ".join(f"own{n}x{i}" if i in own else f"b{i}" for i in range(120))))
    monkeypatch.setattr(neardup, "FAMILY", 50)
    monkeypatch.setattr(neardup, "BLOCK", 12)
    monkeypatch.setattr(neardup, "AHEAD", 1, raising=False)
    monkeypatch.setattr(neardup, "CENTRES", 1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), quiet=quiet).collect()}
    assert got == brute(rows, 5, 80)


@pytest.mark.parametrize("heavy", [1 << 20, 600])
def test_blocks_meet_each_other_once(spark, monkeypatch, heavy):
    """Every two of a family's blocks are compared, in one turn only, however many turns and blocks there are."""
    from corvane.llm import neardup
    from corvane.scratch import Scratch

    sets = spark.range(200).select("id", F.expr("transform(sequence(0, 19), i -> if(i < 18, CAST(i AS BIGINT), id * 100 + i))").alias("shingles"))
    families = spark.range(200).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("family"), F.lit(200).cast("long").alias("size"), F.lit(4000).cast("long").alias("weight"))
    seen = []
    for ahead in (1, 16):
        monkeypatch.setattr(neardup, "AHEAD", ahead)
        monkeypatch.setattr(neardup, "BLOCK", 40)
        monkeypatch.setattr(neardup, "WEIGHT", heavy)
        labels = neardup._by_blocks(families, sets, spark.createDataFrame([], "id long, component long"), 80, Scratch(spark, "blocks"), "blocks")
        seen.append(sorted(map(tuple, labels.collect())))
    assert seen == [[(i, 0) for i in range(200)]] * 2
