import random
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvane.llm.packing import Encoder, pack, plan

PATH = public_tokenizers.path("byte_bpe_50k.json")
EXACT = Tokenizer.from_file(PATH)


def best_fit(sizes, capacity):
    rooms = []
    for k in sorted(sizes, reverse=True):
        i = bisect_left(rooms, k)
        insort(rooms, (rooms.pop(i) if i < len(rooms) else capacity) - k)
    return len(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rng = random.Random(seed)
    sizes = [min(2048, max(1, int(rng.lognormvariate(6.2, 1.2)))) for _ in range(rng.choice([0, 1, 30, 2000]))]
    filled, counted = Counter(), Counter()
    for k, first, n, sequence, offset in sorted(plan(dict(Counter(sizes)), 2048), key=lambda r: (r[3], r[4])):
        counted[k] += n
        for i in range(n):
            assert filled[sequence + i] == offset
            filled[sequence + i] += k
    assert counted == Counter(sizes) and all(v <= 2048 for v in filled.values())
    assert len(filled) <= best_fit(sizes, 2048) * 1.01 + 1


def test_same_ids():
    e = Encoder(PATH)
    for t in ["", " ", "a  b\n\n c", "don't x's", "<|endoftext|>a", "été ÀÉ ß ñ", "12 3\u00a0x", "日本 \u3000 語", "a\x1cb \x85", "ŋ ɐ ʰ", "e\u0301"]:
        assert list(e.ids(t)) == EXACT.encode(t, add_special_tokens=False).ids


def test_pieces(spark):
    rng = random.Random(8)
    texts = [None, "", "short", *(" ".join(f"w{rng.randrange(9999)}" for _ in range(n)) for n in (10, 400, 3000, 40))]
    df = spark.createDataFrame(list(enumerate(texts)) + [(2, "short"), (None, "x")], "doc_id long, text string").withColumn("rank", F.lit(1)).withColumn("length", F.lit("x"))
    rows = pack(df, PATH).collect()
    for i, t in enumerate(texts):
        ids = np.array([*EXACT.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: (r.piece, r.sequence_id))
        if i != 2:
            assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) == len(ids)
            assert all(r.length == 2048 for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    by = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 2048 and sum(r.doc_id == 2 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    assert pack(df.limit(0), PATH).count() == 0


def test_other_vocabularies_take_the_library_itself(tmp_path):
    import json

    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    assert Encoder(path).fast is not None
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(spec), encoding="utf-8")
    other = Encoder(str(tmp_path / "other.json"))
    assert other.fast is None and other.ids("word") == Encoder(path).ids(" word")


def test_a_very_long_word_and_text(spark):
    texts = ["x" * 100_000, "lorem ipsum " * 300_000]
    got = pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json")).groupBy("doc_id").agg({"length": "sum"}).collect()
    exact = Encoder(public_tokenizers.path("byte_bpe_50k.json")).exact
    assert dict(map(tuple, got)) == {i: len(exact.encode(t, add_special_tokens=False)) + 1 for i, t in enumerate(texts)}
