import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corvane.llm.tokens import Counter, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
EXACT = Tokenizer.from_file(PATH)


def exact(text):
    return len(EXACT.encode(text or "", add_special_tokens=False))


def test_whole_and_chunked(spark):
    rng = random.Random(4)
    odd = ["a\x1cb", "<|endoftext|> x", "don't", "é", "e\u0301", "\u00a0", "\u2028x", "ÀÉ", "日本語", "12345", "!!!", "\n\n", "x" * 90]
    texts = [" ".join(rng.choice(odd + ["word", "other"]) for _ in range(n)) for n in (0, 1, 5, 50, 400, 3000)] + [None, "y" * 3000, "z " * 9 + "q" * 900 + " r" * 400]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(None, "a b")], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(rows, PATH, chunk=700, overlap=16).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (len((t or "").encode()), exact(t), exact(t) > 2048)
    # every text of more than a chunk comes from splices, but for those without a place to splice
    counted = {r.doc_id: r.chunks for r in token_counts(rows, PATH, chunk=700, overlap=16).collect()}
    for i, t in enumerate(texts):
        assert (counted[i] > 1) == (len(t or "") > 700 and t[0] != "y")
    assert got[None][1] == 2 and token_counts(rows.limit(0), PATH).count() == 0


@pytest.mark.parametrize("chunk, overlap", [(40, 1), (64, 8), (1000, 500)])
def test_splicing(spark, chunk, overlap):
    c = Counter(PATH, chunk, overlap)
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect():
        assert c.spliced(r.text)[0] == exact(r.text)


@pytest.mark.parametrize("space", ["\x1c", "\x1f", "\x85", "\u3000", " \x1d "])
def test_odd_separators(space):
    c = Counter(PATH, 64, 8)
    for text in (space.join(f"w{i} x" for i in range(300)), space.join("ab" for _ in range(20))):
        assert c.counts([text])[0] == [exact(text)]


def test_a_huge_word_and_the_given_documents(spark):
    c = Counter(PATH, 4096, 128)
    for text in ("z" * 300_000, "a b " * 50_000 + "q" * 50_000 + " c d" * 50_000):
        assert c.counts([text])[0] == [exact(text)]
    rows = token_counts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), PATH).selectExpr("sum(if(chunks > 1, 1, 0)) AS spliced", "sum(if(n_bytes > 16384 AND chunks = 1, 1, 0)) AS whole").first()
    assert rows.spliced > 0 and rows.whole == 0
