import re

import numpy as np
from hypothesis import given, settings, strategies as st

from corvane.llm.words import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \n\t\x1c ", max_size=40)), max_size=5))
def test_words(texts):
    w = Words(texts)
    seen = {}
    for i, t in enumerate(texts):
        words = [x.translate(str.maketrans("AB", "ab")) for x in WORD.findall(t or "")]
        assert len(w.of(i)) == len(words)
        for x, h in zip(words, w.of(i).tolist(), strict=True):
            assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


def test_long_words_differ():
    a, b = "x" * 64 + "y" * 64, "y" * 64 + "x" * 64
    h = Words([f"{a} {b} {a}"]).of(0)
    assert h[0] == h[2] != h[1]
    assert len(Words(["one two"]).shingles(0, 5)) == 1 and len(np.unique(Words(["a b c d e f"]).shingles(0, 5))) == 2
