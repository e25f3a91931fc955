"""Token counts with overlap resynchronisation for long documents.

Documents up to ``chunk`` characters, a few thousand, are encoded whole: white
space always ends a token of this vocabulary and carries none, so the library
encodes each distinct piece between white space once for a batch. Longer
documents are encoded in overlapping chunks with offsets. Two neighbouring
chunks are spliced where a piece starts after white space inside the overlap and
both encodings have a token that starts there: from such a place on both see the
same pieces. Without one the overlap is widened and the chunk is encoded again.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

if TYPE_CHECKING:
    from tokenizers import Encoding

CHUNK, OVERLAP, MOST_PIECES = 1 << 12, 1 << 7, 400_000
#: Separators to Python's str.split() and \\s but not to the tokenizer's: they are parts of a piece.
ODD_SPACE = re.compile("[\x1c-\x1f]")
PIECE, SPACE, START = re.compile(r"[\S\x1c-\x1f]+"), re.compile(r"[^\S\x1c-\x1f]"), re.compile(r"(?<=[^\S\x1c-\x1f])[\S\x1c-\x1f]")


class Counter:
    """Counts tokens of texts as ``tokenizers`` does."""

    def __init__(self, path: str, chunk: int, overlap: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunk, self.overlap, self.known = chunk, overlap, {}

    def encode(self, text: str) -> Encoding:
        return self.tokenizer.encode(text, add_special_tokens=False)

    def spliced(self, text: str) -> tuple[int, int]:
        """Tokens of a text and the chunks that were spliced to count them."""
        lo, hi, total, chunks = 0, min(self.chunk, len(text)), 0, 1
        own, at, counted = self.encode(text[:hi]), 0, 0  # the chunk's encoding, where it begins, and how many of its tokens the one before has
        while hi < len(text):
            overlap = self.overlap
            while True:
                back = max(hi - overlap, lo)
                far = min(back + max(self.chunk, 2 * (hi - back)), len(text))
                after = self.encode(text[back:far])
                place = self.common(text, back, hi, own, at, after)
                if place is not None:
                    break
                if back == lo:  # no stable place in all of this chunk: the longer one takes its place
                    own, at, counted, hi = after, lo, 0, far
                    if hi == len(text):
                        return total + len(own), chunks
                overlap *= 2
            lo, mine, theirs = place
            total += mine - counted
            own, at, counted, hi, chunks = after, back, theirs, far, chunks + 1
        return total + len(own) - counted, chunks

    @staticmethod
    def first_token(encoding: Encoding, place: int) -> int | None:
        """The first token that starts at a place, None if none does."""
        i = encoding.char_to_token(place)
        if i is None or encoding.token_to_chars(i)[0] != place:
            return None
        while i and encoding.token_to_chars(i - 1)[0] == place:
            i -= 1
        return i

    def common(self, text: str, lo: int, hi: int, a: Encoding, at: int, b: Encoding) -> tuple[int, int, int] | None:
        """The first piece start in (lo, hi) at which both encodings start a token, and after which the first one has a whole piece left; with both tokens' numbers."""
        for m in START.finditer(text, lo + 1, hi):
            mine, theirs = self.first_token(a, m.start() - at), self.first_token(b, m.start() - lo)
            if mine is not None and theirs is not None:
                return (m.start(), mine, theirs) if SPACE.search(text, m.start(), hi) else None
        return None

    def counts(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """Tokens and chunks of each text."""
        out, chunks = [0] * len(texts), [1] * len(texts)
        known, split = self.known, []
        for i, t in enumerate(texts):
            if len(t) > self.chunk:
                out[i], chunks[i] = self.spliced(t)
            else:
                split.append((i, PIECE.findall(t) if ODD_SPACE.search(t) else t.split()))
        new = list({p for _, s in split for p in s} - known.keys())
        for k in range(0, len(new), 4096):
            part = new[k : k + 4096]
            of = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False).word_ids
            known.update(zip(part, np.bincount(np.array([w for w in of if w is not None], dtype=np.int64), minlength=len(part)).tolist(), strict=True))
        for i, s in split:
            out[i] = sum(map(known.__getitem__, s))
        if len(known) > MOST_PIECES:
            known.clear()
        return out, chunks


def _count(path: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or Counter(path, chunk, overlap)
            n, chunks, sizes = [], [], []
            part, size = [], 0

            def flush() -> None:
                for all_, some in zip((n, chunks), counter.counts(part), strict=True):
                    all_.extend(some)
                part.clear()

            for t in batch.column(1):
                t = t.as_py() or ""
                sizes.append(len(t.encode("utf-8", "surrogatepass")))
                part.append(t)
                size += len(t)
                if size > 4 << 20:
                    flush()
                    size = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, n, chunks))], ["doc_id", "n_bytes", "n_tokens", "chunks"])

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, *, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, chunks, over_limit) for each row; ``chunks`` of more than 1 tells that the count was spliced.

    Counts are those of the library for the whole text, with no special tokens added and special
    strings inside a text handled as it does by default. Null and empty texts have 0 bytes and tokens.
    Rows repeat as they do in the input; other columns are ignored. The tokenizer must drop
    white space between tokens; ``tokenizer_path`` must be readable on the executors.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_count(tokenizer_path, chunk, overlap), f"doc_id {kind}, n_bytes long, n_tokens long, chunks long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
