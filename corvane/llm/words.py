"""Words, word hashes and shingles of whole texts, vectorised over batches.

A word is a run of bytes outside ``\\x20`` and ``\\x09-\\x0D``. Hashes are sums of
random table entries by byte and place, so equal-length words collide with
probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..scratch import Scratch

U64 = np.uint64
#: Bytes of text that are held as numpy temporaries at one time; one longer text is still taken whole.
SLICE_BYTES = 1 << 20
#: Bytes of words that are hashed at one time.
BLOCK = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = np.asarray(x, dtype=U64).copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(salt) * U64(0xD1B54A32D192ED03))


_TABLE = seeds(64 * 256, 1)
_SHINGLE = seeds(64, 2) | U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEP = np.zeros(256, dtype=bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True


def _word_hashes(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, lower: bool) -> np.ndarray:
    before = np.cumsum(lens) - lens
    at = np.arange(int(lens.sum()), dtype=np.int64)
    place = at - np.repeat(before, lens)
    data = buf[at + np.repeat(starts - before, lens)]
    if lower:
        data = _LOWER[data]
    values = _TABLE[((place & 63) << 8) | data]
    with np.errstate(over="ignore"):
        if lens.max() > 64:
            values = values * (2 * (place >> 6) + 1).astype(U64)
        return mix(np.add.reduceat(values, before) + lens.astype(U64) * U64(0x9E3779B97F4A7C15))


class Words:
    """The words of a slice of texts: byte ranges, 64-bit hashes and each text's first word."""

    def __init__(self, texts: list[str | None], lower: bool = True):
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts))
        buf = np.frombuffer(b"\n".join([*parts, b""]), dtype=np.uint8)
        sep = _SEP[buf]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], sep, [True])).view(np.int8)))
        self.starts, self.ends = edge[::2], edge[1::2]
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        self.buf, self.base = buf, bounds[:-1]
        self.first = np.searchsorted(self.starts, bounds)
        lens = self.ends - self.starts
        if not len(lens):
            self.hashes = np.zeros(0, dtype=U64)
            return
        self.hashes = np.empty(len(lens), dtype=U64)
        done, ends = 0, np.cumsum(lens)
        while done < len(lens):
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + BLOCK, side="right")))
            self.hashes[done:upto] = _word_hashes(buf, self.starts[done:upto], lens[done:upto], lower)
            done = upto

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.first[i] : self.first[i + 1]]

    def shingles(self, i: int, width: int) -> np.ndarray:
        """Hashes of text i's ``width``-word shingles in order; with fewer words, one for the whole sequence."""
        return shingle_hashes(self.of(i), width)


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    if not len(h):
        return h
    w = min(width, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - w + 1, w, dtype=U64)
        for j in range(w):
            out += h[j : len(h) - w + 1 + j] * _SHINGLE[j]
    return mix(out)


def slices(texts: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of about ``most`` bytes each."""
    part: list[str | None] = []
    size = start = 0
    for i, t in enumerate(texts):
        t = t.as_py()
        part.append(t)
        size += len(t or "")
        if size >= most:
            yield start, part
            part, size, start = [], 0, i + 1
    if part:
        yield start, part


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=U64).view(np.int64)


def lists(parts: list[np.ndarray], kind: type = np.int64) -> pa.Array:
    """An Arrow list column of integer arrays, 64-bit hashes by default."""
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(flat) if kind is np.int64 else flat.astype(kind)))


def one_per_id(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with one row for each doc_id, that with the least text; rows with a null doc_id all stay.

    Only ids are counted, so texts are shuffled where ids repeat and nowhere else.
    """
    torn = scratch.save(docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "torn")
    if not torn.limit(1).count():
        return docs
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(F.col("text").isNull().alias("none"), *(F.col(f"`{c}`").alias(c) for c in ["text", *others]))
    chosen = docs.join(torn.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(row).alias("row"))
    chosen = scratch.save(chosen.select(*(F.col("doc_id") if c == "doc_id" else F.col(f"row.`{c}`").alias(c) for c in docs.columns)), "chosen")
    return docs.join(torn.select("doc_id"), "doc_id", "left_anti").select(*docs.columns).union(chosen)


def with_repeats(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` about the documents of ``one_per_id``, each as often as its doc_id stood in the input."""
    if "chosen" not in scratch.names:
        return rows
    torn = scratch.spark.read.parquet(scratch.path("torn"))
    more = torn.select("doc_id", F.explode(F.sequence(F.lit(2), F.col("times"))).alias("__n"))
    return rows.union(rows.join(more, "doc_id").select(*rows.columns))
