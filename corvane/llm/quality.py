"""Quality rules: an isolation forest on rule statistics.

Every text gets rule counts in one pass. Trees of random splits are grown on a
bounded sample of the statistics; a row that few splits isolate is anomalous
(Liu, Ting, Zhou 2008). The score above which a row is dropped is the one that
drops most labelled bad rows while it keeps nearly all labelled good ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..scratch import Scratch
from .words import U64, Words, mix, slices

TREES, PER_TREE, KEEP_GOOD, SEED = 128, 256, 0.998, 20260101
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = " \t\n\x0b\x0c\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_distinct"]
SCHEMA = "doc_id {}, " + ", ".join(f"{c} long" for c in COUNTS)


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    upper, mark = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
    upper[65:91] = True
    mark[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
    mark[list(b".,")] = False
    return upper, mark


def rule_counts(texts: list[str | None]) -> np.ndarray:
    """One row of ``COUNTS`` for each text."""
    w = Words(texts, lower=False)
    n = len(texts)
    buf, out = w.buf, np.zeros((n, len(COUNTS)), dtype=np.int64)
    upper, mark = _kinds()
    head = (buf & 0xC0) != 0x80  # the first byte of a code point
    inside = np.zeros(len(buf) + 1, dtype=np.int8)
    np.add.at(inside, w.starts, 1)
    np.add.at(inside, w.ends, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    for j, at in ((1, head & inside), (2, _SYMBOL[buf]), (5, upper[buf]), (6, mark[buf])):
        out[:, j] = np.diff(np.concatenate(([0], np.cumsum(at)))[np.concatenate((w.base, [len(buf)]))])
    out[:, 0] = np.diff(w.first)
    doc = np.repeat(np.arange(n), out[:, 0])
    if len(doc):
        with np.errstate(over="ignore"):
            own = mix(doc.astype(U64) + U64(77))
            _, first = np.unique(mix(w.hashes) ^ own, return_index=True)
            out[:, 7] = np.bincount(doc[first], minlength=n)
            if len(doc) > 2:
                h = w.hashes
                three = mix(h[:-2] * U64(3) + h[1:-1] * U64(5) + mix(h[2:]) * U64(7) + h[:-2] * h[1:-1]) ^ own[:-2]
                at = np.flatnonzero(doc[:-2] == doc[2:])
                _, back, times = np.unique(three[at], return_inverse=True, return_counts=True)
                twice = at[times[back] > 1]
                repeated = np.zeros(len(doc), dtype=bool)
                for k in range(3):
                    repeated[twice + k] = True
                out[:, 4] = np.bincount(doc[repeated], minlength=n)
    for i, t in enumerate(texts):
        lines = [x for x in (t or "").split("\n") if x.strip(_SPACE)]
        out[i, 3] = len(lines) - len(set(lines))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, part in slices(batch.column(1)):
            c = rule_counts(part)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), *(pa.array(c[:, j]) for j in range(len(COUNTS)))], ["doc_id", *COUNTS])


def features(c: np.ndarray) -> np.ndarray:
    """The statistics that the forest splits, from rows of ``COUNTS``."""
    words, chars = np.maximum(c[:, 0], 1), np.maximum(c[:, 1], 1)
    return np.stack([c[:, 1] / words, c[:, 2] / words, c[:, 4] / words, c[:, 5] / chars, c[:, 6] / words, c[:, 7] / words ** 0.9], axis=1)


class IsolationForest:
    """Trees of random splits, all nodes in flat arrays."""

    def __init__(self, x: np.ndarray, trees: int, per_tree: int, seed: int):
        rng = np.random.default_rng(seed)
        depth = max(1, int(np.ceil(np.log2(max(2, min(per_tree, len(x)))))))
        split, at, left, right, size, roots = [], [], [], [], [], []

        def grow(rows: np.ndarray, d: int) -> int:
            me = len(split)
            for a, v in ((split, -1), (at, 0.0), (left, me), (right, me), (size, _path(len(rows)))):
                a.append(v)
            lo, hi = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (0, 0)
            can = np.flatnonzero(hi > lo) if len(rows) > 1 else []
            if d == depth or not len(can):
                return me
            f = int(rng.choice(can))
            cut = rng.uniform(lo[f], hi[f])
            below = rows[:, f] < cut
            split[me], at[me] = f, cut
            left[me] = grow(rows[below], d + 1)
            right[me] = grow(rows[~below], d + 1)
            return me

        for _ in range(trees):
            roots.append(grow(x[rng.choice(len(x), min(per_tree, len(x)), replace=False)], 0))
        self.depth, self.norm = depth, max(_path(min(per_tree, len(x))), 1e-9)
        self.split, self.at, self.left, self.right, self.size, self.roots = (np.array(a) for a in (split, at, left, right, size, roots))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path length / its mean in random data): near 1 for rows that few splits isolate."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.split[node]
                inner = f >= 0
                total += inner
                node = np.where(inner, np.where(x[rows, f] < self.at[node], self.left[node], self.right[node]), node)
            total += self.size[node]
        return np.exp2(-total / len(self.roots) / self.norm)


def _path(n: int) -> float:
    """Mean path length of an unsuccessful search among n."""
    return 2 * (log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def _score(forest: IsolationForest | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.stack([batch.column(x).to_numpy(zero_copy_only=False) for x in COUNTS], axis=1)
            s = forest.scores(features(c)) if forest and len(c) else np.zeros(len(c))
            yield batch.append_column("score", pa.array(s, pa.float64()))

    return run


def judge(docs: DataFrame, labels: DataFrame, *, trees: int = TREES, per_tree: int = PER_TREE, keep_good: float = KEEP_GOOD, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) for each row.

    A row is kept unless a base rule fails (``n_words < 50`` or more than half of the words
    in repeated 3-word windows) or its anomaly score is over the calibrated threshold. ``labels`` has
    (doc_id, quality 0 or 1). The forest grows on about ``trees * per_tree`` rows at most, drawn by the hash of
    their id; the threshold uses the scores of all labelled rows that pass the base rules and keeps a share of
    ``keep_good`` of the good ones. Without labelled bad rows only the base rules drop.
    Null and empty texts have 0 words and fail. Rows repeat as in the input.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_count, SCHEMA.format(kind))
    counted = scratch.save(counted.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")), "counts")
    passed = counted.where("NOT base_failed")
    n, most = passed.count(), trees * per_tree
    rows = passed.select(*COUNTS, F.xxhash64("doc_id", "word_chars").alias("h")).where(F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / max(n, 1)))).drop("h").toPandas()
    forest = IsolationForest(features(rows.sort_values(COUNTS).to_numpy()), trees, per_tree, seed) if len(rows) > 1 else None
    scored = scratch.save(counted.mapInArrow(_score(forest), f"{SCHEMA.format(kind)}, base_failed boolean, score double"), "scored")
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # a histogram of 1,000 bins, whatever the number of labelled rows
    bins = scored.where("NOT base_failed").join(known, "doc_id").groupBy(F.floor(F.col("score") * 1000).alias("bin")).agg(F.sum(F.col("quality").cast("long")).alias("good"), F.sum(1 - F.col("quality").cast("long")).alias("bad")).collect()
    limit = threshold({int(r["bin"]): (r["good"], r["bad"]) for r in bins}, keep_good)
    kept = ~F.col("base_failed") & (F.floor(F.col("score") * 1000) < limit)
    return scored.select("doc_id", *COUNTS[:5], "base_failed", "score", kept.alias("kept"))


def threshold(bins: dict[int, tuple[int, int]], keep_good: float) -> int:
    """The lowest bin from which rows are dropped: most bad ones go, and at least ``keep_good`` of the good ones stay."""
    good = sum(g for g, _ in bins.values())
    lost, limit = 0, 1 << 20
    for b in sorted(bins, reverse=True):
        lost += bins[b][0]
        if lost > (1 - keep_good) * good:
            break
        if bins[b][1]:
            limit = b
    return limit
