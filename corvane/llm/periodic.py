"""Periodic runs of words, found by Karp-Miller-Rosenberg names.

Every stretch of 2**k words gets a name, equal stretches of a text the same one;
a name of level k + 1 is a pair of names of level k. Stretches that stand once in
their text need no name, so levels shrink fast. A run of period q repeats over so
many words that one of a grid of places lies within it: each place that equals the
one q words on is extended both ways, level by level from the longest names down.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import slices

LEAST, TIMES = 24, 3
#: Candidates that are held at a time.
CANDIDATES = 1 << 20


def names(first: np.ndarray) -> list[np.ndarray]:
    """Names of all stretches of 1, 2, 4, .. words, by first word; -1 for one that stands once."""
    levels, name, width = [], first, 1
    at = np.arange(len(first))
    key = first.astype(np.int64)
    while len(at):
        _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
        again = n[inverse] > 1
        at, kept = at[again], inverse[again]
        if not len(at):
            break
        number = np.cumsum(n > 1) - 1
        name = np.full(len(first), -1, dtype=np.int32)
        name[at] = number[kept]
        levels.append(name)
        at = at[at + width < len(first)]
        at = at[name[at + width] >= 0]
        key = name[at].astype(np.int64) * (int(number[-1]) + 1) + name[at + width]
        width *= 2
    return levels


def _equal(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
    """How many words are equal from places i and j on, or before them."""
    done = np.zeros(len(i), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        name, step = levels[k], 1 << k
        a, b = (i - done - step, j - done - step) if back else (i + done, j + done)
        inside = (a >= 0) if back else (b < len(name))
        a, b = np.where(inside, a, 0), np.where(inside, b, 0)
        done += np.where(inside & (name[a] >= 0) & (name[a] == name[b]), step, 0)
    return done


def _grid(lens: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, place within the text): what any run of ``least`` words and ``times`` periods must meet."""
    most = np.where(lens >= least, lens // times, 0)
    pair_text = np.repeat(np.arange(len(lens)), most)
    period = np.arange(len(pair_text)) - np.repeat(np.cumsum(most) - most, most) + 1
    step = np.maximum(least, times * period) - period  # equal pairs that such a run has in a row
    n = (lens[pair_text] - period - 1) // step + 1
    ends = np.cumsum(n)
    done = 0
    while done < len(n):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + CANDIDATES, side="right")))
        count = n[done:upto]
        pair = np.repeat(np.arange(done, upto), count)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
        yield pair_text[pair], period[pair], place * step[pair]
        done = upto


def runs(texts: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (text, start, end, period) of all runs of lists of words, by text, start and period.

    A run is a stretch with its smallest period q, of ``max(least, times * q)`` words or more, that no neighbouring word
    extends keeping period q.
    """
    lens = np.array([len(t) for t in texts], dtype=np.int64)
    base = np.cumsum(lens) - lens
    if lens.sum() == 0:
        return np.zeros((0, 4), dtype=np.int64)
    word = np.array(pa.array((w for t in texts for w in t), pa.large_binary()).dictionary_encode().indices, dtype=np.int64)
    levels = names(np.repeat(np.arange(len(texts)), lens) * (int(word.max()) + 1) + word)  # texts share no name
    if not levels:
        return np.zeros((0, 4), dtype=np.int64)
    found = []
    for text, q, place in _grid(lens, least, times):
        i = base[text] + place
        hit = np.flatnonzero((levels[0][i] >= 0) & (levels[0][i] == levels[0][i + q]))
        i, q, text = i[hit], q[hit], text[hit]
        after = _equal(levels, i, i + q, back=False)
        before = _equal(levels, i, i + q, back=True)
        long = np.flatnonzero(before + after + q >= np.maximum(least, times * q))
        found.append(np.stack((text[long], (i - before - base[text])[long], (i + after + q - base[text])[long], q[long]), axis=1))
    every = np.concatenate(found) if found else np.zeros((0, 4), dtype=np.int64)
    every = every[np.lexsort((every[:, 3], every[:, 2], every[:, 1], every[:, 0]))]
    # of one stretch the smallest period
    first = np.ones(len(every), dtype=bool)
    first[1:] = (every[1:, :3] != every[:-1, :3]).any(axis=1)
    every = every[first]
    return every[np.lexsort((every[:, 3], every[:, 1], every[:, 0]))]


def collapsed(words: list[bytes], own: np.ndarray) -> list[bytes]:
    """``words`` without those that one of their runs (start, end, period) has after its first period."""
    if not len(own):
        return words
    step = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(step, own[:, 0] + own[:, 2], 1)
    np.add.at(step, own[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, *, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, n_words, runs, text): all runs (start, length, period) of each document (doc_id, text), and its text without their repeats.

    Words are ``[^\\x20\\x09-\\x0D]+`` as they stand, joined by one space in the result; a null or empty text has none. Each
    row is taken for itself, whatever its id; other columns are not looked at. No documents, no rows.
    """
    name = docs.schema["doc_id"].dataType.simpleString()
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, part in slices(batch.column(1)):
                texts = [(t or "").encode().split() for t in part]
                found = runs(texts, least, times)
                ends = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
                spans = pa.StructArray.from_arrays([pa.array(found[:, 1]), pa.array(found[:, 2] - found[:, 1]), pa.array(found[:, 3])], fields=list(kind))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), spans)
                kept = (b" ".join(collapsed(t, found[ends[i] : ends[i + 1], 1:])).decode() for i, t in enumerate(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), pa.array(list(map(len, texts)), pa.int64()), lists, pa.array(kept, pa.string())], ["doc_id", "n_words", "runs", "text"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {name}, n_words long, runs array<struct<start:long,length:long,period:long>>, text string")
