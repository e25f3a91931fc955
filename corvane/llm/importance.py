"""Importance resampling towards a target distribution, by an external sort-count of hashed features.

One pass over the texts writes their features' buckets as packed uint16 streams
with the documents' offsets. Streams are sorted in runs and run-length encoded
into counts, which add up over all tasks. A second pass over the streams, not the
texts, gathers each bucket's gain and sums it by document with ``np.add.reduceat``.
Documents are then drawn by weight plus Gumbel noise of their id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..scratch import Scratch
from .mixing import copies
from .words import slices

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 10, 2024
#: Bucket numbers that are sorted at a time, and bytes of a word whose check sum is taken step by step for all words.
RUN, SHORT = 1 << 22, 48
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_CRC = _crc_table()


def crc32(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of byte ranges, each carried on from ``before``, for all ranges at once, a byte of each at a time."""
    lens = ends - starts
    state = np.zeros(len(starts), dtype=np.uint32) if before is None else before.astype(np.uint32)
    order = np.argsort(np.minimum(-lens, 0), kind="stable")
    long = int(np.searchsorted(-lens[order], -SHORT, side="left"))
    for i in order[:long].tolist():
        state[i] = zlib.crc32(buf[starts[i] : ends[i]], int(state[i]))
    order = order[long:]
    left, at = lens[order], starts[order]
    s = ~state[order]
    upto = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), side="left")  # ranges longer than each step
    for step, n in enumerate(upto.tolist()):
        s[:n] = _CRC[(s[:n] ^ buf[at[:n] + step]) & np.uint32(255)] ^ (s[:n] >> np.uint32(8))
    state[order] = ~s
    return state


def feature_buckets(texts: list[str | None], longest: int = 1, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(uint16 bucket of each feature, offset of each text's first one and the end, words of each text).

    Features are runs of 1 to ``longest`` words, a text's runs of one word first; words are runs of bytes of ``[0-9a-z]`` and
    above 0x7F, once A-Z are lower-cased.
    """
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    buf = _LOWER[np.frombuffer(b"\n".join([*parts, b""]), dtype=np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], _WORD[buf], [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    bounds = np.array([0, *accumulate(len(p) + 1 for p in parts)])
    words = np.diff(np.searchsorted(starts, bounds))
    doc = np.repeat(np.arange(len(texts)), words)
    crc = crc32(buf, starts, ends)
    found, owner = [crc], [doc]
    for n in range(1, longest):
        whole = np.flatnonzero(doc[n:] == doc[: len(doc) - n])
        spaced = np.full(len(whole), 1, dtype=np.int64)
        crc = crc32(np.frombuffer(b" ", dtype=np.uint8), spaced - 1, spaced, crc[whole])
        crc = crc32(buf, starts[whole + n], ends[whole + n], crc)
        found.append(crc)
        owner.append(doc[whole])
        full = np.zeros(len(doc), dtype=np.uint32)
        full[whole] = crc
        crc = full
    every, owner = np.concatenate(found), np.concatenate(owner)
    if longest > 1:
        every = every[np.argsort(owner, kind="stable")]
    offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts)))))
    return (every % np.uint32(buckets)).astype("<u2"), offsets, words


def streams(docs: DataFrame, key: str, longest: int, buckets: int) -> DataFrame:
    """(ids, words, offsets, stream): packed buckets of about a megabyte of texts a row."""
    name = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in slices(batch.column(1)):
                packed, offsets, words = feature_buckets(texts, longest, buckets)
                columns = [pa.array([batch.column(0).slice(lo, len(texts)).to_pylist()], pa.list_(batch.column(0).type))]
                columns += [pa.array([x], pa.list_(pa.int64())) for x in (words, offsets)] + [pa.array([packed.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["ids", "words", "offsets", "stream"])

    return docs.select(key, F.col("text").cast("string")).mapInArrow(run, f"ids array<{name}>, words array<long>, offsets array<long>, stream binary")


def bucket_counts(packed: DataFrame) -> DataFrame:
    """(bucket, n) of all ``streams``: each run of ``RUN`` buckets sorted and run-length encoded, runs added up by task and then by bucket."""

    def encode(run: list[np.ndarray], total: dict[int, int]) -> None:
        s = np.sort(np.concatenate(run))
        at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        for b, n in zip(s[at].tolist(), np.diff(np.concatenate((at, [len(s)]))).tolist(), strict=True):
            total[b] = total.get(b, 0) + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part, size = {}, [], 0
        for batch in batches:
            for s in batch.column(0):
                part.append(np.frombuffer(s.as_buffer(), dtype="<u2"))
                size += len(part[-1])
                if size >= RUN:
                    encode(part, total)
                    part, size = [], 0
        if size:
            encode(part, total)
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array(total.values(), pa.int64())], ["bucket", "n"])

    return packed.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares, rounded down."""
    s, t = sum(source.values()), sum(target.values())
    return np.array([floor(1000 * log((target.get(b, 0) + 1) * (s + buckets) / ((source.get(b, 0) + 1) * (t + buckets)))) for b in range(buckets)], dtype=np.int64)


def weights(packed: DataFrame, key: str, gain: np.ndarray) -> DataFrame:
    """(key, n_words, n_features, weight): the mean gain of each document's features, rounded down; 0 without features."""
    name = packed.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                offsets = np.array(batch.column(2)[i].values)
                n = np.diff(offsets)
                some, weight = n > 0, np.zeros(len(n), dtype=np.int64)
                if some.any():
                    gathered = gain[np.frombuffer(batch.column(3)[i].as_buffer(), dtype="<u2")]
                    weight[some] = np.add.reduceat(gathered, offsets[:-1][some]) // n[some]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, batch.column(1)[i].values, pa.array(n), pa.array(weight)], [key, "n_words", "n_features", "weight"])

    return packed.select("ids", "words", "offsets", "stream").mapInArrow(run, f"{key} {name}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, *, longest: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): ``percent`` of the documents (doc_id, text) of ``least_words`` or more, drawn by likeness to ``target`` (text).

    ``score`` is weight plus noise that the id alone decides, ``rank`` counts the drawn from 1 by score, ties by smaller id
    (null last); it is null for all others. A null text is empty, a null id counts as an empty string for the noise, equal
    rows count each, other columns are not looked at. No documents, no rows; no target, all its counts are 0.
    """
    scratch = Scratch(docs.sparkSession, "importance")
    packed = scratch.save(streams(docs, "doc_id", longest, buckets), "streams")
    count = lambda p: {r["bucket"]: r["n"] for r in bucket_counts(p).collect()}  # noqa: E731  at most ``buckets`` rows
    gain = gains(count(packed), count(streams(target.select(F.lit(0).alias("id"), "text"), "id", longest, buckets)), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")
    scored = weights(packed, "doc_id", gain).select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= least_words).alias("enough"))
    scored = scratch.save(scored, "scored")
    scratch.drop("streams")
    # scores are whole thousandths of logs of counts: some hundred thousand values whatever the input
    at = {r["score"]: r["n"] for r in scored.where("enough").groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = percent * sum(at.values()) // 100
    before, places = 0, []
    for s in sorted(at, reverse=True):
        if before >= draw:
            break
        places.append((s, before))
        before += at[s]
    cut = places[-1][0] if places else None
    top = F.col("enough") & (F.col("score") >= cut) if places else F.lit(False)
    others = scored.where(~top).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    if not places:
        return others
    # rows that nothing tells apart are ranked as one, then written out
    alike = scored.where(top).groupBy("doc_id", "n_features", "weight", "score").agg(F.count(F.lit(1)).alias("times"))
    order = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    alike = alike.withColumn("within", F.sum("times").over(order) - F.col("times")).join(F.broadcast(docs.sparkSession.createDataFrame(places, "score long, before long")), "score")
    rank = F.col("before") + F.col("within") + F.col("copy") + 1
    drawn = copies(alike, "times", "copy").select("doc_id", "n_features", "weight", "score", F.when(rank <= draw, rank).alias("rank"))
    return others.union(drawn)
