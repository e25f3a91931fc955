"""Best-fit packing by a linear grouping scheme.

Only the histogram of piece lengths, at most ``capacity`` entries, reaches the
driver. Large lengths are rounded up within groups of equal cardinality; a few
configurations of the rounded sizes are chosen, each used for many sequences;
actual lengths are put back in their places, and small pieces go best-fit into
what is left. The plan is a list of runs: the pieces of one length with
consecutive ranks go to consecutive sequences at one offset. Spark ranks the
pieces within their length and looks their run up.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..scratch import Scratch

CAPACITY, GROUPS, SALTS, ROWS_PER_SALT = 2048, 512, 256, 1_000_000
#: All characters below this are classed alike by both tokenizer libraries; texts with others are encoded by ``tokenizers`` itself.
SAFE = 0x250


#: Fixed value: how a ByteLevel pre-tokenizer with use_regex splits.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Token ids of texts, as ``tokenizers`` gives them for ``path`` with add_special_tokens=False.

    The same vocabulary, given as ranks, is several times faster in ``tiktoken``; it takes the
    texts on which the two split words alike, the library itself takes the others.
    """

    def __init__(self, path: str):
        import json
        import os

        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.fast = self._fast(spec, tiktoken)

    @staticmethod
    def _fast(spec: dict, tiktoken):
        """The same vocabulary as ranks; None unless the file says that it splits, merges and looks for special tokens as that library does."""
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        simple = not any(x[y] for x in spec["added_tokens"] for y in ("single_word", "lstrip", "rstrip", "normalized"))
        if spec["normalizer"] or model["type"] != "BPE" or not plain or not simple or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex"):
            return None
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        byte = _byte_of_char()
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        return tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> list[int]:
        if self.fast and (text.isascii() or max(map(ord, set(text))) < SAFE):
            return self.fast.encode(text, allowed_special="all")
        return self.exact.encode(text, add_special_tokens=False).ids


def _byte_of_char() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies: itself if printable, else 256, 257, ... in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(path)
            ids, out = batch.column(0).to_pylist(), []
            for doc, text in zip(ids, batch.column(1), strict=True):
                tokens = np.array([*encoder.ids(text.as_py() or ""), end_id], dtype="<u4")
                n = len(tokens)
                # whole pieces last, so that only the first may be shorter
                first = n if n <= capacity else (n - 1) % capacity + 1
                cuts = [0, *range(first, n + 1, capacity)]
                out += [(doc, i, s, e - s, zlib.crc32(tokens[s:e].tobytes())) for i, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False))]
            if out:
                doc, *rest = zip(*out, strict=True)
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(doc, batch.schema.field(0).type), *(pa.array(x, k) for x, k in zip(rest, kinds, strict=True))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pieces of each group in one sequence, sequences): each holds the largest size left and fills the rest as far as a subset of the sizes can."""
    left, out = list(counts), []
    while True:
        top = next((g for g in range(len(sizes)) if left[g]), None)
        if top is None:
            return out
        # reach[x]: a group whose last use reaches the sum x; bounded knapsack from large to small
        room = capacity - sizes[top]
        via = np.full(room + 1, -1, dtype=np.int64)
        used = np.zeros(room + 1, dtype=np.int64)
        via[0] = len(sizes)
        for g in range(top, len(sizes)):
            s, most = sizes[g], left[g] - (g == top)
            if not most or s > room:
                continue
            used[:] = 0
            reached = via >= 0
            for x in range(s, room + 1):
                if not reached[x] and reached[x - s] and used[x - s] < most:
                    reached[x], via[x], used[x] = True, g, used[x - s] + 1
        x, take = int(np.flatnonzero(via >= 0)[-1]), {top: 1}
        while x:
            g = int(via[x])
            take[g] = take.get(g, 0) + 1
            x -= sizes[g]
        times = min(left[g] // m for g, m in take.items())
        for g, m in take.items():
            left[g] -= m * times
        out.append((take, times))


def plan(histogram: dict[int, int], capacity: int, groups: int = GROUPS) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces, first sequence, offset) runs that pack all pieces of ``histogram`` (count by length, 1 to ``capacity``)."""
    small = capacity // 4
    large = sorted((k for k in histogram if small < k), reverse=True)
    total = sum(histogram[k] for k in large)
    # groups of equal cardinality over the lengths in falling order; a group's size is its largest length
    share = max(1, -(-total // groups))
    members: list[list[list[int]]] = []
    room = 0
    for k in large:
        n = histogram[k]
        while n:
            if not room:
                members.append([])
                room = share
            take = min(n, room)
            members[-1].append([k, take])
            n, room = n - take, room - take
    sizes, counts = [m[0][0] for m in members], [sum(n for _, n in m) for m in members]
    # segments: (sequences, lengths in each), all alike; a place of a configuration is filled in falling order of length
    segments: list[tuple[int, list[int]]] = []
    for take, times in configurations(sizes, counts, capacity):
        places = []
        for g, m in take.items():
            for _ in range(m):
                runs, need = [], times
                while need:
                    k, n = members[g][0]
                    got = min(n, need)
                    runs.append((k, got))
                    need -= got
                    members[g][0][1] -= got
                    if not members[g][0][1]:
                        members[g].pop(0)
                places.append(runs)
        cuts = sorted({c for runs in places for c in np.cumsum([n for _, n in runs]).tolist()})
        done = 0
        for c in cuts:
            here = []
            for runs in places:
                at = 0
                for k, n in runs:
                    at += n
                    if at > done:
                        here.append(k)
                        break
            segments.append((c - done, here))
            done = c
    # best-fit: the tightest segments that a small length still fits
    by_room: list[tuple[int, int]] = []  # (room, number of a segment)
    for i, (_, here) in enumerate(segments):
        insort(by_room, (capacity - sum(here), i))
    for k in sorted((k for k in histogram if k <= small), reverse=True):
        n = histogram[k]
        while n:
            at = bisect_left(by_room, (k, -1))
            if at == len(by_room):
                fit = capacity // k
                if n >= fit:
                    segments.append((n // fit, [k] * fit))
                    n %= fit
                else:
                    segments.append((1, [k] * n))
                    n = 0
                insort(by_room, (capacity - sum(segments[-1][1]), len(segments) - 1))
                continue
            space, i = by_room.pop(at)
            b, here = segments[i]
            fit = space // k
            whole = min(b, n // fit)
            rest, n = (n - whole * fit, 0) if whole < b else (0, n - whole * fit)
            parts = [(whole, here + [k] * fit), (1 if rest else 0, here + [k] * rest), (b - whole - (1 if rest else 0), here)]
            parts = [p for p in parts if p[0]]
            segments[i] = parts[0]
            insort(by_room, (capacity - sum(parts[0][1]), i))
            for p in parts[1:]:
                segments.append(p)
                insort(by_room, (capacity - sum(p[1]), len(segments) - 1))
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for b, here in segments:
        offset = 0
        for k in here:
            out.append((k, rank.get(k, 0), b, sequence, offset))
            rank[k] = rank.get(k, 0) + b
            offset += k
        sequence += b
    return out


def pack(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, groups: int = GROUPS, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): all token pieces of all rows, packed.

    A row's ids are those of its whole text (null: empty) and ``end_id``. Longer ones than
    ``capacity`` are cut; the first piece may be shorter. No sequence is over ``capacity`` and pieces
    lie in it without a gap from 0. Rows that share a doc_id are packed each; other columns are
    ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = scratch.save(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_pieces(tokenizer_path, capacity, end_id), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    runs = plan(histogram, capacity, groups)
    # A length may hold most pieces, so ranks are counted within salted parts of it that keep their size as the input grows.
    salts = max(SALTS, sum(histogram.values()) // ROWS_PER_SALT)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(within) - 1).join(base, ["length", "salt"]).withColumn("rank", F.col("nth") + F.col("base"))
    table = spark.createDataFrame(runs, "length long, first long, pieces long, sequence long, offset long")
    # the runs number some thousands, bounded by lengths, groups and configurations, never by documents
    placed = ranked.join(F.broadcast(table), "length").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("pieces")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")
