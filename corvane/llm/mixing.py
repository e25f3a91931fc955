"""Mixing sources to target weights over fixed-length blocks of words.

Each source's documents are laid end to end, in an order that a hash of the id
gives, and cut into blocks of ``block`` words. Output shards draw how many of
their slots each source gets, one multinomial a shard; what a source draws beyond
its quota is dealt to the sources that drew too little. A source's k-th slot is
sent through a pseudorandom permutation of its block numbers, another one each
time its blocks are used up, and slots meet blocks in an equi-join on the index.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..scratch import Scratch
from .words import U64, mix

#: Words of a block, slots of a shard, and sources at most: the plan of all sources is held by the driver and every task.
BLOCK, SHARD, MOST_SOURCES, SEED = 1024, 4096, 1 << 16, 20240607
#: Copies of a row that are written out from one array.
CHUNK = 4096
ROUNDS = 4
_WORD, _SPACE = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]*"


def _keys(source: int, epoch: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        base = U64(seed) * U64(0x9E3779B97F4A7C15) + U64(source + 1) * U64(0xD1B54A32D192ED03) + U64(epoch + 1) * U64(0x8CB92BA72F3D8DD7)
        return mix(base + np.arange(1, ROUNDS + 1, dtype=U64) * U64(0xA24BAED4963EE407))


def _feistel(x: np.ndarray, half: int, keys: np.ndarray, back: bool) -> np.ndarray:
    mask = U64((1 << half) - 1)
    left, right = x >> U64(half), x & mask
    with np.errstate(over="ignore"):
        for key in keys[::-1] if back else keys:
            if back:
                left, right = right ^ (mix(left + key) & mask), left
            else:
                left, right = right, left ^ (mix(right + key) & mask)
    return (left << U64(half)) | right


def permuted(places: np.ndarray, n: int, keys: np.ndarray, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0 to n - 1 at ``places``, or its inverse: a Feistel network walked until it is inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    x = _feistel(np.asarray(places, dtype=U64), half, keys, back)
    while (out := x >= U64(n)).any():
        x[out] = _feistel(x[out], half, keys, back)
    return x.astype(np.int64)


def targets(sizes: Sequence[int], weights: Sequence[int], cap: int) -> list[float]:
    """All words shared by weight; none gets more than ``cap`` times its size, and what is above is shared anew by weight."""
    total, capped = sum(sizes), set()
    while True:
        rest = total - sum(cap * sizes[i] for i in capped)
        weight = sum(w for i, w in enumerate(weights) if i not in capped)
        over = {i for i, w in enumerate(weights) if i not in capped and rest * w > cap * sizes[i] * weight}
        if not over:
            return [float(cap * n) if i in capped else rest * w / weight for i, (n, w) in enumerate(zip(sizes, weights, strict=True))]
        capped |= over


@dataclass(frozen=True)
class Plan:
    """What each source gives, by its number: ``quota`` words as ``slots`` blocks, the last of them cut to ``last`` words."""

    names: list[str | None]
    size: list[int]
    target: list[float]
    blocks: np.ndarray
    quota: np.ndarray
    slots: np.ndarray
    last: np.ndarray
    block: int
    seed: int


def plan(sizes: dict[str | None, int], weights: Sequence[int], cap: int, block: int, seed: int) -> Plan:
    names = sorted((n for n in sizes if n is not None)) + [None] * (None in sizes)
    size = [sizes[n] for n in names]
    target = targets(size, [weights[i % len(weights)] for i in range(len(names))], cap)
    blocks, quota = np.array([-(-n // block) for n in size], dtype=np.int64), np.array([round(t) for t in target], dtype=np.int64)
    slots, last = np.zeros(len(names), dtype=np.int64), np.full(len(names), block, dtype=np.int64)
    for i, (n, q) in enumerate(zip(size, quota.tolist(), strict=True)):
        if not n:
            continue
        epochs, rest = divmod(q, n)
        slots[i] = epochs * blocks[i]
        if rest:
            # the one short block may be among those of the last, unfinished round
            short = int(permuted(np.array([blocks[i] - 1]), int(blocks[i]), _keys(i, epochs, seed), back=True)[0])
            lack = int(blocks[i]) * block - n
            more = -(-rest // block) if rest <= short * block else max(short + 1, -(-(rest + lack) // block))
            before = (more - 1) * block - (lack if more - 1 > short else 0)
            slots[i], last[i] = slots[i] + more, rest - before
    return Plan(names, size, target, blocks, quota, slots, last, block, seed)


def copies(df: DataFrame, times: str, name: str) -> DataFrame:
    """``df`` with each row ``times`` times, numbered from 0 in ``name``; no array is longer than ``CHUNK``."""
    first = df.withColumn("__from", F.explode(F.expr(f"sequence(0L, `{times}` - 1, {CHUNK}L)")))
    return first.withColumn(name, F.explode(F.expr(f"sequence(__from, least(__from + {CHUNK - 1}, `{times}` - 1))"))).drop("__from", times)


def word_count(text: F.Column) -> F.Column:
    one = F.regexp_replace(text, f"{_SPACE}{_WORD}+{_SPACE}", "x")
    return F.when(text.rlike(_WORD), F.length(one)).otherwise(0).cast("long")


class Mix:
    """A mix of ``docs`` (doc_id, text, source); other columns are not looked at.

    Words are ``[^\\x20\\x09-\\x0D]+``; a null or empty text has none and is never taken. Sources come in the order of their
    code points, null last, and get ``weights`` in turn; together they give as many words as the input has. Equal rows count
    each. No documents, no rows. More than ``MOST_SOURCES`` sources are an error.
    """

    def __init__(self, docs: DataFrame, *, weights: Sequence[int] = (1, 2, 3), cap: int = 3, block: int = BLOCK, shard: int = SHARD, seed: int = SEED):
        self.spark: SparkSession = docs.sparkSession
        self.scratch, self.shard = Scratch(self.spark, "mix"), shard
        each = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
        # rows that nothing tells apart become one with a count, so no id is hot
        self.sized = self.scratch.save(each.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("times")), "sized")
        rows = self.sized.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("size"), F.count(F.lit(1)).alias("groups")).limit(MOST_SOURCES + 1).collect()
        if len(rows) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        self.groups = sum(r["groups"] for r in rows)
        self.plan = plan({r["source"]: r["size"] for r in rows}, weights, cap, block, seed)

    def sources(self) -> DataFrame:
        """(number, source, source_size, target), at most ``MOST_SOURCES`` rows."""
        p = self.plan
        rows = [(i, n, s, t) for i, (n, s, t) in enumerate(zip(p.names, p.size, p.target, strict=True))]
        return self.spark.createDataFrame(rows, "number int, source string, source_size long, target double")

    def numbered(self) -> DataFrame:
        known = self.sources()
        return self.sized.alias("d").join(F.broadcast(known).alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("number", "doc_id", "size", "times")

    def pieces(self) -> DataFrame:
        """(number, block, doc_id, size, start, lo, hi): the parts of blocks that documents fill.

        Places are running sums in two steps, over hash buckets and within them, of about as many rows each.
        """
        buckets = max(1, int(np.ceil(np.sqrt(self.groups))))
        h = F.xxhash64("doc_id", "size")
        rows = self.numbered().where("size > 0").withColumn("h", h).withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int")).withColumn("words", F.col("size") * F.col("times"))
        inside = Window.partitionBy("number", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        base = rows.groupBy("number", "bucket").agg(F.sum("words").alias("all"))
        base = base.withColumn("base", F.sum("all").over(Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("all"))
        placed = rows.withColumn("before", F.sum("words").over(inside) - F.col("words")).join(base.select("number", "bucket", "base").hint("merge"), ["number", "bucket"])
        each = copies(placed.select("number", "doc_id", "size", "times", (F.col("base") + F.col("before")).alias("first")), "times", "copy")
        each = each.withColumn("start", F.col("first") + F.col("copy") * F.col("size")).withColumn("end", F.col("start") + F.col("size"))
        b = self.plan.block
        cut = each.withColumn("block", F.explode(F.expr(f"sequence(start div {b}, (end - 1) div {b})")))
        edge = F.col("block") * b
        return cut.select("number", "block", "doc_id", "size", "start", (F.greatest("start", edge) - edge).cast("int").alias("lo"), (F.least("end", edge + b) - edge).cast("int").alias("hi"))

    def draws(self) -> DataFrame:
        """(shard, number, n): each shard's multinomial draw of slots by source."""
        p, width = self.plan, self.shard
        slots = int(p.slots.sum())
        share = p.slots / max(slots, 1)

        def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for k in part["id"].tolist():
                    n = np.random.default_rng([p.seed, k]).multinomial(min(width, slots - k * width), share)
                    some = np.flatnonzero(n)
                    yield pd.DataFrame({"shard": k, "number": some.astype(np.int32), "n": n[some]})

        return self.spark.range(-(-slots // width)).mapInPandas(draw, "shard long, number int, n long")

    def slots(self) -> DataFrame:
        """(shard, turn, number, block, upto): the blocks of each shard, read by ``turn``; of a source's last one only ``upto`` words count."""
        p = self.plan
        draws = self.scratch.save(self.draws(), "draws")
        drawn = np.zeros(len(p.names), dtype=np.int64)
        for r in draws.groupBy("number").agg(F.sum("n").alias("n")).collect():
            drawn[r["number"]] = r["n"]
        over, under = np.maximum(drawn - p.slots, 0), np.maximum(p.slots - drawn, 0)
        over_at, under_end = np.cumsum(over) - over, np.cumsum(under)
        under_at = under_end - under
        before = Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)

        def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for row in range(0, len(part), 64):
                    yield pd.concat([slots_of(*r) for r in part.iloc[row : row + 64][["shard", "number", "n", "before"]].itertuples(index=False)])

        def slots_of(shard: int, source: int, n: int, first: int) -> pd.DataFrame:
            k = first + np.arange(n, dtype=np.int64)
            number = np.full(n, source, dtype=np.int32)
            beyond = k >= p.slots[source]
            if beyond.any():
                at = over_at[source] + k[beyond] - p.slots[source]
                number[beyond] = to = np.searchsorted(under_end, at, side="right")
                k[beyond] = drawn[to] + at - under_at[to]
            block = np.empty(n, dtype=np.int64)
            for s in np.unique(number):
                mine = np.flatnonzero(number == s)
                epoch, place = np.divmod(k[mine], p.blocks[s])
                for e in np.unique(epoch):
                    block[mine[epoch == e]] = permuted(place[epoch == e], int(p.blocks[s]), _keys(int(s), int(e), p.seed))
            upto = np.where(k == p.slots[number] - 1, p.last[number], p.block).astype(np.int32)
            with np.errstate(over="ignore"):
                turn = mix(mix(k.astype(U64) + U64(p.seed)) + number.astype(U64)).view(np.int64)
            return pd.DataFrame({"shard": shard, "turn": turn, "number": number, "block": block, "upto": upto})

        return draws.withColumn("before", F.sum("n").over(before) - F.col("n")).mapInPandas(spread, "shard long, turn long, number int, block long, upto int")

    def samples(self) -> DataFrame:
        """(shard, turn, source, doc_id, start, length): the mix itself, as stretches of documents' words; ``start`` is the word within the document."""
        b = self.plan.block
        met = self.pieces().join(self.slots(), ["number", "block"]).where("lo < upto")
        met = met.join(F.broadcast(self.sources().select("number", "source")), "number")
        return met.select("shard", "turn", "source", "doc_id", (F.col("block") * b + F.col("lo") - F.col("start")).alias("start"), (F.least("hi", "upto") - F.col("lo")).cast("long").alias("length"))

    def taken(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken): one row for each row of ``docs``; ``taken`` counts the words that the mix has of it."""
        used = F.when(F.col("upto") > F.col("lo"), F.least("hi", "upto") - F.col("lo")).otherwise(0)  # no slot, no upto
        met = self.pieces().join(self.slots().select("number", "block", "upto"), ["number", "block"], "left")
        some = met.groupBy("number", "start", "doc_id", "size").agg(F.sum(used).cast("long").alias("taken")).select("number", "doc_id", "size", "taken")
        none = copies(self.numbered().where("size = 0"), "times", "copy").select("number", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
        return some.union(none).join(F.broadcast(self.sources()), "number").select("doc_id", "size", "source_size", "target", "taken")
