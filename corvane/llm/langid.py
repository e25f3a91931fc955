"""Language identification by prediction by partial matching over bytes.

Each language has a byte context tree of orders 0 to ``order``. A symbol's
probability under a context is that of PPM method C: ``count / (total +
distinct)``, and ``distinct / (total + distinct)`` to escape to the next
shorter context, in which the symbols of the longer one are excluded; below
order 0 all bytes are equally likely. The statistics are frozen after training,
so a text's code length is a sum of table entries, one for each byte.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

ORDER = 3
#: Bounds of the labelled sample that the trees are fitted on, whatever the input's size; more languages are an error.
SAMPLE_PER_LANG, MAX_LANGS = 400, 200
_UPPER = re.compile(r"[^\W\d_]+")
_CHUNK = 1 << 19


def letters(text: str | None) -> bytes:
    """The lower-cased letter runs of a whole text, between single spaces, in UTF-8."""
    return (" ".join(_UPPER.findall(text or "")).lower()).encode("utf-8", "replace")


def _counts(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = letters(text)
                if not data:
                    continue
                buf = np.frombuffer(b" " * order + data + b" ", dtype=np.uint8).astype(np.int64)
                for k in range(order + 1):
                    gram = np.zeros(len(buf) - order, dtype=np.int64)
                    for j in range(k, -1, -1):
                        gram = gram << 8 | buf[order - j : len(buf) - j]
                    g, n = np.unique(gram, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(np.full(len(g), k, dtype=np.int32)), pa.array(g), pa.array(n)], ["lang", "k", "gram", "n"])

    return run


class ContextTrees:
    """Frozen trees of several languages as one walk and one cost table."""

    def __init__(self, order: int, langs: list[str], k: np.ndarray, gram: np.ndarray, lang: np.ndarray, n: np.ndarray):
        self.order, self.langs = order, langs
        symbol = np.unique(gram[k == 0])
        width = len(symbol) + 1  # the last column is every unseen byte
        self.column = np.full(256, width - 1, dtype=np.int64)
        self.column[symbol] = np.arange(len(symbol))
        contexts = [np.unique(gram[k == j] >> 8) for j in range(order + 1)]
        base = np.cumsum([0, *(len(c) for c in contexts)])
        total = int(base[-1])
        seen = np.zeros((len(langs), total, width), dtype=np.float32)
        for j in range(order + 1):
            at = k == j
            seen[lang[at], base[j] + np.searchsorted(contexts[j], gram[at] >> 8), self.column[gram[at] & 255]] = n[at]
        # a context's parent lacks its oldest byte, the highest one
        parent = np.full(total, -1, dtype=np.int64)
        for j in range(1, order + 1):
            parent[base[j] : base[j + 1]] = base[j - 1] + np.searchsorted(contexts[j - 1], contexts[j] & (1 << 8 * (j - 1)) - 1)
        self.cost = np.zeros((total, width, len(langs)), dtype=np.float32)
        floor = np.ones(width, dtype=np.float32)
        floor[-1] = 256 - len(symbol)
        for a in range(len(langs)):
            for lo in range(0, total, 4096):
                node = np.arange(lo, min(lo + 4096, total))
                cost = np.zeros((len(node), width))
                done = np.zeros((len(node), width), dtype=bool)
                at = node.copy()
                while (live := at >= 0).any():
                    c = np.where(done, 0, seen[a, np.maximum(at, 0)]) * live[:, None]
                    kinds, mass = (c > 0).sum(axis=1, keepdims=True), c.sum(axis=1, keepdims=True)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        hit = c > 0
                        cost = np.where(hit, cost - np.log2(c / (mass + kinds)), cost)
                        done |= hit
                        cost = np.where(~done & (kinds > 0), cost - np.log2(kinds / (mass + kinds)), cost)
                    at = np.where(live, parent[np.maximum(at, 0)], -1)
                left = np.maximum(np.where(done, 0, floor).sum(axis=1, keepdims=True), 1)
                self.cost[lo : lo + len(node), :, a] = np.where(done, cost, cost + np.log2(left))
        # the walk: from a context and one older byte to the longer context, if any language has it
        self.next = np.full((total, width), -1, dtype=np.int64)
        for j in range(1, order + 1):
            self.next[parent[base[j] : base[j + 1]], self.column[contexts[j] >> 8 * (j - 1)]] = np.arange(base[j], base[j + 1])

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in each language, in bits."""
        pad = b" " * self.order
        data = [pad + t + b" " for t in texts]
        out = np.zeros((len(texts), len(self.langs)))
        sizes = np.array([len(d) for d in data])
        col = self.column[np.frombuffer(b"".join(data), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(col)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.flatnonzero(place >= self.order)
        for lo in range(0, len(at), _CHUNK):
            p = at[lo : lo + _CHUNK]
            node = np.zeros(len(p), dtype=np.int64)
            on = np.ones(len(p), dtype=bool)
            for j in range(1, self.order + 1):
                deeper = self.next[node, col[p - j]]
                on &= deeper >= 0
                node = np.where(on, deeper, node)
            cost = self.cost[node, col[p]]
            who = owner[p]
            cut = np.flatnonzero(np.diff(who, prepend=-1))
            out[who[cut]] += np.add.reduceat(cost, cut, axis=0)
        return out


def fit(docs: DataFrame, *, order: int = ORDER, sample_per_lang: int = SAMPLE_PER_LANG, max_langs: int = MAX_LANGS) -> tuple | None:
    """The arguments of ``ContextTrees`` for the labelled rows of ``docs`` (text, lang); None without any.

    The sample is every row whose hash of text and doc_id (where ``docs`` has one) lies under a threshold that lets
    about ``sample_per_lang`` rows of each language through: one pass, no sort, the same rows in every run. A text
    that many documents repeat is drawn as often as its share; rows with equal lang, text and doc_id count once. So
    the driver gets at most ``order + 1`` table entries for each byte of about ``sample_per_lang`` texts a language.
    More than ``max_langs`` languages raise an error, since the tables grow with their number; none is left out.
    """
    drawn = F.xxhash64(F.col("text").cast("string"), *([F.col("doc_id").cast("string")] if "doc_id" in docs.columns else []))
    labelled = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), drawn.alias("drawn")).where("lang IS NOT NULL AND text IS NOT NULL AND lang <> ''")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(max_langs + 1).collect()}
    if not sizes:
        return None
    if len(sizes) > max_langs:
        raise ValueError(f"lang has more than {max_langs} values: raise max_langs, or map rare and mistyped ones to null first")
    langs = sorted(sizes)
    share = F.element_at(F.create_map(*(x for k in langs for x in (F.lit(k), F.lit(min(1.0, sample_per_lang / sizes[k]))))), F.col("lang"))
    # a third of all rows may be one row: what repeats meets in partial aggregates, so its copies are not shuffled
    sample = labelled.where((F.pmod("drawn", F.lit(1 << 20)) / (1 << 20)) < share).groupBy("lang", "drawn").agg(F.first("text").alias("text")).select("lang", "text")
    rows = sample.mapInArrow(_counts(order), "lang string, k int, gram long, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")).toPandas()
    if not len(rows):
        return None
    langs = sorted(set(rows["lang"]))
    number = {x: i for i, x in enumerate(langs)}
    return (order, langs, rows["k"].to_numpy(), rows["gram"].to_numpy(), rows["lang"].map(number).to_numpy(), rows["n"].to_numpy())


def _predict(model: tuple | None, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = ContextTrees(*model) if model else None
        for batch in batches:
            n = batch.num_rows
            lang, score = ["und"] * n, [0.0] * n
            part: list[tuple[int, bytes]] = []

            def flush() -> None:
                if trees and part:
                    bits = trees.bits([t for _, t in part])
                    best = bits.argmin(axis=1)
                    # the posterior of the best language with flat priors, its evidence tempered by the text's length
                    gap = (bits - bits.min(axis=1, keepdims=True)) / np.sqrt([[len(t)] for _, t in part])
                    p = 1 / np.exp2(-gap).sum(axis=1)
                    for (i, _), b, s in zip(part, best, p, strict=True):
                        lang[i], score[i] = trees.langs[b], float(s)
                part.clear()

            size = 0
            for i, t in enumerate(batch.column(text_at)):
                data = letters(t.as_py())
                if data:
                    part.append((i, data))
                    size += len(data)
                if size > 1 << 20:
                    flush()
                    size = 0
            flush()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: tuple | None, *, carry: list[str] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` with lang_pred and score for each row: the language with the shortest code for the whole text.

    ``und`` with score 0 for null texts and texts without a letter, and for all if no row was
    labelled. Rows repeat as they do in the input. ``carry`` may not hold lang_pred or score.
    """
    given = docs.select(*carry, F.col("text").cast("string").alias("__text"))
    schema = T.StructType([*given.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return given.mapInArrow(_predict(model, len(given.columns) - 1), schema)
