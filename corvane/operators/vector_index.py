"""A stored vector index: cells of near vectors as partitions, product-quantised codes, exact re-ranking.

Few full vectors are read: a query looks at the codes of its nearest cells, which
are partitions of the table, and full vectors only of the best of those. How many
cells and candidates that takes is measured when the index is built, against a flat
scan of some of its own vectors, so hard data costs more and not recall.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T
from ..sources.tables import Versions
from .retrieval import nearest, top
from .topk import TopK

#: Rows that models are fitted on, queries that measure recall, and cells at most, whatever the table's size.
SAMPLE, PROBES, MOST_CELLS, ROUNDS, WORDS = 65_536, 128, 4096, 12, 256

#: Queries of one pass over the codes: a task holds the products with all code words, and the best candidates, of so many.
BLOCK = 512


def kmeans(x: np.ndarray, k: int, seed: int, unit: bool = False) -> np.ndarray:
    """Centres of Lloyd's rounds; an empty cell takes the row that is worst served."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        score = 2 * x @ centres.T - (centres * centres).sum(axis=1)
        own = score.argmax(axis=1)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        worst = np.argsort(score[np.arange(len(x)), own])[: int((n == 0).sum())]
        sums[n == 0], n[n == 0] = x[worst], 1
        centres = sums / n[:, None]
        if unit:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


@dataclass
class Model:
    """Cell centres of unit length and, for each part of the rest, its code words."""

    centres: np.ndarray
    words: np.ndarray  # part, word, place

    @staticmethod
    def fit(x: np.ndarray, cells: int, parts: int, seed: int = 7) -> Model:
        centres = kmeans(x, cells, seed, unit=True)
        rest = x - centres[(x @ centres.T).argmax(axis=1)]
        width = -(-x.shape[1] // parts)
        rest = np.pad(rest, ((0, 0), (0, width * parts - x.shape[1])))
        words = [kmeans(rest[:, p * width : (p + 1) * width], WORDS, seed + p) for p in range(parts)]
        return Model(centres, np.stack(words))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = (x @ self.centres.T).argmax(axis=1)
        parts, _, width = self.words.shape
        rest = np.pad(x - self.centres[cell], ((0, 0), (0, width * parts - x.shape[1])))
        codes = [(2 * rest[:, p * width : (p + 1) * width] @ w.T - (w * w).sum(axis=1)).argmax(axis=1) for p, w in enumerate(self.words)]
        return cell, np.stack(codes, axis=1).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """The product of each query's parts with each code word: (query, part, word)."""
        parts, _, width = self.words.shape
        q = np.pad(queries, ((0, 0), (0, width * parts - queries.shape[1]))).reshape(len(queries), parts, width)
        return np.einsum("qpd,pwd->qpw", q, self.words)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


class VectorIndex:
    """Vectors (vec_id, embedding) below ``root``. Rows without an embedding are not indexed; ids are unique.

    Below ``least_rows`` there are no cells and every search is a flat scan. ``add`` puts new rows into the cells that are
    there; at twice the rows that the cells were made for, all is built anew. ``delete`` hides ids until then.
    """

    def __init__(self, spark: SparkSession, root: str, *, least_rows: int = 100_000, recall: float = 0.97, k: int = 60):
        self.spark, self.root = spark, root.rstrip("/")
        self.versions = Versions(spark, root)
        self.least_rows, self.recall, self.k = least_rows, recall, k

    def _state(self) -> tuple[int, dict]:
        return self.versions.latest()

    def _model(self, state: dict) -> Model:
        rows = self.spark.read.parquet(f"{self.root}/{state['model']}").orderBy("kind", "n").collect()  # at most MOST_CELLS + WORDS a part
        centres = np.array([r["v"] for r in rows if r["kind"] == -1])
        words = [np.array([r["v"] for r in rows if r["kind"] == p]) for p in range(state["parts"])]
        return Model(centres, np.stack(words))

    def rows(self, state: dict | None = None) -> DataFrame:
        """(cell, vec_id, code, embedding) of all live rows."""
        state = state or self._state()[1]
        kind = f"vec_id {state['id']}, code binary, embedding {state['vector']}, cell int"
        found = reduce(DataFrame.union, (self.spark.read.schema(kind).parquet(f"{self.root}/{p}") for p in state["data"]))
        if state["gone"]:
            found = found.join(self.spark.read.parquet(*(f"{self.root}/{p}" for p in state["gone"])), "vec_id", "left_anti")
        return found

    def _encode(self, vectors: DataFrame, model: Model | None, dim: int, to: str) -> None:
        name = vectors.schema["vec_id"].dataType.simpleString()
        shared = self.spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, m = matrix(batch.column(1), dim), shared.value
                cell, code = m.encode(unit(x)) if m else (np.zeros(len(x), dtype=np.int64), np.zeros((len(x), 0), dtype=np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column(0), pa.array([c.tobytes() for c in code], pa.binary()), batch.column(1)], ["cell", "vec_id", "code", "embedding"])

        coded = vectors.mapInArrow(run, f"cell int, vec_id {name}, code binary, embedding {vectors.schema['embedding'].dataType.simpleString()}")
        # a cell with a large share of all rows is split
        coded.hint("rebalance", "cell").write.partitionBy("cell").parquet(to)

    def build(self, vectors: DataFrame, *, cells: int | None = None, parts: int | None = None) -> None:
        vectors = vectors.where("embedding IS NOT NULL").select("vec_id", "embedding")
        number, _ = self._state()
        n = vectors.count()
        base = f"build-{uuid.uuid4().hex}"
        state = {"base": base, "data": [f"{base}/rows"], "gone": [], "built": n, "rows": n, "id": vectors.schema["vec_id"].dataType.simpleString(), "vector": vectors.schema["embedding"].dataType.simpleString(), "model": None, "parts": 0, "probe": 0, "candidates": 0, "dim": 0}
        if n:
            state["dim"] = dim = len(vectors.select("embedding").first()["embedding"])
        if n < max(self.least_rows, 2):
            self._encode(vectors, None, state["dim"], f"{self.root}/{base}/rows")
            return self.versions.publish(number + 1, state)
        chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()
        sample = unit(matrix(chosen.column(0).combine_chunks(), dim))
        cells = cells or min(MOST_CELLS, max(1, int(np.sqrt(n))))
        parts = parts or max(1, dim // 4)
        model = Model.fit(sample, cells, parts)
        flat = [(-1, i, c.tolist()) for i, c in enumerate(model.centres)] + [(p, i, w.tolist()) for p, ws in enumerate(model.words) for i, w in enumerate(ws)]
        self.spark.createDataFrame(flat, "kind int, n int, v array<double>").write.parquet(f"{self.root}/{base}/model")
        state |= {"model": f"{base}/model", "parts": parts}
        self._encode(vectors, model, dim, f"{self.root}/{base}/rows")
        self._measure(state, model)
        self.versions.publish(number + 1, state)

    def _measure(self, state: dict, model: Model) -> None:
        """The fewest cells, and candidates, that keep ``recall`` of the true neighbours of some of the index's own vectors."""
        rows = self.rows(state)
        some = rows.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(PROBES).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))
        k = min(self.k, state["rows"] - 1)
        true = nearest(some, rows, k).join(rows.select("vec_id", "cell"), "vec_id").select("qid", "vec_id", "cell").collect()  # PROBES * k rows
        probes = some.collect()
        asked = {r["qid"]: i for i, r in enumerate(probes)}
        order = np.argsort(-(unit(np.array([r["query"] for r in probes], dtype=np.float64)) @ model.centres.T), axis=1)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], axis=1)
        needed = np.sort([rank[asked[r["qid"]], r["cell"]] for r in true])
        enough = min(1.0, self.recall + (1 - self.recall) / 2)  # the rest is left to the codes
        state["probe"] = int(needed[min(len(needed) - 1, int(np.ceil(enough * len(needed))) - 1)]) + 1
        state["candidates"] = 16 * k
        coded = self._candidates(some, state, model).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("approx"), F.asc("vec_id"))))
        places = {(r["qid"], r["vec_id"]): r["rank"] for r in coded.collect()}  # PROBES * 16 k rows
        at = np.sort([places.get((r["qid"], r["vec_id"]), 1 << 30) for r in true])
        state["candidates"] = int(min(16 * k, at[min(len(at) - 1, int(np.ceil(self.recall * len(at))) - 1)])) + 1

    def _candidates(self, queries: DataFrame, state: dict, model: Model) -> DataFrame:
        """(qid, vec_id, cell, approx): the best rows of each query's nearest cells by their codes."""
        rows, found = self.rows(state), None
        name, kind = queries.schema["qid"].dataType.simpleString(), rows.schema["vec_id"].dataType.simpleString()
        block = []
        for row in chain(queries.select("qid", "query").toLocalIterator(), [None]):
            if row is not None:
                block.append(row)
            if block and (row is None or len(block) == BLOCK):
                q = unit(np.array([r["query"] for r in block], dtype=np.float64))
                near = q @ model.centres.T
                probed = np.argsort(-near, axis=1)[:, : state["probe"]]
                run = _look(self.spark.sparkContext.broadcast((pa.array([r["qid"] for r in block], to_arrow_type(queries.schema["qid"].dataType)), near, probed, model.tables(q))), state["candidates"])
                cells = np.unique(probed).tolist()
                part = rows.where(F.col("cell").isin(cells)).select("cell", "vec_id", "code").mapInArrow(run, f"qid {name}, vec_id {kind}, cell int, approx double")
                part = top(part, "qid", state["candidates"], F.desc("approx"), F.asc("vec_id")).drop("rank")
                found, block = part if found is None else found.union(part), []
        return found if found is not None else self.spark.createDataFrame([], f"qid {name}, vec_id {kind}, cell int, approx double")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, vec_id, similarity, rank): the ``k`` nearest of ``queries`` (qid, query) by exact cosine of the candidates."""
        state = self._state()[1]
        if not state["model"]:
            return nearest(queries, self.rows(state).select("vec_id", "embedding"), k, itself=True)
        # rows that came since compete for the same places
        most = max(int(np.ceil(state["candidates"] * max(1, state["rows"] / state["built"]))), k)
        found = self._candidates(queries, state | {"candidates": most}, self._model(state))
        full = self.rows(state).select("cell", "vec_id", "embedding")
        exact = found.join(full, ["cell", "vec_id"]).join(queries.select("qid", "query"), "qid")
        scored = exact.select("qid", "vec_id", F.round(T.cosine(F.col("query"), F.col("embedding")), 6).alias("similarity"))
        return top(scored, "qid", k, F.desc("similarity"), F.asc("vec_id"))

    def read_share(self) -> float:
        """The share of full vectors that a query reads."""
        state = self._state()[1]
        return min(1.0, state["candidates"] / max(1, state["rows"])) if state["model"] else 1.0

    def add(self, vectors: DataFrame) -> None:
        """New rows in the cells that are there; at twice the rows of the last build all cells are made anew."""
        number, state = self._state()
        vectors = vectors.where("embedding IS NOT NULL").select("vec_id", "embedding")
        n = state["rows"] + vectors.count()
        if n >= max(2 * state["built"], 1) or not state["dim"]:
            return self.build(self.rows(state).select("vec_id", "embedding").unionByName(vectors) if state["rows"] else vectors)
        to = f"{state['base']}/more-{uuid.uuid4().hex}"
        self._encode(vectors, self._model(state) if state["model"] else None, state["dim"], f"{self.root}/{to}")
        self.versions.publish(number + 1, state | {"data": [*state["data"], to], "rows": n})

    def delete(self, ids: DataFrame) -> None:
        """Hides ids (vec_id) from now on; they are left out for good by the next build."""
        number, state = self._state()
        to = f"{state['base']}/gone-{uuid.uuid4().hex}"
        ids.select("vec_id").distinct().write.parquet(f"{self.root}/{to}")
        self.versions.publish(number + 1, state | {"gone": [*state["gone"], to]})

    def state(self) -> dict:
        """What the last build found out and what came since."""
        return self._state()[1]


def _look(shared, most: int):
    """Of the codes of a task the ``most`` best of each query whose cells they are in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, near, probed, tables = shared.value
        best, ids_type = TopK(len(qids), most), None
        asking = {}
        for q, cells in enumerate(probed.tolist()):
            for c in cells:
                asking.setdefault(c, []).append(q)
        for batch in batches:
            cell, ids = batch.column(0).to_numpy(zero_copy_only=False), np.array(batch.column(1).to_pylist())
            ids_type = batch.column(1).type
            code = np.array([np.frombuffer(c, dtype=np.uint8) for c in batch.column(2).to_pylist()]).astype(np.int64).reshape(len(cell), -1)
            for c in np.unique(cell):
                who = np.array(asking.get(int(c), []), dtype=np.int64)
                if not len(who):
                    continue
                at = np.flatnonzero(cell == c)
                for lo in range(0, len(who), 256):
                    w = who[lo : lo + 256]
                    score = near[w, c][:, None] + sum(tables[w, p][:, code[at, p]] for p in range(code.shape[1]))
                    query, row = np.repeat(w, len(at)), np.tile(at, len(w))
                    best.add(query, score.ravel(), ids[row], np.full(len(row), c, dtype=np.int32))
        kept = best.columns()
        if kept:
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(kept[0])), pa.array(kept[2].tolist(), ids_type), pa.array(kept[3]), pa.array(kept[1])], ["qid", "vec_id", "cell", "approx"])

    return run
