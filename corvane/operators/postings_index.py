"""A stored keyword index: segments of postings in blocks, merged on read.

A segment holds the postings of one batch of documents, one row for each term and
range of documents, with the highest count and the least length there, which bound
what any of them can score, whatever the average length. Changed and deleted documents leave
tombstones behind, and their counts are taken off the stored statistics, so scores
are those of an index built anew. Small segments are merged into larger ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T
from ..scratch import Scratch
from ..settings import SEARCH, Search
from ..sources.tables import Versions
from .retrieval import QUERIES, top
from .topk import TopK, rounded

#: Documents of a range, segments of one size that are merged, and the share of dead documents that makes a segment be rewritten.
RANGE, FAN, DEAD = 128, 4, 0.3


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, doc_id, tf, dl) of the words (doc_id, term, n) of documents one after another."""
    held: list[pa.RecordBatch] = []  # the rows of a document that may go on in the next batch

    def counted(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        if not len(rows):
            return
        ids, n = rows.column(0).combine_chunks(), rows.column(2).to_numpy()
        new = np.concatenate(([True], pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)))
        of, first = np.cumsum(new) - 1, np.flatnonzero(new)
        tf = pa.table({"of": of, "term": rows.column(1), "n": n}).group_by(["of", "term"]).aggregate([("n", "sum")]).combine_chunks()
        at, dl = tf.column("of").to_numpy(), np.add.reduceat(n.astype(np.int64), first)
        columns = [tf.column("term"), ids.take(pa.array(first[at])), tf.column("n_sum").cast(pa.int32()), pa.array(dl[at].astype(np.int32))]
        yield from pa.table(columns, names=["term", "doc_id", "tf", "dl"]).to_batches(max_chunksize=1 << 16)

    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0)
        if held and held[-1].column(0)[-1] != ids[0]:
            yield from counted(held)
            held = []
        last = np.flatnonzero(pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False))
        if len(last):
            yield from counted([*held, batch.slice(0, int(last[-1]) + 1)])
            held, batch = [], batch.slice(int(last[-1]) + 1)
        held.append(batch)
    if held:
        yield from counted(held)


def terms(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(term, key, tf, dl): stems of all words of three letters or more; ``tf`` leaves stop words out, so it may be 0, ``dl`` is their sum.

    Counted where a document is, without a shuffle, so the ids have to be unique.
    """
    word = docs.select(F.col(key).alias("doc_id"), F.explode(F.filter(T.words(text), lambda w: F.length(w) >= 3)).alias("w"))
    counts = F.when(F.col("w").isin(*T.STOP_WORDS), 0).otherwise(1)
    kind = docs.schema[key].dataType.simpleString()
    return word.select("doc_id", T.stem(F.col("w")).alias("term"), counts.alias("n")).mapInArrow(_counted, f"term string, doc_id {kind}, tf int, dl int").withColumnRenamed("doc_id", key)


class PostingsIndex:
    """Postings of documents (doc_id, text) below ``root``; ids are unique and not null, a null text has no terms.

    ``apply`` adds or replaces documents and deletes ids; ``bm25`` scores queries. Each state names its segments, so readers
    keep what they began with.
    """

    def __init__(self, spark: SparkSession, root: str, cfg: Search = SEARCH):
        self.spark, self.root, self.cfg = spark, root.rstrip("/"), cfg
        self.versions = Versions(spark, root)

    def _state(self) -> tuple[int, dict]:
        number, state = self.versions.latest()
        return number, state or {"segments": [], "id": None}

    def _ddl(self, state: dict) -> str:
        return f"rng int, term string, ids array<{state['id']}>, tfs array<int>, dls array<int>, df long, most int, least int"

    def _read(self, state: dict, kind: str, name: str) -> DataFrame:
        schema = {"blocks": self._ddl(state), "docs": f"doc_id {state['id']}, rng int, dl int", "gone": f"doc_id {state['id']}, rng int, dl int", "lost": "term string, n long"}[kind]
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{kind}")

    def _segment(self, posts: DataFrame, n: int, kind: str) -> dict | None:
        """Writes postings (term, doc_id, tf, dl) of about ``n`` documents as a segment; they are shuffled once, to the place where they are kept."""
        scratch, name = Scratch(self.spark, "segment"), f"segment-{uuid.uuid4().hex}"
        ranges = max(1, -(-n // RANGE))
        posts = scratch.save(posts, "posts")
        rng = F.pmod(F.xxhash64("doc_id"), F.lit(ranges)).cast("int")
        # partial before the shuffle, to a row for each document where its postings lie together
        docs = posts.groupBy("doc_id").agg(F.max("dl").alias("dl")).select("doc_id", rng.alias("rng"), "dl")
        docs.write.parquet(f"{self.root}/{name}/docs")
        docs = self.spark.read.parquet(f"{self.root}/{name}/docs")
        size = docs.agg(F.count_if(F.col("dl") > 0).alias("docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words"), F.count(F.lit(1)).alias("all")).first()
        counted = F.col("tf") > 0
        dealt = posts.withColumn("rng", rng).repartitionByRange("term", "rng")
        blocks = dealt.groupBy("term", "rng").agg(
            F.collect_list(F.struct("doc_id", "tf", "dl")).alias("p"),  # no more than a range's documents
            F.count_if(counted).alias("df"), F.max("tf").alias("most"), F.min(F.when(counted, F.col("dl"))).alias("least"),
        )
        blocks = blocks.select("rng", "term", F.col("p.doc_id").alias("ids"), F.col("p.tf").alias("tfs"), F.col("p.dl").alias("dls"), "df", "most", "least")
        blocks.sortWithinPartitions("term", "rng").write.parquet(f"{self.root}/{name}/blocks")
        scratch.drop("posts")
        return {"name": name, "docs": size["docs"], "words": size["words"], "all": size["all"], "gone": [], "dead": 0, "dead_words": 0, "dead_all": 0}

    def apply(self, docs: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """``docs`` (doc_id, text) in place of older versions, and the ids of ``gone`` (doc_id) deleted; then small segments are merged."""
        number, state = self._state()
        state = state | {"id": state["id"] or (docs if docs is not None else gone).schema["doc_id"].dataType.simpleString(), "segments": [dict(s) for s in state["segments"]]}
        ids = [d.select("doc_id") for d in (docs, gone) if d is not None]
        ids = Scratch(self.spark, "ids").save((ids[0] if len(ids) == 1 else ids[0].union(ids[1])).distinct(), "ids")
        for s in state["segments"]:
            self._bury(state, s, ids)
        if docs is not None:
            docs = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
            n = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("ids")).first()
            if n["rows"] > n["ids"]:  # rows that share an id are one document
                docs = docs.groupBy("doc_id").agg(F.concat_ws("\n", F.collect_list("text")).alias("text"))
            s = self._segment(terms(docs, "doc_id", F.col("text")), n["rows"], state["id"])
            if s["all"]:
                state["segments"].append(s)
        self._compact(state)
        self.versions.publish(number + 1, state)

    def _live_docs(self, state: dict, s: dict) -> DataFrame:
        docs = self._read(state, "docs", s["name"])
        for g in s["gone"]:
            docs = docs.join(self._read(state, "gone", g).select("doc_id"), "doc_id", "left_anti")
        return docs

    def _bury(self, state: dict, s: dict, ids: DataFrame) -> None:
        """Tombstones for ``ids`` that live in a segment, and the counts of their terms."""
        name = f"gone-{uuid.uuid4().hex}"
        self._live_docs(state, s).join(ids, "doc_id", "left_semi").write.parquet(f"{self.root}/{name}/gone")
        dead = self._read(state, "gone", name)
        size = dead.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("dl") > 0).alias("docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).first()
        if not size["all"]:
            self.versions.folder.drop(name)
            return
        blocks = self._read(state, "blocks", s["name"]).join(dead.select("rng").distinct(), "rng", "left_semi")
        post = blocks.select("term", F.explode(F.arrays_zip("ids", "tfs")).alias("p")).select("term", F.col("p.ids").alias("doc_id"), F.col("p.tfs").alias("tf")).where("tf > 0")
        post.join(dead.select("doc_id"), "doc_id", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{self.root}/{name}/lost")
        s["gone"] = [*s["gone"], name]
        s["dead"], s["dead_words"], s["dead_all"] = s["dead"] + size["docs"], s["dead_words"] + size["words"], s["dead_all"] + size["all"]

    def _compact(self, state: dict) -> None:
        """Merges ``FAN`` segments of one order of size, and rewrites those with many dead documents."""
        while True:
            tiers: dict[int, list[dict]] = {}
            for s in state["segments"]:
                tiers.setdefault(int(log(max(s["all"] - s["dead_all"], 1), FAN)), []).append(s)
            merge = next((t for t in tiers.values() if len(t) >= FAN), None) or [s for s in state["segments"] if s["dead_all"] > DEAD * s["all"]][:1]
            if not merge:
                return
            posts = None
            for s in merge:
                one = self._read(state, "blocks", s["name"]).select(F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p"), "term").select("term", F.col("p.ids").alias("doc_id"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"))
                one = one.join(self._live_docs(state, s).select("doc_id"), "doc_id", "left_semi")
                posts = one if posts is None else posts.union(one)
            state["segments"] = [s for s in state["segments"] if s not in merge]
            if live := sum(s["all"] - s["dead_all"] for s in merge):
                state["segments"].append(self._segment(posts, live, state["id"]))

    def sizes(self) -> tuple[int, float]:
        """Live documents with a term, and their average length."""
        segments = self._state()[1]["segments"]
        n = sum(s["docs"] - s["dead"] for s in segments)
        return n, sum(s["words"] - s["dead_words"] for s in segments) / max(n, 1)

    def _blocks(self, state: dict, asked: DataFrame) -> DataFrame | None:
        """(place, rng, term, ids, tfs, dls, most, least, dead): the blocks of the asked terms (term), with the dead ids of their range."""
        found = None
        for i, s in enumerate(state["segments"]):
            one = self._read(state, "blocks", s["name"]).join(asked, "term", "left_semi").withColumn("place", F.lit(i))
            if s["gone"]:
                dead = None
                for g in s["gone"]:
                    rows = self._read(state, "gone", g)
                    dead = rows if dead is None else dead.union(rows)
                one = one.join(dead.groupBy("rng").agg(F.collect_set("doc_id").alias("dead")), "rng", "left")
            else:
                one = one.withColumn("dead", F.lit(None).cast(f"array<{state['id']}>"))
            one = one.select("place", "rng", "term", "ids", "tfs", "dls", "most", "least", "dead", "df")
            found = one if found is None else found.union(one)
        return found

    def _run(self, queries: DataFrame, k: int, count: bool) -> DataFrame:
        state = self._state()[1]
        name = queries.schema["qid"].dataType.simpleString()
        ddl = f"qid {name}, read long, held long" if count else f"qid {name}, doc_id {state['id']}, bm25 double, matched long"
        scratch, found = Scratch(self.spark, "bm25"), None
        asked = scratch.save(queries.groupBy("qid", "term").agg(F.count(F.lit(1)).alias("n")), "asked")
        blocks = self._blocks(state, asked.select("term").distinct()) if state["segments"] else None
        if blocks is None:
            return self.spark.createDataFrame([], ddl)
        blocks = scratch.save(blocks, "blocks")
        df = blocks.groupBy("term").agg(F.sum("df").alias("n"))
        lost = [self._read(state, "lost", g) for s in state["segments"] for g in s["gone"]]
        for part in lost:
            df = df.union(part.join(asked, "term", "left_semi").select("term", (-F.col("n")).alias("n")))
        df = df.groupBy("term").agg(F.sum("n").alias("df"))
        rows = asked.join(df, "term").select("qid", "term", "n", "df").orderBy("qid").toLocalIterator()
        docs, average = self.sizes()
        # a block of queries with their terms is what a task holds
        part, seen = [], set()
        for row in chain(rows, [None]):
            if part and (row is None or (len(seen) == QUERIES and row["qid"] not in seen)):
                run = _score(self.spark.sparkContext.broadcast(_Asked(part, docs, average, self.cfg, to_arrow_type(queries.schema["qid"].dataType))), k, count)
                dealt = blocks.drop("df").repartition("place", "rng").sortWithinPartitions("place", "rng")
                one = dealt.mapInArrow(run, ddl)
                found, part, seen = one if found is None else found.union(one), [], set()
            if row is not None:
                part.append(row)
                seen.add(row["qid"])
        return found if found is not None else self.spark.createDataFrame([], ddl)

    def bm25(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, doc_id, bm25, keyword_rank, matched) of ``queries`` (qid, term), a row for each occurrence of a term.

        A term counts once for the score; ``matched`` is how many of the query's occurrences the document has, stop words of
        the text included.
        """
        return top(self._run(queries, k, False), "qid", k, F.desc("bm25"), F.asc("doc_id"), rank="keyword_rank")

    def read_share(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, read, held): the postings that a search scores, and all that its terms have."""
        return self._run(queries, k, True).groupBy("qid").agg(F.sum("read").alias("read"), F.sum("held").alias("held"))


class _Asked:
    """A block of queries by term: who asks, how often, and what the term weighs."""

    def __init__(self, rows: list, docs: int, average: float, cfg: Search, kind: pa.DataType):
        ids = sorted({r["qid"] for r in rows})
        at = {q: i for i, q in enumerate(ids)}
        self.qids = pa.array(ids, kind)
        by: dict[str, list] = {}
        for r in rows:
            by.setdefault(r["term"], []).append((at[r["qid"]], r["n"], log(1 + (docs - r["df"] + 0.5) / (r["df"] + 0.5))))
        self.terms = {t: (np.array([x[0] for x in v]), np.array([x[1] for x in v]), v[0][2]) for t, v in by.items()}
        self.k1, self.base, self.slope = cfg.bm25_k1, cfg.bm25_k1 * (1 - cfg.bm25_b), cfg.bm25_k1 * cfg.bm25_b / max(average, 1e-9)

    def weight(self, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return tf * (self.k1 + 1) / (tf + self.base + self.slope * dl)


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _score(shared, k: int, count: bool):
    """Ranges one after the other: only queries that the blocks' bounds let reach their k-th score, first by the terms that
    can decide, then the others' postings of documents that still can."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            place, rng = held.column("place").to_numpy(), held.column("rng").to_numpy()
            cuts = np.flatnonzero((place[1:] != place[:-1]) | (rng[1:] != rng[:-1])) + 1
            done = 0
            for c in cuts.tolist():
                yield held.slice(done, c - done)
                done = c
            held = held.slice(done)
        if held is not None and len(held):
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: _Asked = shared.value
        best = TopK(len(a.qids), k)
        read, total, kind = np.zeros(len(a.qids), dtype=np.int64), np.zeros(len(a.qids), dtype=np.int64), None
        for group in groups(batches):
            group = group.combine_chunks()
            column = {n: group.column(n).combine_chunks() for n in ("term", "ids", "tfs", "dls", "dead")}
            known = [a.terms.get(t) for t in column["term"].to_pylist()]
            rows = [i for i, x in enumerate(known) if x is not None]
            if not rows:
                continue
            # what a term can give at most in this range, for each query that asks for it
            most, least_dl = (group.column(n).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False) for n in ("most", "least"))
            bound = a.weight(most.astype(np.float64), least_dl.astype(np.float64))
            asks = np.array([len(known[i][0]) for i in rows])
            row = np.repeat(rows, asks)
            query = np.concatenate([known[i][0] for i in rows])
            times = np.concatenate([known[i][1] for i in rows])
            idf = np.repeat([known[i][2] for i in rows], asks)
            upper = idf * bound[row]
            lens = np.asarray(column["ids"].value_lengths())
            if count:
                total += np.bincount(query, weights=lens[row], minlength=len(total)).astype(np.int64)
            reach = np.bincount(query, weights=upper, minlength=len(best.least))
            least = best.least - 1e-5  # bounds and scores are rounded differently
            active = (reach >= least) & (reach > 0)
            on = active[query]
            if not on.any():
                continue
            row, query, times, idf, upper = (x[on] for x in (row, query, times, idf, upper))
            order = np.lexsort((upper, query))
            row, query, times, idf, upper = (x[order] for x in (row, query, times, idf, upper))
            sums = np.cumsum(upper)
            first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
            sums -= np.repeat(sums[first] - upper[first], np.diff(np.concatenate((first, [len(query)]))))
            decides = sums >= least[query]
            rest = np.bincount(query[~decides], weights=upper[~decides], minlength=len(active))
            # postings of this range by place
            kind = column["ids"].type.value_type
            raw = column["ids"].flatten()
            docs, doc = np.unique(np.array(raw.to_pylist()) if not pa.types.is_integer(kind) else raw.to_numpy(zero_copy_only=False), return_inverse=True)
            dead = column["dead"][0].as_py()
            alive = ~np.isin(docs, np.array(dead)) if dead else np.ones(len(docs), dtype=bool)
            tf = _flat(column["tfs"]).astype(np.float64)
            weight = a.weight(tf, _flat(column["dls"]).astype(np.float64))
            start = np.concatenate(([0], np.cumsum(lens)))
            names, q = np.unique(query, return_inverse=True)
            score, hits, matched = (np.zeros((len(docs), len(names))) for _ in range(3))

            def take(which: np.ndarray, can: np.ndarray | None) -> None:
                n = lens[row[which]]
                entry = np.repeat(which, n)
                at = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n) + start[row[entry]]
                keep = alive[doc[at]]
                if can is not None:
                    keep &= can[doc[at], q[entry]]
                entry, at = entry[keep], at[keep]
                place = doc[at] * len(names) + q[entry]
                for to, w in ((score, weight[at] * idf[entry]), (hits, tf[at]), (matched, times[entry])):
                    to += np.bincount(place, weights=w, minlength=score.size).reshape(score.shape)
                read[:] += np.bincount(query[entry], minlength=len(read))

            take(np.flatnonzero(decides), None)
            can = (score + rest[names][None, :] >= least[names][None, :]) & (score > 0) if np.isfinite(least[names]).any() else None
            take(np.flatnonzero(~decides), can)
            d, c = np.nonzero((hits > 0) if can is None else (hits > 0) & can)
            best.add(names[c], rounded(score[d, c]), docs[d], matched[d, c].astype(np.int64))
            best.prune()
        if count:
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([a.qids.take(pa.array(some)), pa.array(read[some]), pa.array(total[some])], ["qid", "read", "held"])
            return
        kept = best.columns()
        if kept:
            yield pa.RecordBatch.from_arrays([a.qids.take(pa.array(kept[0])), pa.array(kept[2].tolist(), kind), pa.array(kept[1]), pa.array(kept[3])], ["qid", "doc_id", "bm25", "matched"])

    return run
