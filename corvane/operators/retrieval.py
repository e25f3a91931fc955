"""Retrieval legs and their fusion, for any number of queries at a time."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..settings import DIM, SEARCH, Search
from .topk import TopK, rounded

#: Queries of one pass over the vectors.
QUERIES = 4096
#: Pieces that the files of one class of names are dealt to.
PIECES = 4096


def top(df: DataFrame, key: str, k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each ``key``; Spark limits each group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("int")).where(F.col(rank) <= k)


def slots(df: DataFrame, key: str, text: Column, dim: int = DIM) -> DataFrame:
    """(key, slot, n): the hashed bag of words of each text, one row per slot in use."""
    word = df.select(key, F.explode(T.words(text)).alias("w"))
    slot = (F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long") % dim).cast("int")
    return word.select(key, slot.alias("slot")).groupBy(key, "slot").agg(F.count(F.lit(1)).alias("n"))


def bags(slot_rows: DataFrame, key: str, dim: int = DIM) -> DataFrame:
    """(key, vector): ``slots`` rows as one vector for each text."""
    counts = F.map_from_entries(F.collect_list(F.struct("slot", F.col("n").cast("double"))))
    filled = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("counts", i), F.lit(0.0)))
    return slot_rows.groupBy(key).agg(counts.alias("counts")).select(key, filled.alias("vector"))


def vector_leg(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id, similarity, vector_rank): top ``k`` by cosine of ``bags`` tables (qid or doc_id, vector); pairs without a common slot are left out."""
    found = nearest(queries.withColumnRenamed("vector", "query"), docs.select(F.col("doc_id").alias("vec_id"), F.col("vector").alias("embedding")), k, itself=True)
    return found.where("similarity > 0").select("qid", F.col("vec_id").alias("doc_id"), "similarity", F.col("rank").alias("vector_rank"))


def _scan(qids: list, matrix: np.ndarray, k: int, itself: bool):
    """Of all vectors of a task the ``k`` nearest of every query, as blocks of rows against the block of queries."""
    norms = np.sqrt((matrix * matrix).sum(axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind, names = TopK(len(qids), k), None, np.array(qids)
        for batch in batches:
            kind, width = batch.column(0).type, matrix.shape[1]
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            norm, ids = np.sqrt((v * v).sum(axis=1)), np.array(batch.column(0).to_pylist())
            for lo in range(0, len(v), 1024):
                part, own = v[lo : lo + 1024], ids[lo : lo + 1024]
                scale = norm[lo : lo + 1024, None] * norms[None, :]
                sim = rounded(np.divide(part @ matrix.T, scale, out=np.zeros((len(part), len(qids))), where=scale > 0))
                if not itself:
                    sim[own[:, None] == names[None, :]] = -np.inf
                floor = best.least
                if len(part) >= k:
                    floor = np.maximum(floor, np.partition(sim, len(part) - k, axis=0)[len(part) - k])
                row, query = np.nonzero((sim >= floor) & np.isfinite(sim))
                best.add(query, sim[row, query], own[row])
        kept = best.columns()
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([qids[i] for i in kept[0].tolist()]), pa.array(kept[2].tolist(), kind), pa.array(kept[1])], ["qid", "vec_id", "similarity"])

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int, *, itself: bool = False) -> DataFrame:
    """(qid, vec_id, similarity, rank): exact cosine top ``k`` of dense vectors (vec_id, embedding) for ``queries`` (qid, query).

    A flat scan: one pass over the vectors for each block of ``QUERIES`` queries, which travel to the tasks; every task
    gives its ``k`` best of each query. A vector is not its own neighbour unless ``itself``.
    """
    first = vectors.schema["vec_id"].dataType.simpleString()
    name = queries.schema["qid"].dataType.simpleString()
    blocks = None
    rows, block = queries.select("qid", "query").toLocalIterator(), []
    for row in chain(rows, [None]):
        if row is not None:
            block.append(row)
        if block and (row is None or len(block) == QUERIES):
            matrix = np.array([r["query"] for r in block], dtype=np.float64)
            found = vectors.select("vec_id", "embedding").where("embedding IS NOT NULL").mapInArrow(_scan([r["qid"] for r in block], matrix, k, itself), f"qid {name}, vec_id {first}, similarity double")
            blocks, block = found if blocks is None else blocks.union(found), []
    if blocks is None:
        blocks = vectors.sparkSession.createDataFrame([], f"qid {name}, vec_id {first}, similarity double")
    return top(blocks, "qid", k, F.desc("similarity"), F.asc("vec_id"))


def postings(docs: DataFrame, key: str, text: Column, asked: DataFrame | None = None) -> DataFrame:
    """(term, key, tf, dl): counts of the stemmed terms without stop words.

    With ``asked`` (term), all other terms of a text are one row of a null term: they count for its length and go no further.
    """
    word = docs.select(key, F.explode(T.words(text)).alias("w")).where((F.length("w") >= 3) & ~F.col("w").isin(*T.STOP_WORDS))
    term = word.select(key, T.stem(F.col("w")).alias("term"))
    if asked is not None:
        known = asked.select("term").distinct().withColumn("known", F.lit(True))
        term = term.join(F.broadcast(known), "term", "left").select(key, F.when(F.col("known"), F.col("term")).alias("term"))
    tf = term.groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"))
    dl = tf.groupBy(key).agg(F.sum("tf").alias("dl"))
    return tf.join(dl, key)


def bm25_leg(queries: DataFrame, posts: DataFrame, k: int, cfg: Search = SEARCH) -> DataFrame:
    """(qid, doc_id, bm25, keyword_rank) of ``queries`` (qid, term); idf is ln(1 + (N - df + 0.5) / (df + 0.5)).

    The queries' terms travel to the postings, which are dealt by document: scores are summed where a document is, and only
    each task's ``k`` best are shuffled. ``posts`` are read several times; write them first.
    """
    size = posts.groupBy("doc_id").agg(F.max("dl").alias("dl")).agg(F.count(F.lit(1)).alias("docs"), F.avg("dl").alias("avgdl"))
    asked = queries.distinct()
    # only the queries' terms go on: a posting is one row for each term and document, so their count is the term's df
    hit = posts.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    norm = F.col("tf") + cfg.bm25_k1 * (1 - cfg.bm25_b + cfg.bm25_b * F.col("dl") / F.col("avgdl"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(df, "term").join(F.broadcast(size)).select("qid", "term", "avgdl", idf.alias("idf"))  # one row of sizes
    parts = int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: postings are small against the scores they make
    part = hit.repartition(parts, "doc_id").join(F.broadcast(weighed), "term").select("qid", "doc_id", (F.col("idf") * F.col("tf") * (cfg.bm25_k1 + 1) / norm).alias("part"))
    scored = part.groupBy("qid", "doc_id").agg(F.round(F.sum("part"), 6).alias("bm25"))
    return top(scored, "qid", k, F.desc("bm25"), F.asc("doc_id"), rank="keyword_rank")


def name_leg(queries: DataFrame, files: DataFrame) -> DataFrame:
    """(qid, path, share, exact) of all files (path) whose name answers a query (qid, query): ``name_share`` and ``name_exact``, counted instead of judged pair by pair.

    Names that have the same of the queries' words answer every query alike. So matches are counted once for such a class, and
    pairs of files and queries are made last, from pieces of a class that lie in many tasks; they are never shuffled or grouped.
    """
    # equal for just those words that name_share takes as one: of four letters or more without a final s, else as they are
    root = lambda w: F.concat(F.lit("w"), F.when(F.length(w) >= 4, F.concat(F.regexp_replace(w, "s$", ""), F.lit("\0"))).otherwise(w))
    extension, whole = (lambda w: F.concat(F.lit("e"), w)), (lambda w: F.concat(F.lit("x"), w))
    written = F.trim(F.regexp_replace(F.lower("query"), r"\s+", " "))  # a name as it stands, with or without its extension
    terms = queries.select("qid", F.explode(T.query_terms(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("n"))
    total = terms.groupBy("qid").agg(F.sum("n").alias("total"))
    asked = terms.join(total, "qid").select("qid", "term", "n", "total", F.explode(F.array(root(F.col("term")), extension(F.col("term")))).alias("key"))
    names_asked = queries.where(written != "").select("qid", F.lit("").alias("term"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("total"), whole(written).alias("key"))
    name = T.file_name(F.col("path"))
    tokens = F.transform(F.split(T.name_words(F.col("path")), r"\s+"), lambda w: root(w))
    keys = F.array_distinct(F.concat(tokens, F.array(extension(F.col("ext")), whole(name), whole(T.stem_of(name)))))
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number, so that few small names still are many tasks
    asked = asked.union(names_asked.select(asked.columns))
    names = files.select("path").repartition(parts, "path").distinct().withColumn("ext", T.extension(name)).select("path", "ext", F.explode(keys).alias("key"))
    known = names.join(F.broadcast(asked.select("key").distinct()), "key").groupBy("path", "ext").agg(F.array_sort(F.collect_set("key")).alias("words"))
    pieces = known.groupBy("ext", "words", F.pmod(F.xxhash64("path"), F.lit(PIECES)).alias("piece")).agg(F.collect_list("path").alias("paths"))
    met = pieces.select("ext", "words").distinct().withColumn("key", F.explode("words")).join(F.broadcast(asked), "key").withColumn("kind", F.substring("key", 1, 1))
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x).otherwise(0))
    # the file's extension is no term of its query
    counted = met.where("kind <> 'w' OR term <> ext").groupBy("ext", "words", "qid").agg(of("w", F.col("n")).alias("hits"), (F.max("total") - of("e", F.col("n"))).alias("terms"), F.max(F.col("kind") == "x").alias("exact"))
    share = F.when(F.col("exact"), F.lit(1.0)).when(F.col("terms") > 0, F.col("hits") / F.col("terms")).otherwise(F.lit(0.0))
    answers = counted.select("ext", "words", "qid", share.alias("share"), "exact").where("share > 0 OR exact").groupBy("ext", "words").agg(F.collect_list(F.struct("qid", "share", "exact")).alias("found"))
    # dealt anew, since nearly all names may be of one class
    both = pieces.join(answers, ["ext", "words"]).repartition(parts, "piece", "words")
    return both.select(F.explode("paths").alias("path"), "found").select("path", F.explode("found").alias("f")).select("f.qid", "path", "f.share", "f.exact")


def fuse(vector: DataFrame, keyword: DataFrame, floor: float = 0.0, cfg: Search = SEARCH) -> DataFrame:
    """Both legs outer-joined: score = vector weight * scaled similarity + keyword weight * BM25 over the query's best."""
    best = F.max(F.coalesce("bm25", F.lit(0.0))).over(Window.partitionBy("qid"))
    both = vector.join(keyword, ["qid", "doc_id"], "full_outer").withColumn("best", best)
    relative = F.when(F.col("best") > 0, F.coalesce("bm25", F.lit(0.0)) / F.col("best")).otherwise(0.0)
    score = cfg.vector_weight * T.scaled_similarity(F.col("similarity"), floor) + cfg.keyword_weight * relative
    return both.select("qid", "doc_id", F.round(score, 8).alias("score"), "similarity", "bm25", "vector_rank", "keyword_rank")


def fused_order(similarity: Column) -> Column:
    """The second sort key of fused rows: no similarity, and one of exactly 0 too, counts as -1."""
    return F.when(F.coalesce(similarity, F.lit(0.0)) == 0, -1.0).otherwise(similarity)
