"""Benchmark decontamination: size-partitioned MinHash containment search, DataFrame functions only.

A test item is short and a document is long, so their Jaccard similarity says
little; containment is estimated from MinHash samples of the item alone
(Koslicki and Zabeti 2017): under each hash function the smallest shingle of
the item is looked for among the document's shingles and is there with a
probability equal to the containment. Items are partitioned by size: each
partition has its own number of hash functions and of hits asked for, and a
document takes part in partitions of items that fit into it. Candidates are
verified by exact containment on all shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..scratch import Scratch

WIDTH, PERCENT = 5, 80
#: (largest number of shingles, hash functions, hits asked for) of each partition of items. At a containment
#: of 0.8, 16 functions miss with probability 5e-6 and 24 with 2e-6; items of up to 8 shingles use all of them.
PARTITIONS = [(8, 0, 1), (64, 16, 5), (1 << 62, 24, 9)]


def words(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def shingles(ws: Column, width: int) -> Column:
    """Distinct 64-bit hashes of ``width``-word shingles; of the whole sequence if it is shorter, none of an empty one."""


    def of(h: Column) -> Column:
        n = F.size(h)
        many = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(width))))
        return F.when(n >= width, F.array_distinct(many)).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    # the word hashes are bound to a lambda's variable, else they would be computed anew for every shingle
    return F.transform(F.array(F.transform(ws, lambda w: F.xxhash64(w))), of)[0]


def contamination(docs: DataFrame, items: DataFrame, *, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, n_item, n_common): items of which a document holds at least ``percent`` of the distinct ``width``-word shingles.

    Words are lower-cased runs of letters, marks and digits; case, punctuation and line breaks don't
    count. An item or document with fewer words is one shingle; null and blank ones match nothing.
    Rows with a null id are left out. Rows of ``docs`` that share a doc_id are looked at each and give
    a pair once, with the larger count; ``items`` that share an item_id are tried each. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontam")
    docs = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    items = items.select(F.col("item_id").alias("item_id"), words(F.col("text").cast("string")).alias("ws")).where("item_id IS NOT NULL AND size(ws) > 0")
    items = items.select("item_id", shingles(F.col("ws"), width).alias("s")).withColumn("n_item", F.size("s"))
    items = scratch.save(items.withColumn("item", F.xxhash64("item_id", "s")), "items")
    part = F.lit(None)
    for i in reversed(range(len(PARTITIONS))):
        part = F.when(F.col("n_item") <= PARTITIONS[i][0], F.lit(i)).otherwise(part)
    sketches = None
    for i, (_, functions, hits) in enumerate(PARTITIONS):
        own = items.where(part == i)
        seeds = F.array(*(F.lit(k) for k in range(functions)))
        least = lambda k: F.array_min(F.transform("s", lambda x: F.struct(F.xxhash64(x, k).alias("h"), x.alias("x"))))["x"]
        sample = F.array_distinct(F.transform(seeds, least)) if functions else F.col("s")
        # several functions may share a smallest shingle; the hits asked for follow the distinct ones
        own = own.select("item", "n_item", sample.alias("sample")).select("item", "n_item", F.greatest(F.lit(1), F.floor(F.size("sample") * F.lit(hits / max(functions, 1) if functions else 0.25))).alias("hits"), F.explode("sample").alias("x"))
        sketches = own if sketches is None else sketches.union(own)
    sketches = scratch.save(sketches, "sketches")
    probes = sketches.select("x").distinct()
    # Spark broadcasts the probes if their files are under its threshold, else it shuffles both sides
    sized = docs.select("doc_id", shingles(words(F.col("text")), width).alias("s")).withColumn("n_doc", F.size("s"))
    met = sized.select("doc_id", "n_doc", F.explode("s").alias("x")).join(probes, "x")
    hits = met.join(sketches, "x").where(F.col("n_doc") * 100 >= F.col("n_item") * percent)
    # rows of one doc_id add up here, which only lets more candidates through
    found = hits.groupBy("doc_id", "item").agg(F.count(F.lit(1)).alias("n"), F.min("hits").alias("hits")).where("n >= hits").select("doc_id", "item")
    found = scratch.save(found, "candidates")
    whole = docs.join(found.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", shingles(words(F.col("text")), width).alias("sd"))
    whole = scratch.save(whole, "documents")
    scratch.keep_only("items", "candidates", "documents")
    pairs = found.join(items, "item").join(whole, "doc_id").select("doc_id", "item_id", F.col("n_item").cast("long").alias("n_item"), F.size(F.array_intersect("s", "sd")).cast("long").alias("n_common"))
    kept = pairs.where(F.col("n_common") * 100 >= F.col("n_item") * percent)
    return kept.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_common", "n_item")).alias("m")).select("doc_id", "item_id", "m.n_item", "m.n_common")


def without_contaminated(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in no pair; rows with a null doc_id stay."""
    return docs.join(found.select(F.col("doc_id").alias("doc_id")).distinct(), "doc_id", "left_anti").select(*docs.columns)
