"""The registered ``opN_<name>`` queries and, where SQL can state one, its DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontam, html_extract, importance, langid, packing, periodic, quality, substr, tokens, urls, warc
from .mixing import Mix
from .neardup import near_duplicates
from ..scratch import Scratch

#: The rules of the registered URL query: (verdict, host, path).
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Globs for URLs without a rule.
URL_BLOCKED = urls.read_globs(Path(__file__).with_name("url_globs.txt"))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substr.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES, URL_BLOCKED)


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, root = table(spark, sf_dir, "pages"), Scratch(spark, "archives").root
    warc.write_archives(pages, root)
    return warc.look_up(pages.select(warc.url_key(F.col("url")).alias("key")), root)


@query
def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


@query
def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(table(spark, sf_dir, "documents")).taken()


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Words from the a-th on, of n, become repeats of the p words from there, where the id's check sum ends in 0.
PERIODIC = r"""
WITH d AS (SELECT doc_id, text, crc32(cast(doc_id AS string)) AS h FROM {docs}),
w AS (SELECT *, h div 10 AS g, CASE WHEN h % 10 = 0 THEN regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0) END AS w FROM d),
n AS (SELECT *, cast(size(w) AS bigint) AS n FROM w),
a AS (SELECT *, g % nullif(n, 0) AS a FROM n),
p AS (SELECT *, 1 + (n - a) div (3 + g % 8) AS p FROM a)
SELECT doc_id, CASE WHEN n > 0
  THEN array_join(transform(sequence(0L, n - 1), i -> get(w, cast(if(i < a, i, a + (i - a) % p) AS int))), ' ') ELSE text END AS text
FROM p
"""


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.sql(PERIODIC, docs=table(spark, sf_dir, "documents").select("doc_id", "text"))
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    best = F.aggregate("runs", none, lambda b, r: F.when(better(b, r), r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    found = periodic.periodic_runs(docs).withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )


ORACLE["op9_near_dedup"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[]
    WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')))) END AS sh
  FROM w
), c AS (
  SELECT min(doc_id) AS node, sh FROM s WHERE len(sh) > 0 GROUP BY sh
), e AS (
  SELECT node, len(sh) AS n, unnest(sh) AS x FROM c
), p AS (
  SELECT a.node AS a, b.node AS b FROM e a JOIN e b ON a.x = b.x AND a.node < b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), both_ways AS (
  SELECT a, b FROM p UNION SELECT b, a FROM p
), r(node, reach) AS (
  SELECT node, node FROM c UNION SELECT r.node, b.b FROM r JOIN both_ways b ON b.a = r.reach
), m AS (
  SELECT node, min(reach) AS component_id FROM r GROUP BY node
)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id,
  s.doc_id = coalesce(m.component_id, s.doc_id) AS kept
FROM s LEFT JOIN c ON c.sh = s.sh LEFT JOIN m ON m.node = c.node
"""


_HOST = "CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END"
# Canonical forms but for escapes and dots in paths, which the given URLs have none of; tests cover those.
_CLEAN = r"regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '')"
_QUERY = r"CASE WHEN regexp_extract(url, '^.*?://[^?#]*\?([^#]*)', 1) <> '' THEN '?' || regexp_extract(url, '^.*?://[^?#]*\?([^#]*)', 1) ELSE '' END"
_GLOB = {"**": "(?s:.*)", "*": r"[^\n]*", urls.SEP: r"\n"}
_GLOBS = "|".join("".join(_GLOB.get(x) or re.escape(x) for x in re.findall(r"\*\*|.|\n", g)) for g in URL_BLOCKED)
_PATH = "CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END"
_RULE = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{{i}}}'" for i, (_, h, p) in sorted(enumerate(URL_RULES), key=lambda r: -len(r[1][1] + r[1][2])))
ORACLE["op5_url_filters"] = f"""
WITH u AS (SELECT page_id, url, {_HOST} AS host, {_PATH} AS path FROM pages)
SELECT page_id, host, path, CASE {_RULE.format(*(h + p for _, h, p in URL_RULES))} END AS rule,
  CASE {_RULE.format(*(v for v, _, _ in URL_RULES))}
    WHEN host <> '' AND regexp_full_match({_CLEAN} || chr(10) || CASE path WHEN '' THEN '/' ELSE path END || {_QUERY}, '{_GLOBS}') THEN 'block' ELSE 'allow' END AS verdict
FROM u
"""

_SPLIT = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda w: w <> '')"
_FIVES = "CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END"
ORACLE["op1_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_SPLIT.format("text")} AS ws FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, {_SPLIT.format("text")} AS ws FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT doc_id, unnest({_FIVES}) AS x FROM d WHERE len(ws) > 0),
bs AS (SELECT item_id, {_FIVES} AS s FROM b WHERE len(ws) > 0),
bx AS (SELECT item_id, len(s) AS n_item, unnest(s) AS x FROM bs)
SELECT doc_id, item_id, CAST(n_item AS BIGINT) AS n_item, CAST(count(*) AS BIGINT) AS n_common
FROM ds JOIN bx USING (x) GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 80 * n_item
"""

ORACLE["op8_warc"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), m AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM m
"""
