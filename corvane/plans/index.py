"""The write path: changed files to chunks, vectors reused, tables replaced by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..operators import chunking, privacy, scope
from ..operators.state import keep_last
from ..providers import hashed
from ..settings import CHUNKING, Chunking
from ..sources.sinks import replace_rows


def finalised(chunks: DataFrame, key: str = "doc_id", order: str = "n", text: str = "text", *, most_chars: int = CHUNKING.stored_chars, most_chunks: int = 300) -> DataFrame:
    """Extracted ``chunks`` as they are kept: trimmed, blank ones dropped, texts cut, the first ``most_chunks`` of each file."""
    tidy = chunks.withColumn(text, F.substring(F.regexp_replace(text, r"^\s+|\s+$", ""), 1, most_chars)).where(F.col(text) != "")
    return keep_last(tidy, key, [F.asc(order)], most_chunks)


def accepted(files: DataFrame, most_bytes: int = 512 * 1024) -> DataFrame:
    """``files`` (size, text, kind, ext) without large data files and machine-written code."""
    data = F.col("ext").isin(".json", ".csv", ".tsv", ".xml", ".yaml", ".yml", ".sql") & (F.col("size") > most_bytes)
    return files.where(~data & ~((F.col("kind") == "code") & T.looks_generated(F.col("text"))))


def embed_text(path: Column, symbol: Column, text: Column) -> Column:
    """What an embedder sees of a chunk: where it stands, then its text."""
    return F.concat(path, F.when(symbol != "", F.concat(F.lit(" > "), symbol)).otherwise(""), F.lit("\n"), text)


def chunk_rows(files: DataFrame, markdown: bool = False, cfg: Chunking = CHUNKING) -> DataFrame:
    """Chunks of ``files`` (doc_id, path, project, kind, mtime, text): credentials stripped, equal chunks of a file once.

    Notes of AI tools are of the kind ai-note; a chunk that says hardly anything counts no characters, so it is found by its words alone.
    """
    parts = finalised(chunking.chunk(files, markdown=markdown, cfg=cfg), most_chars=1 << 30)
    named = parts.join(files.drop("text"), "doc_id").withColumn("body", privacy.strip_credentials(F.col("text")))
    source = scope.ai_note_source(F.col("path"))
    where = F.concat_ws(" > ", "project", "path", F.nullif(F.col("heading"), F.lit("")))
    kind = F.when(source.isNotNull(), "ai-note").otherwise(F.col("kind"))
    chars = F.when(T.low_content(F.col("body")), 0).otherwise(T.content_chars(F.col("body")))
    rows = named.select(
        "path", "project", kind.alias("kind"), F.coalesce(source, F.lit("")).alias("source"), "mtime", F.col("heading").alias("symbol"), "n", "start_line", "end_line", T.content_hash(kind, F.col("heading"), F.col("body")).alias("chunk_hash"),
        F.substring(F.concat(where, F.lit("\n"), "body"), 1, CHUNKING.stored_chars).alias("text"), embed_text(F.col("path"), F.col("heading"), F.col("body")).alias("embed_text"), chars.alias("content_chars"), T.file_name(F.col("path")).alias("name"), T.search_text(F.col("path"), F.col("body")).alias("search_text"),
    )
    # the first of equal chunks in a file
    first = rows.groupBy("path", "chunk_hash").agg(F.min("n").alias("n"))
    return rows.join(first, ["path", "chunk_hash", "n"])


def with_vectors(rows: DataFrame, stored: DataFrame, embed: Callable[[Column], Column] = hashed) -> DataFrame:
    """``rows`` with ``vector``: that of ``stored`` (chunk_hash, vector) if its content is known, else embedded once for each new content."""
    known = stored.select("chunk_hash", "vector").dropDuplicates(["chunk_hash"])
    new = rows.join(known, "chunk_hash", "left_anti").groupBy("chunk_hash").agg(F.min("search_text").alias("t")).select("chunk_hash", embed(F.col("t")).alias("vector"))
    return rows.join(known.unionByName(new), "chunk_hash")


def document_vectors(chunks: DataFrame) -> DataFrame:
    """(path, doc_vector): the mean of a file's chunk vectors at unit length, place by place."""
    each = chunks.select("path", F.posexplode("vector").alias("i", "x"))
    mean = each.groupBy("path", "i").agg(F.avg("x").alias("x")).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    return mean.select("path", F.transform("v", lambda p: p["x"]).alias("m")).select("path", T.truncate_normalise(F.col("m"), 1 << 20).alias("doc_vector"))


def index_batch(target: DataFrame, files: DataFrame, embed: Callable[[Column], Column] = hashed) -> DataFrame:
    """``target`` with the chunks of ``files`` in place of those files' old ones; running it twice changes nothing."""
    new = with_vectors(chunk_rows(files), target, embed)
    return replace_rows(target, new.select(*target.columns), "path")


def indexed(manifest: DataFrame, files: DataFrame, failed: DataFrame | None = None, *, now: float) -> DataFrame:
    """The manifest (path, mtime, size, content_hash, indexed_at) after ``files`` (path, mtime, size, text) were indexed; ``failed`` ones (path) are kept with that hash, so that only a change brings them back."""
    hashed_ = F.md5(F.coalesce("text", F.lit("")))
    if failed is not None:
        files = files.join(failed.select("path").distinct().withColumn("__failed", F.lit(True)), "path", "left")
        hashed_ = F.when(F.col("__failed"), "failed").otherwise(hashed_)
    new = files.select("path", "mtime", "size", hashed_.alias("content_hash"), F.lit(now).alias("indexed_at"))
    return replace_rows(manifest, new.select(*manifest.columns), "path")


def whole_documents(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(path, text, refused): each document's stored text, else its chunks that are no outline, in order; secrets and files out of scope are refused.

    ``documents`` has (path, full_text), ``chunks`` (path, n, kind, text) with a header line in each text.
    """
    row = F.sort_array(F.collect_list(F.struct("n", T.body(F.col("text")).alias("t"))))
    joined = chunks.where("kind <> 'outline'").groupBy("path").agg(row.alias("rows")).select("path", F.array_join(F.transform("rows", lambda r: r["t"]), "\n").alias("__chunks"))
    both = documents.select("path", "full_text").join(joined, "path", "left")
    refused = scope.is_secret(F.col("path")) | ~scope.path_allowed(F.col("path"))
    return both.select("path", F.when(~refused, F.coalesce(F.nullif("full_text", F.lit("")), "__chunks", F.lit(""))).alias("text"), refused.alias("refused"))
