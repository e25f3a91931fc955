"""Manifest, queue and usage tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T

DELETE_PRIORITY = 1e18


def _key(path: Column) -> Column:
    return F.lower(F.regexp_replace(path, r"\\", "/"))


def under(path: Column, roots: list[str]) -> Column:
    """The path lies below one of the folders, whatever the case and slashes."""
    low = _key(path)
    return reduce(lambda a, b: a | b, (low.startswith(r.lower().replace("\\", "/").rstrip("/") + "/") for r in roots), F.lit(False))


def manifest_diff(disk: DataFrame, manifest: DataFrame, *, scanned: list[str] | None = None, roots: list[str] | None = None) -> DataFrame:
    """(path, op, priority): new or changed files are upserted, newest first; files gone are deleted before all.

    Both have (path, mtime, size); paths meet whatever their case and slashes. Unchanged files give no row. With
    ``scanned`` folders only files below them can be gone. A full scan, without ``scanned``, also deletes what lies below
    none of ``roots``.
    """
    key = lambda d, p: d.select(_key(F.col("path")).alias("key"), F.col("path").alias(f"{p}_path"), F.col("mtime").alias(f"{p}_mtime"), F.col("size").alias(f"{p}_size"))
    both = key(disk, "d").join(key(manifest, "m"), "key", "full_outer")
    gone = F.col("d_path").isNull() & (under(F.col("m_path"), scanned) if scanned is not None else F.lit(True))
    orphan = ~under(F.col("m_path"), roots) & F.col("m_path").isNotNull() if scanned is None and roots is not None else F.lit(False)
    changed = F.col("d_path").isNotNull() & (F.col("m_path").isNull() | (F.col("d_mtime") != F.col("m_mtime")) | (F.col("d_size") != F.col("m_size")))
    op = F.when(gone | orphan, "delete").when(changed, "upsert")
    path = F.when(op == "delete", F.col("m_path")).otherwise(F.coalesce("d_path", "m_path"))
    return both.select(path.alias("path"), op.alias("op"), F.when(op == "delete", DELETE_PRIORITY).otherwise(F.col("d_mtime").cast("double")).alias("priority")).where("op IS NOT NULL")


def canonical(paths: DataFrame, manifest: DataFrame) -> DataFrame:
    """``paths`` (path) with ``known``: the spelling that the manifest has of it, else its own."""
    stored = manifest.select(_key(F.col("path")).alias("__key"), F.col("path").alias("__stored")).groupBy("__key").agg(F.max("__stored").alias("__stored"))
    return paths.withColumn("__key", _key(F.col("path"))).join(stored, "__key", "left").withColumn("known", F.coalesce("__stored", "path")).drop("__key", "__stored")


def with_indexed_at(results: DataFrame, manifest: DataFrame) -> DataFrame:
    """``results`` (path) with ``indexed_at`` of the manifest, 0 for files that it hasn't."""
    at = manifest.select(_key(F.col("path")).alias("__key"), "indexed_at").groupBy("__key").agg(F.max("indexed_at").alias("indexed_at"))
    return results.withColumn("__key", _key(F.col("path"))).join(at, "__key", "left").withColumn("indexed_at", F.coalesce("indexed_at", F.lit(0.0))).drop("__key")


def listing(manifest: DataFrame, text: str = "", *, failed: bool | None = None, limit: int = 200) -> DataFrame:
    """The newest ``limit`` files of the manifest (path, content_hash, indexed_at) whose path holds ``text``; ``failed`` ones are those with that hash."""
    kept = manifest.where(F.contains(F.lower("path"), F.lit(text.lower()))) if text else manifest
    if failed is not None:
        kept = kept.where((F.col("content_hash") == "failed") == failed)
    return kept.orderBy(F.desc("indexed_at"), "path").limit(limit)


def health(files: DataFrame, chunks: DataFrame, documents: DataFrame, queue: DataFrame, now: float) -> DataFrame:
    """One row of counts: files, failed, chunks, documents, due, waiting."""
    counted = [
        files.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("content_hash") == "failed").alias("failed")), chunks.agg(F.count(F.lit(1)).alias("chunks")), documents.agg(F.count(F.lit(1)).alias("documents")),
        queue.agg(F.count_if(F.col("not_before") <= now).alias("due"), F.count(F.lit(1)).alias("waiting")),
    ]
    return reduce(lambda a, b: a.join(F.broadcast(b)), counted)  # each has one row


def change_kind(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, action): skip if time and size are equal, else touch if the hash is, else index."""
    both = found.alias("f").join(manifest.alias("m"), "path", "left")
    same = F.coalesce((F.col("f.mtime") == F.col("m.mtime")) & (F.col("f.size") == F.col("m.size")), F.lit(False))
    return both.select("path", F.when(same, "skip").when(F.coalesce(F.col("f.hash") == F.col("m.hash"), F.lit(False)), "touch").otherwise("index").alias("action"))


def collapse_case(rows: DataFrame) -> DataFrame:
    """The newest spelling of each path (path, indexed_at); of equals the last in order of its characters."""
    return _spellings(rows).where("nth = 1").drop("nth")


def dropped_spellings(rows: DataFrame) -> DataFrame:
    """(path, kept): the spellings that ``collapse_case`` drops, so that what was stored under them can be deleted."""
    kept = F.first("path").over(Window.partitionBy(_key(F.col("path"))).orderBy(F.desc("indexed_at"), F.desc("path")))
    return _spellings(rows.withColumn("kept", kept)).where("nth > 1").select("path", "kept")


def _spellings(rows: DataFrame) -> DataFrame:
    last = Window.partitionBy(_key(F.col("path"))).orderBy(F.desc("indexed_at"), F.desc("path"))
    return rows.withColumn("nth", F.row_number().over(last))


def newest_by(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("nth = 1").drop("nth")


def recent(rows: DataFrame, at: str, n: int) -> DataFrame:
    """The newest ``n`` sessions or searches."""
    return rows.orderBy(F.desc(at)).limit(n)


def claim(queue: DataFrame, now: float, n: int, most: int = 3) -> DataFrame:
    """The next ``n`` due items with attempts left: by priority, then by arrival."""
    return queue.where((F.col("attempts") < most) & (F.col("not_before") <= now)).orderBy(F.desc("priority"), "seq").limit(n)


def usage_totals(usage: DataFrame) -> DataFrame:
    return usage.groupBy("provider", "model").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"))


def within_budget(spend: DataFrame, key: str, order: list[str], amount: str, budget: float, *, reserved: str | None = None) -> DataFrame:
    """``allowed``: whether a row's amount and all earlier ones of its key, and what it holds ``reserved`` besides, stay within the budget."""
    so_far = F.sum(amount).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return spend.withColumn("allowed", F.round(so_far + (F.coalesce(F.col(reserved), F.lit(0)) if reserved else 0), 2) <= budget)


def spent_since(usage: DataFrame, since: Column, provider: str | None = None) -> DataFrame:
    """One row (cost_usd): what was spent from a time on, 0 without a row."""
    rows = usage.where(F.col("at") >= since)
    return (rows.where(F.col("provider") == provider) if provider else rows).agg(F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 4).alias("cost_usd"))


def with_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """``usage`` (model, prompt_tokens, completion_tokens) with ``cost_usd`` by ``prices`` (model, price_in, price_out) per million tokens, a small table.

    Few models have all the rows, so the prices travel to the rows.
    """
    named = lambda d: d.withColumn("__model", T.model_name(F.col("model")))
    priced = named(usage).join(F.broadcast(named(prices).select("__model", "price_in", "price_out")), "__model", "left")
    return priced.withColumn("cost_usd", T.cost(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("price_in"), F.col("price_out"))).drop("__model", "price_in", "price_out")


def set_values(store: DataFrame, changes: DataFrame) -> DataFrame:
    """A key/value table (key, value) after ``changes`` (key, value): a null value deletes its key."""
    return store.join(changes.select("key"), "key", "left_anti").unionByName(changes.where("value IS NOT NULL"))


def after_failure(queue: DataFrame, failed: DataFrame, now: float, *, wait: float = 300, most: int = 3) -> DataFrame:
    """``queue`` (path, op, seq, attempts, not_before) after ``failed`` (path, seq) tries: one more attempt and a pause; after ``most`` the row goes."""
    hit = failed.select("path", "seq").distinct().withColumn("__hit", F.lit(True))
    tried = queue.join(hit, ["path", "seq"], "left")
    again = F.coalesce("__hit", F.lit(False))
    moved = tried.withColumn("attempts", F.col("attempts") + again.cast("int")).withColumn("not_before", F.when(again, now + wait).otherwise(F.col("not_before")))
    return moved.where(F.col("attempts") < most).select(*queue.columns)


def deferred(queue: DataFrame, paths: DataFrame, until: float) -> DataFrame:
    """``queue`` with the given paths put off without an attempt counted, as while a provider is out."""
    put = paths.select("path").distinct().withColumn("__put", F.lit(True))
    return queue.join(put, "path", "left").withColumn("not_before", F.when(F.col("__put"), F.greatest("not_before", F.lit(until))).otherwise(F.col("not_before"))).select(*queue.columns)


def keep_last(rows: DataFrame, key: str, order: list, n: int) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("nth") <= n).drop("nth")


def trim_history(messages: DataFrame, key: str, order: str, cost: str, budget: int) -> DataFrame:
    """The newest messages of each conversation that fit the budget; the newest one always stays."""
    back = Window.partitionBy(key).orderBy(F.desc(order))
    used = F.sum(cost).over(back.rowsBetween(Window.unboundedPreceding, 0))
    return messages.withColumn("used", used).withColumn("nth", F.row_number().over(back)).where((F.col("used") <= budget) | (F.col("nth") == 1)).drop("nth")


def debounce(events: DataFrame, gap: str = "30 seconds") -> DataFrame:
    """(path, started, ended, events): one row for each burst of changes with pauses under ``gap``."""
    burst = F.session_window("ts", gap)
    return events.groupBy("path", burst.alias("w")).agg(F.count(F.lit(1)).alias("events")).select("path", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def rate_limit(events: DataFrame, per_second: int = 400) -> DataFrame:
    """(second, events, dropped): what lies over the limit in each second is dropped and calls for a full diff."""
    return events.groupBy(F.date_trunc("second", "ts").alias("second")).agg(F.count(F.lit(1)).alias("events")).withColumn("dropped", F.greatest(F.col("events") - per_second, F.lit(0)))
