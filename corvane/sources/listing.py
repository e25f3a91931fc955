"""A pruned walk: the folders of one level are listed on executors, rules say which of those found are opened next."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import scope
from ..scratch import Scratch

IGNORE_FILES = (".gitignore",)
#: kind is folder, file or link; of the opened folder itself it is opened or unreadable. text is an ignore file's.
ENTRIES = "root string, path string, kind string, size long, mtime timestamp, text string"
#: Entries that a task hands on together, so that a folder of millions of files is not held as one table.
TOGETHER = 8192


@dataclass(frozen=True)
class Walk:
    """``files`` (path, size, mtime) in scope, each once; ``opened`` (path, readable): every folder that was listed."""

    files: DataFrame
    opened: DataFrame


def local(root: str) -> str:
    """A root without a trailing slash, a local one as a plain path."""
    return re.sub(r"(?<=.)/+$", "", re.sub("^file:/*", "/", root))


def _entries(folder: str, ignore: tuple[str, ...]) -> Iterator[tuple[str, str, int, int | None, str | None]]:
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(folder)
    before = folder[: len(folder) - len(path)] if folder.endswith(path) else ""
    on_disk = where.type_name == "local"
    for info in where.get_file_info(fs.FileSelector(path, recursive=False)):
        text = None
        if on_disk and os.path.islink(info.path):
            kind = "link"  # it may lead back to a folder above
        elif info.type == fs.FileType.Directory:
            kind = "folder"
        elif info.type == fs.FileType.File:
            kind = "file"
            if info.base_name in ignore:
                with where.open_input_stream(info.path) as stream:
                    text = stream.read().decode("utf-8", "replace")
        else:
            continue
        yield before + info.path, kind, info.size if kind == "file" else 0, info.mtime_ns // 1000 if info.mtime_ns else None, text


def _list(ignore: tuple[str, ...]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    columns = ["root", "path", "kind", "size", "mtime", "text"]

    def table(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=columns)
        out["mtime"] = pd.to_datetime(out["mtime"].astype("Int64"), unit="us", utc=True).dt.round("us")
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for root, folder in zip(batch["root"], batch["path"], strict=True):
                state = "opened"
                try:
                    for entry in _entries(folder, ignore):
                        rows.append((root, *entry))
                        if len(rows) >= TOGETHER:
                            yield table(rows)
                            rows = []
                except OSError:  # no right to read it, or it went away since its parent was listed
                    state = "unreadable"
                rows.append((root, folder, state, 0, None, None))
            if rows:
                yield table(rows)

    return run


def walk(
    spark: SparkSession, roots: list[str], *, rules: DataFrame | None = None, ignore: tuple[str, ...] = IGNORE_FILES,
    enter: Callable[[Column], Column] = scope.descend, reject: Callable[[Column, Column, Column], Column] = scope.reject_reason,
) -> Walk:
    """The files below ``roots`` that no rule rejects. A folder that ``enter`` or an ignore rule excludes is never opened.

    One job a level: its folders are dealt over all tasks, what they hold is written to the shared folder, and the
    next level is the folders found there that the rules let through; nothing but a count comes to the driver. Ignore
    files are read while their folder is listed; ``rules`` (of ``scope.ignore_rules``) come on top. What lies below an
    excluded folder can't be taken back in by a later rule. Links are not followed. A folder that can't be listed is in
    ``opened`` as not readable and gives no files. Roots themselves are always opened; a file below two of them
    comes once, if the rules below either let it through. Without a folder the result is empty.
    """
    scratch, level = Scratch(spark, "walk"), 0
    front = spark.createDataFrame([(r, r) for r in dict.fromkeys(map(local, roots))], "root string, path string")
    levels: list[DataFrame] = []
    known = [] if rules is None else [rules.select("dir", "n", "pattern", "negated")]
    while True:
        tasks = spark.sparkContext.defaultParallelism
        found = scratch.save(front.repartition(tasks).mapInPandas(_list(tuple(ignore)), ENTRIES), f"level-{level}")
        levels.append(found)
        known.append(scratch.save(scope.ignore_rules(found.where("text IS NOT NULL").select("path", "text").distinct()), f"rules-{level}"))
        every = reduce(DataFrame.union, known)
        # a folder meets the rules with a slash at its end, which rules for folders ask for
        below = found.where("kind = 'folder'").where(enter(F.col("path"))).select("root", F.concat("path", F.lit("/")).alias("path"))
        front = scratch.save(_not_ignored(below, every).select("root", F.regexp_replace("path", "/$", "").alias("path")), f"front-{level}")
        if front.isEmpty():
            break
        level += 1
    found = reduce(DataFrame.union, levels)
    # rules of a deeper folder fit nothing above it, so all files meet all rules at once
    inside = found.where("kind = 'file'").where(reject(F.col("path"), F.col("size"), F.col("root")).isNull())
    files = scratch.save(_not_ignored(inside, every).select("path", "size", "mtime").dropDuplicates(["path"]), "files")
    seen = found.where("kind IN ('opened', 'unreadable')").groupBy("path").agg(F.bool_and(F.col("kind") == "opened").alias("readable"))
    return Walk(files, scratch.save(seen, "opened"))


def _not_ignored(entries: DataFrame, rules: DataFrame) -> DataFrame:
    said = scope.ignored(entries.select("path").distinct(), rules).where("ignored").select("path")
    return entries.join(said, "path", "left_anti")
