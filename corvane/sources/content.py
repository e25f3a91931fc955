"""Content sources: where files come from, which paths are theirs, and what is still to be indexed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import scope
from ..operators.state import under
from ..registry import SOURCES
from . import files, listing


@dataclass(frozen=True)
class ContentSource:
    """``files`` gives (path, size, mtime, text, ..) below ``roots``; ``valid`` says of a path and size whether it is indexed."""

    name: str
    roots: list[str]
    files: Callable[[SparkSession], DataFrame]
    valid: Callable[[Column, Column], Column] = field(default=lambda path, size: scope.reject_reason(path, size).isNull())

    def owns(self, path: Column) -> Column:
        return under(path, self.roots)

    def still_valid(self, path: Column, size: Column) -> Column:
        return self.owns(path) & self.valid(path, size)


@SOURCES.register("folders")
def folders(roots: list[str], glob: str = "*", rules: DataFrame | None = None) -> ContentSource:
    """Files below folders, those in scope, named like ``glob`` and not ignored by ignore files or ``rules`` (of ``scope.ignore_rules``).

    The walk opens no excluded folder and only the files that it keeps are read, each once.
    """

    def read(spark: SparkSession) -> DataFrame:
        found = listing.walk(spark, roots, rules=rules).files
        named = found if glob == "*" else found.where(F.rlike(T.file_name(F.col("path")), F.lit(scope.glob_to_regex(glob.lower()))))
        return files.read_paths(named)

    return ContentSource("folders", roots, read)
