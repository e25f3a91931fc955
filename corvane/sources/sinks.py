"""Keyed sinks: a table with the rows of some keys replaced, updated or deleted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def replace_rows(target: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``target`` without the keys of ``new``, then ``new``."""
    return target.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def set_groups(target: DataFrame, groups: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` from ``groups`` (key, column), empty for other keys."""
    return target.drop(column).join(groups.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(""))).select(*target.columns)


def delete_under(target: DataFrame, prefixes: list[str], path: str = "path") -> DataFrame:
    """``target`` without a path of ``prefixes`` or below one, whatever the case."""
    low = F.lower(F.col(path))
    hit: Column = reduce(lambda a, b: a | b, ((low == p.lower().rstrip("/")) | low.startswith(p.lower().rstrip("/") + "/") for p in prefixes), F.lit(False))
    return target.where(~hit)
