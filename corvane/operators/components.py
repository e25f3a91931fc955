"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component): the smallest id that each end of ``edges`` (a, b: one type that orders) reaches.

    Every round takes the least label among a node and its neighbours, then
    follows labels once, so rounds grow with the logarithm of a path's length.
    Rounds are written to the shared folder; nothing is collected but a count.
    Null ends are dropped, an empty edge table gives an empty result.
    """
    both = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = scratch.save(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))), f"{name}-edges")
    labels = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component"))
    labels, step = scratch.save(labels, f"{name}-0"), 0
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        moved = scratch.save(labels.join(near, "id").select("id", F.least("component", "near").alias("component"), F.col("component").alias("was")), f"{name}-{step}-near")
        jump = moved.select(F.col("id").alias("at"), F.col("component").alias("to"))
        # a label is always the id of a node of the same component, so the join keeps every row
        new = moved.join(jump, moved["component"] == jump["at"]).select("id", F.least("component", "to").alias("component"), "was")
        new = scratch.save(new, f"{name}-{step + 1}")
        changed = new.where("component < was").limit(1).count()
        scratch.drop(f"{name}-{step}-near", f"{name}-{step}")
        labels, step = new.select("id", "component"), step + 1
        if not changed:
            scratch.drop(f"{name}-edges")
            return labels


def merged_components(labels: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``labels`` (id, component) after more ``links`` (a, b): only the components that a link joins are worked on.

    Ends that have no label yet get one.
    """
    named = links.join(labels.toDF("a", "ca"), "a", "left").join(labels.toDF("b", "cb"), "b", "left")
    named = scratch.save(named.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")), f"{name}-links")
    moved = connected_components(named.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), scratch, f"{name}-of").toDF("component", "to")
    ends = named.select(F.col("a").alias("id"), F.col("ca").alias("component")).union(named.select("b", "cb"))
    every = labels.union(ends.join(labels, "id", "left_anti")).distinct()
    out = scratch.save(every.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component")), name)
    scratch.drop(f"{name}-links")
    return out
