"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import discard, materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (or the smaller and own) neighbours of each node on the least node of its neighbourhood.

    The least neighbour is summed up before the shuffle; the join that follows may be split where a node is a hub.
    """
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.where("v > u" if large else "true").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.union(least.select("u", F.col("m").alias("v")))
    return moved.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (u, v): the least node that each reaches.

    Nulls and loops are dropped. Each round is written to the shared folder, and the last but one removed.
    """
    now = materialize(edges.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        new = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("x"), F.coalesce(F.max_by("u", "u"), F.lit(0)).alias("m"))
        seen = now.agg(new.alias("s")).first()["s"]
        if seen == mark:
            break
        mark = seen
        after = materialize(_stars(_stars(now, large=True), large=False), "edges")
        discard(now)
        now = after
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
