"""Connected components of an edge list, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm.common import saved


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root (the least node it can reach) for every node of `edges` (u, v, of one orderable type).

    Self loops, repeated and null-ended edges are dropped; an empty list gives an empty result. Each round hooks all neighbours to
    the least one, first the larger ones (large star), then the smaller ones (small star), until only stars are left. Minima are
    combined before the shuffle, so a hub costs no single large task; rounds are checkpointed.
    """
    u, v = F.col("u"), F.col("v")
    now = saved(edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    before, state = None, _state(now)
    while state != before:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(u, F.least(u, F.col("m")).alias("m"))
        large = both.join(least, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).where(u != v).distinct()  # a hub's rows become few before they meet
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(v.alias("u"), F.col("m").alias("v")).where(u != v)
        now = saved(small.union(least.select("u", "m")).distinct())
        before, state = state, _state(now)
    return now.select(u.alias("node"), v.alias("root")).union(now.select(v, v).distinct())
