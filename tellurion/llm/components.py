"""Connected components of an edge table, by alternating large-star and small-star rounds.

No node's neighbours ever meet in one task: each round is an aggregate (minimum neighbour, combined before the
shuffle) and an equi-join that adaptive execution may split where a hub is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over ``edges`` (u > v, distinct)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if large:  # larger neighbours move to the smallest neighbour
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # smaller neighbours, and the node itself, move to the smallest one
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u long, v long): component is the smallest node reachable.

    Null ends and loops are ignored; an empty edge table gives an empty result. Rounds are logarithmic in the longest
    path; each round's edges are written to the checkpoint folder, so that the plan doesn't grow.
    """
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if state == seen or not state[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        seen = state
        e = cut(_star(_star(e, large=True), large=False))
