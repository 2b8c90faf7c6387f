"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node hands its neighbours (larger ones, or smaller ones and itself) to the smallest of them all."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    # A table of its own: the join below then deals out both sides itself, and the links of a hub can be split.
    least = materialise(least, "least")
    near = both.join(least, both["u"] == least["w"])
    if large:
        out = near.where(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        own = least.select(F.col("m").alias("a"), F.col("w").alias("b"))
        out = near.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(own)
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of the links ``a, b``: the smallest node of its component.

    Null ends and loops are dropped. Alternating large and small stars take a number of rounds that grows with the logarithm
    of the component sizes; each round is a table in the shared folder, so lost executors cost one round at most. A node
    with very many links is pre-aggregated, and both sides of each join come from tables by exchanges of the join's own, so
    that adaptive execution can split such a node's rows. Nothing is collected but two numbers a round.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    edges = materialise(edges, "links")
    before = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == before or not now[0]:
            break
        before = now
        edges = materialise(_star(_star(edges, True), False), "links")
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
