"""Connected components by star contraction, in a number of rounds that grows with the logarithm of a component's width."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sources.checkpoints import checkpointed, forgotten


def _to_least(edges: DataFrame, greater: bool) -> DataFrame:
    """Every node's neighbours joined to the least of the node and its neighbours instead: the greater ones (large star) or those not greater (small star).

    Neighbours are reduced to their least before the shuffle, so a node with very many costs no task more than their rows.
    """
    both = edges.union(edges.select("b", "a")) if greater else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    near = both.join(least, both.a == least.u)
    moved = near.filter("b > u").select(F.col("b").alias("a"), F.col("m").alias("b")) if greater else near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """id and the least id that edges (a, b) reach from it, for every id that has an edge to another."""
    edges = checkpointed(edges.select("a", "b").filter("a <> b").distinct())
    while True:
        # _to_least() reads its input twice, so what it gets is cut from its lineage
        wide = checkpointed(_to_least(edges, True))
        new = checkpointed(_to_least(wide, False))
        forgotten(wide)
        same = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if same == edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first():
            break
        forgotten(edges)
        edges = new
    labels = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels.union(edges.select("b", "b").distinct())
