"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import release, settle


#: Edges in a partition at least: small graphs go to few tasks, whatever the number of shuffle partitions.
FEW = 50_000


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every end of the edges (a, b); root is the smallest id of its component.

    Each step only takes minima per node (partial sums before the shuffle) and joins them back, so a node of very many
    edges is not gathered in one place. Every round is checkpointed; it ends when the edges no longer change. Partitions
    follow the number of edges of the round before.
    """
    e = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        mark = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
        release(edges.sparkSession)
        packed = lambda x: x.coalesce(1 + 2 * mark[0] // FEW)
        both = packed(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = packed(large.distinct())
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(small, "u")
        e = settle(packed(near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()))
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return settle(e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots))
