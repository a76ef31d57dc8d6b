"""Connected components of an edge table, by large-star and small-star rounds.

Each round hangs every node under the smallest node it knows of, in
O(log^2 n) rounds at worst and two or three for the star-shaped edges made
here. Nothing is collected: a node's smallest neighbour is a partial
aggregate, and a hub's edges are joined to one row. These rows are dealt out by
another key in between: the join then reads exchanges on both sides, and adaptive
execution may split a hub's edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .cluster import cut


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node of its component.

    Loops and repeated edges are fine; rows with a null end are dropped; no edges give no rows.
    """
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = cut(e)
    mark = _mark(e)
    while True:  # until a round changes nothing, however many it takes
        least = e.union(e.select("v", "u")).groupBy("u").agg(F.min("v").alias("m")).repartition(F.xxhash64("u"))
        large = e.join(least.select(F.col("u").alias("v"), F.least("u", "m").alias("m")), "v").select("u", F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m")).repartition(F.xxhash64("u"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = cut(small.select("e.u", "e.v").filter("u <> v").distinct())
        now = _mark(new)
        e = new
        if now == mark:
            break
        mark = now
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))
