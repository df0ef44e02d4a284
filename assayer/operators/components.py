"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assayer.session import cut


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node of its component, for every node of the edges (a, b).

    Every root that has a smaller neighbour hooks onto the smallest one; the chains that this gives are shortened by
    doubling; edges are then drawn between roots. This repeats until no edge is left, so nothing bounds the length
    of a chain. A node that is linked to itself alone is its own root.
    """
    loops = edges.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    edges = cut(edges.select("a", "b").where("a <> b").distinct())
    roots = None
    while edges.count():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root")))
        while True:
            # two jumps at a time; the second tells whether any is left
            further = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            once = up.join(further, "root").select("node", F.col("next").alias("root"))
            jumped = cut(once.join(further, "root").select(
                "node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
            up = jumped.drop("moved")
            if not jumped.agg(F.bool_or("moved")).first()[0]:
                break
        if roots is None:
            roots = up
        else:
            # every earlier root that still has edges is among the nodes of this round
            moved = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = cut(roots.join(moved, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        edges = cut(
            edges.join(up.toDF("a", "ra"), "a").join(up.toDF("b", "rb"), "b").where("ra <> rb")
            .select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    if roots is None:
        return loops
    return roots.unionByName(loops.join(roots, "node", "left_anti"))
