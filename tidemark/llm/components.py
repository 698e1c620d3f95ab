"""Connected components by contraction, from shuffles that aggregate before they move rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, release


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of `edges` (columns a, b); nodes of one component have the same root.

    Each round maps every node to its least neighbour, itself included, and replaces edges by those between the images. Ids
    should be in random order (digests are): then a constant share of nodes goes in each round, even on a long path. A round
    takes a minimum per node, so a node of any degree costs one row per task.
    """
    edges = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("a").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
        step = materialise(both.groupBy("node").agg(F.min("to").alias("to")), "components")
        maps.append(step)
        left, right = step.select(F.col("node").alias("a"), F.col("to").alias("x")), step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = edges.join(left, "a").join(right, "b")
        before, edges = edges, materialise(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct(), "edges")
        release(before)
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = maps[0].withColumnRenamed("to", "root")
    for step in maps[1:]:
        roots = roots.join(step.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    roots = materialise(roots, "roots")
    release(edges, *maps)
    return roots
