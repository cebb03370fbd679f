"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.session import cut


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of the links ``a, b``; a component is named by its least node.

    Each round every node takes the least name among its neighbours, and then
    the name that the node of that name has; the distance covered doubles. A
    round is written out before the next reads it.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    names = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(names.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = names.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("name"))
        of_name = names.select(F.col("node").alias("name"), F.col("component").alias("further"))
        after = cut(lower.join(of_name, "name").select("node", "old", F.least("name", "further").alias("component")))
        names = after.select("node", "component")
        if after.where("component <> old").isEmpty():
            return names
