"""Connected components of an edge table by alternating large-star and small-star steps,
each written to the shared folder.

An edge is (node, root) with root < node. Large star: each node's root becomes the
smallest root of that root. Small star: a node's roots are linked with the smallest one.
The smallest roots are found by a minimum that combines before the shuffle. They meet the
edges by a broadcast if the edges are few (counted), else by a join that spreads nodes
with very many edges, so no task holds a hub's neighbours.

What a step reads twice is written first, and the end is seen from the edges themselves (no
root is a node, no node has two roots): plans stay small and no round only confirms the last,
since the driver's memory and time go into plans, not rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import spread_join, written

#: Edges whose smallest roots are broadcast (at most 16 MB).
FEW = 500_000


def star(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of type long -> (node, root): every node but the roots, with the
    smallest node of its component. An empty table gives an empty table."""

    def stars(e: DataFrame) -> bool:
        ends = e.select(F.col("node").alias("end"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.unionByName(e.select(F.col("root").alias("end"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("end").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return not ends.agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0]

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("node").agg(F.min("root").alias("low"))

    def meet(e: DataFrame, low: DataFrame, column: str, n: int) -> DataFrame:
        """``e`` with ``low`` of the node in ``column``, null if it has none."""
        low = low.withColumnRenamed("node", column)
        if n <= FEW:
            return e.join(F.broadcast(low), column, "left")
        return spread_join(e, low, [column], e.groupBy(column).agg(F.count(F.lit(1)).alias("size")), by="node" if column == "root" else "root", how="left")

    e = edges.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct()
    e = written(e, "edges", edges.count())
    while not stars(e):
        n = e.count()
        large = written(meet(e, least(e), "root", n).select("node", F.coalesce("low", "root").alias("root")), "edges", n)
        low = written(least(large), "edges", n)
        small = meet(large, low, "node", n).where("root <> low").select(F.col("root").alias("node"), F.col("low").alias("root"))
        e = written(small.unionByName(low.select("node", F.col("low").alias("root"))).distinct(), "edges", n)
    return e
