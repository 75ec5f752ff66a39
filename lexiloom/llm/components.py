"""Connected components by alternating large and small stars.

Every round is two aggregations and two joins on the edge list, cut by a
checkpoint, until the edges are stars around their least nodes.  Aggregations
combine map-side and the joins are plain sort-merge joins, so a node with a
third of all edges is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpoint


def _unfinished(edges: DataFrame) -> bool:
    """Whether some node has two parents, or a parent that is a child itself."""
    ends = F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("c"), F.lit(0).alias("p")), F.struct(F.col("v").alias("n"), F.lit(0).alias("c"), F.lit(1).alias("p")))
    nodes = edges.where("u != v").select(F.explode(ends).alias("e")).groupBy("e.n").agg(F.sum("e.c").alias("c"), F.max("e.p").alias("p"))
    return not nodes.where("c > 1 or c > 0 and p > 0").isEmpty()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for every node of an edge; root is the component's least node.

    Works on any orderable type.  Self-loops give a component of one node;
    edges with a null end are left out.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    e = checkpoint(pairs.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") >= F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        e = checkpoint(large)
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("p"))
        e = checkpoint(small.select("p.*").where("u != v").unionByName(e.where("u = v")).distinct())
        if not _unfinished(e):
            break
    roots = e.where("u != v").select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
