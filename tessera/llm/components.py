"""Connected components of a link table by contraction, entirely in DataFrames.

Each round hooks every node to the smallest label among its neighbours (one
partial aggregation, so a node with very many neighbours is combined before the
shuffle; its neighbours read its label by broadcast) and then follows the hooks; the number of rounds is logarithmic in
practice.  Nothing is collected but one count per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_one


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) links -> (node, label): label is the smallest node of the component.

    Nodes without links do not appear; self links and links with a null end are
    ignored; repeated links do not matter; an empty table gives an empty table.
    Alternates large-star and small-star steps until every edge points at a root.
    """
    edges = (links.where("a is not null and b is not null and a <> b")
             .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    edges = scratch.write(edges, "edges")
    old = edges
    while True:
        total = 2 * edges.count()
        # Large star: every larger neighbour of u moves to the smallest of u and its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("m", "u").alias("m"), "n")
        large = (join_one(both, low, "u", "n", total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .distinct())
        # Small star: u and its smaller neighbours move to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        moved = join_one(large, low, "u", "n", total).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = scratch.write(small, "edges")
        scratch.drop(old)
        old = edges
        # Settled when every child has one parent and no parent is a child: each edge then ends in its root.
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        unsettled = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where(
            "up > 1 or (up > 0 and down > 0)")
        if unsettled.isEmpty():
            break
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
