"""Connected components of a graph given by its edges, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from correctionlab.plans.sizing import cut_lineage


def stars(edges: DataFrame) -> DataFrame:
    """From edges (a, b) to (node, root): every node that has an edge, with the smallest node of its component.

    Large stars and small stars take turns until nothing changes: each node links its larger neighbours, then its smaller
    ones, to the smallest it knows. Only minima are gathered, so a node with any number of neighbours is one row
    after the map side; edges of a star are joined to that row and never to each other. Rounds are written down.
    """
    now = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("node").alias("u"), F.col("root").alias("v")).union(now.select(F.col("root").alias("u"), F.col("node").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("node"), F.col("m").alias("root")).distinct()
        lower = large.groupBy("node").agg(F.min("root").alias("m"))
        small = large.join(lower, "node").select(F.explode(F.array(F.struct(F.col("node"), F.col("m").alias("root")), F.struct(F.col("root").alias("node"), F.col("m").alias("root")))).alias("e"))
        now = cut_lineage(small.select("e.*").where("node <> root").distinct(), "edges")
        if (after := _mark(now)) == mark:
            break
        mark = after
    roots = now.select(F.col("root").alias("node"), "root").distinct()
    return now.union(roots)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "root")), F.sum(F.xxhash64("root", "node").cast("decimal(38,0)"))).first())
