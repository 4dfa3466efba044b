"""Connected components of a table of links, by alternating stars (a published map-reduce algorithm)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _shared


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of the links (a, b) reaches. Nodes without links are left out.

    Each turn hangs every node's larger neighbours on its smallest neighbour, then its smaller ones; the number of turns
    grows with the logarithm of the longest chain. Every turn is written to the shared folder.
    """
    flat = links.where("a != b")
    edges = _shared.written(flat.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = down.groupBy("u").agg(F.min("v").alias("m"))
        turned = down.join(small, "u")
        edges = _shared.written(turned.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if now == before:
            break
        before = now
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
