"""Connected components of links between nodes, in DataFrame operations with written tables between the rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of links (a, b) that isn't the least of its component; root is that least node.

    Each round hooks all smaller neighbours of a node to the least of them, then replaces parents by their parents.
    Both tables of each join are written before, so a node with very many neighbours can be split over tasks.
    """
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("near")).distinct(), "edges")
    while True:
        least = materialize(edges.groupBy("node").agg(F.min("near").alias("root"), F.count(F.lit(1)).alias("n")), "least")
        above = least.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = materialize(least.join(above, "root", "left").select("node", "n", F.col("root").alias("low"), F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "jumped")
        release(least)
        if jumped.filter("n > 1 or moved").isEmpty():
            release(edges)
            return jumped.select("node", "root")
        met, old = edges.join(jumped, "node"), edges
        edges = materialize(
            met.select("node", F.col("root").alias("near")).union(met.select(F.col("near").alias("node"), F.col("root").alias("near"))).filter("node <> near")
            .select(F.greatest("node", "near").alias("node"), F.least("node", "near").alias("near")).distinct(),
            "edges",
        )
        release(old, jumped)
