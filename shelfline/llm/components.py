"""Connected components over an edge table, by alternating star contractions.

Each round replaces a node's larger neighbours' edges by edges to its smallest
neighbour and then does the same for the smaller ones; edges only get shorter,
and the table ends as stars around each component's smallest node.  Rounds are
written to the shared folder; only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.session import stored


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Edges (v, u) with v > u, contracted around every node."""
    if larger:
        both = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        moved = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
    else:
        least = edges.groupBy("v").agg(F.min("u").alias("m"))
        joined = edges.join(least, "v")
        moved = joined.select(F.col("u").alias("v"), F.col("m").alias("u")).union(joined.select("v", F.col("m").alias("u")))
    return moved.where("v > u").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of a link (a, b) that isn't its component's smallest node."""
    edges = stored(
        links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v > u").distinct(), "edges"
    )
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("component"))
        before = now
        edges = stored(_star(_star(edges, True), False), "edges")
