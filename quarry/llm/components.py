"""Connected components of a link table, by alternating large and small stars.

Each step is a grouped minimum and a join on node ids, so no task holds a
node's whole neighbourhood and nothing is collected; the table is written to
the shared folder after each round, which ends its lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def _star(pairs: DataFrame, lows: DataFrame, own: bool) -> DataFrame:
    """Replace each (u, v) by (v, lowest of u); with ``own`` also (u, lowest of u)."""
    moved = pairs.join(lows, "u").select("v", F.col("low"))
    if own:
        moved = moved.union(lows.select(F.col("u").alias("v"), "low"))
    return moved.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def components(links: DataFrame, folder: str, name: str = "components") -> DataFrame:
    """(node, component) for every node with a link; links has columns a, b.  The component is its smallest node."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = shared.stored(edges, folder, f"{name}-0")
    state, turn = None, 0
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state, turn, n = now, turn + 1, now[0]
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        lows = shared.stored(lows, folder, f"{name}-{turn}-large-low", 2 * n)
        large = shared.stored(_star(both.where("v > u"), lows, own=False), folder, f"{name}-{turn}-large", n)
        lows = shared.stored(large.groupBy("u").agg(F.min("v").alias("low")), folder, f"{name}-{turn}-small-low", n)
        edges = shared.stored(_star(large, lows, own=True), folder, f"{name}-{turn}", 2 * n)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
