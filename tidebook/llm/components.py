"""Connected components as DataFrame rounds of large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize


#: Edges in a file of a round, about.
FILE_ROWS = 250_000


def _round(edges: DataFrame) -> DataFrame:
    """edges: distinct ``u > v``."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.join(least, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u")
    hung = small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for each end of ``edges (a, b)``; the component is
    the smallest node reachable.  Edges with a null end or equal ends count for
    nothing.  Rounds end when stars remain.  Each round is written to shared
    storage: lineage stays short, and a lost executor costs one round."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = materialize(edges, "edges"), None
    while True:
        sign = edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).head()
        if sign == before or sign[0] == 0:
            break
        files = 1 + sign[0] // FILE_ROWS
        edges, before = materialize(_round(edges).coalesce(files), "edges"), sign
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
