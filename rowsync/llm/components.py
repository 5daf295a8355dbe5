"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import skew_lookup, stored


def _least(edges: DataFrame, n: int) -> DataFrame:
    """Each edge (u, v) with ``m``, the least neighbour of u; hubs are looked up by broadcast."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("deg"))
    return skew_lookup(edges, least, ["u"], "deg", max(n, 1), ["m"], F.col("v"))


def checksum(*cols: str) -> Column:
    """64 bits that a set of rows shares whatever its order; exclusive-or can't overflow, however many rows."""
    return F.bit_xor(F.xxhash64(*cols))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u long, v long)`` to ``(u, root)``: the least node of each component, for all nodes but the roots.

    Self-loops, repeated and reversed edges are fine. Each round is written to the shared folder, so lineage stays
    short; rounds grow with the logarithm of the longest path. An empty input gives an empty output.
    """
    turned = F.col("u") < F.col("v")
    e = stored(edges.where("u <> v").select(F.when(turned, F.col("v")).otherwise(F.col("u")).alias("u"), F.when(turned, F.col("u")).otherwise(F.col("v")).alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        n, mark = e.agg(F.count("*"), checksum("u", "v")).first()
        if (n, mark) == before or n == 0:
            return e.select("u", F.col("v").alias("root"))
        before = (n, mark)
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, 2 * n).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        large = stored(large, "edges")
        small = _least(large, n)
        e = stored(small.select(F.col("u"), F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
    raise RuntimeError("components did not settle")
