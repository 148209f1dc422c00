"""Connected components of a stored graph, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component`` (the least id reached) of every vertex of the edges ``a, b``.

    Each round hangs every vertex's larger neighbours, then its smaller ones, below the least of them; rounds
    grow with the logarithm of the longest path. A round is two aggregates and two joins on vertices.
    """
    stars = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct())
    state = None
    while True:
        both = stars.union(stars.select(F.col("m").alias("v"), F.col("v").alias("m")))
        large = _hang(both, F.col("m") > F.col("v"))
        stars = cut_lineage(_hang(large, F.lit(True)).distinct())
        now = stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "m")), F.sum(F.xxhash64("m", "v") % 1_000_003)).first()
        if now == state:
            return stars.select(F.col("v").alias("id"), F.col("m").alias("component")).union(
                stars.select(F.col("m").alias("id"), F.col("m").alias("component")).distinct()
            )
        state = now


def _hang(pairs: DataFrame, which) -> DataFrame:
    """Neighbours (those of ``which``) and the vertex itself below the least of the vertex and its neighbours."""
    least = pairs.groupBy("v").agg(F.least(F.min("m"), F.col("v")).alias("least"))
    moved = pairs.filter(which).join(least, "v").select(F.col("m").alias("v"), F.col("least").alias("m"))
    return moved.union(least.select("v", F.col("least").alias("m"))).filter("v > m").distinct()
