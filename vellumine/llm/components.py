"""Connected components of an edge table by alternating large-star and small-star steps.

Every step groups edges by a vertex with map-side minima and joins those back; the table never grows
beyond its edges. Each round is cut off by a checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex's larger neighbours are tied to the least of it and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex and its smaller neighbours are tied to the least of these; edges point from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, root): every vertex that has an edge, and the least vertex it is connected with.

    Loops and repeated edges are harmless; edges with a null end are left out; no edges, no rows.
    """
    now = checkpointed(edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())

    before = mark(now)
    while before[0]:
        now = checkpointed(_small_star(_large_star(now)))
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("v"), F.col("b").alias("root")).union(now.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())
