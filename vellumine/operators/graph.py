"""Similarity joins over 64-bit hashes, connected components, cluster facts, bursts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumine.functions.numbers import seconds_between
from vellumine.functions.vectors import HASH_BITS, hamming, hash_likeness


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a local one only where none is named and all runs on one machine."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or (current.get() if current.isDefined() else None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return named or "file:///tmp/vellumine-checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all machines see."""
    return f"{checkpoint_root(spark).rstrip('/')}/vellumine-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, kept in the shared folder; later plans start from them."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(checkpoint_root(df.sparkSession))
    return df.checkpoint(eager=True)


def bands(code: Column, radius: int) -> Column:
    """The code cut into radius + 1 runs of bits, each with its number; codes within the radius share one of them."""
    n = min(radius + 1, HASH_BITS)
    edges = [round(i * HASH_BITS / n) for i in range(n + 1)]
    cut = [F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(code, a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1)).alias("bits")) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
    return F.explode(F.array(*cut))


def hamming_pairs(df: DataFrame, key: str, code: str, radius: int) -> DataFrame:
    """(a, b, distance) with a < b for all pairs of distinct keys within the radius: an equi-join on bands, then the exact distance.

    Each pair is made once, at the first band that it shares, so that no duplicates are shuffled away.
    Wide radii leave few bits in a band and so long lists; those over a sixth of the bits are refused.
    """
    if not 0 <= radius <= HASH_BITS // 6:
        raise ValueError(f"the radius must be from 0 to {HASH_BITS // 6}")
    side = df.where(F.col(code).isNotNull()).select(F.col(key).alias("k"), F.col(code).alias("c")).select("k", "c", bands(F.col("c"), radius).alias("x")).select("k", "c", "x.band", "x.bits")
    a, b = side.select(F.col("k").alias("a"), F.col("c").alias("ca"), "band", "bits"), side.select(F.col("k").alias("b"), F.col("c").alias("cb"), "band", "bits")
    n = min(radius + 1, HASH_BITS)
    edges = [round(i * HASH_BITS / n) for i in range(n + 1)]
    differ = F.col("ca").bitwiseXOR(F.col("cb"))
    first = F.lit(None).cast("int")
    for i in reversed(range(n)):
        width = edges[i + 1] - edges[i]
        same = F.shiftrightunsigned(differ, edges[i]).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1)) == 0
        first = F.when(same, i).otherwise(first)
    met = a.join(b, ["band", "bits"]).where((F.col("a") < F.col("b")) & (hamming(F.col("ca"), F.col("cb")) <= radius) & (first == F.col("band")))
    return met.select("a", "b", hamming(F.col("ca"), F.col("cb")).alias("distance"))


def components(edges: DataFrame) -> DataFrame:
    """(v, root): the least vertex that each vertex of the (a, b) edges is connected with.

    Labels spread along edges and are then followed to their own label, which halves what is left each round.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    while True:
        labels = checkpointed(labels)
        near = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("root").alias("near"))
        spread = labels.join(near, labels.v == near.a).select("v", "root", F.least("root", "near").alias("to"))
        jump = labels.select(F.col("v").alias("to"), F.col("root").alias("further"))
        moved = spread.join(jump, "to", "left").select("v", F.col("root").alias("old"), F.least("to", F.coalesce("further", "to")).alias("root"))
        moved = checkpointed(moved)
        labels = moved.select("v", "root")
        if moved.where("old <> root").isEmpty():
            return labels


def scene_clusters(df: DataFrame, key: str, code: str, quality: str, shot: str, radius: int = 8, window_seconds: float = 120.0) -> DataFrame:
    """(key, cluster_id, cluster_size, is_best, similarity, margin) of every row.

    Rows within the radius are linked unless both are dated and further apart than the window; links chain.
    The winner has the best quality, then the largest key, and names the cluster. Unlinked rows stand alone.
    """
    at = df.select(F.col(key).alias("k"), F.col(shot).alias("shot"))
    pairs = hamming_pairs(df, key, code, radius).join(at.select(F.col("k").alias("a"), F.col("shot").alias("sa")), "a").join(at.select(F.col("k").alias("b"), F.col("shot").alias("sb")), "b")
    far = F.coalesce(seconds_between(F.col("sa"), F.col("sb")) > window_seconds, F.lit(False))
    roots = components(pairs.where(~far).select("a", "b"))
    member = df.select(F.col(key).alias("v"), F.col(code).alias("code"), F.col(quality).alias("q")).join(roots, "v")
    best = member.groupBy("root").agg(F.max_by(F.struct("v", "code", "q"), F.struct("q", "v")).alias("w"), F.count("*").alias("size"))
    facts = member.join(best, "root").select("v", F.col("w.v").alias("cluster_id"), F.col("size").alias("cluster_size"), (F.col("w.v") == F.col("v")).alias("is_best"), hash_likeness(F.col("code"), F.col("w.code")).alias("similarity"), F.bround(F.col("w.q") - F.col("q"), 2).alias("margin"))
    out = df.select(F.col(key).alias("v")).join(facts, "v", "left")
    return out.select(
        F.col("v").alias(key), F.coalesce("cluster_id", "v").alias("cluster_id"), F.coalesce("cluster_size", F.lit(1)).cast("long").alias("cluster_size"), F.coalesce("is_best", F.lit(True)).alias("is_best"),
        F.coalesce(F.when(F.col("is_best"), 0.0).otherwise(F.col("similarity")), F.lit(0.0)).alias("similarity"), F.coalesce("margin", F.lit(0.0)).alias("margin"),
    )


def bursts(df: DataFrame, stream: str, shot: str, key: str, code: str, gap_seconds: float = 3.0, radius: int = 8) -> DataFrame:
    """The rows with `burst`, a number within the stream: consecutive ones share it within gap and radius of the one before.

    Ranges of (stream, shot, key) are looked at apart; each is told the last row of its stream before it and how many bursts began there, so that a long stream is spread over tasks.
    """
    order = [F.col(stream), F.col(shot), F.col(key)]
    ranged = checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))  # so that ranges are cut once
    own = Window.partitionBy("_part", stream).orderBy(shot, key)
    along = Window.partitionBy("_stream").orderBy("_at")  # a row for each range that a stream reaches into
    ends = ranged.groupBy(F.col("_part").alias("_at"), F.col(stream).alias("_stream")).agg(F.max(F.struct(F.col(shot).alias("shot"), F.col(key).alias("key"), F.col(code).alias("code"))).alias("_last"))
    ends = ends.select("_at", "_stream", F.lag("_last").over(along).alias("_before"))
    here = (F.col("_part") == F.col("_at")) & F.col(stream).eqNullSafe(F.col("_stream"))
    told = ranged.join(ends, here).drop("_at", "_stream").withColumn("_nth", F.row_number().over(own))
    before_at = F.when(F.col("_nth") == 1, F.col("_before.shot")).otherwise(F.lag(shot).over(own))
    before_code = F.when(F.col("_nth") == 1, F.col("_before.code")).otherwise(F.lag(code).over(own))
    same = F.coalesce((seconds_between(F.col(shot), before_at) <= gap_seconds) & (hamming(F.col(code), before_code) <= radius), F.lit(False))
    flagged = checkpointed(told.withColumn("_new", F.when(same, 0).otherwise(1)).drop("_before", "_nth"))
    begun = flagged.groupBy(F.col("_part").alias("_at"), F.col(stream).alias("_stream")).agg(F.sum("_new").alias("_n"))
    begun = begun.select("_at", "_stream", F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    return flagged.join(begun, here).withColumn("burst", (F.col("_earlier") + F.sum("_new").over(own)).cast("long")).drop("_at", "_stream", "_part", "_new", "_earlier")
