"""How far scores agree with a person's piles: join, confusion, precision, and a sweep of thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PILES = ["top", "good", "weak"]
TOP, WEAK = 85, 45


def pile(score: Column, top: int | Column = TOP, weak: int | Column = WEAK) -> Column:
    return F.when(score >= top, "top").when(score < weak, "weak").otherwise("good")


def compare(records: DataFrame, labels: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Labels with their records, and labels without one."""
    return labels.join(records, key), labels.join(records, key, "left_anti")


def histogram(pairs: DataFrame) -> DataFrame:
    """(pile, score, n): all that the figures below need, of a size that doesn't follow the rows."""
    return pairs.groupBy("pile", "score").agg(F.count("*").alias("n"))


def confusion(pairs: DataFrame, top: int = TOP, weak: int = WEAK) -> DataFrame:
    """(human, top, good, weak): how the tool files each human pile; piles without rows give zeros."""
    counted = pairs.groupBy(F.col("pile").alias("human")).pivot("tool", PILES).agg(F.sum("n")) if "tool" in pairs.columns else histogram(pairs).withColumn("tool", pile(F.col("score"), top, weak)).groupBy(F.col("pile").alias("human")).pivot("tool", PILES).agg(F.sum("n"))
    order = pairs.sparkSession.createDataFrame([(p,) for p in PILES], "human string")
    return F.broadcast(order).join(counted, "human", "left").select("human", *(F.coalesce(p, F.lit(0)).cast("long").alias(p) for p in PILES))


def sweep(pairs: DataFrame, tops: tuple[int, int] = (50, 99), weak_from: int = 10) -> DataFrame:
    """(top, weak, hits) for every pair of thresholds, from the score histogram, not from the rows."""
    spark = pairs.sparkSession
    grid = spark.range(tops[0], tops[1] + 1).select(F.col("id").alias("top")).select("top", F.explode(F.sequence(F.lit(weak_from).cast("long"), F.col("top") - 1)).alias("weak"))
    counts = histogram(pairs)
    hit = F.sum(F.when(pile(F.col("score"), F.col("top"), F.col("weak")) == F.col("pile"), F.col("n")).otherwise(0))
    # The histogram has at most 3 x 101 rows and the grid some thousand.
    return F.broadcast(counts).crossJoin(grid).groupBy("top", "weak").agg(hit.cast("long").alias("hits"))


def agreement(pairs: DataFrame, top: int = TOP, weak: int = WEAK) -> DataFrame:
    """(n, agreed, top_precision, top_recall, best_hits, best_top, best_weak); the present thresholds stay unless others do strictly better."""
    tool = pile(F.col("score"), top, weak)
    now = histogram(pairs).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(tool == F.col("pile"), F.col("n"))), F.lit(0)).alias("agreed"),
        F.sum(F.when((tool == "top") & (F.col("pile") == "top"), F.col("n")).otherwise(0)).alias("hit"), F.sum(F.when(tool == "top", F.col("n")).otherwise(0)).alias("called"), F.sum(F.when(F.col("pile") == "top", F.col("n")).otherwise(0)).alias("human"),
    )
    best = sweep(pairs).agg(F.max_by(F.struct("hits", "top", "weak"), F.struct(F.col("hits"), -F.col("top"), -F.col("weak"))).alias("b"))
    better = F.coalesce(F.col("b.hits") > F.col("agreed"), F.lit(False))
    ratio = lambda a, b: F.coalesce(F.bround(F.try_divide(F.col(a), F.col(b)), 4), F.lit(0.0))
    return now.crossJoin(F.broadcast(best)).select(
        "n", "agreed", ratio("hit", "called").alias("top_precision"), ratio("hit", "human").alias("top_recall"),
        F.when(better, F.col("b.hits")).otherwise(F.col("agreed")).alias("best_hits"), F.when(better, F.col("b.top")).otherwise(top).cast("long").alias("best_top"), F.when(better, F.col("b.weak")).otherwise(weak).cast("long").alias("best_weak"),
    )
