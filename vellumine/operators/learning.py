"""A person's preferences: what decisions were recorded, what is known, the fitted strengths, predictions, and where they disagree.

Decisions: (signal, winner, loser, confidence, genre, camera, tool_said, answer). Empty text and null both mean none. No
decisions give a row of zeros, no strengths, and predictions that abstain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.operators import history, ranking

# Decisions from which on the model ranks, decides, and knows a genre; and how far from even it must be.
TO_RANK, TO_DECIDE, TO_KNOW_GENRE, MARGIN = 50, 1000, 40, 0.15
CORRECTING = ["restored_from_quarantine", "added_to_portfolio"]


def said(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def is_pairwise() -> Column:
    return said(F.col("winner")) & said(F.col("loser"))


def is_correction() -> Column:
    """The person undid what the tool did, or answered otherwise than it said."""
    return F.col("signal").isin(CORRECTING) | (said(F.col("tool_said")) & said(F.col("answer")) & (F.col("tool_said") != F.col("answer")))


def store_facts(decisions: DataFrame) -> DataFrame:
    """(decisions, pairs, corrections, genres, cameras, can_rank, can_decide): one row."""
    weight = history.decision_weight(F.col("signal"), F.col("confidence"))
    one = decisions.agg(
        F.count("*").alias("decisions"), F.count_if(is_pairwise() & (weight > 0)).alias("pairs"), F.count_if(is_correction()).alias("corrections"),
        F.count_distinct(F.when(said(F.col("genre")), F.col("genre"))).alias("genres"), F.count_distinct(F.when(said(F.col("camera")), F.col("camera"))).alias("cameras"),
    )
    return one.withColumns({"can_rank": F.col("decisions") >= TO_RANK, "can_decide": F.col("decisions") >= TO_DECIDE})


def seen(decisions: DataFrame, column: str) -> DataFrame:
    """(value, n, known): the genres or cameras of the decisions; a genre is known from TO_KNOW_GENRE on, a camera at once."""
    counts = decisions.where(said(F.col(column))).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("known", F.col("n") >= (TO_KNOW_GENRE if column == "genre" else 1))


def fit(decisions: DataFrame) -> DataFrame:
    """(item, strength) from the pairwise decisions, each as often as its weight says, at least once."""
    times = history.repetitions(history.decision_weight(F.col("signal"), F.col("confidence")))
    wins = decisions.where(is_pairwise()).groupBy("winner", "loser").agg(F.sum(times).alias("n"))
    return ranking.bradley_terry(wins)


def predict(assets: DataFrame, probabilities: DataFrame, decisions: DataFrame) -> DataFrame:
    """The assets (key, genre, camera) with probability, in_distribution, abstained, keeps and reason.

    Abstains with too few decisions, an unfamiliar genre or camera (an unnamed camera counts as familiar), or a probability near even.
    """
    genres = seen(decisions, "genre").where("known").select(F.col("value").alias("genre"), F.lit(True).alias("_g"))
    cameras = seen(decisions, "camera").select(F.col("value").alias("camera"), F.lit(True).alias("_c"))
    n = decisions.agg(F.count("*").alias("_n"))
    df = assets.join(genres, "genre", "left").join(cameras, "camera", "left").join(probabilities.select(F.col("item").alias("key"), F.col("probability").alias("_p")), "key", "left").crossJoin(F.broadcast(n))
    knows, has_camera = F.coalesce("_g", F.lit(False)), F.coalesce("_c", F.lit(False)) | ~said(F.col("camera"))
    few, strange, p = F.col("_n") < TO_RANK, ~(knows & has_camera), F.coalesce("_p", F.lit(0.5))
    even = F.abs(p - 0.5) < MARGIN
    reason = (
        F.when(few, F.concat(F.lit("only "), F.col("_n").cast("string"), F.lit(" decisions recorded")))
        .when(strange, F.concat(F.lit("unfamiliar "), F.when(knows, "camera").otherwise("genre"), F.lit(": nothing comparable has been judged yet")))
        .when(even, F.concat(F.lit("probability "), F.format_string("%.2f", F.bround(p, 2)), F.lit(" is too close to a coin toss")))
        .otherwise("")
    )
    out = df.withColumns({"probability": F.when(few | strange, 0.5).otherwise(p), "in_distribution": few | ~strange, "abstained": few | strange | even, "reason": reason})
    return out.withColumn("keeps", F.col("probability") >= 0.5).drop("_g", "_c", "_p", "_n")


def disagrees(curator_keeps: Column) -> Column:
    """Whether a prediction that doesn't abstain differs from the curator."""
    return ~F.col("abstained") & (F.col("keeps") != curator_keeps)
