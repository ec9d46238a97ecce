"""Queries of preferences and clips over the driver's events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.operators import clips, learning
from vellumine.plans.bindings import duck, table
from vellumine.plans.registry import query

#: Decisions over the event's columns, read alike by both engines.
DECISION = {
    "signal": "CASE event_type WHEN 'view' THEN 'not_opened' WHEN 'click' THEN 'pairwise_keep' WHEN 'error' THEN 'restored_from_quarantine' WHEN 'purchase' THEN 'published' ELSE 'intent_label' END", "confidence": "value / 50",
    "winner": "CASE WHEN event_id % 3 = 0 THEN '' ELSE CAST(event_id % 97 AS STRING) END", "loser": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST((event_id % 97 + 1 + event_id % 4) % 97 AS STRING) END",
    "genre": "CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('g', CAST(CAST(floor(sqrt(event_id % 400)) AS BIGINT) AS STRING)) END", "camera": "CASE WHEN event_id % 6 = 0 THEN NULL ELSE concat('cam', CAST(user_id % 7 AS STRING)) END",
    "tool_said": "CASE WHEN event_id % 2 = 0 THEN 'keep' ELSE '' END", "answer": "CASE WHEN event_id % 10 = 0 THEN 'trash' WHEN event_id % 10 = 2 THEN 'keep' ELSE '' END",
}
DECISION_SQL = "D AS (SELECT event_id, " + ", ".join(f"{duck(sql)} AS {name}" for name, sql in DECISION.items()) + " FROM events), DW AS (SELECT *, CASE signal WHEN 'not_opened' THEN 0.0::DOUBLE WHEN 'pairwise_keep' THEN 1.5 WHEN 'restored_from_quarantine' THEN 3.0 WHEN 'published' THEN 2.0 ELSE 1.5 END * least(1.0::DOUBLE, greatest(0.0, confidence)) AS weight, coalesce(winner, '') <> '' AND coalesce(loser, '') <> '' AS pairwise FROM D)"


def decisions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr("event_id", *(f"{sql} AS {name}" for name, sql in DECISION.items()))


@query(f"""WITH {DECISION_SQL} SELECT count(*) AS decisions, count(*) FILTER (pairwise AND weight > 0) AS pairs, count(*) FILTER (signal = 'restored_from_quarantine' OR (tool_said <> '' AND answer <> '' AND tool_said <> answer)) AS corrections,
  count(DISTINCT nullif(genre, '')) AS genres, count(DISTINCT nullif(camera, '')) AS cameras, count(*) >= 50 AS can_rank, count(*) >= 1000 AS can_decide FROM DW""")
def preference_facts(spark: SparkSession, d: str) -> DataFrame:
    return learning.store_facts(decisions(spark, d))


@query(f"WITH {DECISION_SQL} SELECT 'genre' AS kind, genre AS value, count(*) AS n, count(*) >= 40 AS known FROM D WHERE coalesce(genre, '') <> '' GROUP BY genre UNION ALL SELECT 'camera', camera, count(*), true FROM D WHERE coalesce(camera, '') <> '' GROUP BY camera")
def preference_seen(spark: SparkSession, d: str) -> DataFrame:
    own = decisions(spark, d)
    return learning.seen(own, "genre").select(F.lit("genre").alias("kind"), "value", "n", "known").union(learning.seen(own, "camera").select(F.lit("camera").alias("kind"), "value", "n", "known"))


_STEPS = """E AS (SELECT winner AS i, loser AS j, n AS won, n AS met FROM W UNION ALL SELECT loser, winner, 0, n FROM W),
  S AS (SELECT 0 AS step, i AS item, 1.0::DOUBLE AS s FROM (SELECT DISTINCT i FROM E)
    UNION ALL SELECT step + 1, item, r / avg(r) OVER () FROM (SELECT a.step, E.i AS item, (sum(E.won) + 0.5::DOUBLE) / (sum(E.met / (a.s + b.s)) + 0.5::DOUBLE) AS r FROM E JOIN S a ON a.item = E.i JOIN S b ON b.item = E.j WHERE a.step < 60 GROUP BY a.step, E.i))"""
FIT_SQL = f"{DECISION_SQL}, W AS (SELECT winner, loser, sum(greatest(1, CAST(round_even(weight, 0) AS BIGINT))) AS n FROM DW WHERE pairwise GROUP BY 1, 2), {_STEPS}"


@query(f"WITH RECURSIVE {FIT_SQL} SELECT item, round_even(s, 6) AS strength FROM S WHERE step = 60")
def preference_fit(spark: SparkSession, d: str) -> DataFrame:
    """The strengths of what was compared, after 60 steps."""
    return learning.fit(decisions(spark, d)).withColumn("strength", F.bround("strength", 6))


_ASSET = "X AS (SELECT event_id AS key, CASE WHEN event_id % 3 = 0 THEN 'g3' WHEN event_id % 3 = 1 THEN 'g19' ELSE 'g77' END AS genre, CASE WHEN event_id % 2 = 0 THEN 'cam1' WHEN event_id % 4 = 1 THEN '' ELSE 'unheard' END AS camera, (event_id % 101) / 100.0::DOUBLE AS p, event_id % 7 <> 0 AS judged FROM events)"


@query(f"""WITH {DECISION_SQL}, {_ASSET}, G AS (SELECT genre FROM D WHERE coalesce(genre, '') <> '' GROUP BY genre HAVING count(*) >= 40), C AS (SELECT DISTINCT camera FROM D WHERE coalesce(camera, '') <> ''),
  Y AS (SELECT key, genre IN (SELECT genre FROM G) AS kg, camera = '' OR camera IN (SELECT camera FROM C) AS kc, CASE WHEN judged THEN p ELSE 0.5::DOUBLE END AS p, (SELECT count(*) FROM D) AS n FROM X),
  Z AS (SELECT key, n < 50 AS few, NOT (kg AND kc) AS strange, kg, p, n FROM Y)
  SELECT key, CASE WHEN few OR strange THEN 0.5::DOUBLE ELSE p END AS probability, few OR NOT strange AS in_distribution, few OR strange OR abs(p - 0.5) < 0.15::DOUBLE AS abstained, CASE WHEN few OR strange THEN true ELSE p >= 0.5 END AS keeps,
    CASE WHEN few THEN 'only ' || n || ' decisions recorded' WHEN strange THEN 'unfamiliar ' || CASE WHEN kg THEN 'camera' ELSE 'genre' END || ': nothing comparable has been judged yet' WHEN abs(p - 0.5) < 0.15::DOUBLE THEN 'probability ' || printf('%.2f', p) || ' is too close to a coin toss' ELSE '' END AS reason,
    NOT (few OR strange OR abs(p - 0.5) < 0.15::DOUBLE) AND (p >= 0.5) <> (key % 2 = 0) AS disagrees FROM Z""")
def preference_predict(spark: SparkSession, d: str) -> DataFrame:
    """Every event as an asset: what the model says of it, and whether a curator who keeps even ones disagrees."""
    k = F.col("event_id")
    x = table(spark, d, "events").select(k.alias("key"), F.when(k % 3 == 0, "g3").when(k % 3 == 1, "g19").otherwise("g77").alias("genre"), F.when(k % 2 == 0, "cam1").when(k % 4 == 1, "").otherwise("unheard").alias("camera"))
    p = table(spark, d, "events").where("event_id % 7 <> 0").select(k.alias("item"), ((k % 101) / 100.0).alias("probability"))
    out = learning.predict(x, p, decisions(spark, d))
    return out.select("key", "probability", "in_distribution", "abstained", "keeps", "reason", learning.disagrees(F.col("key") % 2 == 0).alias("disagrees"))


# --- clips ----------------------------------------------------------------------------------------

PROBE = {
    "width": "CASE WHEN key % 11 = 0 THEN 0 WHEN key % 3 = 0 THEN 1080 WHEN key % 3 = 1 THEN 1920 ELSE 1100 END", "height": "CASE WHEN key % 3 = 0 THEN 1920 WHEN key % 3 = 1 THEN 1080 WHEN key % 13 = 0 THEN 0 ELSE 1080 END",
    "rate": "CAST(key % 130 AS DOUBLE)", "average": "CAST(key % 130 AS DOUBLE) * (1 + CAST(key % 5 AS DOUBLE) / 100)", "transfer": "CASE key % 4 WHEN 0 THEN 'SMPTE2084' WHEN 1 THEN 'bt709' ELSE NULL END", "profile": "CASE key % 9 WHEN 0 THEN 'S-Log3' WHEN 1 THEN 'HLG' ELSE 'Main' END", "duration": "CAST(key % 100 AS DOUBLE) / 4",
}
PROBE_SQL = "V AS (SELECT key, " + ", ".join(f"{duck(sql)} AS {name}" for name, sql in PROBE.items()) + " FROM (SELECT event_id AS key FROM events))"
_ratio = "CASE WHEN height = 0 THEN 0.0::DOUBLE ELSE round_even(width / height::DOUBLE, 3) END"


@query(f"""WITH {PROBE_SQL} SELECT key, {_ratio} AS aspect_ratio, CASE WHEN width = 0 OR height = 0 THEN 'unknown' WHEN abs({_ratio} - 1) < 0.05::DOUBLE THEN 'square' WHEN width > height THEN 'horizontal' ELSE 'vertical' END AS orientation,
  rate <> 0 AND average <> 0 AND abs(rate - average) / greatest(rate, 1e-6) > 0.02::DOUBLE AS variable, coalesce(lower(transfer), '') = 'smpte2084' OR regexp_matches(lower(profile), 'log|hlg|flat') AS flat, rate >= 100 AS slow_motion, rate > 0 AND rate <= 12 AS time_lapse,
  CASE WHEN duration > 0 THEN array_to_string([printf('%.3f', round_even(greatest(0.0, duration - 1) * (i + 0.5::DOUBLE) / 3, 3)) for i in range(3)], ',') ELSE '' END AS bursts FROM V""")
def clip_facts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    v = table(spark, d, "events").selectExpr("event_id AS key").selectExpr("key", *(f"{sql} AS {name}" for name, sql in PROBE.items()))
    starts = F.array_join(F.transform(clips.burst_starts(c("duration"), 3), lambda x: F.format_string("%.3f", x)), ",")
    return v.select(
        "key", clips.aspect_ratio(c("width"), c("height")).alias("aspect_ratio"), clips.orientation(c("width"), c("height")).alias("orientation"), clips.variable_rate(c("rate"), c("average")).alias("variable"), clips.flat_footage(c("transfer"), c("profile")).alias("flat"),
        clips.slow_motion(c("rate")).alias("slow_motion"), clips.time_lapse(c("rate")).alias("time_lapse"), starts.alias("bursts"),
    )


SHIFT = {"clip": "user_id", "burst": "event_id % 3", "dx": "CAST((event_id * 7) % 21 - 10 AS DOUBLE) / (1 + user_id % 40)", "dy": "CAST((event_id * 11) % 17 - 8 AS DOUBLE) / (1 + user_id % 40)", "shear": "CAST(event_id % 50 AS DOUBLE) / 10", "difference": "CAST(event_id % 30 AS DOUBLE) / 10"}
SHIFT_SQL = "T AS (SELECT " + ", ".join(f"{duck(sql)} AS {name}" for name, sql in SHIFT.items()) + " FROM events), B AS (SELECT clip, burst, round_even(sqrt(avg(dx) ** 2 + avg(dy) ** 2), 3) AS pan, round_even(sqrt(stddev_pop(dx) ** 2 + stddev_pop(dy) ** 2), 3) AS jitter, round_even(max(shear), 3) AS shear, count(*) FILTER (difference < 0.6::DOUBLE) AS frozen FROM T GROUP BY 1, 2)"


@query(f"""WITH {SHIFT_SQL}, M AS (SELECT clip, max(pan) AS pan, max(jitter) AS jitter, max(shear) AS shear, CAST(sum(frozen) AS BIGINT) AS frozen FROM B GROUP BY clip)
  SELECT *, CASE WHEN pan < 0.5::DOUBLE AND jitter < 0.5::DOUBLE THEN 'static' WHEN pan > jitter * 1.5::DOUBLE THEN 'pan or tilt' ELSE 'handheld' END AS movement FROM M""")
def clip_motion(spark: SparkSession, d: str) -> DataFrame:
    """Movement by burst, the worst of each clip, and what the camera did."""
    t = table(spark, d, "events").selectExpr(*(f"{sql} AS {name}" for name, sql in SHIFT.items()))
    return clips.combined_motion(clips.motion(t)).select("clip", "pan", "jitter", "shear", "frozen", "movement")


_CLIP = "V AS (SELECT user_id AS clip, CAST(event_id AS DOUBLE) AS ts, floor(least(100.0::DOUBLE, value)) AS quality, CAST(event_id % 60 AS DOUBLE) AS mean_luma FROM events)"


@query(f"WITH {_CLIP} SELECT clip, arg_max(ts, struct_pack(q := quality, t := -ts)) AS poster, count(*) FILTER (mean_luma <= 12) AS black_frames FROM V GROUP BY clip")
def clip_poster(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("clip"), F.col("event_id").cast("double").alias("ts"), F.floor(F.least(F.lit(100.0), F.col("value"))).cast("double").alias("quality"), (F.col("event_id") % 60).cast("double").alias("mean_luma"))
    return clips.clip_summary(e)


@query("""WITH S AS (SELECT user_id AS clip, CAST(event_id % 1000 AS DOUBLE) AS a, CAST(event_id % 1000 AS DOUBLE) + 3 + event_id % 17 / 4.0::DOUBLE AS b FROM events), R AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY round_even(b - a, 3) DESC, a) AS p FROM S)
  SELECT clip, a AS "start", b AS "end", round_even(b - a, 3) AS duration FROM R WHERE p = 1""")
def clip_longest_segment(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    s = table(spark, d, "events").select(F.col("user_id").alias("clip"), (k % 1000).cast("double").alias("start"), ((k % 1000).cast("double") + 3 + k % 17 / F.lit(4.0)).alias("end"))
    return clips.longest_segment(s)


