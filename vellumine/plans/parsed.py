"""Queries of model replies: each group of events stands for a reply, written as JSON and parsed; the checking SQL knows what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.operators import replies
from vellumine.plans.bindings import table
from vellumine.plans.registry import query

#: Fields of an object as JSON text over key (a frame's number) and n (its place in a group of 4); SQL for both engines.
GROUP = 4


def _objects(spark: SparkSession, d: str, fields: str) -> DataFrame:
    """(g, reply, names): groups of four objects, as an array, an object that holds one, prose around one, or no JSON."""
    e = table(spark, d, "events").selectExpr("event_id AS key", f"floor(event_id / {GROUP}) AS g", f"CAST(event_id % {GROUP} AS INT) + 1 AS n").withColumn("o", F.expr(fields))
    groups = e.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("n", "key", "o"))).alias("a"))
    body = F.concat(F.lit("["), F.array_join(F.transform("a", lambda x: x["o"]), ","), F.lit("]"))
    reply = F.when(F.col("g") % 5 == 0, body).when(F.col("g") % 5 == 1, F.concat(F.lit('{"frames": '), body, F.lit("}"))).when(F.col("g") % 5 == 2, F.concat(F.lit("Here you are:\n"), body, F.lit("\nDone."))).when(F.col("g") % 5 == 3, F.concat(F.lit("  "), body)).otherwise("no luck")
    return groups.select("g", reply.alias("reply"), F.transform("a", lambda x: F.concat(F.lit("f"), x["key"].cast("string"))).alias("names"))


#: Objects name their frame by its number, by none, or by a wrong one.
_FIRST = """concat('{', CASE key % 3 WHEN 0 THEN concat('"n": ', CAST(n AS STRING), ', ') WHEN 1 THEN '' ELSE '"n": "x", ' END, CASE WHEN key % 7 = 0 THEN '' ELSE concat('"genre": "', CASE key % 4 WHEN 0 THEN ' Street ' WHEN 1 THEN 'night' WHEN 2 THEN 'NOWHERE' ELSE 'portrait' END, '", ') END,
  '"axis_a": ', CAST(key % 130 AS STRING), '.4, "axis_b": "', CASE WHEN key % 5 = 0 THEN 'high' ELSE CAST(key % 90 AS STRING) END, '", "axis_c": -3, "recover": "', CASE key % 3 WHEN 0 THEN 'EASY' WHEN 1 THEN 'hopeless' ELSE '?' END, '", "note": "', CASE WHEN key % 2 = 0 THEN ' a  b c d e f g h i j k l m n ' ELSE '' END,
  '", "intended_frame": ', CASE key % 4 WHEN 0 THEN 'false' WHEN 1 THEN '"No"' WHEN 2 THEN '"maybe"' ELSE 'true' END, CASE WHEN key % 6 = 0 THEN ', "subject_strength": "strong"' ELSE concat(', "subject_strength": ', CAST(key % 101 AS STRING)) END, '}')"""
_OWN = "E AS (SELECT event_id AS key, event_id // 4 AS g, event_id % 4 + 1 AS n FROM events), O AS (SELECT * FROM E WHERE g % 5 <> 4)"


@query(f"""WITH {_OWN} SELECT key, CASE WHEN key % 7 = 0 THEN 'genre' ELSE '' END AS missing, CASE WHEN key % 7 <> 0 THEN CASE key % 4 WHEN 0 THEN 'street' WHEN 1 THEN 'night' WHEN 2 THEN 'other' ELSE 'portrait' END END AS genre, CASE WHEN key % 7 <> 0 THEN least(100, key % 130) END AS axis_a,
  CASE WHEN key % 7 <> 0 THEN CASE WHEN key % 5 = 0 THEN 0 ELSE key % 90 END END AS axis_b, CASE WHEN key % 7 <> 0 THEN CAST(0 AS BIGINT) END AS axis_c, CASE WHEN key % 7 <> 0 THEN CASE key % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'hopeless' ELSE 'moderate' END END AS recover,
  CASE WHEN key % 7 <> 0 THEN CASE WHEN key % 2 = 0 THEN 'a b c d e f g h i j k l' ELSE '' END END AS note, CASE WHEN key % 7 <> 0 THEN key % 4 IN (2, 3) END AS intended_frame, CASE WHEN key % 7 <> 0 THEN CASE WHEN key % 6 = 0 THEN 50 ELSE key % 101 END END AS subject_strength FROM O""")
def reply_assessments(spark: SparkSession, d: str) -> DataFrame:
    """Every object of every reply, put to its frame and read."""
    out = replies.assessment(replies.placed(_objects(spark, d, _FIRST), "reply", "names"))
    return out.select(F.substring("filename", 2, 20).cast("long").alias("key"), "missing", "genre", "axis_a", "axis_b", "axis_c", "recover", "note", "intended_frame", "subject_strength")


_DIMENSIONS = "', '".join(f"\"{n}\": ', CASE WHEN key % 11 = {i} THEN '\"none\"' ELSE CAST((key * {3 + i}) % 110 AS STRING) END, '," for i, n in enumerate(replies.ARTISTIC))
_SECOND = f"""concat('{{', '{_DIMENSIONS}', '"artistic_candidate": "', CASE WHEN key % 2 = 0 THEN 'yes' ELSE 'x' END, '", ', CASE key % 3 WHEN 0 THEN '"artistic_confidence": 140, ' WHEN 1 THEN '"artistic_confidence": "?", ' ELSE '' END, CASE WHEN key % 4 = 0 THEN '' ELSE '"uncertainty": 33.5, ' END, '"series_role": "', CASE key % 3 WHEN 0 THEN ' pause' WHEN 1 THEN 'NONE' ELSE 'finale' END, '"',
  CASE WHEN key % 5 < 2 THEN concat(', "portrait": {{"face_count": ', CAST(key % 3 AS STRING), ', "primary_face_visible": ', CASE WHEN key % 2 = 0 THEN 'true' ELSE 'false' END, ', "primary_face_area_ratio": 1.5, "eyes_state": "', CASE WHEN key % 7 = 0 THEN 'closed' ELSE 'glass' END, '", "expression": "Blink", "expression_quality": ', CAST(key % 120 AS STRING), '}}') ELSE '' END, '}}')"""
_ok = "key % 11 > 7"
_dim = lambda i: f"least(100, (key * {3 + i}) % 110)"
_over = " + ".join(f"CAST((key * {3 + i}) % 110 > 100 AS BIGINT)" for i in range(8))
_line = " || ', ' || ".join(f"'{n.split('_')[0]} ' || {_dim(i)}" for i, n in enumerate(replies.ARTISTIC[:4]))


@query(f"""WITH {_OWN} SELECT key, CASE WHEN {_ok} THEN 'completed' ELSE 'failed' END AS status, {", ".join(f"CASE WHEN {_ok} THEN {_dim(i)} END AS {n}" for i, n in enumerate(replies.ARTISTIC))}, CASE WHEN {_ok} THEN key % 2 = 0 END AS candidate, CASE WHEN {_ok} THEN CASE WHEN key % 3 = 0 THEN 100 ELSE CAST(0 AS BIGINT) END END AS confidence,
  CASE WHEN {_ok} THEN CASE WHEN key % 4 = 0 THEN CAST(50 AS BIGINT) ELSE 34 END END AS uncertainty, CASE WHEN {_ok} THEN CASE WHEN key % 3 = 0 THEN 'PAUSE' ELSE 'NONE' END END AS series_role, CASE WHEN {_ok} THEN {_over} + CAST(key % 3 < 2 AS BIGINT) END AS errors, {_ok} AND key % 3 = 0 AS carries_series,
  CASE WHEN key % 5 < 2 THEN key % 3 END AS face_count, CASE WHEN key % 5 < 2 THEN key % 2 = 0 END AS face_visible, CASE WHEN key % 5 < 2 THEN 1.0::DOUBLE END AS face_area, CASE WHEN key % 5 < 2 THEN CASE WHEN key % 7 = 0 THEN 'CLOSED' ELSE 'UNCLEAR' END END AS eyes, CASE WHEN key % 5 < 2 THEN 'BLINK' END AS expression, CASE WHEN key % 5 < 2 THEN least(100, key % 120) END AS expression_quality,
  key % 5 < 2 AND key % 3 > 0 AND key % 2 = 0 AS face_applies, CASE WHEN NOT {_ok} THEN 'artistic: failed' ELSE 'artistic: ' || {_line} || ', confidence ' || CASE WHEN key % 3 = 0 THEN 100 ELSE 0 END || CASE WHEN key % 5 < 2 AND key % 3 > 0 AND key % 2 = 0 THEN ' | face: blink, eyes ' || CASE WHEN key % 7 = 0 THEN 'closed' ELSE 'unclear' END || ', quality ' || least(100, key % 120) ELSE '' END END AS summary FROM O""")
def reply_artistic(spark: SparkSession, d: str) -> DataFrame:
    out = replies.portrait(replies.artistic_read(replies.placed(_objects(spark, d, _SECOND), "reply", "names")))
    out = out.withColumn("summary", replies.read_summary(out))
    return out.select(F.substring("filename", 2, 20).cast("long").alias("key"), "status", *replies.ARTISTIC, "candidate", "confidence", "uncertainty", "series_role", F.col("errors").cast("long").alias("errors"), "carries_series", "face_count", "face_visible", "face_area", "eyes", "expression", "expression_quality", "face_applies", "summary")


@query("SELECT event_id AS key, CASE event_id % 4 WHEN 0 THEN 'direct ' || event_type WHEN 1 THEN 'a' || event_type WHEN 2 THEN 'ab' ELSE '' END AS text FROM events")
def reply_output_text(spark: SparkSession, d: str) -> DataFrame:
    """The text of batch replies, direct or in blocks."""
    k, t = F.col("event_id"), F.col("event_type")
    block = lambda kind, text: F.concat(F.lit('{"type": "' + kind + '", "text": "'), text, F.lit('"}'))
    out = lambda *blocks: F.concat(F.lit('{"output": [{"content": ['), F.array_join(F.array(*blocks), ","), F.lit(']}, {"content": null}]}'))
    body = F.when(k % 4 == 0, F.concat(F.lit('{"output_text": "direct '), t, F.lit('"}'))).when(k % 4 == 1, out(block("output_text", F.lit("a")), block("refusal", F.lit("no")), block("text", t))).when(k % 4 == 2, out(block("text", F.lit("a")), block("text", F.lit("b")))).otherwise("{}")
    return table(spark, d, "events").select(k.alias("key"), replies.output_text(body).alias("text"))


@query("SELECT user_id % 20 AS batch, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS models, count(DISTINCT event_type) AS n_models, count(DISTINCT event_type) <= 1 AS is_single FROM events GROUP BY 1")
def batch_models(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select((F.col("user_id") % 20).alias("batch"), F.col("event_type").alias("model"))
    return replies.one_model(e)
