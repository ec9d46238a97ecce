"""Queries of tone curves, crops and edit costs over the driver's events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.operators import tones
from vellumine.plans.bindings import duck, table
from vellumine.plans.registry import query

#: Linear values and a recipe over the event's id, read alike by both engines.
POINT = {
    "r": "CAST(key * 7 % 101 AS DOUBLE) / 80", "g": "CAST(key * 11 % 101 AS DOUBLE) / 90", "b": "CAST(key * 13 % 101 AS DOUBLE) / 100", "exposure_ev": "CAST(key % 9 AS DOUBLE) / 4 - 1", "temperature": "key % 13 * 300 - 1800", "tint": "key % 7 * 10 - 30", "highlights": "key % 11 * 15 - 75",
    "shadows": "key % 10 * 15 - 60", "whites": "key % 5 * 10 - 20", "blacks": "key % 6 * 10 - 30", "contrast": "key % 8 * 10 - 30", "saturation": "key % 9 * 10 - 40", "vibrance": "key % 12 * 8 - 40", "monochrome": "key % 10 = 0",
}
_n = lambda sql: f"greatest(0.0, least(1.0::DOUBLE, {sql}))"
_gain = {"r": "greatest(0.2::DOUBLE, least(5.0::DOUBLE, 1 + temperature / 4000.0::DOUBLE))", "g": "greatest(0.2::DOUBLE, least(5.0::DOUBLE, 1 + tint / 200.0::DOUBLE * 0.5::DOUBLE))", "b": "greatest(0.2::DOUBLE, least(5.0::DOUBLE, 1 - temperature / 4000.0::DOUBLE))"}


def _stage(name: str, before: str, of) -> str:
    return f"{name} AS (SELECT * REPLACE ({', '.join(f'{of(c)} AS {c}' for c in 'rgb')}) FROM {before})"


_CHAIN = ", ".join([
    "N AS (SELECT key, " + ", ".join(f"{duck(sql)} AS {name}" for name, sql in POINT.items()) + " FROM (SELECT event_id AS key FROM events))",
    _stage("T1", "N", lambda c: f"least(1.0::DOUBLE, pow(greatest(0.0, {c} * {_gain[c]} * pow(2.0::DOUBLE, exposure_ev)), 1 / 2.2::DOUBLE))"),
    _stage("T2", "T1", lambda c: _n(f"{c} + {_n(f'({c} - 0.72::DOUBLE) / (1 - 0.72::DOUBLE)')} * (1 - {c}) * 0.9::DOUBLE * highlights / 100")),
    _stage("T3", "T2", lambda c: _n(f"{c} + least(1.0::DOUBLE, greatest(0.0, 0.28::DOUBLE - {c}) / 0.28::DOUBLE) * greatest(0.0, 0.28::DOUBLE - {c}) * 0.8::DOUBLE * shadows / 100")),
    _stage("T4", "T3", lambda c: f"{c} + greatest(0.0, {c} - 0.5::DOUBLE) * 0.6::DOUBLE * whites / 100"), _stage("T5", "T4", lambda c: _n(f"{c} + greatest(0.0, 0.5::DOUBLE - {c}) * 0.6::DOUBLE * blacks / 100")),
    _stage("T6", "T5", lambda c: _n(f"{c} + ({c} - 0.5::DOUBLE) * (1 - 2 * abs({c} - 0.5::DOUBLE)) * contrast / 100")),
    "T7 AS (SELECT *, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS l FROM T6)", f"T8 AS (SELECT *, 1 + saturation / 100.0::DOUBLE + vibrance / 100.0::DOUBLE * (1 - {_n('2.5::DOUBLE * greatest(abs(r - l), abs(g - l), abs(b - l))')}) AS gain FROM T7)",
    _stage("T9", "T8", lambda c: _n(f"l + ({c} - l) * gain")),
])


@query(f"WITH {_CHAIN}, M AS (SELECT *, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS grey FROM T9) SELECT key, {', '.join(f'round_even(CASE WHEN monochrome THEN grey ELSE {c} END, 6) AS {c}' for c in 'rgb')} FROM M")
def render_points(spark: SparkSession, d: str) -> DataFrame:
    """Each event as a point: balance, exposure, every curve, colour."""
    p = table(spark, d, "events").selectExpr("event_id AS key").selectExpr("key", *(f"{sql} AS {name}" for name, sql in POINT.items()))
    return tones.rendered(p).select("key", *(F.bround(c, 6).alias(c) for c in "rgb"))


@query("""WITH N AS (SELECT event_id AS key, CAST(event_id % 256 AS DOUBLE) AS m, CAST(event_id * 3 % 256 AS DOUBLE) AS r, CAST(event_id * 5 % 256 AS DOUBLE) AS g, CAST(event_id * 7 % 256 AS DOUBLE) AS b, event_id % 10 / 20.0::DOUBLE + 0.5 AS keep, event_id % 21 / 10.0::DOUBLE AS stops, event_id % 4 = 0 AS dn, event_id % 100 / 1.0::DOUBLE AS cur, event_id * 7 % 100 / 1.0::DOUBLE AS best, event_id % 3 = 0 AS raw FROM events),
  C AS (SELECT *, 3.0::DOUBLE * greatest(0.0, stops - 0.5) + 26.0::DOUBLE * (1 - keep) + CASE WHEN dn THEN 4.0::DOUBLE ELSE 0.0 END AS cost, greatest(0.0, best - cur) AS gain, (r + g + b) / 3 AS mean FROM N)
  SELECT key, greatest(-2.0::DOUBLE, least(2.0::DOUBLE, round_even(log2(118.0::DOUBLE / greatest(m, 1.0)), 2))) AS stops, round_even(CASE WHEN r > 1 THEN 1 + (mean / r - 1) * 0.5::DOUBLE ELSE 1.0 END, 6) AS gain_r, round_even(CASE WHEN b > 1 THEN 1 + (mean / b - 1) * 0.5::DOUBLE ELSE 1.0 END, 6) AS gain_b,
    round_even(cost, 4) AS cost, round_even(greatest(0.0, gain - round_even(cost + CASE WHEN raw THEN 0.0 ELSE gain * 0.35::DOUBLE END, 2)), 2) AS uplift FROM C""")
def edit_costs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    e = table(spark, d, "events").select(k.alias("key"), (k % 256).cast("double").alias("m"), *((k * f % 256).cast("double").alias(c) for f, c in ((3, "r"), (5, "g"), (7, "b"))), (k % 10 / 20.0 + 0.5).alias("keep"), (k % 21 / 10.0).alias("s"), (k % 100).cast("double").alias("cur"), (k * 7 % 100).cast("double").alias("best"))
    c = F.col
    gains, cost = tones.grey_gains(c("r"), c("g"), c("b")), tones.edit_cost(c("keep"), c("s"), c("key") % 4 == 0)
    return e.select("key", tones.suggested_stops(c("m")).alias("stops"), F.bround(gains[0], 6).alias("gain_r"), F.bround(gains[2], 6).alias("gain_b"), F.bround(cost, 4).alias("cost"), F.bround(tones.uplift(c("cur"), c("best"), cost, c("key") % 3 == 0), 2).alias("uplift"))


@query("SELECT vec_id AS key, round_even((SELECT avg(x) FROM unnest(v) t(x) WHERE x >= (SELECT quantile_cont(x, 0.9) FROM unnest(v) u(x))), 2) AS brightest FROM (SELECT vec_id, list_transform(embedding, lambda x: round_even(CAST(x AS DOUBLE) * 1000, 0)) AS v FROM embeddings)")
def brightest_tenth(spark: SparkSession, d: str) -> DataFrame:
    v = F.transform("embedding", lambda x: F.bround(x.cast("double") * 1000))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), tones.brightest_tenth(v).alias("brightest"))


_BOX = "B AS (SELECT event_id AS key, 10 + event_id % 400 AS w, 10 + event_id * 3 % 300 AS h, event_id % 400 AS x, event_id % 300 AS y FROM events), B1 AS (SELECT *, least(w, CAST(floor(h * 0.8::DOUBLE) AS BIGINT)) AS bw FROM B), B2 AS (SELECT *, least(h, CAST(floor(bw / 0.8::DOUBLE) AS BIGINT)) AS bh FROM B1), B3 AS (SELECT * REPLACE (least(w, CAST(floor(bh * 0.8::DOUBLE) AS BIGINT)) AS bw) FROM B2), B4 AS (SELECT *, greatest(0, least(w - bw, x - bw // 2)) AS l, greatest(0, least(h - bh, y - bh // 2)) AS t FROM B3)"
_TURN = "D AS (SELECT *, radians((key % 37)::DOUBLE * 4.7::DOUBLE % 180) AS a0 FROM B4), D1 AS (SELECT *, CASE WHEN a0 > pi() / 2 THEN pi() - a0 ELSE a0 END AS a FROM D), D2 AS (SELECT *, abs(sin(a)) AS s, abs(cos(a)) AS c FROM D1), D3 AS (SELECT *, least(w, h) <= 2 * s * c * greatest(w, h) OR abs(s - c) < 1e-10 AS slim FROM D2)"


@query(f"""WITH {_BOX}, {_TURN} SELECT key, CASE WHEN bw >= 16 AND bh >= 16 THEN l || ',' || t || ',' || (l + bw) || ',' || (t + bh) END AS box,
  greatest(1, CAST(floor(CASE WHEN slim THEN CASE WHEN w >= h THEN least(w, h) * 0.5 / s ELSE least(w, h) * 0.5 / c END ELSE (w * c - h * s) / (c * c - s * s) END ) AS BIGINT)) AS turned_width FROM D3""")
def crop_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of 4 to 5 around a place, and the width that is left of turned frames."""
    k, c = F.col("event_id"), F.col
    e = table(spark, d, "events").select(k.alias("key"), (10 + k % 400).alias("w"), (10 + k * 3 % 300).alias("h"), (k % 400).alias("x"), (k % 300).alias("y"))
    b = tones.box(c("w"), c("h"), c("x"), c("y"), 0.8)
    text = F.concat_ws(",", b["left"].cast("string"), b["top"].cast("string"), b["right"].cast("string"), b["bottom"].cast("string"))
    return e.select("key", F.when(b.isNotNull(), text).alias("box"), tones.inscribed(c("w"), c("h"), (c("key") % 37).cast("double") * 4.7)["width"].alias("turned_width"))
