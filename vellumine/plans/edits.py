"""Queries of edit recipes: each event of the driver's table stands for a frame, its measurements fixed arithmetic on the id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.operators import recipes, selection
from vellumine.plans.bindings import duck, spread, table
from vellumine.plans.registry import query

#: Columns over the event's id, read alike by both engines.
FRAME = {
    "mean_luma": "CAST((key * 37) % 2560 AS DOUBLE) / 10", "stddev_luma": "CAST(key % 90 AS DOUBLE)", "mean_r": "CAST((key * 7) % 256 AS DOUBLE)", "mean_g": "CAST((key * 11) % 256 AS DOUBLE)", "mean_b": "CAST((key * 13) % 256 AS DOUBLE)",
    "noise": "CAST(key % 150 AS DOUBLE) / 10", "tilt": "CAST(key % 41 AS DOUBLE) / 10 - 2", "is_raw": "key % 2 = 0", "raw_available": "key % 3 <> 0", "highlight_stops": "CAST(key % 40 AS DOUBLE) / 10", "shadow_stops": "CAST(key % 30 AS DOUBLE) / 10",
    "clipped_any": "CAST(key % 50 AS DOUBLE) / 10000", "blown": "CAST(key % 17 AS DOUBLE) / 200", "monochrome": "key % 4 = 0", "worst_clipped": "CAST(key % 30 AS DOUBLE) / 10000", "all_clipped": "CAST(key % 29 AS DOUBLE) / 1000",
    "crop_confidence": "CAST(key % 10 AS DOUBLE) / 10", "crop_left": "CAST(key % 4 AS DOUBLE) / 16", "crop_right": "1 - CAST(key % 5 AS DOUBLE) / 16",
}
SIGNALS = [("darkness", "key % 5 = 0"), ("motion_blur", "key % 7 = 0"), ("horizon_tilt", "key % 11 = 0"), ("grain", "key % 13 = 0"), ("blown_highlights", "key % 9 = 0")]
SURE = "key % 3 <> 1"
#: Light values before and after an edit, 60 of each frame.
BEFORE, AFTER = "CAST((key * 31 + i * 17) % 101 AS DOUBLE) / 100", "least(1.0D, greatest(0.0D, (CAST((key * 31 + i * 17) % 101 AS DOUBLE) / 100 - 0.5D) * (1 + CAST(key % 7 AS DOUBLE) / 10) + 0.5D + CAST(key % 5 AS DOUBLE) / 20))"


def frames(spark: SparkSession, d: str) -> DataFrame:
    signals = "filter(array(" + ", ".join(f"CASE WHEN {when} THEN named_struct('defect', '{name}', 'verdict', CASE WHEN {SURE} THEN 'likely_intentional' ELSE 'unclear' END, 'evidence', 'seen') END" for name, when in SIGNALS) + "), x -> x IS NOT NULL)"
    return spread(table(spark, d, "events").selectExpr("event_id AS key")).selectExpr("key", *(f"{sql} AS {name}" for name, sql in FRAME.items()), f"{signals} AS signals")


def edited(spark: SparkSession, d: str) -> DataFrame:
    pixels = lambda sql: f"transform(sequence(0, 59), i -> {sql})"
    df = recipes.generate(frames(spark, d).selectExpr("*", f"{pixels(BEFORE)} AS luma_before", f"{pixels(AFTER)} AS luma_after"))  # once for all variants
    return df.withColumn("crop_keeps", F.when(F.col("key") % 6 != 0, recipes.crop_keeps(F.col("crop_left"), F.lit(0.0), F.col("crop_right"), F.lit(1.0))))


_K = recipes.KEPT
_own = {name: f"({when} AND {SURE})" for name, when in SIGNALS}
_kinds = [("dark", "darkness"), ("blur", "motion_blur"), ("tilt", "horizon_tilt"), ("grain", "grain"), ("bright", "blown_highlights")]
_texts = lambda i: "list_filter([" + ", ".join(f"CASE WHEN {_own[s]} THEN '{_K[k][i]}' END" for k, s in _kinds if _K[k][i] is not None) + "], lambda x: x IS NOT NULL)"
FRAME_SQL = "N AS (SELECT *, " + ", ".join(f"{duck(sql)} AS {name}" for name, sql in FRAME.items()) + f", {_texts(0)} AS preserve, {_texts(1)} AS warnings, " + ", ".join(f"{_own[s]} AS has_{k}" for k, s in _kinds) + " FROM (SELECT event_id AS key FROM events))"
BASE_SQL = f"""{FRAME_SQL}, B AS (SELECT *, log2(0.46::DOUBLE * 255.0::DOUBLE / greatest(mean_luma, 1.0)) AS needed,
  CASE WHEN NOT (is_raw AND raw_available) THEN -15 WHEN clipped_any < 0.002::DOUBLE THEN 0 WHEN blown > 0.05::DOUBLE THEN -20 ELSE -round_even(20 + 35 * least(1.0::DOUBLE, highlight_stops / 2), 0) END::BIGINT AS hi,
  CASE WHEN has_dark THEN 6 WHEN mean_luma > 110 THEN 0 WHEN raw_available AND shadow_stops < 0.5::DOUBLE THEN 8 ELSE round_even(least(35.0::DOUBLE, (110 - mean_luma) * 0.35::DOUBLE), 0) END::BIGINT AS lo,
  CASE WHEN greatest(mean_r, mean_g, mean_b) <= 1 THEN 0 ELSE greatest(-1000.0::DOUBLE, least(1000.0::DOUBLE, round_even(-(mean_r - mean_b) / greatest((mean_r + mean_b) / 2, 1.0) * 900, 0))) END::BIGINT AS kelvin,
  CASE WHEN greatest(mean_r, mean_g, mean_b) <= 1 THEN 0 ELSE greatest(-30.0::DOUBLE, least(30.0::DOUBLE, round_even(-(mean_g - (mean_r + mean_b) / 2) / greatest(mean_g, 1.0) * 40, 0))) END::BIGINT AS tnt,
  CASE WHEN noise <= 2 THEN 0 ELSE round_even(least(45.0::DOUBLE, (noise - 2) * 6), 0) END::BIGINT AS dn,
  CASE WHEN has_blur THEN 0 ELSE 20 END::BIGINT AS sharpening, CASE WHEN has_blur THEN 0 ELSE floor(least(85.0::DOUBLE, 40 + noise * 4)) END::BIGINT AS masking,
  CASE WHEN has_tilt THEN 0.0::DOUBLE ELSE -tilt END AS rotation,
  CASE WHEN has_dark THEN 'preserve_low_key_mood' WHEN has_blur THEN 'preserve_motion' WHEN has_tilt THEN 'preserve_deliberate_angle' WHEN mean_luma < 70 THEN 'open_the_frame_without_flattening_it' ELSE 'correct_only_what_limits_the_frame' END AS base_intent FROM N),
  E AS (SELECT *, CASE WHEN needed > 0 THEN least(needed, CASE WHEN is_raw AND raw_available THEN least(1.5::DOUBLE, shadow_stops) ELSE 1.5::DOUBLE END) ELSE greatest(-1.0::DOUBLE, needed) END AS ev FROM B),
  R AS (
    SELECT *, 'faithful' AS variant, base_intent AS intent, round_even(ev, 2) AS exposure_ev, hi AS highlights, lo AS shadows, CASE WHEN lo > 0 THEN -4 ELSE 0 END AS blacks, 0 AS whites, CASE WHEN stddev_luma < 45 THEN 6 ELSE 0 END AS contrast, 0 AS clarity, kelvin AS temperature, tnt AS tint, 4 AS vibrance, 0 AS saturation, dn AS denoise, least(100, dn * 2) AS denoise_color FROM E
    UNION ALL SELECT *, 'expressive', base_intent || ' (strengthened)', round_even(ev * 0.45::DOUBLE, 2), least(0, hi - 8), greatest(0, lo - 6), -12, -4, 14, 8, kelvin, tnt, 8, -3, greatest(0, dn - 4), least(100, dn * 2) FROM E
    UNION ALL SELECT *, 'monochrome', base_intent, round_even(ev * 0.6::DOUBLE, 2), hi, lo, -10, 0, 18, 6, 0, 0, 0, 0, dn, 0 FROM E WHERE monochrome)"""
_longs = lambda *names: ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)
_AMOUNTS = ["highlights", "shadows", "blacks", "whites", "contrast", "clarity", "temperature", "tint", "vibrance", "saturation", "denoise", "denoise_color", "sharpening", "masking"]


@query(f"WITH {BASE_SQL} SELECT key, variant, intent, array_to_string(preserve, '; ') AS preserve, array_to_string(warnings, '; ') AS warnings, round_even(exposure_ev, 2) + 0.0 AS exposure_ev, round_even(rotation, 2) + 0.0 AS rotation, {_longs(*_AMOUNTS)} FROM R")
def recipe_generate(spark: SparkSession, d: str) -> DataFrame:
    """Every frame's variants with their adjustments, what they keep and what to beware of."""
    out = recipes.generate(frames(spark, d))
    return out.select("key", "variant", "intent", F.array_join("preserve", "; ").alias("preserve"), F.array_join("warnings", "; ").alias("warnings"), (F.col("exposure_ev") + 0.0).alias("exposure_ev"), (F.bround("rotation", 2) + 0.0).alias("rotation"), *_AMOUNTS)


_sign = lambda x: f"CASE WHEN {x} > 0 THEN '+' ELSE '' END || CAST({x} AS VARCHAR)"
_line = lambda label, x, unit="": f"CASE WHEN {x} <> 0 THEN '{label} ' || {_sign(f'CAST({x} AS BIGINT)')} || '{unit}' END"
_exposure = "CASE WHEN abs(exposure_ev) > 0.04 THEN 'Exposure ' || CASE WHEN exposure_ev > 0 THEN '+' ELSE '' END || regexp_replace(regexp_replace(CAST(exposure_ev AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') || ' EV' END"
_LINES = [_exposure] + [_line(label, column, unit) for label, column, unit, _ in recipes.LINES[1:]]
_LINES += ["CASE WHEN denoise <> 0 THEN 'Luminance denoise ' || denoise END", "CASE WHEN denoise_color <> 0 THEN 'Colour denoise ' || denoise_color END", "CASE WHEN sharpening <> 0 THEN 'Sharpening ' || sharpening || ' (masking ' || masking || ')' END"]
_LINES += ["CASE WHEN round_even(rotation, 6) <> 0 THEN 'Rotate ' || printf('%+.1f', rotation) || '°' END", "CASE WHEN variant = 'monochrome' THEN 'Convert to monochrome' END"]
_NOOP = " AND ".join(f"{x} = 0" for x in ["exposure_ev", *_AMOUNTS[:-1]])


@query(f"""WITH {BASE_SQL} SELECT key, variant, coalesce(nullif(array_to_string(list_filter([{", ".join(_LINES)}], lambda x: x IS NOT NULL), ' | '), ''), 'No adjustment: the frame is already where it should be.') AS description, {_NOOP} AS noop,
  has_dark OR has_blur AS keeps_mood FROM (SELECT * REPLACE (round_even(rotation, 6) AS rotation) FROM R)""")
def recipe_describe(spark: SparkSession, d: str) -> DataFrame:
    out = recipes.describe(recipes.generate(frames(spark, d)).withColumn("rotation", F.bround("rotation", 6)))
    return out.select("key", "variant", F.array_join("description", " | ").alias("description"), recipes.is_noop(out).alias("noop"), recipes.protects(F.col("preserve"), "low-key", "blur").alias("keeps_mood"))


@query(f"""WITH {FRAME_SQL} SELECT key, is_raw AND raw_available AND highlight_stops >= 0.25::DOUBLE AS recoverable, is_raw AND raw_available AND shadow_stops >= 0.5::DOUBLE AS liftable,
  CASE WHEN NOT raw_available THEN 'RAW measurements unavailable (no decoder)' ELSE printf('%.2f stops of highlight headroom above the rendered white point', highlight_stops) || '|' || printf('%.1f stops between saturation and the noise floor', shadow_stops)
    || CASE WHEN worst_clipped > 0.001::DOUBLE THEN '|G clips first at ' || printf('%.2f', round_even(worst_clipped * 100, 2)) || '%; all channels saturated on ' || printf('%.2f', round_even(all_clipped * 100, 2)) || '% of the frame' ELSE '' END
    || CASE WHEN all_clipped > 0.02::DOUBLE THEN '|' || printf('%.1f', round_even(all_clipped * 100, 1)) || '% of the frame has no data in any channel and cannot be recovered by any converter' ELSE '' END END AS lines FROM N""")
def raw_summary(spark: SparkSession, d: str) -> DataFrame:
    """What raw measurements allow, and say."""
    c, f = F.col, frames(spark, d)
    have = c("is_raw") & c("raw_available")
    lines = recipes.raw_lines(c("raw_available"), F.lit("no decoder"), c("highlight_stops"), c("shadow_stops"), F.lit("G"), c("worst_clipped"), c("all_clipped"))
    return f.select("key", recipes.can_recover_highlights(have, c("highlight_stops")).alias("recoverable"), recipes.can_lift_shadows(have, c("shadow_stops")).alias("liftable"), F.array_join(lines, "|").alias("lines"))


PIXEL_SQL = f"{BASE_SQL}, X AS (SELECT *, list_transform(range(60), lambda i: {duck(BEFORE)}) AS lb, list_transform(range(60), lambda i: {duck(AFTER).replace('0.0D', '0.0::DOUBLE').replace('0.5D', '0.5::DOUBLE')}) AS la, CASE WHEN key % 6 <> 0 THEN greatest(0.0, crop_right - crop_left) END AS crop_keeps FROM R)"
_share = lambda x, cond: f"(len(list_filter({x}, lambda v: {cond})) / 60.0::DOUBLE)"
_pairs = lambda cond: f"(len(list_filter(range(1, 61), lambda i: {cond})) / 60.0::DOUBLE)"


@query(f"""WITH {PIXEL_SQL}, Y AS (SELECT *, round_even({_pairs("la[i] >= 0.996 AND lb[i] < 0.996")}, 5) AS new_white, round_even({_pairs("la[i] <= 0.004 AND lb[i] > 0.004")}, 5) AS new_black, {_share("lb", "v < 0.25")} AS mb, {_share("la", "v < 0.25")} AS ma FROM X)
  SELECT key, variant, new_white, new_black, CASE WHEN has_dark THEN round_even(mb, 4) END AS mass_before, CASE WHEN has_dark THEN round_even(ma, 4) END AS mass_after,
  array_to_string(list_filter([CASE WHEN new_white > 0.015 THEN 'new_clipping' END, CASE WHEN new_black > 0.06 THEN 'new_crushing' END, CASE WHEN has_dark AND mb > 0.01 AND (mb - ma) / mb > 0.3 THEN 'low_key_flattened' END, CASE WHEN has_blur AND sharpening > 0 THEN 'sharpening_intentional_blur' END,
    CASE WHEN crop_keeps < 0.999 AND crop_confidence < 0.6::DOUBLE THEN 'low_confidence_crop' END, CASE WHEN crop_keeps < 0.999 AND crop_keeps < 0.55::DOUBLE THEN 'excessive_crop' END], lambda x: x IS NOT NULL), ',') AS violations FROM Y""")
def recipe_validate(spark: SparkSession, d: str) -> DataFrame:
    out = recipes.validate(edited(spark, d))
    return out.select("key", "variant", "new_white", "new_black", "mass_before", "mass_after", F.array_join("violations", ",").alias("violations"))


SCORED_SQL = f"""{PIXEL_SQL}, S AS (SELECT *, round_even(greatest(0.0, {_share("lb", "v < 0.03 OR v > 0.97")} - {_share("la", "v < 0.03 OR v > 0.97")}), 5) AS recovered_detail, round_even(greatest(0.0, 1 - 8 * {_share("la", "v <= 0.004 OR v >= 0.996")}), 5) AS clipping_safety,
  {_share("lb", "v < 0.25")} AS mb, {_share("la", "v < 0.25")} AS ma, abs(exposure_ev) / 2 + (abs(contrast) + abs(highlights) + abs(shadows) + abs(clarity)) / 400.0::DOUBLE + sharpening / 200.0::DOUBLE + denoise / 200.0::DOUBLE AS travel FROM X),
  T AS (SELECT *, round_even(greatest(0.0, 1 - travel), 5) AS restraint, list_filter([CASE WHEN has_dark THEN CASE WHEN mb > 0.01 THEN least(1.0::DOUBLE, ma / mb) ELSE 1.0::DOUBLE END END, CASE WHEN has_blur THEN CASE WHEN sharpening > 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END END, CASE WHEN has_tilt THEN CASE WHEN rotation <> 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END END], lambda x: x IS NOT NULL) AS parts FROM S),
  U AS (SELECT *, CASE WHEN len(parts) = 0 THEN 1.0::DOUBLE ELSE round_even(list_sum(parts) / len(parts), 5) END AS intent_preserved FROM T)"""


@query(f"WITH {SCORED_SQL} SELECT key, variant, recovered_detail, clipping_safety, intent_preserved, restraint FROM U")
def recipe_scores(spark: SparkSession, d: str) -> DataFrame:
    return recipes.candidate_scores(edited(spark, d)).select("key", "variant", "recovered_detail", "clipping_safety", "intent_preserved", "restraint")


_NAMES = ["recovered_detail", "clipping_safety", "intent_preserved", "restraint"]


@query(f"""WITH {SCORED_SQL}, P AS (SELECT key, variant, {", ".join(_NAMES)} FROM U), Q AS (SELECT * FROM P a WHERE NOT EXISTS (SELECT 1 FROM P b WHERE b.key = a.key AND b.variant <> a.variant AND {" AND ".join(f"b.{n} >= a.{n} - 1e-9" for n in _NAMES)} AND ({" OR ".join(f"b.{n} > a.{n} + 1e-9" for n in _NAMES)})))
  SELECT key, variant, row_number() OVER (PARTITION BY key ORDER BY CASE variant WHEN 'faithful' THEN 0 WHEN 'expressive' THEN 1 ELSE 2 END) AS place FROM Q""")
def recipe_choose(spark: SparkSession, d: str) -> DataFrame:
    """Of each frame's variants those that none dominates, in their order."""
    scored = recipes.candidate_scores(edited(spark, d)).select("key", "variant", *_NAMES)
    return recipes.choose(selection.skyline(scored, "key", "variant", _NAMES)).select("key", "variant", "place")
