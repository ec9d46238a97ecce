"""Edit recipes: what to change in a frame from its measurements, what to leave alone, and whether an edit kept to that.

Rows in, columns out. `signals` is array<struct<defect, verdict, evidence>>; frames for validation come as
flat arrays of light values from 0 to 1, before and after, of equal length. Rounding is half to even. Null or absent
signals count as none; repeated rows are treated alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.functions.bound import once

# Limits of lifts and pulls in stops, the middle grey aimed at, and the least clipping worth recovering.
MOST_LIFT, MOST_PULL, TARGET, LEAST_CLIPPED = 1.5, 1.0, 0.46, 0.002
#: Headroom in stops from which highlights are worth recovering and shadows worth lifting.
HIGHLIGHT_STOPS, SHADOW_STOPS = 0.25, 0.5
# What is kept for each kind of deliberate defect, and what to beware of.
KEPT = {
    "dark": ("the low-key structure and the weight of the shadows", "Lifting shadows past about +15 will flatten the low-key structure"),
    "blur": ("the intentional blur, which is carrying the frame", "Do not sharpen: the blur is the subject, not a defect"),
    "tilt": ("the deliberate tilt", "Do not straighten the horizon; the angle is doing work"),
    "grain": ("the natural grain", "Heavy denoise will remove the texture and the sense of presence"),
    "bright": ("the high-key treatment", None),
}
# The validator's limits.
NEW_CLIPPING, NEW_CRUSHING, LOW_KEY_LOSS, CROP_CONFIDENCE, CROP_KEEP = 0.015, 0.06, 0.3, 0.6, 0.55
VARIANTS = ["faithful", "expressive", "monochrome"]


def fixed(x: Column, places: int) -> Column:
    """A number as text with so many places, rounded half to even."""
    return F.format_string(f"%.{places}f", F.bround(x, places))


def can_recover_highlights(available: Column, stops: Column) -> Column:
    return available & (stops >= HIGHLIGHT_STOPS)


def can_lift_shadows(available: Column, stops: Column) -> Column:
    return available & (stops >= SHADOW_STOPS)


def deliberate(signals: Column) -> Column:
    return F.filter(F.coalesce(signals, F.array().cast("array<struct<defect:string,verdict:string,evidence:string>>")), lambda s: s["verdict"] == "likely_intentional")


def kept_kind(defect: Column) -> Column:
    """Which entry of KEPT a defect belongs to; null for those that nothing is kept for."""
    has = lambda w: F.contains(defect, F.lit(w))
    return F.when(defect == "darkness", "dark").when(has("motion") | (defect == "softness"), "blur").when(has("tilt"), "tilt").when(defect == "grain", "grain").when(has("highlight"), "bright")


def preserve_and_warnings(signals: Column) -> tuple[Column, Column]:
    """Texts of what the edit must keep, and of what to beware, in the signals' order."""
    kinds = F.transform(deliberate(signals), lambda s: kept_kind(s["defect"]))
    of = lambda i: F.create_map(*(F.lit(x) for k, v in KEPT.items() if v[i] is not None for x in (k, v[i])))
    texts = lambda i: F.filter(F.transform(kinds, lambda k: F.try_element_at(of(i), F.coalesce(k, F.lit("")))), lambda t: t.isNotNull())
    return texts(0), texts(1)


def protects(preserve: Column, *words: str) -> Column:
    """Whether one of the texts has one of the words, in any letter case."""
    return F.exists(preserve, lambda p: F.lower(p).rlike("|".join(words)))


def intent(signals: Column, mean_luma: Column) -> Column:
    own = deliberate(signals)
    any_ = lambda w: F.exists(own, lambda s: F.contains(s["defect"], F.lit(w)))
    dark = F.exists(own, lambda s: s["defect"] == "darkness")
    return (
        F.when(dark, "preserve_low_key_mood").when(any_("motion"), "preserve_motion").when(any_("tilt"), "preserve_deliberate_angle")
        .when(mean_luma < 70, "open_the_frame_without_flattening_it").otherwise("correct_only_what_limits_the_frame")
    )


def exposure(mean_luma: Column, is_raw: Column, available: Column, shadow_stops: Column) -> Column:
    """Stops towards middle grey; lifts stop where a raw file's shadows end."""
    needed = F.log2(TARGET * 255.0 / F.greatest(mean_luma, F.lit(1.0)))
    ceiling = F.when(is_raw & available, F.least(F.lit(MOST_LIFT), F.greatest(F.lit(0.0), shadow_stops))).otherwise(MOST_LIFT)
    return F.when(needed > 0, F.least(needed, ceiling)).otherwise(F.greatest(F.lit(-MOST_PULL), needed))


def highlights(is_raw: Column, available: Column, clipped_any: Column, blown: Column, stops: Column) -> Column:
    reach = -F.bround(20 + 35 * F.least(F.lit(1.0), stops / 2))
    return F.when(~(is_raw & available), -15.0).when(clipped_any < LEAST_CLIPPED, 0.0).when(blown > 0.05, -20.0).otherwise(reach).cast("long")


def shadows(mean_luma: Column, available: Column, shadow_stops: Column, preserve: Column) -> Column:
    lift = F.bround(F.least(F.lit(35.0), (110 - mean_luma) * 0.35))
    return F.when(protects(preserve, "low-key", "dark"), 6.0).when(mean_luma > 110, 0.0).when(available & ~can_lift_shadows(available, shadow_stops), 8.0).otherwise(lift).cast("long")


def white_balance(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """Kelvin and tint that take a cast back, within limits; black frames have none."""
    black = F.greatest(r, g, b) <= 1.0
    half = (r + b) / 2
    within = lambda x, most: F.greatest(F.lit(-float(most)), F.least(F.lit(float(most)), F.bround(x)))
    kelvin = within(-(r - b) / F.greatest(half, F.lit(1.0)) * 900, 1000)
    tint = within(-(g - half) / F.greatest(g, F.lit(1.0)) * 40, 30)
    return F.when(black, 0.0).otherwise(kelvin).cast("long"), F.when(black, 0.0).otherwise(tint).cast("long")


def denoise(noise: Column) -> Column:
    return F.when(noise <= 2.0, 0.0).otherwise(F.bround(F.least(F.lit(45.0), (noise - 2) * 6))).cast("long")


def sharpening(noise: Column, preserve: Column) -> tuple[Column, Column]:
    """Amount and masking; none where blur is kept."""
    soft = protects(preserve, "blur", "motion")
    return F.when(soft, 0).otherwise(20).cast("long"), F.when(soft, 0.0).otherwise(F.floor(F.least(F.lit(85.0), 40 + noise * 4))).cast("long")


def raw_lines(available: Column, reason: Column, headroom: Column, stops: Column, worst_name: Column, worst_clipped: Column, all_clipped: Column) -> Column:
    """What a raw file's measurements say, as lines; the worst channel is the one that clips most."""
    percent = lambda x, d: F.concat(fixed(x * 100, d), F.lit("%"))
    lines = [
        F.concat(fixed(headroom, 2), F.lit(" stops of highlight headroom above the rendered white point")),
        F.concat(fixed(stops, 1), F.lit(" stops between saturation and the noise floor")),
        F.when(worst_clipped > 0.001, F.concat(worst_name, F.lit(" clips first at "), percent(worst_clipped, 2), F.lit("; all channels saturated on "), percent(all_clipped, 2), F.lit(" of the frame"))),
        F.when(all_clipped > 0.02, F.concat(percent(all_clipped, 1), F.lit(" of the frame has no data in any channel and cannot be recovered by any converter"))),
    ]
    missing = F.array(F.concat(F.lit("RAW measurements unavailable ("), reason, F.lit(")")))
    return F.when(available, F.filter(F.array(*lines), lambda x: x.isNotNull())).otherwise(missing)


def generate(df: DataFrame) -> DataFrame:
    """A row for each variant of each frame, with its adjustments; `monochrome` says whether that variant is offered.

    Reads mean_luma, stddev_luma, mean_r, mean_g, mean_b, noise, tilt, is_raw, raw_available, highlight_stops, shadow_stops, clipped_any, blown, signals, monochrome.
    """
    c = F.col
    keep, warn = preserve_and_warnings(c("signals"))
    df = df.withColumns({"preserve": keep, "warnings": warn, "intent": intent(c("signals"), c("mean_luma")), "tilted": F.exists(deliberate(c("signals")), lambda s: F.contains(s["defect"], F.lit("tilt")))})
    kelvin, tint = white_balance(c("mean_r"), c("mean_g"), c("mean_b"))
    sharp, mask = sharpening(c("noise"), c("preserve"))
    df = df.withColumns({
        "ev": exposure(c("mean_luma"), c("is_raw"), c("raw_available"), c("shadow_stops")), "hi": highlights(c("is_raw"), c("raw_available"), c("clipped_any"), c("blown"), c("highlight_stops")),
        "lo": shadows(c("mean_luma"), c("raw_available"), c("shadow_stops"), c("preserve")), "kelvin": kelvin, "tint": tint, "dn": denoise(c("noise")), "sharpening": sharp, "masking": mask,
        "rotation": F.when(c("tilted"), 0.0).otherwise(-c("tilt")), "tone_confidence": F.when(c("is_raw") & c("raw_available"), 0.85).otherwise(0.5), "detail_confidence": F.when(c("noise") > 0, 0.7).otherwise(0.5),
    })
    offered = F.when(c("monochrome"), F.array(*map(F.lit, VARIANTS))).otherwise(F.array(*map(F.lit, VARIANTS[:2])))
    df = df.withColumn("variant", F.explode(offered))
    by = lambda faithful, expressive, mono: F.when(c("variant") == "faithful", faithful).when(c("variant") == "expressive", expressive).otherwise(mono)
    whole = lambda x: F.lit(x).cast("long") if isinstance(x, int) else x.cast("long")
    zero = whole(0)
    return df.withColumns({
        "exposure_ev": by(F.bround(c("ev"), 2), F.bround(c("ev") * 0.45, 2), F.bround(c("ev") * 0.6, 2)),
        "highlights": by(c("hi"), F.least(zero, c("hi") - 8), c("hi")), "shadows": by(c("lo"), F.greatest(zero, c("lo") - 6), c("lo")),
        "blacks": by(F.when(c("lo") > 0, whole(-4)).otherwise(zero), whole(-12), whole(-10)), "whites": by(zero, whole(-4), zero),
        "contrast": by(F.when(c("stddev_luma") < 45, whole(6)).otherwise(zero), whole(14), whole(18)), "clarity": by(zero, whole(8), whole(6)),
        "temperature": by(c("kelvin"), c("kelvin"), zero), "tint": by(c("tint"), c("tint"), zero), "vibrance": by(whole(4), whole(8), zero), "saturation": by(zero, whole(-3), zero),
        "denoise": by(c("dn"), F.greatest(zero, c("dn") - 4), c("dn")), "denoise_color": by(F.least(whole(100), c("dn") * 2), F.least(whole(100), c("dn") * 2), zero),
        "intent": F.when(c("variant") == "expressive", F.concat("intent", F.lit(" (strengthened)"))).otherwise(c("intent")),
    }).drop("ev", "hi", "lo", "kelvin", "dn", "tilted")


# The lines of a description, with the columns they show, their units, and what is too little to show.
LINES = [("Exposure", "exposure_ev", " EV", 0.04), ("Contrast", "contrast", "", 0), ("Highlights", "highlights", "", 0), ("Shadows", "shadows", "", 0), ("Whites", "whites", "", 0), ("Blacks", "blacks", "", 0), ("Temperature", "temperature", " K", 0), ("Tint", "tint", "", 0), ("Clarity", "clarity", "", 0), ("Vibrance", "vibrance", "", 0), ("Saturation", "saturation", "", 0)]


def signed(x: Column) -> Column:
    """A number as text with its sign and without trailing zeros."""
    body = F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(x > 0, F.concat(F.lit("+"), body)).otherwise(body)


def describe(df: DataFrame, name: str = "description") -> DataFrame:
    """The rows with the lines a person reads about a recipe."""
    c = F.col
    lines = [F.when(F.abs(c(column)) > least, F.concat(F.lit(label + " "), signed(c(column)), F.lit(unit))) for label, column, unit, least in LINES]
    lines += [
        F.when(c("denoise") != 0, F.concat(F.lit("Luminance denoise "), c("denoise").cast("string"))), F.when(c("denoise_color") != 0, F.concat(F.lit("Colour denoise "), c("denoise_color").cast("string"))),
        F.when(c("sharpening") != 0, F.concat(F.lit("Sharpening "), c("sharpening").cast("string"), F.lit(" (masking "), c("masking").cast("string"), F.lit(")"))),
        F.when(c("rotation") != 0, F.concat(F.lit("Rotate "), F.when(c("rotation") > 0, "+").otherwise(""), fixed(c("rotation"), 1), F.lit("°"))),
        F.when(c("variant") == "monochrome", "Convert to monochrome"),
    ]
    shown = F.filter(F.array(*lines), lambda x: x.isNotNull())
    return df.withColumn(name, F.when(F.size(shown) > 0, shown).otherwise(F.array(F.lit("No adjustment: the frame is already where it should be."))))


def is_noop(df: DataFrame) -> Column:
    """Nothing in tone, colour or detail is changed."""
    out = F.lit(True)
    for name in ("exposure_ev", "highlights", "shadows", "blacks", "whites", "contrast", "clarity", "temperature", "tint", "vibrance", "saturation", "denoise", "denoise_color", "sharpening"):
        out = out & (F.col(name) == 0)
    return out


def crop_keeps(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.greatest(F.lit(0.0), right - left) * F.greatest(F.lit(0.0), bottom - top)


def share(values: Column, holds) -> Column:
    """The share of an array's elements for which a condition holds; 0 for empty arrays."""
    return F.coalesce(F.try_divide(F.size(F.filter(values, holds)).cast("double"), F.size(values).cast("double")), F.lit(0.0))


def both_share(before: Column, after: Column, holds) -> Column:
    """The share of places where a condition on both frames holds."""
    return share(F.arrays_zip(before.alias("a"), after.alias("b")), lambda z: holds(z["a"], z["b"]))


def validate(df: DataFrame) -> DataFrame:
    """The rows with measurements and `violations`: of light values before and after, the recipe's `preserve` and sharpening, and its crop.

    Reads luma_before, luma_after (arrays), preserve, sharpening, crop_confidence and crop_keeps (null without a crop).
    """
    c = F.col
    mass = lambda x: share(x, lambda v: v < 0.25)
    dark = F.exists("preserve", lambda p: F.lower(p).rlike("low-key|shadow"))
    # Light is moved from and to the last steps of 8 bits; these are the bounds in shares of full light.
    df = df.withColumns({
        "new_white": F.bround(both_share(c("luma_before"), c("luma_after"), lambda a, b: (b >= 0.996) & (a < 0.996)), 5), "new_black": F.bround(both_share(c("luma_before"), c("luma_after"), lambda a, b: (b <= 0.004) & (a > 0.004)), 5),
        "mass_before": F.when(dark, F.bround(mass(c("luma_before")), 4)), "mass_after": F.when(dark, F.bround(mass(c("luma_after")), 4)), "_lost": F.try_divide(mass(c("luma_before")) - mass(c("luma_after")), mass(c("luma_before"))), "_mass": mass(c("luma_before")),
    })
    cropped = c("crop_keeps").isNotNull() & (c("crop_keeps") < 0.999)
    rules = [
        ("new_clipping", c("new_white") > NEW_CLIPPING), ("new_crushing", c("new_black") > NEW_CRUSHING), ("low_key_flattened", dark & (c("_mass") > 0.01) & (c("_lost") > LOW_KEY_LOSS)),
        ("sharpening_intentional_blur", protects(c("preserve"), "blur", "motion") & (c("sharpening") > 0)), ("low_confidence_crop", cropped & (c("crop_confidence") < CROP_CONFIDENCE)), ("excessive_crop", cropped & (c("crop_keeps") < CROP_KEEP)),
    ]
    return df.withColumn("violations", F.filter(F.array(*(F.when(rule, code) for code, rule in rules)), lambda x: x.isNotNull())).drop("_lost", "_mass")


def candidate_scores(df: DataFrame) -> DataFrame:
    """The rows with recovered_detail, clipping_safety, intent_preserved and restraint of an edit; reads what `validate` reads and the adjustments."""
    c = F.col
    hidden = lambda x: share(x, lambda v: (v < 0.03) | (v > 0.97))
    mass = lambda x: share(x, lambda v: v < 0.25)
    clipped = share(c("luma_after"), lambda v: (v <= 0.004) | (v >= 0.996))
    travel = F.abs(c("exposure_ev")) / 2 + (F.abs(c("contrast")) + F.abs(c("highlights")) + F.abs(c("shadows")) + F.abs(c("clarity"))) / 400.0 + c("sharpening") / 200.0 + c("denoise") / 200.0
    parts = F.filter(F.array(
        F.when(F.exists("preserve", lambda p: F.lower(p).rlike("low-key|shadow")), once(mass(c("luma_before")), lambda m: F.when(m > 0.01, F.least(F.lit(1.0), F.try_divide(mass(c("luma_after")), m))).otherwise(1.0))),
        F.when(protects(c("preserve"), "blur", "motion"), F.when(c("sharpening") > 0, 0.0).otherwise(1.0)), F.when(protects(c("preserve"), "tilt"), F.when(c("rotation") != 0, 0.0).otherwise(1.0)),
    ), lambda x: x.isNotNull())
    kept = once(parts, lambda p: F.coalesce(F.try_divide(F.aggregate(p, F.lit(0.0), lambda a, x: a + x), F.size(p).cast("double")), F.lit(1.0)))
    return df.withColumns({
        "recovered_detail": F.bround(F.greatest(F.lit(0.0), hidden(c("luma_before")) - hidden(c("luma_after"))), 5), "clipping_safety": F.bround(F.greatest(F.lit(0.0), 1 - clipped * 8), 5),
        "intent_preserved": F.bround(kept, 5), "restraint": F.bround(F.greatest(F.lit(0.0), 1 - travel), 5),
    })


def choose(front: DataFrame, key: str = "key", limit: int = 3) -> DataFrame:
    """Of the variants that none dominates, the first by the order of VARIANTS, with their `place`."""
    from vellumine.operators.selection import top_per

    order = F.coalesce(F.array_position(F.array(*map(F.lit, VARIANTS)), F.col("variant")), F.lit(0))
    return top_per(front.withColumn("_order", F.when(order == 0, 9).otherwise(order)), key, ["_order", "variant"], limit).drop("_order")
