"""Whether apparent defects look like decisions, and the white balance an exporter may write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Where a measurement speaks for a choice, and how far a verdict counts.
SOFT, SELECTIVE, DIRECTIONAL, DARK, LOW_KEY, TILT, SLIGHT_TILT, HIGH_KEY, BLOWN, HIGH_ISO = 6.0, 4.0, 0.7, 70.0, 90.0, 3.0, 0.5, 60.0, 0.10, 3200
COUNTS = {"likely_intentional": 1.0, "cannot_tell": 0.55, "likely_accidental": 0.0}


def signals(df: DataFrame) -> DataFrame:
    """The rows with `signals`, array<struct<defect, verdict, confidence>>: one for each apparent defect.

    Reads blur_ratio, sharp_global, sharp_tile, anisotropy, mean_luma, brightest, tilt, highlights, iso.
    """
    c = F.col
    soft, dark, tilted = c("blur_ratio") < SOFT, c("mean_luma") < DARK, F.abs("tilt")
    selective, moving = c("sharp_tile") > c("sharp_global") * SELECTIVE, c("anisotropy") >= DIRECTIONAL
    found = [
        (soft & selective, "softness", "likely_intentional", 0.75), (soft & ~selective & moving, "motion blur", "likely_intentional", 0.65), (soft & ~selective & ~moving, "softness", "cannot_tell", 0.35),
        (dark & (c("brightest") >= LOW_KEY), "darkness", "likely_intentional", 0.7), (dark & (c("brightest") < LOW_KEY), "darkness", "cannot_tell", 0.4),
        (tilted >= TILT, "tilted horizon", "likely_intentional", 0.6), ((tilted >= SLIGHT_TILT) & (tilted < TILT), "tilted horizon", "cannot_tell", 0.3),
        ((c("highlights") > BLOWN) & (c("mean_luma") >= HIGH_KEY), "blown highlights", "likely_intentional", 0.55), (c("iso") >= HIGH_ISO, "grain", "likely_intentional", 0.5),
    ]
    each = [F.when(rule, F.struct(F.lit(d).alias("defect"), F.lit(v).alias("verdict"), F.lit(s).alias("confidence"))) for rule, d, v, s in found]
    return df.withColumn("signals", F.filter(F.array(*each), lambda x: x.isNotNull()))


def intentionality(found: Column) -> Column:
    """0 to 100, high where defects look like decisions; 50 without any."""
    share = lambda x: F.when(x["verdict"] == "likely_intentional", COUNTS["likely_intentional"]).when(x["verdict"] == "cannot_tell", COUNTS["cannot_tell"]).otherwise(COUNTS["likely_accidental"])
    total = F.aggregate(found, F.lit(0.0), lambda s, x: s + share(x) * x["confidence"])
    possible = F.aggregate(found, F.lit(0.0), lambda s, x: s + x["confidence"])
    return F.when(possible > 0, F.bround(F.try_divide(100 * total, possible))).otherwise(50.0).cast("long")


def uncertainty(found: Column, present: Column) -> Column:
    open_ = F.size(F.filter(found, lambda x: x["verdict"] == "cannot_tell"))
    return F.least(F.lit(100), F.when(present, 30).otherwise(70) + 12 * open_).cast("long")


def rescued(route_class: Column, intent: Column, soft_dimensions: list[Column]) -> Column:
    """A class that destroys becomes review where any artistic signal speaks; no class becomes worse."""
    return F.when(route_class.isin("trash", "archive_only") & (F.greatest(intent, *soft_dimensions) >= 55), "review").otherwise(route_class)


def white_balance(is_raw: Column, delta: Column, tint: Column, as_shot: Column) -> Column:
    """A struct of temperature, tint (null if not written) and lost: rendered files take a relative value, raw files an absolute one or none."""
    relative = F.greatest(F.lit(-100), F.least(F.lit(100), F.bround(delta / 1000.0 * 12.0))).cast("long")
    absolute = F.greatest(F.lit(2000), F.least(F.lit(50000), as_shot + delta)).cast("long")
    some = (delta != 0) | (tint != 0)
    known = as_shot.isNotNull() & (as_shot != 0)
    limit = lambda most: F.when(tint != 0, F.greatest(F.lit(-most), F.least(F.lit(most), tint))).cast("long")
    temperature = F.when(some & ~is_raw & (relative != 0), relative).when(some & is_raw & known, absolute)
    return F.struct(temperature.alias("temperature"), F.when(some & ~is_raw, limit(100)).when(some & is_raw & known, limit(150)).alias("tint"), (some & is_raw & ~known).alias("lost"))
