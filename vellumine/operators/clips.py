"""Facts about clips from their container and from the movement between neighbouring frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Transfer curves and words of profiles that mark flat or high-range footage.
FLAT_TRANSFERS, FLAT_HINTS = ["arib-std-b67", "smpte2084", "log", "bt2020-10", "bt2020-12"], ["log", "slog", "vlog", "clog", "hlg", "flat"]
#: Movement in pixels below which a clip stands still, luminance up to which a frame is black, mean difference below which two are one.
STILL, BLACK, FROZEN = 0.5, 12.0, 0.6


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.coalesce(F.bround(F.try_divide(width.cast("double"), height.cast("double")), 3), F.lit(0.0))


def orientation(width: Column, height: Column) -> Column:
    unknown = (F.coalesce(width, F.lit(0)) == 0) | (F.coalesce(height, F.lit(0)) == 0)
    return F.when(unknown, "unknown").when(F.abs(aspect_ratio(width, height) - 1) < 0.05, "square").when(width > height, "horizontal").otherwise("vertical")


def variable_rate(nominal: Column, average: Column) -> Column:
    """Both rates are known and differ by more than a fiftieth of the nominal one."""
    return F.coalesce((nominal != 0) & (average != 0) & (F.abs(nominal - average) / F.greatest(nominal, F.lit(1e-6)) > 0.02), F.lit(False))


def flat_footage(transfer: Column, profile: Column) -> Column:
    return F.lower(F.coalesce(transfer, F.lit(""))).isin(FLAT_TRANSFERS) | F.lower(F.coalesce(profile, F.lit(""))).rlike("|".join(FLAT_HINTS))


def slow_motion(rate: Column) -> Column:
    return rate >= 100


def time_lapse(rate: Column) -> Column:
    return (rate > 0) & (rate <= 12)


def burst_starts(duration: Column, count: int) -> Column:
    """Where short runs of frames are taken: the middles of `count` equal parts of what leaves a second at the end."""
    usable = F.greatest(F.lit(0.0), duration - 1)
    places = [usable / 2] if count == 1 else [F.bround(usable * (i + 0.5) / count, 3) for i in range(count)]
    return F.when((duration > 0) & F.lit(count >= 1), F.array(*places)).otherwise(F.array().cast("array<double>"))


def motion(shifts: DataFrame) -> DataFrame:
    """(clip, burst, pan, jitter, shear, frozen): the mean shift is the pan, its spread the shake. Reads clip, burst, dx, dy, shear, difference of each pair of frames."""
    length = lambda x, y: F.bround(F.sqrt(x * x + y * y), 3)
    return shifts.groupBy("clip", "burst").agg(
        length(F.avg("dx"), F.avg("dy")).alias("pan"), length(F.stddev_pop("dx"), F.stddev_pop("dy")).alias("jitter"), F.bround(F.max("shear"), 3).alias("shear"), F.count_if(F.col("difference") < FROZEN).alias("frozen")
    )


def combined_motion(bursts: DataFrame) -> DataFrame:
    """(clip, pan, jitter, shear, frozen, movement): the worst of a clip's bursts, and what the camera did."""
    worst = bursts.groupBy("clip").agg(F.max("pan").alias("pan"), F.max("jitter").alias("jitter"), F.max("shear").alias("shear"), F.sum("frozen").alias("frozen"))
    return worst.withColumn("movement", camera_movement(F.col("pan"), F.col("jitter")))


def camera_movement(pan: Column, jitter: Column) -> Column:
    return F.when((pan < STILL) & (jitter < STILL), "static").when(pan > jitter * 1.5, "pan or tilt").otherwise("handheld")


def clip_summary(samples: DataFrame) -> DataFrame:
    """(clip, poster, black_frames): the time of the best sample, the first among equals, and how many samples are black."""
    return samples.groupBy("clip").agg(F.max_by("ts", F.struct("quality", -F.col("ts"))).alias("poster"), F.count_if(F.col("mean_luma") <= BLACK).alias("black_frames"))


def longest_segment(segments: DataFrame, group: str = "clip") -> DataFrame:
    """Each clip's longest segment by its duration to 3 places, the first among equals; reads start and end."""
    duration = F.bround(F.col("end") - F.col("start"), 3)
    best = F.max_by(F.struct("start", "end", duration.alias("duration")), F.struct(duration, -F.col("start")))
    return segments.groupBy(group).agg(best.alias("s")).select(group, "s.start", "s.end", "s.duration")
