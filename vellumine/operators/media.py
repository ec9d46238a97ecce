"""Assets from files, staleness, issues from measurements, and clips' usable segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions.text import media_kind, photo_format

# Limits of the photo measurements.
BLUR_MISSED, BLUR_SOFT, HIGHLIGHT_SOME, HIGHLIGHT_SEVERE, SHADOW_SOME, SHADOW_SEVERE = 2.0, 6.0, 0.03, 0.35, 0.15, 0.70
NOISE_MILD, NOISE_HEAVY, DARK, BRIGHT, FLAT, CAST, LEAST_MEGAPIXELS = 3.0, 8.0, 70.0, 200.0, 28.0, 1.18, 1.0
SEGMENT_QUALITY, BLACK, HANDLE, LEAST_SEGMENT = 35.0, 12.0, 0.5, 3.0


def group_assets(files: DataFrame) -> DataFrame:
    """(dir, stem, primary, siblings, n): one asset for each folder and stem; raw before video before others, then by path."""
    name = F.element_at(F.split("path", "/"), -1)
    df = files.select("path", F.regexp_replace("path", r"/[^/]*$", "").alias("dir"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"))
    order = F.when(photo_format(F.col("path")) == "RAW", 0).when(media_kind(F.col("path")) == "video", 1).otherwise(2)
    all_ = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("path").alias("p"))))
    return df.groupBy("dir", "stem").agg(all_.alias("f")).select("dir", "stem", F.col("f")[0]["p"].alias("primary"), F.transform(F.slice("f", 2, 1 << 20), lambda x: x["p"]).alias("siblings"), F.size("f").cast("long").alias("n"))


def with_checksum(df: DataFrame, content: str) -> DataFrame:
    sha = F.sha2(F.col(content).cast("binary"), 256)
    return df.withColumns({"checksum": sha, "asset_id": F.substring(sha, 1, 16)})


def state_changes(before: DataFrame, now: DataFrame, path: str = "path") -> DataFrame:
    """(path, state): missing, same (size and checksum), touched (checksum same, time not), changed or added."""
    b = before.select(path, *(F.col(c).alias(f"_{c}") for c in ("size", "modified", "checksum")))
    j = b.join(now, path, "full")
    state = F.when(F.col("checksum").isNull(), "missing").when(F.col("_checksum").isNull(), "added").when(F.col("size") != F.col("_size"), "changed").when(F.col("checksum") != F.col("_checksum"), "changed").when(F.col("modified") != F.col("_modified"), "touched").otherwise("same")
    return j.select(path, state.alias("state"))


def photo_issues(df: DataFrame) -> DataFrame:
    """The rows with `issues`, array<struct<code, certainty>> in a fixed order. Reads blur_ratio, highlights, shadows, megapixels, mean_luma, stddev_luma, red, green, blue, noise, is_raw."""
    c = F.col
    severe = F.when(c("is_raw"), HIGHLIGHT_SEVERE * 2).otherwise(HIGHLIGHT_SEVERE)
    cast = F.greatest("red", "green", "blue") / F.greatest(F.least("red", "green", "blue"), F.lit(1.0))
    found = [
        (c("blur_ratio") < BLUR_MISSED, "missed_focus", 1.0), ((c("blur_ratio") >= BLUR_MISSED) & (c("blur_ratio") < BLUR_SOFT), "soft_focus", 0.6), (c("highlights") > severe, "blown_highlights", 1.0),
        ((c("highlights") <= severe) & (c("highlights") > HIGHLIGHT_SOME), "some_clipped_highlights", 0.7), (c("shadows") > SHADOW_SEVERE, "crushed_shadows", 1.0), ((c("shadows") <= SHADOW_SEVERE) & (c("shadows") > SHADOW_SOME), "some_crushed_shadows", 0.7),
        (c("megapixels") < LEAST_MEGAPIXELS, "insufficient_resolution", 1.0), (c("mean_luma") < DARK, "underexposed", 1.0), (c("mean_luma") > BRIGHT, "overexposed", 1.0), (c("stddev_luma") < FLAT, "flat_contrast", 1.0),
        (cast > CAST, "color_cast", 0.5), (c("noise") > NOISE_HEAVY, "heavy_noise", 1.0), ((c("noise") <= NOISE_HEAVY) & (c("noise") > NOISE_MILD), "mild_noise", 1.0),
    ]
    each = [F.when(rule, F.struct(F.lit(code).alias("code"), F.lit(sure).alias("certainty"))) for rule, code, sure in found]
    return df.withColumn("issues", F.filter(F.array(*each), lambda x: x.isNotNull()))


def usable_segments(samples: DataFrame, clip: str = "clip") -> DataFrame:
    """(clip, start, end, mean_quality): runs of good samples without gaps, cut by a handle at both ends, long enough.

    Reads ts, quality, mean_luma and duration (of the clip). The step between samples is the duration over their number.
    """
    n = F.count("*").over(Window.partitionBy(clip))
    good = samples.withColumn("_step", F.col("duration") / n).where((F.col("quality") >= SEGMENT_QUALITY) & (F.col("mean_luma") > BLACK))
    order = Window.partitionBy(clip).orderBy("ts")
    joined = F.coalesce(F.col("ts") - F.lag("ts").over(order) <= F.col("_step") * 1.6, F.lit(False))
    runs = good.withColumn("_new", F.when(joined, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order))
    each = runs.groupBy(clip, "_run").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.avg(F.col("quality").cast("decimal(18,4)")).alias("q"), F.first("_step").alias("s"), F.first("duration").alias("d"))
    start, end = F.greatest(F.lit(0.0), F.col("a") - F.col("s") / 2 + HANDLE), F.least(F.col("d"), F.col("b") + F.col("s") / 2 - HANDLE)
    return each.where(end - start >= LEAST_SEGMENT).select(clip, F.bround(start, 3).alias("start"), F.bround(end, 3).alias("end"), F.bround("q", 2).cast("double").alias("mean_quality"))


def exposure_stability(samples: DataFrame, clip: str = "clip", key: str | None = None) -> DataFrame:
    """(clip, n, mean_quality, focus_consistency, exposure_range, flicker) of each clip's samples; those of one time follow each other by `key`, without one in no fixed order."""
    order = Window.partitionBy(clip).orderBy("ts", *[key] * (key is not None))
    d = samples.withColumn("_d", F.abs(F.col("mean_luma") - F.lag("mean_luma").over(order)))
    out = d.groupBy(clip).agg(F.count("*").alias("n"), F.bround(F.avg("quality"), 2).alias("mean_quality"), F.stddev_pop("sharpness").alias("sd"), F.avg("sharpness").alias("m"), (F.max("mean_luma") - F.min("mean_luma")).alias("r"), F.stddev_pop("_d").alias("fl"))
    focus = F.when(F.col("n") < 2, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_divide("sd", "m"), F.lit(1.0))))
    return out.select(clip, "n", "mean_quality", F.bround(focus, 4).alias("focus_consistency"), F.bround("r", 4).alias("exposure_range"), F.bround(F.when(F.col("n") >= 3, F.col("fl")).otherwise(0.0), 4).alias("flicker"))


def parse_probe(df: DataFrame, text: str) -> DataFrame:
    """(…, has_video, width, height, duration, frame_rate, orientation, corrupt) from a container probe's JSON."""
    schema = "format struct<format_name:string,duration:string>, streams array<struct<codec_type:string,codec_name:string,width:int,height:int,duration:string,r_frame_rate:string>>"
    from vellumine.functions.numbers import parse_ratio

    p = df.withColumn("_p", F.from_json(text, schema)).withColumn("_v", F.try_element_at(F.filter("_p.streams", lambda s: s["codec_type"] == "video"), F.lit(1)))
    w, h = F.coalesce("_v.width", F.lit(0)), F.coalesce("_v.height", F.lit(0))
    p = p.withColumns({"has_video": F.col("_v").isNotNull(), "width": w, "height": h, "duration": F.coalesce(F.col("_v.duration").try_cast("double"), F.col("_p.format.duration").try_cast("double"), F.lit(0.0)), "frame_rate": parse_ratio(F.coalesce("_v.r_frame_rate", F.lit("")))})
    ratio = F.try_divide(F.col("width"), F.col("height"))
    orient = F.when(F.abs(ratio - 1) <= 0.05, "square").when(ratio > 1, "horizontal").otherwise("vertical")
    return p.withColumns({"orientation": orient, "corrupt": ~F.col("has_video") | (F.col("width") == 0) | (F.col("height") == 0) | (F.col("duration") <= 0)}).drop("_p", "_v")


def video_issues(df: DataFrame) -> DataFrame:
    """The rows with `issues`, codes joined by commas. Reads corrupt, duration, width, height, samples, segments, first_start, jitter, shear, focus_consistency, exposure_range, flicker, black, audio, channels."""
    c = F.col
    no_samples = c("samples") == 0
    rest = [
        F.when(c("duration") < 0.4, "unusable_duration").when(c("duration") < 3, "short_clip"), F.when(c("width") * c("height") / 1e6 < 1.9, "insufficient_resolution"), F.when(no_samples, "encoding_corruption"),
        F.when(~no_samples & (c("segments") == 0), "no_usable_segment").when(~no_samples & ((c("duration") > 60) | (c("first_start") > HANDLE)), "needs_trim"),
        F.when(~no_samples & (c("jitter") >= 4.5), "unusable_shake").when(~no_samples & (c("jitter") >= 1.6), "moderate_shake"), F.when(~no_samples & (c("shear") >= 2.5), "rolling_shutter"), F.when(~no_samples & (c("focus_consistency") < 0.45), "broken_focus_pull"),
        F.when(~no_samples & (c("exposure_range") > 42), "exposure_drift"), F.when(~no_samples & (c("flicker") > 9), "exposure_drift"), F.when(~no_samples & (c("black") == c("samples")), "empty_frame").when(~no_samples & (c("black") > 0), "needs_trim"),
        F.when(~no_samples & c("audio") & (c("channels") == 0), "unusable_audio"),
    ]
    return df.withColumn("issues", F.when(c("corrupt"), "encoding_corruption").otherwise(F.concat_ws(",", *rest)))


def sample_times(duration, count: int = 9):
    """Evenly spaced times with an inset at both ends; the middle alone for clips of up to two seconds."""
    inset = F.least(F.lit(0.5), duration * 0.05)
    many = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.bround(inset + (duration - 2 * inset) * i / (count - 1), 3))
    return F.when(duration <= 0, F.array().cast("array<double>")).when(duration <= 2, F.array(F.bround(duration / 2, 3))).otherwise(many)
