"""Where an asset may be published: technical limits and provenance rules, asset by platform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "platform string, photo_min double, photo_max double, formats array<string>, video_min double, video_max double, ideal_min double, ideal_max double, min_width long, min_height long, containers array<string>, ai string, exclusive boolean"

# Limits of eight platforms by their ids, as checked on 2026-08-11; rule set 2026.08.11.
NAMES = {"adobe_stock": "Adobe Stock", "shutterstock": "Shutterstock", "getty_istock": "Getty Images / iStock", "alamy": "Alamy", "pond5": "Pond5", "dreamstime": "Dreamstime", "depositphotos": "Depositphotos", "123rf": "123RF"}
RULES = [
    ("adobe_stock", 4.0, 100.0, ["JPEG"], 5.0, 60.0, 10.0, 20.0, 1920, 1080, ["mov", "mp4", "mpeg"], "accepted_with_label", False),
    ("shutterstock", 4.0, None, ["JPEG"], 5.0, 60.0, None, None, 1920, 1080, ["mov", "mp4"], "rejected", False),
    ("getty_istock", 4.0, None, ["JPEG"], 5.0, 60.0, None, None, 1920, 1080, ["mov", "mp4"], "rejected", True),
    ("alamy", 4.0, None, ["JPEG", "TIFF"], 5.0, 120.0, None, None, 1920, 1080, ["mov", "mp4"], "rejected", False),
    ("pond5", 4.0, None, ["JPEG"], 3.0, 600.0, None, None, 1280, 720, ["mov", "mp4", "mxf"], "accepted_with_label", False),
    ("dreamstime", 3.0, None, ["JPEG"], 5.0, 120.0, None, None, 1280, 720, ["mov", "mp4"], "accepted_with_label", False),
    ("depositphotos", 4.0, None, ["JPEG"], 5.0, 60.0, None, None, 1920, 1080, ["mov", "mp4"], "accepted_with_label", False),
    ("123rf", 4.0, None, ["JPEG"], 5.0, 60.0, None, None, 1920, 1080, ["mov", "mp4"], "accepted_with_label", False),
]


def rules(spark: SparkSession, rows: list[tuple] = RULES) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


def container_matches(reported: Column, accepted: Column) -> Column:
    return F.arrays_overlap(F.transform(F.split(reported, ","), lambda x: F.lower(F.trim(x))), accepted)


def evaluate(assets: DataFrame, platforms: DataFrame) -> DataFrame:
    """The product with `blockers` (comma list of codes), `conflict`, `eligible`, `suitability`.

    Reads kind, megapixels, format, duration, width, height, container, stock_potential, generative, uncertain_origin.
    Platforms are a table of a few rows, broadcast.
    """
    c = F.col
    photo, video = c("kind") == "photo", c("kind") == "video"
    fits = (c("width") >= c("min_width")) & (c("height") >= c("min_height")) | (c("width") >= c("min_height")) & (c("height") >= c("min_width"))
    conflict = F.when(c("generative") & (c("ai") == "rejected"), "blocking").when(c("generative") & (c("ai") == "accepted_with_label"), "action_required").when(c("uncertain_origin") & (c("ai") == "rejected"), "advisory")
    codes = [
        F.when(photo & (c("megapixels") < c("photo_min")), "too_small"), F.when(photo & (c("megapixels") > c("photo_max")), "too_large"), F.when(photo & ~F.array_contains("formats", F.upper("format")), "format"),
        F.when(video & (c("duration") < c("video_min")), "too_short"), F.when(video & (c("duration") > c("video_max")), "too_long"), F.when(video & ~fits, "resolution"),
        F.when(video & (c("container") != "") & ~container_matches(c("container"), c("containers")), "container"), F.when(conflict == "blocking", "generative"),
    ]
    bonus = F.when(photo & (c("megapixels") >= c("photo_min") * 3), 6).when(video & (c("duration") >= c("ideal_min")) & (c("duration") <= c("ideal_max")), 8).otherwise(0) - F.when(c("exclusive"), 10).otherwise(0)
    df = assets.crossJoin(F.broadcast(platforms)).withColumns({"blockers": F.concat_ws(",", *codes), "conflict": conflict})
    df = df.withColumn("eligible", F.col("blockers") == "")
    return df.withColumn("suitability", F.when(F.col("eligible"), F.greatest(F.lit(0), F.least(F.lit(100), c("stock_potential") + bonus))).otherwise(0).cast("long"))


def provenance(df: DataFrame) -> DataFrame:
    """The rows with `provenance` from source_type, software, has_camera, scanned: the first rule that holds."""
    s, w = F.lower("source_type"), F.lower("software")
    rule = (
        F.when(s.contains("trainedalgorithmicmedia"), "generative").when(s.contains("compositewithtrained"), "generative_edit").when(w.rlike("midjourney|stable diffusion|dall|firefly"), "generative")
        .when(w.rlike("photoshop|lightroom|capture one"), "edited").when(F.col("has_camera") & F.col("scanned"), "camera_original").otherwise("unknown")
    )
    return df.withColumn("provenance", rule)
