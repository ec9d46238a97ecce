"""Stored state: overrides that can be taken back, what a run would delete or publish, questions about bursts, templates of texts, faces' boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions.numbers import rank_to_percentile

# Where each class is put when files are dealt into folders.
FOLDERS = {"trash": "proposed_for_removal", "review": "manual_review", "archive_only": "archive", "duplicate_candidate": "duplicate_review", "stock_standard": "stock/standard", "stock_strong": "stock/strong", "flagship": "portfolio/flagship"}
#: What an axis is without a group to rank it in.
UNKNOWN_AXIS = 50


def current(log: DataFrame, key: str = "asset_id", at: str = "seq") -> DataFrame:
    """(key, value): the last entry of each key, without those whose last entry took it back (value null)."""
    return log.groupBy(key).agg(F.max_by("value", at).alias("value")).where("value IS NOT NULL")


def captured(records: DataFrame) -> DataFrame:
    """Records as overrides to be: what the tool said, with its scores as a text in the order of their names."""
    scores = F.array_join(F.transform(F.array_sort(F.map_keys("scores")), lambda k: F.concat(k, F.lit("="), F.element_at("scores", k).cast("string"))), ",")
    return records.select("asset_id", "checksum", "filename", F.col("route_class").alias("tool_said"), scores.alias("tool_scores"))


def distribution(records: DataFrame) -> DataFrame:
    """(filename, destination): the folder of each record's class; unknown classes have none."""
    return records.select("filename", F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in FOLDERS.items() for x in pair)), F.col("route_class")), F.lit("")).alias("destination"))


def delete_candidates(records: DataFrame) -> DataFrame:
    """(source_path, reason, line): records for removal with a line that no odd name can break, as the path is JSON."""
    reason = F.coalesce(F.nullif(F.array_join("reasons", "; "), F.lit("")), F.lit("below every threshold"))
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("source_path").alias("p"))), r'^\{"p":(.*)\}$', 1)
    return records.where("route_class = 'trash'").select("source_path", reason.alias("reason"), F.concat(quoted, F.lit("\t"), reason).alias("line"))


def burst_questions(records: DataFrame) -> DataFrame:
    """(cluster_id, first, second, value, margin): one question about each cluster's first two members, worth more if they are close."""
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy("asset_id"))
    two = records.where((F.col("cluster_id").cast("string") != "") & (F.col("cluster_size") > 1)).withColumn("_p", place).where("_p <= 2")
    pair = two.groupBy("cluster_id").agg(F.min_by("asset_id", "_p").alias("first"), F.max_by("asset_id", "_p").alias("second"), F.count("*").alias("_n"), F.abs(F.max_by("quality", "_p") - F.min_by("quality", "_p")).alias("margin"))
    return pair.where("_n = 2").select("cluster_id", "first", "second", F.when(F.col("margin") < 5, 1.0).otherwise(0.5).alias("value"), "margin")


def alternatives(frames: DataFrame, group: str, margin: float = 10.0) -> DataFrame:
    """(group, similar): whether a group's frames can't be told apart by quality; one with two reads ten apart is still a choice, one frame is none."""
    spread = lambda c: F.max(c) - F.min(c)
    return frames.groupBy(group).agg(((F.count("*") >= 2) & F.coalesce(spread("quality") < margin, F.lit(False))).alias("similar"))


def semantic(df: DataFrame) -> DataFrame:
    """The rows with axes as percentiles of their group: ranks from 1 (best) among group_size, UNKNOWN_AXIS where there is no group."""
    axis = lambda c: F.when(F.col("group_size").isNull(), F.lit(UNKNOWN_AXIS).cast("long")).otherwise(rank_to_percentile(F.col(c), F.col("group_size")))
    return df.withColumns({c: axis(c) for c in ("axis_a", "axis_b", "axis_c")})


def localised(df: DataFrame, templates: DataFrame, default: str = "en") -> DataFrame:
    """The rows of (key, language, params map, text) with `shown`: the template of their language, else of the default, with its {names} filled; else their own text, else the key.

    Templates: (key, language, template), few. Names that have no value stay as they are.
    """
    own = F.broadcast(templates.select(F.col("key"), F.col("language"), F.col("template").alias("_own")))
    other = F.broadcast(templates.where(F.col("language") == default).select("key", F.col("template").alias("_other")))
    j = df.join(own, ["key", "language"], "left").join(other, "key", "left").withColumn("_t", F.coalesce("_own", "_other"))
    filled = F.aggregate(F.map_entries(F.coalesce("params", F.create_map().cast("map<string,string>"))), F.col("_t"), lambda a, e: F.replace(a, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))))
    return j.withColumn("shown", F.coalesce(F.when(F.col("_t").isNotNull(), filled), F.nullif("text", F.lit("")), F.col("key"))).drop("_own", "_other", "_t")


def padded_box(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column, pad: float) -> Column:
    """struct<left, top, right, bottom>: a box wider on all sides by a share of its own size, within the frame."""
    w, h = right - left, bottom - top
    whole = lambda x: F.floor(x).cast("long")
    return F.struct(
        F.greatest(F.lit(0), left - whole(w * pad)).alias("left"), F.greatest(F.lit(0), top - whole(h * pad)).alias("top"), F.least(width, right + whole(w * pad)).alias("right"), F.least(height, bottom + whole(h * pad)).alias("bottom")
    )


def default_face(width: Column, height: Column) -> Column:
    """Where a face most likely is if none was found."""
    whole = lambda x: F.floor(x).cast("long")
    return F.struct(whole(width * 0.28).alias("left"), whole(height * 0.08).alias("top"), whole(width * 0.72).alias("right"), whole(height * 0.55).alias("bottom"))


# Fields of a file's own metadata that tell where it came from, and what marks signed credentials.
MARKERS, SIGNED = ["DigitalSourceType", "CreatorTool", "Software"], ["c2pa", "jumb", "contentauth"]


def markers(head: Column) -> Column:
    """struct<c2pa, xmp, DigitalSourceType, CreatorTool, Software> of the text at a file's beginning."""
    from vellumine.functions.text import markup_value

    packet = F.regexp_extract(head, r"(?s)<x:xmpmeta.*?(?:</x:xmpmeta>|$)", 0)
    return F.struct(F.lower(head).rlike("|".join(SIGNED)).alias("c2pa"), (packet != "").alias("xmp"), *(F.nullif(F.trim(markup_value(packet, name)), F.lit("")).alias(name) for name in MARKERS))
