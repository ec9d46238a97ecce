"""Readers: media files, JSON lines, stored runs, labels, ratings in sidecars. Bad rows are skipped, unknown fields dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.functions.text import markup_value, media_kind


def media_files(spark: SparkSession, root: str, exclude: list[str] | None = None, content: bool = False) -> DataFrame:
    """(path, length, modificationTime[, content], kind) of all files under a root; content is read only if asked for."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    for folder in exclude or []:
        df = df.where(~F.col("path").contains(f"/{folder.strip('/')}/"))
    columns = ["path", "length", "modificationTime"] + (["content"] if content else [])
    return df.select(*columns, media_kind(F.col("path")).alias("kind"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def stored_run(spark: SparkSession, path: str, asset_schema: str) -> DataFrame:
    """The assets of a run's document {summary, assets[]}, a row each."""
    return spark.read.schema(f"assets array<struct<{asset_schema}>>").option("multiLine", "true").json(path).select(F.inline("assets"))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """(filename, pile, score): of CSV files; a rank counts as its negative score; the last row of a name, by file and place, wins."""
    df = spark.read.option("header", "true").option("enforceSchema", "false").schema("filename string, human_pile string, human_score string, human_rank string").csv(path)
    df = df.select("filename", F.nullif(F.lower(F.trim("human_pile")), F.lit("")).alias("pile"), F.coalesce(F.expr("try_cast(human_score AS double)"), -F.expr("try_cast(human_rank AS double)")).alias("score"), F.struct(F.input_file_name(), F.monotonically_increasing_id()).alias("_at"))
    kept = df.where("filename IS NOT NULL AND (pile IS NOT NULL OR score IS NOT NULL)")
    return kept.groupBy("filename").agg(F.max_by(F.struct("pile", "score"), "_at").alias("r")).select("filename", "r.pile", "r.score")


def ratings(spark: SparkSession, root: str, written_before: str | None = None) -> DataFrame:
    """(stem, rating) of sidecar files, 1 to 5 stars; unrated ones and those written after a time are left out."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xmp").load(root)
    if written_before:
        df = df.where(F.col("modificationTime") < F.to_timestamp(F.lit(written_before)))
    text = F.decode("content", "UTF-8")
    out = df.select(F.regexp_extract("path", r"([^/]+)\.xmp$", 1).alias("stem"), markup_value(text, "xmp:Rating").try_cast("int").alias("rating"))
    return out.where("rating > 0")


def latest_run(spark: SparkSession, path: str, schema: str, order: str = "started_at") -> DataFrame:
    """The last run of a ledger."""
    return json_lines(spark, path, schema).orderBy(F.desc(order)).limit(1)
