"""What becomes of planned moves: outcomes by group, rolled back whole, restores, locks. Tables in, tables out; `commands` carries them out.

Operations: (op_id, group_id, seq, source, destination, checksum). States of files: (path, checksum, symlink), a row for each that exists.
Groups are the files of one asset, so few; a group moves whole or not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds after which a lock no longer counts.
STALE_SECONDS = 3600.0


def _with_states(operations: DataFrame, states: DataFrame) -> DataFrame:
    own = states.select(F.col("path").alias("source"), F.col("checksum").alias("_sum"), F.col("symlink").alias("_link"), F.lit(True).alias("_there"))
    goal = states.select(F.col("path").alias("destination"), F.col("checksum").alias("_goal"), F.lit(True).alias("_taken"))
    no = F.lit(False)
    return operations.join(own, "source", "left").join(goal, "destination", "left").withColumns({"_there": F.coalesce("_there", no), "_taken": F.coalesce("_taken", no), "_link": F.coalesce("_link", no)})


def applied(operations: DataFrame, states: DataFrame, unreadable: list[str] | None = None) -> DataFrame:
    """The operations with `status` (moved, skipped, failed) and `error`.

    One failure (a file that changed since it was planned, or can't be read) rolls its group back: files before it are returned, files after it not touched.
    """
    df = _with_states(operations, states)
    broken = F.col("_there") & ~F.col("_link") & ((F.col("_sum") != F.col("checksum")) | F.col("source").isin(unreadable or []))
    first = F.min(F.when(broken, F.col("seq"))).over(Window.partitionBy("group_id"))
    df = df.withColumn("_first", first)
    aborted = F.col("_first").isNotNull()
    rules = [
        (aborted & (F.col("seq") == F.col("_first")), "failed", "the file changed since it was planned"), (aborted & (F.col("seq") > F.col("_first")), "skipped", "group aborted before this file was touched"), (aborted, "skipped", "rolled back"),
        (F.col("_link"), "skipped", "source is a symlink; refusing to move what it points at"), (~F.col("_there") & F.col("_taken"), "skipped", "already at the destination"), (~F.col("_there"), "skipped", "source no longer exists"),
        (F.col("_taken") & (F.col("_goal") == F.col("_sum")), "skipped", "identical file already quarantined"),
    ]
    status, error = F.lit("moved"), F.lit("")
    for rule, s, e in reversed(rules):
        status, error = F.when(rule, s).otherwise(status), F.when(rule, e).otherwise(error)
    return df.withColumns({"status": status, "error": error}).select(*operations.columns, "status", "error")


def restored(operations: DataFrame, states: DataFrame) -> DataFrame:
    """The operations with what a restore does to each: restored, or failed or skipped and why."""
    df = _with_states(operations, states)
    status = F.when(~F.col("_taken"), "failed").when(F.col("_there"), "skipped").otherwise("restored")
    error = F.when(~F.col("_taken"), "quarantined file is gone").when(F.col("_there"), "a file already occupies the original path").otherwise("")
    return df.withColumns({"status": status, "error": error}).select(*operations.columns, "status", "error")


def by_operation(log: DataFrame, op_id: str) -> DataFrame:
    return log.where(F.col("op_id") == op_id)


def lock_held(text: Column, now: Column, stale: float = STALE_SECONDS) -> Column:
    """Whether a lock's JSON, with the second it was taken `at`, still counts; no text, junk and old ones don't."""
    at = F.get_json_object(text, "$.at").try_cast("double")
    return F.coalesce(text.isNotNull() & F.when(F.from_json(text, "map<string,string>").isNotNull(), now - F.coalesce(at, F.lit(0.0)) <= stale), F.lit(False))


def trash_plan(candidates: DataFrame, states: DataFrame) -> DataFrame:
    """(file, action): what a delete plan does to each of its files, each named once: gone, refused as a symlink, or moved."""
    files = candidates.select(F.explode(F.when(F.size("files") > 0, F.col("files")).otherwise(F.array("source_path"))).alias("file")).distinct()
    j = files.join(states.select(F.col("path").alias("file"), "symlink"), "file", "left")
    return j.select("file", F.when(F.col("symlink").isNull(), "already gone").when(F.col("symlink"), "symlink; refusing").otherwise("move").alias("action"))


def inside(base: str, candidate: Column) -> Column:
    """A file's own name below a folder, whatever folders it was given with; null for names that climb."""
    name = F.regexp_extract(candidate, r"([^/]*)/*$", 1)
    return F.when((name != "") & (name != ".") & (name != ".."), F.concat(F.lit(base.rstrip("/") + "/"), name))
