"""External reads of groups of assets, replayed from a table: the library makes no calls itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPLY = "array<struct<n:int,genre:string,axis_a:int,axis_b:int,axis_c:int,note:string>>"
AXES = ["axis_a", "axis_b", "axis_c"]


def requests(groups: DataFrame, model: str) -> DataFrame:
    """(group_id, members, request): a JSON request for each group, its members in order."""
    members = F.array_sort(F.collect_list(F.struct("position", "key")))
    out = groups.groupBy("group_id").agg(members.alias("m")).select("group_id", F.transform("m", lambda x: x["key"]).alias("members"))
    return out.withColumn("request", F.to_json(F.struct(F.lit(model).alias("model"), F.col("group_id").cast("string").alias("custom_id"), F.transform("members", lambda k: k.cast("string")).alias("frames"))))


def replies(asked: DataFrame, replay: DataFrame) -> DataFrame:
    """(group_id, key, genre, axis_a, axis_b, axis_c, problem) from replies in text; JSON may stand in prose; groups without a usable reply keep their members with a problem."""
    j = asked.join(replay.select("group_id", "text"), "group_id", "left")
    parsed = F.from_json(F.regexp_extract("text", r"(\[[\s\S]*\])", 1), REPLY)
    items = F.transform(parsed, lambda x, i: F.struct(F.coalesce(x["n"], i + 1).alias("n"), x["genre"].alias("genre"), *(x[a].alias(a) for a in AXES)))
    rows = j.withColumn("items", F.coalesce(items, F.array())).select("group_id", F.posexplode("members").alias("p", "key"), "items", F.col("text").isNull().alias("silent"))
    own = F.try_element_at(F.filter("items", lambda x: x["n"] == F.col("p") + 1), F.lit(1))
    problem = F.when(F.col("silent"), "no reply").when(F.size("items") == 0, "unreadable").when(own.isNull(), "missing")
    return rows.select("group_id", "key", own["genre"].alias("genre"), *(own[a].cast("long").alias(a) for a in AXES), problem.alias("problem"))
