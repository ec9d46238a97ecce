"""File operations as tables: plans with mirrored destinations, group checks, restores, free names. Nothing here moves a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def relative_to(path: Column, root: str) -> Column:
    """The path below a root; null outside of it."""
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substring(path, len(base) + 1, 1 << 30))


def plan(files: DataFrame, root: str, target: str) -> DataFrame:
    """(group_id, source, destination, refused): destinations mirror the folders below the root; what lies outside or climbs is refused."""
    inside = relative_to(F.col("source"), root)
    ok = inside.isNotNull() & ~inside.rlike(r"(^|/)\.\.(/|$)")
    group = F.coalesce(F.nullif("group_id", F.lit("")), F.nullif("asset_id", F.lit("")), F.col("source"))
    return files.select(group.alias("group_id"), "source", F.when(ok, F.concat(F.lit(target.rstrip("/") + "/"), inside)).alias("destination"), (~ok).alias("refused"))


def verified_groups(operations: DataFrame, states: DataFrame) -> DataFrame:
    """Operations with `ok`: a group goes only if every file of it still has its size and checksum."""
    j = operations.join(states.select(F.col("path").alias("source"), F.col("size").alias("_s"), F.col("checksum").alias("_c")), "source", "left")
    same = F.coalesce((F.col("size") == F.col("_s")) & (F.col("checksum") == F.col("_c")), F.lit(False))
    return j.withColumn("ok", F.bool_and(same).over(Window.partitionBy("group_id"))).drop("_s", "_c")


def restorable(log: DataFrame) -> DataFrame:
    """The last operation of each destination where that is a move."""
    rest = [c for c in log.columns if c != "destination"]
    last = log.groupBy("destination").agg(F.max_by(F.struct(*rest), F.col("seq")).alias("r")).select("destination", *(F.col(f"r.{c}").alias(c) for c in rest))
    return last.where("status = 'moved'")


def free_names(planned: DataFrame, name: str = "destination", order: str = "source") -> DataFrame:
    """Planned names that meet get _1, _2 and so on before their suffix, until no two are equal, made ones and planned ones alike.

    The first of equal names keeps it; `order` must be unique. Each round settles every name that nobody has; what is left goes on by one.
    """
    from vellumine.operators.graph import checkpointed

    stem, suffix = F.regexp_replace("_base", r"\.[^./]*$", ""), F.regexp_extract("_base", r"(\.[^./]*)$", 1)
    n = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    rows = checkpointed(planned.withColumn("_base", F.col(name)).withColumn("_n", n))
    settled, open_ = rows.where("_n = 0"), rows.where("_n > 0")
    while not open_.isEmpty():
        tried = open_.withColumn(name, F.concat(stem, F.lit("_"), F.col("_n").cast("string"), suffix))
        taken = settled.select(F.col(name).alias("_name"), F.lit(True).alias("_taken"))
        first = F.row_number().over(Window.partitionBy(name).orderBy("_base", order))
        tried = checkpointed(tried.withColumn("_first", first).join(taken, F.col(name) == F.col("_name"), "left").withColumn("_free", F.col("_taken").isNull() & (F.col("_first") == 1)))
        keep = [c for c in rows.columns]
        settled = checkpointed(settled.unionByName(tried.where("_free").select(*keep)))
        # Those of one base that are left move on together, so that they don't meet each other.
        step = tried.where("NOT _free").select(*keep)
        most = tried.groupBy("_base").agg(F.max("_n").alias("_m"))
        rank = F.row_number().over(Window.partitionBy("_base").orderBy("_n", order))
        open_ = checkpointed(step.join(most, "_base").withColumn("_n", F.col("_m") + rank).select(*keep))
    return settled.select(*planned.columns)


def resolved(observations: DataFrame, truths: DataFrame, key: str = "asset_id") -> DataFrame:
    """Observations with what a person decided, where they had none yet."""
    t = truths.select(key, F.col("actual").alias("_t"))
    return observations.join(t, key, "left").withColumn("actual", F.coalesce(F.nullif("actual", F.lit("")), "_t")).drop("_t")
