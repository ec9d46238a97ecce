"""Reports over records: filters, orders, comparison rows, summaries, insights, migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.operators import ranking

STRONG_DIMENSION, WEAK_DIMENSION, LEAST_FRAMES, LEAST_SHARE = 62, 42, 3, 0.15
SORT_KEYS = ["final_score", "post_edit_potential", "stock_potential", "aesthetic_potential", "confidence", "uniqueness", "current_quality", "filename"]


def filtered(records: DataFrame, *, media: str | None = None, classes: list[str] | None = None, genre: str | None = None, least_score: float | None = None, least_confidence: float | None = None, clustered: bool = False, platform: str | None = None) -> DataFrame:
    """Records for which every given condition holds; a missing score counts as 0."""
    rule = F.lit(True)
    for given, condition in (
        (media, lambda: F.col("kind") == media), (classes, lambda: F.col("route_class").isin(classes)), (genre, lambda: F.col("genre") == genre), (least_score, lambda: F.coalesce("final_score", F.lit(0)) >= least_score),
        (least_confidence, lambda: F.coalesce("confidence", F.lit(0)) >= least_confidence), (clustered or None, lambda: F.col("cluster_size") > 1), (platform, lambda: F.exists("marketplaces", lambda m: (m["platform_id"] == platform) & m["eligible"])),
    ):
        if given is not None:
            rule = rule & condition()
    return records.where(rule)


def ordered(records: DataFrame, key: str = "final_score") -> DataFrame:
    """Largest first, names ascending; by name alone for filename."""
    return records.orderBy("filename") if key == "filename" else records.orderBy(F.desc(key), "filename")


def ranked_sections(records: DataFrame, section: str = "category", score: str = "final_score", name: str = "key") -> DataFrame:
    """The records with `place` from 1 within their section, best first; sections are few, so rows are placed by ranges of them."""
    return ranking.numbered_within(records, section, [F.desc(score), F.col(name)])


def comparison_rows(records: DataFrame) -> DataFrame:
    """Records that lost to a sibling or go to the trash, beside the winner of their cluster if there is one."""
    winners = records.where("is_best").groupBy("cluster_id").agg(F.max_by(F.struct("key", "quality"), "key").alias("w"))
    losers = records.where(F.col("route_class").isin("duplicate_candidate", "trash") & ~F.col("is_best"))
    return losers.join(winners, "cluster_id", "left").select("key", "cluster_id", F.col("w.key").alias("winner"), F.bround(F.col("w.quality") - F.col("quality"), 2).alias("margin"))


def summary(records: DataFrame) -> DataFrame:
    """One row of figures over the records whose status is ok."""
    ok = records.where("status = 'ok'")
    return ok.agg(
        F.count("*").alias("n"), F.count_if(F.col("kind") == "video").alias("videos"), F.count_if("present").alias("read"), F.coalesce(F.bround(F.avg(F.col("present").cast("double")), 4), F.lit(0.0)).alias("read_share"),
        F.max("final_score").alias("best"), F.count_if(F.col("cluster_size") > 1).alias("clustered"), F.count_distinct("genre").alias("genres"), F.coalesce(F.bool_or("is_raw"), F.lit(False)).alias("any_raw"), F.coalesce(F.bool_and("present"), F.lit(True)).alias("all_read"),
        F.count_if(F.col("post_edit_potential") - F.col("current_quality") >= 8).alias("gains"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("bytes"),
    )


def genre_standing(records: DataFrame, least: int = LEAST_FRAMES) -> DataFrame:
    """(genre, n, lead): how far a genre's mean score is over the mean of all records, 4 places."""
    mean = records.agg(F.avg("final_score").alias("all"))
    by = records.groupBy("genre").agg(F.count("*").alias("n"), F.avg("final_score").alias("own")).where(F.col("n") >= least)
    return by.crossJoin(F.broadcast(mean)).select("genre", "n", F.bround(F.col("own") - F.col("all"), 4).alias("lead"))


def dimension_shares(records: DataFrame, dimensions: list[str], least: float = STRONG_DIMENSION, most: float = WEAK_DIMENSION) -> DataFrame:
    """(dimension, strong, weak, mean): shares of records over and under two lines, from one pass."""
    long = records.unpivot([], dimensions, "dimension", "value")
    share = lambda rule: F.bround(F.avg(rule.cast("double")), 4)
    return long.groupBy("dimension").agg(share(F.col("value") >= least).alias("strong"), share(F.col("value") <= most).alias("weak"), F.bround(F.avg("value"), 4).alias("mean"))


def patterns(records: DataFrame, rules: dict[str, Column], least: int = LEAST_FRAMES, share: float = LEAST_SHARE) -> DataFrame:
    """(pattern, n, share) of the rules that enough records fulfil."""
    one = records.agg(F.count("*").alias("_all"), *(F.count_if(rule).alias(name) for name, rule in rules.items()))
    long = one.unpivot(["_all"], list(rules), "pattern", "n")
    return long.select("pattern", "n", F.bround(F.try_divide("n", "_all"), 4).alias("share")).where((F.col("n") >= least) & (F.col("share") >= share))


# Retired words of stored rows and what they are called now.
RENAMED_CLASSES = {"hero": "flagship", "keep": "stock_standard", "reject": "trash", "editorial": "stock_standard"}


def migrated(records: DataFrame, retired_tags: list[str]) -> DataFrame:
    """Stored rows in today's words: classes renamed, retired tags dropped."""
    table = F.create_map(*(F.lit(x) for kv in RENAMED_CLASSES.items() for x in kv))
    return records.withColumns({"route_class": F.coalesce(F.try_element_at(table, "route_class"), "route_class"), "tags": F.array_except("tags", F.array(*map(F.lit, retired_tags)))})


# What is done with each class.
ACTIONS = {"trash": "quarantine", "duplicate_candidate": "compare", "review": "decide", "archive_only": "archive", "stock_standard": "export", "stock_strong": "export", "flagship": "edit"}


def action(route_class: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in ACTIONS.items() for x in kv)), route_class), F.lit("none"))


def move_plan(records: DataFrame, files: DataFrame, key: str = "key") -> DataFrame:
    """(key, number, file, reason): each file of each record that goes to the trash; nothing is moved.

    Records are picked by a generator, as a filter would be pushed below the class's rules and spell out all scores at each of their places.
    """
    trash = records.select(key, F.explode(F.when(F.col("route_class") == "trash", F.array("reason_key"))).alias("reason"))
    return trash.join(files, key).select(key, F.posexplode("files").alias("number", "file"), "reason")
