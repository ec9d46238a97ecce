"""Ten score dimensions of an asset, and the class that follows from them.

Input columns: technical_quality, uplift double; is_raw, present, is_best boolean; axis_a, axis_b, axis_c, cluster_size
long; similarity, completeness double; issues array<struct<code string, certainty double>>.
All are expressions within one row; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine import params
from vellumine.functions.numbers import clamp_score

#: Codes that decide alone.
FATAL = ["corrupt_file", "encoding_corruption", "empty_frame", "no_usable_segment", "insufficient_resolution", "legal_blocker"]
DIMENSIONS = ["current_quality", "recoverability", "content", "post_edit_potential", "uniqueness", "aesthetic_potential", "stock_potential", "portfolio_potential", "confidence", "routing_score"]


def issues_among(codes: list[str], issues: str = "issues") -> Column:
    return F.filter(issues, lambda i: i["code"].isin(codes))


def with_issue_counts(df: DataFrame) -> DataFrame:
    """Issues of the asset itself by class; a duplicate's standing among others is none of them."""
    own = [c for c in params.PARTIAL if c != "weaker_duplicate"]
    return df.withColumns(
        {
            "n_fixable": F.size(issues_among(params.FIXABLE)).cast("long"), "n_partial": F.size(issues_among(own)).cast("long"), "n_unrecoverable": F.size(issues_among(params.UNRECOVERABLE)).cast("long"),
            "n_fatal": F.size(issues_among(FATAL)).cast("long"), "n_uncertain": F.size(F.filter("issues", lambda i: (i["certainty"] < 0.8) & (i["code"] != "weaker_duplicate"))).cast("long"),
        }
    )


def score_dimensions(df: DataFrame, profile: params.Profile = params.PROFILES["default-photo"]) -> DataFrame:
    """The rows with the ten DIMENSIONS and the issue counts they rest on."""
    c = F.col
    df = with_issue_counts(df).withColumns(
        {
            "current_quality": clamp_score(c("technical_quality")),
            "recoverability": clamp_score(F.when(c("is_raw"), 100.0).otherwise(78.0) - 11.0 * c("n_partial") - 34.0 * c("n_unrecoverable")),
            "content": F.when(c("present"), c("axis_a")).otherwise(0).cast("long"),
            "uniqueness": F.when(~c("is_best"), clamp_score(12.0 - c("similarity") * 10.0)).when(c("cluster_size") <= 1, 100).otherwise(clamp_score(100.0 - 9.0 * (c("cluster_size") - 1) - c("similarity") * 12.0)).cast("long"),
        }
    )
    projected = c("current_quality") + c("uplift") * (0.55 + 0.45 * c("recoverability") / 100.0)
    cap = F.greatest(F.lit(4.0), 22.0 - 8.0 * (c("n_unrecoverable") - 1))
    df = df.withColumn("post_edit_potential", clamp_score(F.when(c("n_unrecoverable") > 0, F.least(projected, cap)).otherwise(projected)))
    potential = c("post_edit_potential")
    df = df.withColumn("aesthetic_potential", F.when(c("present"), clamp_score(0.55 * c("axis_b") + 0.20 * c("axis_c") + 0.25 * potential)).otherwise(clamp_score(potential * 0.75)))
    df = df.withColumn("stock_potential", F.when(c("present"), clamp_score(0.58 * c("axis_a") + 0.42 * potential)).otherwise(clamp_score(potential * 0.80 * 0.85)))
    base = 0.62 * c("aesthetic_potential") + 0.38 * potential
    base = F.when(c("present"), 0.70 * base + 0.30 * c("axis_b")).otherwise(base)
    df = df.withColumn("portfolio_potential", clamp_score(base * F.least(F.lit(1.0), potential / 55.0)))
    sure = (100.0 - F.when(c("present"), 0.0).otherwise(30.0) - F.when(c("is_raw"), 0.0).otherwise(8.0)) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), c("completeness"))) - 5.0 * c("n_uncertain")
    torn = (c("n_unrecoverable") > 0) & (c("n_fixable") > 0) & (c("n_partial") == 0)
    df = df.withColumn("confidence", clamp_score(sure - F.when(torn, 10.0).otherwise(0.0)))
    blend = F.lit(0.0)
    for name, share in profile.parts.items():
        blend = blend + F.lit(share) * c(name)
    return df.withColumn("routing_score", clamp_score(blend))


def route_class(df: DataFrame, profile: params.Profile = params.PROFILES["default-photo"]) -> DataFrame:
    """The rows with `route_class` and `reason_key`: the first rule that holds, top to bottom.

    Besides the scores it reads flagship_selected and hero_blocked (boolean) and semantic_ran.
    """
    c, t = F.col, profile.limits.__getitem__
    low = c("post_edit_potential") < t("trash_potential")
    strong, standard = c("stock_potential") >= t("stock_strong"), c("stock_potential") >= t("stock_standard")
    rules = [
        (c("n_fatal") > 0, "trash", "unrecoverable"),
        (~c("is_best") & c("semantic_ran"), "duplicate_candidate", "duplicate_candidate"),
        (~c("is_best"), "duplicate_candidate", "duplicate_unchecked"),
        ((c("n_unrecoverable") > 0) & low, "trash", "capped"),
        (c("confidence") < t("review_confidence"), "review", "low_confidence"),
        (low, "archive_only", "below_trash"),
        (c("flagship_selected") & ~c("hero_blocked"), "flagship", "flagship"),
        (c("flagship_selected") & strong, "stock_strong", "hero_blocked"),
        (c("flagship_selected") & standard, "stock_standard", "hero_blocked"),
        (c("flagship_selected"), "review", "hero_blocked"),
        (strong, "stock_strong", "stock_strong"),
        (standard, "stock_standard", "stock_standard"),
    ]
    kind, why = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for rule, a, b in rules[1:]:
        kind, why = kind.when(rule, a), why.when(rule, b)
    return df.withColumns({"route_class": kind.otherwise("review"), "reason_key": why.otherwise("archive")})


def tags(df: DataFrame, profile: params.Profile = params.PROFILES["default-photo"]) -> DataFrame:
    """The rows with `tags`, joined by commas in a fixed order."""
    c, t = F.col, profile.limits.__getitem__
    each = [
        F.lit("commercial_ok"), F.when(c("is_best"), "best_in_cluster").otherwise("weaker_duplicate"), F.when(c("route_class") == "flagship", "portfolio"),
        F.when(c("route_class").isin("stock_standard", "stock_strong") & (c("stock_potential") < t("stock_strong")), "low_stock_demand"),
        F.when((c("route_class") == "review") & (c("post_edit_potential") >= t("trash_potential")), "archive_only"),
    ]
    return df.withColumn("tags", F.concat_ws(",", *each))


def strengths(df: DataFrame) -> DataFrame:
    """The rows with `strengths`: codes of what speaks for the asset."""
    c = F.col
    gain = c("post_edit_potential") - c("current_quality")
    each = [
        F.when(gain >= 8, "edit_gain"), F.when(c("is_raw"), "raw_latitude"), F.when(c("uniqueness") >= 85, "unique"), F.when(c("present") & (c("axis_b") >= 70), "hard_to_repeat"),
        F.when(c("present") & (c("axis_a") >= 70), "strong_content"), F.when(c("present") & (c("axis_c") >= 70), "documentary"), F.when((c("n_unrecoverable") == 0) & (c("n_partial") == 0), "routine_edit"),
    ]
    return df.withColumn("strengths", F.concat_ws(",", *each))


def flagship_eligible(df: DataFrame, profile: params.Profile = params.PROFILES["default-photo"]) -> DataFrame:
    """Rows over both absolute floors."""
    return df.where((F.col("portfolio_potential") >= profile.limits["flagship_portfolio"]) & (F.col("post_edit_potential") >= profile.limits["flagship_potential_floor"]))


def reclassified(stored: DataFrame, profiles: dict[str, params.Profile], kind: str = "kind") -> DataFrame:
    """Stored rows with their class under other profiles, each kind by its own, and whether it `changed` from `previous`. Nothing is measured again."""
    photo, video = (route_class(stored.where(rule), profiles[name]) for name, rule in (("photo", F.col(kind) != "video"), ("video", F.col(kind) == "video")))
    return photo.unionByName(video).withColumn("changed", F.col("route_class") != F.col("previous"))
