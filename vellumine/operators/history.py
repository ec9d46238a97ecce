"""Logs and state: latest by key, overlays, increments, monitoring, policy, preferences, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine import params

# Alarms, gates and the weights of what a person did.
FALSE_TRASH_ALARM, DRIFT_ALARM, CALIBRATION_ALARM, DRIFT_WINDOW, BIN_LEAST = 0.001, 0.25, 0.10, 200, 20
ENOUGH_DECISIONS, ENOUGH_CHECKS, QUARANTINE_CONFIDENCE, AUDIT_SHARE = 1000, 3000, 0.93, 0.05
RANK_DECISIONS, GENRE_DECISIONS, MARGIN = 50, 40, 0.15
SIGNALS = {
    "restored_from_quarantine": 3.0, "added_to_portfolio": 2.5, "published": 2.0, "printed": 2.0, "pairwise_keep": 1.5, "pairwise_emotion": 1.5, "pairwise_series": 1.2, "pairwise_stock": 1.2, "burst_winner": 1.4,
    "variant_choice": 1.0, "intent_label": 1.5, "crop_adjusted": 0.8, "imported_edit": 1.0, "manual_keep": 1.0, "manual_reject": 1.0, "quick_reject": 0.4, "not_opened": 0.0,
}


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, as an aggregate with partial maxima; equal order values must not differ in other columns."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def overlay(records: DataFrame, overrides: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Records with an override's fields where it names one, and `overridden`."""
    o = overrides.select(key, *(F.col(f).alias(f"_{f}") for f in fields), F.lit(True).alias("_hit"))
    joined = records.join(o, key, "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in records.columns), F.coalesce("_hit", F.lit(False)).alias("overridden"))


def split_increment(assets: DataFrame, cached: DataFrame, seen: DataFrame, key: str, path: str) -> DataFrame:
    """The assets with `state`: reused if their content is cached, modified if only their path was seen, else new."""
    a = assets.join(cached.select(key).distinct().withColumn("_c", F.lit(True)), key, "left").join(seen.select(path).distinct().withColumn("_s", F.lit(True)), path, "left")
    return a.withColumn("state", F.when(F.col("_c"), "reused").when(F.col("_s"), "modified").otherwise("new")).drop("_c", "_s")


def false_trash(observations: DataFrame) -> DataFrame:
    """(rate, n) over resolved rows of (predicted, actual): the share filed as trash that a person kept, 5 places."""
    wrong = F.col("predicted").isin("trash", "safe_quarantine_candidate") & F.col("actual").isin("keep", "restored", "portfolio", "published")
    resolved = observations.where("actual IS NOT NULL AND actual <> ''")
    return resolved.agg(F.coalesce(F.bround(F.avg(wrong.cast("double")), 5), F.lit(0.0)).alias("rate"), F.count("*").alias("n"))


def drift(observations: DataFrame, order: str, window: int = DRIFT_WINDOW) -> DataFrame:
    """(drift): the share of unfamiliar rows among the last ones, 4 places."""
    recent = observations.orderBy(F.desc(order)).limit(window)
    return recent.agg(F.coalesce(F.bround(F.avg((~F.col("in_distribution")).cast("double")), 4), F.lit(0.0)).alias("drift"))


def calibration(observations: DataFrame) -> DataFrame:
    """(claimed, actual, n) of resolved rows in bins of a tenth, at most 0.9."""
    edge = F.least(F.lit(0.9), F.greatest(F.lit(0.0), F.bround(F.col("confidence") * 10) / 10))
    resolved = observations.where("actual IS NOT NULL AND actual <> ''")
    return resolved.groupBy(edge.alias("claimed")).agg(F.bround(F.avg((F.col("predicted") == F.col("actual")).cast("double")), 4).alias("actual"), F.count("*").alias("n"))


def alarms(observations: DataFrame, order: str) -> DataFrame:
    """(rate, n, drift, gap, automation): the three figures, and whether all keep within their limits; the rate counts from BIN_LEAST resolved rows on."""
    gap = calibration(observations).where(F.col("n") >= BIN_LEAST).agg(F.coalesce(F.bround(F.max(F.abs(F.col("claimed") - F.col("actual"))), 4), F.lit(0.0)).alias("gap"))
    one = false_trash(observations).crossJoin(drift(observations, order)).crossJoin(gap)  # a row each
    return one.withColumn("automation", ((F.col("n") < BIN_LEAST) | (F.col("rate") <= FALSE_TRASH_ALARM)) & (F.col("drift") <= DRIFT_ALARM) & (F.col("gap") <= CALIBRATION_ALARM))


def audited(asset_id: Column) -> Column:
    """A fixed slice by the first byte of the id's SHA-256."""
    first = F.conv(F.substring(F.sha2(asset_id.cast("string").cast("binary"), 256), 1, 2), 16, 10).cast("long")
    return (asset_id.cast("string") != "") & (first / 255.0 < AUDIT_SHARE)


GATES = ["enough_decisions", "in_distribution", "model_committed", "holdout_validated", "models_agree", "no_artistic_rescue", "stable", "confident", "not_shadow_mode", "monitor_healthy"]


def policy(df: DataFrame) -> DataFrame:
    """The rows with `bucket`, `failed_gate` (the first, or null) and `audit_sampled`.

    Reads key, evidence string, cluster_size, is_best, uncertainty, curator_keeps, route_class, decisions, in_distribution,
    abstained, probability, checks, stable, shadow, healthy.
    """
    c = F.col
    passed = {
        "enough_decisions": c("decisions") >= ENOUGH_DECISIONS, "in_distribution": c("in_distribution"), "model_committed": ~c("abstained"), "holdout_validated": c("checks") >= ENOUGH_CHECKS,
        "models_agree": c("abstained") | ((c("probability") >= 0.5) == c("curator_keeps")), "no_artistic_rescue": ~c("curator_keeps"), "stable": c("stable"), "confident": (1.0 - c("probability")) >= QUARANTINE_CONFIDENCE,
        "not_shadow_mode": ~c("shadow"), "monitor_healthy": c("healthy"),
    }
    failed = F.lit(None).cast("string")
    for name in reversed(GATES):
        failed = F.when(~passed[name], name).otherwise(failed)
    early = [(c("evidence") != "", "safe_quarantine_candidate"), ((c("cluster_size") > 1) & c("is_best"), "burst_winner"), (c("uncertainty") >= 60, "curatorial_review"), (c("route_class").isin("stock_strong", "stock_standard"), "auto_stock_candidate"), (c("route_class") == "flagship", "auto_keep_and_edit")]
    decided, bucket = F.lit(False), F.when(early[0][0], early[0][1])
    for rule, name in early:
        decided = decided | rule
    for rule, name in early[1:]:
        bucket = bucket.when(rule, name)
    sampled = ~decided & failed.isNull() & audited(c("key"))
    bucket = bucket.when(sampled, "manual_review").when(failed.isNull(), "safe_quarantine_candidate").when(c("curator_keeps"), "curatorial_review").otherwise("auto_archive")
    return df.withColumns({"bucket": bucket, "failed_gate": F.when(~decided, failed), "audit_sampled": sampled})


def decision_weight(signal: Column, confidence: Column) -> Column:
    table = F.create_map(*(x for k, v in SIGNALS.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.try_element_at(table, signal), F.lit(0.0)) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence))


def repetitions(weight: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.bround(weight).cast("long"))


def probability_kept(strengths: DataFrame) -> DataFrame:
    """(item, probability): the logistic of the log strength against its mean, 5 places."""
    log = F.log(F.greatest(F.col("strength"), F.lit(1e-6)))
    mean = strengths.agg(F.avg(log).alias("_m"))
    return strengths.crossJoin(F.broadcast(mean)).select("item", F.bround(1.0 / (1.0 + F.exp(-(log - F.col("_m")))), 5).alias("probability"))


def usage_totals(usage: DataFrame, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """(model, prompt, completion, reasoning, usd): tokens by model; reasoning is billed as output; prices per million, (0, 0) if unknown."""
    sums = usage.groupBy("model").agg(*(F.sum(c).cast("long").alias(c) for c in ("prompt", "completion", "reasoning")))
    table = F.create_map(*(x for k, v in prices.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("i"), F.lit(v[1]).alias("o")))))
    price = F.try_element_at(table, F.col("model"))
    cost = F.col("prompt") / 1e6 * F.coalesce(price["i"], F.lit(0.0)) + (F.col("completion") + F.col("reasoning")) / 1e6 * F.coalesce(price["o"], F.lit(0.0))
    return sums.withColumn("usd", F.bround(cost, 4))


def stage_rollup(usage: DataFrame) -> DataFrame:
    """(stage, calls, tokens) for each stage and, under 'total', all."""
    return usage.rollup("stage").agg(F.count("*").alias("calls"), F.sum(F.col("prompt") + F.col("completion")).cast("long").alias("tokens")).withColumn("stage", F.coalesce("stage", F.lit("total")))


def purgeable(evidence: Column, allowed: list[str]) -> Column:
    """Whether a comma list names something and only what is allowed."""
    parts = F.filter(F.transform(F.split(evidence, ","), lambda x: F.trim(x)), lambda x: x != "")
    return (F.size(parts) > 0) & F.forall(parts, lambda x: x.isin(allowed))


# Evidence on which files may be purged.
PURGE_EVIDENCE = ["corrupt_file", "encoding_corruption", "empty_frame", "no_usable_segment", "insufficient_resolution"]
