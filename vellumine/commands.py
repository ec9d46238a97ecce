"""Commands over stored runs and logs: each reads tables at paths, composes the operators, and writes or returns a table.

`python -m vellumine.commands NAME key=value ...` runs one and shows its rows. Files are moved only by `carry_out`, at the driver, after a plan
was made and only if asked for; everything else is a table.
"""

from __future__ import annotations

import os
import shutil
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine import params
from vellumine.operators import agreement, documents, history, learning, moves, quarantine, ranking, records, scoring, selection
from vellumine.sources import readers, sinks

COMMANDS: dict[str, Callable[..., DataFrame]] = {}


def command(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    COMMANDS[f.__name__] = f
    return f


def run_table(spark: SparkSession, path: str) -> DataFrame:
    """A stored run: Parquet, or JSON lines."""
    return spark.read.parquet(path) if not path.endswith((".json", ".jsonl")) else spark.read.json(path)


@command
def report(spark: SparkSession, run: str, out: str = "", least: str = "0", category: str = "") -> DataFrame:
    """The run's rows over a score and of a category, best first; with `out`, also as pages. Reads filename, category, final_score, reason, steps."""
    rows = run_table(spark, run).where(F.col("final_score") >= int(least))
    rows = rows.where(F.col("category") == category) if category else rows
    if out:
        documents.write_pages(documents.sections(documents.card(rows)), out)
    return rows.orderBy(F.desc("final_score"), "filename")


@command
def summary(spark: SparkSession, run: str) -> DataFrame:
    return run_table(spark, run).groupBy("category").agg(F.count("*").alias("n"), F.bround(F.avg("final_score"), 2).alias("mean_score"))


@command
def reclassify(spark: SparkSession, run: str, profile: str = "") -> DataFrame:
    """The run's rows with their class under a named profile. Reads what `route_class` reads, and `route_class` as it was."""
    stored = run_table(spark, run).withColumnRenamed("route_class", "previous").drop("reason_key")
    return scoring.reclassified(stored, params.chosen(profile))


@command
def bench_quality(spark: SparkSession, run: str, labels: str) -> DataFrame:
    """How a run's piles agree with a person's, by pile. Reads filename and final_score."""
    pairs = readers.labels(spark, labels).where("pile IS NOT NULL").select("filename", "pile").join(run_table(spark, run).select("filename", F.col("final_score").cast("long").alias("score")), "filename")
    return pairs.groupBy("pile", agreement.pile(F.col("score")).alias("said")).agg(F.count("*").alias("n"))


def _labelled(spark: SparkSession, run: str, labels: str) -> DataFrame:
    return readers.labels(spark, labels).withColumnRenamed("score", "said").join(run_table(spark, run).select("filename", F.col("final_score").cast("long").alias("score")), "filename")


@command
def bench_figures(spark: SparkSession, run: str, labels: str) -> DataFrame:
    """One row of figures: how often the run agrees with a person's piles, precision and recall of the best pile, the thresholds that would agree most, and the rank correlation with the
    person's scores, with how many labels have one. Reads filename and final_score."""
    own = _labelled(spark, run, labels)
    figures = agreement.agreement(own.where("pile IS NOT NULL").select("pile", "score"))
    rho = ranking.spearman(own.where("said IS NOT NULL").select("said", "score"), "said", "score").select(F.col("n").alias("scored"), "rho")
    return figures.crossJoin(F.broadcast(rho))  # a row each


@command
def bench_confusion(spark: SparkSession, run: str, labels: str) -> DataFrame:
    """How the run files each of a person's piles, at the present thresholds."""
    return agreement.confusion(_labelled(spark, run, labels).where("pile IS NOT NULL").select("pile", "score"))


@command
def bench_sweep(spark: SparkSession, run: str, labels: str) -> DataFrame:
    """Every pair of thresholds with how many labels it would agree with, the best first."""
    return agreement.sweep(_labelled(spark, run, labels).where("pile IS NOT NULL").select("pile", "score")).orderBy(F.desc("hits"), "top", "weak")


@command
def apply_ratings(spark: SparkSession, run: str, sidecars: str, out: str) -> DataFrame:
    """The sidecar of each record with its stars and label, written as one text a row. Reads key and category; `sidecars` has key and document."""
    plan = sinks.plan_ratings(run_table(spark, run).select("key", "category"), run_table(spark, sidecars))
    plan.write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


@command
def insights(spark: SparkSession, run: str) -> DataFrame:
    return documents.improvements(run_table(spark, run))


@command
def ask(spark: SparkSession, run: str, limit: str = "12") -> DataFrame:
    """The questions most worth a person's time. Reads key, score, undecided, known_genre."""
    return selection.questions(run_table(spark, run), int(limit))


@command
def record(spark: SparkSession, log: str, signal: str, winner: str = "", loser: str = "", genre: str = "", camera: str = "", confidence: str = "1.0") -> DataFrame:
    """Append one decision to the log; returns the log's facts."""
    row = spark.createDataFrame([(signal, winner, loser, float(confidence), genre, camera, "", "")], DECISIONS)
    sinks.append_log(row, log)
    return learning.store_facts(readers.json_lines(spark, log, DECISIONS))


DECISIONS = "signal string, winner string, loser string, confidence double, genre string, camera string, tool_said string, answer string"


@command
def learned(spark: SparkSession, log: str) -> DataFrame:
    """What the log of decisions amounts to: the strengths of what was compared."""
    return learning.fit(readers.json_lines(spark, log, DECISIONS)).orderBy(F.desc("strength"), "item")


@command
def policy(spark: SparkSession, run: str) -> DataFrame:
    """How many assets fall into each bucket, and the first gate that holds others back. Reads what `policy` reads."""
    return history.policy(run_table(spark, run)).groupBy("bucket", "failed_gate").agg(F.count("*").alias("n"))


@command
def monitor(spark: SparkSession, log: str) -> DataFrame:
    """False-trash rate, drift and calibration of a log of observations, and whether automation may stay on."""
    rows = spark.read.schema("at long, predicted string, actual string, confidence double, in_distribution boolean").json(log)
    return history.alarms(rows, "at")


@command
def quarantine_plan(spark: SparkSession, run: str, root: str, target: str) -> DataFrame:
    """Where each file of the run would go; names that meet are made different. Reads group_id, asset_id, source."""
    return quarantine.free_names(quarantine.plan(run_table(spark, run), root, target).where("NOT refused"))


@command
def restore(spark: SparkSession, log: str, schema: str = "destination string, source string, status string, seq long") -> DataFrame:
    """The moves of a log that can be taken back."""
    return quarantine.restorable(readers.json_lines(spark, log, schema))


@command
def purge(spark: SparkSession, log: str, schema: str = "destination string, source string, status string, seq long, evidence string") -> DataFrame:
    """Moved files whose evidence allows removing them for good, and those whose doesn't."""
    return restore(spark, log, schema).withColumn("purgeable", history.purgeable(F.col("evidence"), history.PURGE_EVIDENCE))


@command
def trash(spark: SparkSession, plan: str, states: str) -> DataFrame:
    """What a delete plan would do to each of its files. Reads files, source_path; states: path, symlink."""
    return moves.trash_plan(run_table(spark, plan), run_table(spark, states))


@command
def export(spark: SparkSession, run: str, out: str) -> DataFrame:
    """The rows that are worth exporting, as a table for upload."""
    chosen = run_table(spark, run).where(records.worth_exporting(F.col("final_score"), F.col("category")))
    sinks.write_csv(chosen, out)
    return chosen


@command
def override(spark: SparkSession, log: str, asset_id: str, route_class: str, decided_at: str) -> DataFrame:
    """Append a person's class for an asset; returns the last one of each."""
    schema = "asset_id string, route_class string, decided_at string"
    sinks.append_log(spark.createDataFrame([(asset_id, route_class, decided_at)], schema), log)
    return readers.json_lines(spark, log, schema).groupBy("asset_id").agg(F.max_by("route_class", "decided_at").alias("route_class"))


@command
def profiles(spark: SparkSession, name: str = "") -> DataFrame:
    """The limits and parts of the built-in profiles, or of one."""
    rows = [(p.name, kind, key, float(value)) for p in params.PROFILES.values() if not name or p.name == name for kind, values in (("limit", p.limits), ("part", p.parts)) for key, value in values.items()]
    return spark.createDataFrame(rows, "profile string, kind string, name string, value double")


@command
def compare(spark: SparkSession, before: str, after: str) -> DataFrame:
    """Files whose class differs between two runs. Reads filename and route_class."""
    old, new = run_table(spark, before).select("filename", F.col("route_class").alias("was")), run_table(spark, after).select("filename", F.col("route_class").alias("now"))
    return old.join(new, "filename", "full").where(~F.equal_null("was", "now"))


def carry_out(operations: DataFrame, dry_run: bool = True) -> list[tuple[str, str, str]]:
    """Move files by (group_id, seq, source, destination), at the driver, a group at a time; returns (source, destination, outcome).

    A group whose file can't be moved is returned to where it was. Nothing is overwritten: a taken destination fails its group.
    """
    out: list[tuple[str, str, str]] = []
    group, done, failed = None, [], False
    for row in operations.select("group_id", "seq", "source", "destination").orderBy("group_id", "seq").toLocalIterator():
        if row.group_id != group:
            group, done, failed = row.group_id, [], False
        if failed:
            out.append((row.source, row.destination, "skipped"))
        elif dry_run:
            out.append((row.source, row.destination, "planned"))
        else:
            try:
                if os.path.islink(row.source) or os.path.exists(row.destination):
                    raise OSError("a link, or a taken place")
                os.makedirs(os.path.dirname(row.destination), exist_ok=True)
                shutil.move(row.source, row.destination)
                done.append(len(out))
                out.append((row.source, row.destination, "moved"))
            except OSError:
                failed = True
                out.append((row.source, row.destination, "failed"))
                for i in reversed(done):
                    shutil.move(out[i][1], out[i][0])
                    out[i] = (out[i][0], out[i][1], "rolled back")
    return out


def main(arguments: list[str]) -> int:
    if not arguments or arguments[0] not in COMMANDS:
        print("commands: " + ", ".join(sorted(COMMANDS)))
        return 2
    from vellumine.session import session

    COMMANDS[arguments[0]](session(), **dict(a.split("=", 1) for a in arguments[1:])).show(50, truncate=120)
    return 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
