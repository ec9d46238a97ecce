"""Parts of records put together: names and files of assets, evidence and explanations, usage rows, split groups, checks of a finished run.

Null and empty text both mean that nothing is known; empty lists give empty texts and counts of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Files that a finished run has.
ARTEFACTS = ["report.json", "report.csv", "report.html"]
#: The widest budget that a truncated single frame is asked again with.
WIDEST = 4


def megapixels(width: Column, height: Column) -> Column:
    return F.bround(width * height / 1_000_000.0, 2)


def asset_key(relative: Column, path: Column) -> Column:
    """The path below the run's root, else the file's own name."""
    return F.when(F.coalesce(relative, F.lit("")) != "", relative).otherwise(F.regexp_extract(path, r"([^/]*)$", 1))


def all_files(path: Column, siblings: Column, sidecars: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.concat(F.array(path), F.coalesce(siblings, empty), F.coalesce(sidecars, empty))


def default_likeness(by_vector: Column, by_hash: Column) -> Column:
    """That of the vectors where both have one, else that of the hashes."""
    return F.coalesce(by_vector, by_hash)


def evidence(issues: Column, unrecoverable: list[str]) -> Column:
    """The codes that no edit can mend, each once, in alphabetical order."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(issues, lambda i: i["code"]), lambda c: c.isin(unrecoverable)))), ",")


def described(text: Column) -> Column:
    """struct<code, detail> of an issue as reports show it."""
    at = F.instr(text, ": ")
    return F.struct(F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text).alias("code"), F.when(at > 0, F.substring(text, at + 2, F.length(text))).otherwise("").alias("detail"))


def explained(df: DataFrame, name: str = "explained") -> DataFrame:
    """The rows with one JSON object that says what was decided and why. Reads filename, route_class, current_quality, post_edit_potential, strengths, reasons."""
    gain = (F.col("post_edit_potential") - F.col("current_quality")).alias("potential_gain")
    return df.withColumn(name, F.to_json(F.struct("filename", F.col("route_class").alias("class"), gain, "strengths", "reasons")))


def usage_row(reply: Column) -> Column:
    """struct<prompt, completion, reasoning, cached> of a reply's JSON, whichever of two names a service gives its counts; 0 for what is missing or no number."""
    number = lambda *paths: F.coalesce(*(F.nullif(F.get_json_object(reply, p).try_cast("long"), F.lit(0).cast("long")) for p in paths), F.lit(0).cast("long"))
    return F.struct(
        number("$.usage.prompt_tokens", "$.usage.input_tokens").alias("prompt"), number("$.usage.completion_tokens", "$.usage.output_tokens").alias("completion"),
        number("$.usage.completion_tokens_details.reasoning_tokens").alias("reasoning"), number("$.usage.prompt_tokens_details.cached_tokens").alias("cached"),
    )


def asked_again(truncated: DataFrame) -> DataFrame:
    """(group_id, part, frames, budget, failed): what truncated requests (group_id, frames, budget) become: two halves, one frame at twice the budget, or a failure at the widest."""
    n = F.size("frames")
    half = F.floor(n / 2).cast("int")
    parts = F.when(n > 1, F.array(F.struct(F.lit(0).alias("part"), F.slice("frames", F.lit(1), half).alias("frames")), F.struct(F.lit(1).alias("part"), F.slice("frames", half + 1, n).alias("frames")))).otherwise(F.array(F.struct(F.lit(0).alias("part"), F.col("frames").alias("frames"))))
    out = truncated.select("group_id", "budget", (n > 1).alias("_split"), F.explode(parts).alias("p"))
    wider = F.when(F.col("_split"), F.col("budget")).otherwise(F.col("budget") * 2)
    return out.select("group_id", "p.part", "p.frames", wider.alias("budget"), (wider > WIDEST).alias("failed"))


def missing_artefacts(files: DataFrame, runs: DataFrame) -> DataFrame:
    """(run, missing): the files that each run lacks of ARTEFACTS, and 'category folders' if it has no folder at all. Files: (run, path); runs: (run)."""
    own = files.groupBy("run").agg(F.collect_set("path").alias("_p"))
    j = runs.join(own, "run", "left").withColumn("_p", F.coalesce("_p", F.array().cast("array<string>")))
    lacks = F.filter(F.array(*map(F.lit, ARTEFACTS)), lambda a: ~F.array_contains("_p", a))
    folders = F.exists("_p", lambda p: F.contains(p, F.lit("/")))
    return j.select("run", F.array_join(F.concat(lacks, F.when(folders, F.array().cast("array<string>")).otherwise(F.array(F.lit("category folders")))), ",").alias("missing"))


def build_counts(built: DataFrame) -> DataFrame:
    """(with_image, without_image, reasons): how many pictures a report has, lacks, and why, most frequent reason first."""
    why = built.where("NOT ok").groupBy("reason").agg(F.count("*").alias("n"))
    text = why.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "reason", "n"))).alias("r"))
    joined = F.array_join(F.transform("r", lambda x: F.concat(x["reason"], F.lit(": "), x["n"].cast("string"))), ", ")
    return built.agg(F.count_if("ok").alias("with_image"), F.count_if(~F.col("ok")).alias("without_image")).crossJoin(F.broadcast(text)).select("with_image", "without_image", joined.alias("reasons"))


def checks_ok(checks: DataFrame) -> DataFrame:
    """(ok, failed): whether no required check failed, and those that did, in alphabetical order."""
    bad = F.array_sort(F.collect_set(F.when(F.col("required") & ~F.col("passed"), F.col("name"))))
    return checks.agg(bad.alias("b")).select((F.size("b") == 0).alias("ok"), F.array_join("b", ",").alias("failed"))


def label_template(records: DataFrame, seed: int = 0) -> DataFrame:
    """(filename, human_pile): the names to be judged, in an order that doesn't tell what the tool thinks, fixed by the seed."""
    return records.where(F.coalesce("filename", F.lit("")) != "").select("filename", F.lit("").alias("human_pile")).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "filename").cast("binary")), "filename")


def stale_documents(existing: DataFrame, kept: DataFrame, mark: str) -> DataFrame:
    """(name): documents that carry the tool's own mark and belong to no record any more; others' are left alone. Existing: (name, document)."""
    return existing.where(F.contains("document", F.lit(mark))).join(kept.select("name"), "name", "left_anti").select("name")
