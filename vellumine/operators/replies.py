"""Replies of a model, parsed in the JVM: groups of objects, their frames, and the fields of both reads.

Replies are JSON arrays of objects, objects that hold one, or prose around one. Values are read as text and made numbers,
choices and flags here; what can't be read has a stated default or is an error, and never fails the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.functions.numbers import clamp_or, score_or_null

ITEMS = "array<map<string,string>>"
# Choices of the reads, each with the one that stands for all others.
GENRES, RECOVER = ["street", "landscape", "portrait", "detail", "reportage", "night", "architecture", "other"], ["easy", "moderate", "hopeless"]
EYES = ["OPEN", "CLOSED", "SQUINTING", "PARTIALLY_CLOSED", "UNCLEAR", "NOT_APPLICABLE"]
EXPRESSIONS = ["GOOD", "NEUTRAL", "AWKWARD", "GRIMACE", "BLINK", "MID_SPEECH", "UNCLEAR", "NOT_APPLICABLE"]
ROLES = ["TRANSITION", "PAUSE", "ESTABLISHING", "COUNTERPOINT", "RECURRING_MOTIF", "CLOSING", "CONTEXT", "TURN", "NONE"]
ARTISTIC = ["emotional_resonance", "visual_tension", "narrative_openness", "moment_specificity", "formal_coherence", "distinctiveness", "documentary_significance", "conventional_beauty"]
PORTRAIT = ["face_sharpness", "expression_quality", "pose_quality", "face_occlusion", "blink_probability", "grimace_probability", "portrait_publishability", "expression_confidence"]
REQUIRED, NOTE_WORDS, REASONING_CHARS = ["genre", "axis_b", "axis_c", "recover"], 12, 600


def items(text: Column) -> Column:
    """The objects of a reply as maps from names to texts; none if there is no JSON in it."""
    whole = F.trim(text)
    inner = F.regexp_extract(whole, r"(?s)\[.*\]", 0)
    plain = F.when(F.startswith(whole, F.lit("[")), F.from_json(whole, ITEMS))
    held = F.when(F.startswith(whole, F.lit("{")), F.coalesce(F.from_json(F.get_json_object(whole, "$.frames"), ITEMS), F.from_json(F.get_json_object(whole, "$.results"), ITEMS), F.array(F.from_json(whole, "map<string,string>"))))
    found = F.coalesce(plain, held, F.when(inner != "", F.from_json(inner, ITEMS)), F.array().cast(ITEMS))
    return F.filter(found, lambda x: x.isNotNull())


def output_text(body: Column) -> Column:
    """The text of a batch reply's body: `output_text`, or all text blocks of its output, joined."""
    direct = F.get_json_object(body, "$.output_text")
    blocks = F.flatten(F.transform(F.from_json(F.get_json_object(body, "$.output"), "array<struct<content:array<struct<type:string,text:string>>>>"), lambda o: F.coalesce(o["content"], F.array().cast("array<struct<type:string,text:string>>"))))
    own = F.transform(F.filter(blocks, lambda b: b["type"].isin("output_text", "text") & b["text"].isNotNull()), lambda b: b["text"])
    return F.coalesce(direct, F.array_join(own, ""), F.lit(""))


def placed(df: DataFrame, reply: str, group: str) -> DataFrame:
    """A row for each object with its frame: by the number it gives, else by its place; those beyond the group are left out. Adds `item` and `filename`."""
    each = df.select("*", F.posexplode(items(F.col(reply))).alias("_at", "item"))
    n = F.size(group)
    said, at = F.try_element_at("item", F.lit("n")).try_cast("double").cast("int"), F.col("_at") + 1
    index = F.when(said.between(1, n), said).when(at <= n, at)
    return each.withColumn("_index", index).where("_index IS NOT NULL").withColumn("filename", F.element_at(group, F.col("_index"))).drop("_at", "_index")


def value(name: str) -> Column:
    return F.try_element_at("item", F.lit(name))


def flag(text: Column, default: bool) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin("true", "yes", "1"), True).when(low.isin("false", "no", "0"), False).otherwise(default)


def choice(text: Column, choices: list[str], default: str) -> Column:
    own = F.trim(text)
    own = F.upper(own) if default.isupper() else F.lower(own)
    return F.when(own.isin(choices), own).otherwise(default)


def note(text: Column) -> Column:
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    return F.array_join(F.slice(words, 1, NOTE_WORDS), " ")


def assessment(df: DataFrame) -> DataFrame:
    """The rows of `placed` with the first read's fields, or `missing`, the required ones that aren't there, in alphabetical order."""
    absent = F.filter(F.array(*(F.when(~F.map_contains_key("item", n), n) for n in sorted(REQUIRED))), lambda x: x.isNotNull())
    fields = {
        "genre": choice(value("genre"), GENRES, "other"), "axis_a": clamp_or(F.coalesce(value("axis_a"), F.lit("50")), 0), "axis_b": clamp_or(value("axis_b"), 0), "axis_c": clamp_or(value("axis_c"), 0), "recover": choice(value("recover"), RECOVER, "moderate"),
        "note": note(value("note")), "intended_frame": flag(value("intended_frame"), True), "subject_strength": clamp_or(value("subject_strength"), 50), "accidental": clamp_or(value("accidental_probability"), 0), "dead_moment": clamp_or(value("dead_moment_probability"), 0),
    }
    whole = F.size(absent) == 0
    return df.withColumn("missing", F.array_join(absent, ",")).withColumns({k: F.when(whole, v) for k, v in fields.items()})


def artistic_read(df: DataFrame) -> DataFrame:
    """The rows of `placed` with the second read's fields; `status` is failed if one of the eight dimensions isn't a number.

    `errors` counts what had to be mended: values that are missing or no numbers among the confidence fields, and values out of range.
    """
    number = {n: value(n).try_cast("double") for n in [*ARTISTIC, "artistic_confidence", "uncertainty"]}
    usable = F.lit(True)
    for n in ARTISTIC:
        usable = usable & number[n].isNotNull()
    outside = lambda x: F.when(~F.bround(x).between(0, 100), 1).otherwise(0)
    errors = sum((outside(number[n]) for n in number), F.lit(0))
    for n in ("artistic_confidence", "uncertainty"):
        errors = errors + F.when(F.map_contains_key("item", F.lit(n)) & number[n].isNull(), 1).otherwise(0)
    default = lambda n, d: F.when(F.map_contains_key("item", F.lit(n)), F.coalesce(score_or_null(number[n]), F.lit(0).cast("long"))).otherwise(d)
    fields = {n: score_or_null(number[n]) for n in ARTISTIC} | {
        "candidate": flag(value("artistic_candidate"), False), "confidence": default("artistic_confidence", 0), "uncertainty": default("uncertainty", 50), "series_role": choice(value("series_role"), ROLES, "NONE"), "reasoning": F.substring(F.coalesce(value("artistic_reasoning"), F.lit("")), 1, REASONING_CHARS), "errors": errors,
    }
    out = df.withColumn("status", F.when(usable, "completed").otherwise("failed")).withColumns({k: F.when(usable, v) for k, v in fields.items()})
    return out.withColumn("carries_series", F.coalesce(F.col("series_role") != "NONE", F.lit(False)))


def portrait(df: DataFrame) -> DataFrame:
    """The rows of `placed` with the face fields of the object's `portrait`, null where it has none."""
    face = F.from_json(value("portrait"), "map<string,string>")
    of = lambda n: F.try_element_at(face, F.lit(n))
    fields = {
        "face_count": F.greatest(F.lit(0), F.coalesce(of("face_count").try_cast("double").cast("int"), F.lit(0))).cast("long"), "face_visible": flag(of("primary_face_visible"), False), "face_area": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(of("primary_face_area_ratio").try_cast("double"), F.lit(0.0)))),
        "eyes": choice(of("eyes_state"), EYES, "UNCLEAR"), "expression": choice(of("expression"), EXPRESSIONS, "UNCLEAR"),
    } | {n: clamp_or(of(n), 0) for n in PORTRAIT}
    out = df.withColumns({k: F.when(face.isNotNull(), v) for k, v in fields.items()})
    return out.withColumn("face_applies", F.coalesce((F.col("face_count") > 0) & F.col("face_visible"), F.lit(False)))


def read_summary(df: DataFrame) -> Column:
    """One line about a read and the face in it."""
    first = F.concat(*(x for i, n in enumerate(ARTISTIC[:4]) for x in (F.lit(("" if i == 0 else ", ") + n.split("_")[0] + " "), F.col(n).cast("string"))))
    face = F.concat(F.lit(" | face: "), F.lower("expression"), F.lit(", eyes "), F.lower("eyes"), F.lit(", quality "), F.col("expression_quality").cast("string"))
    return F.when(F.col("status") != "completed", F.concat(F.lit("artistic: "), F.col("status"))).otherwise(F.concat(F.lit("artistic: "), first, F.lit(", confidence "), F.col("confidence").cast("string"), F.when(F.col("face_applies"), face).otherwise("")))


def one_model(requests: DataFrame, batch: str = "batch") -> DataFrame:
    """(batch, models, n_models, is_single) of each batch's requests, names in order: a batch may ask one model alone."""
    models = requests.groupBy(batch).agg(F.array_sort(F.collect_set("model")).alias("m"))
    return models.select(batch, F.array_join("m", ",").alias("models"), F.size("m").cast("long").alias("n_models"), (F.size("m") <= 1).alias("is_single"))
