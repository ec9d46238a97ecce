"""Facts, labels and keys of stored records, and the summaries that reports show: column expressions and small aggregates.

Null and empty text both mean that nothing is known. Lists that reports show are joined texts, in a stated order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Versions that cached replies are kept under.
STAGE2_PROMPT, STAGE3_PROMPT, STAGE3_SCHEMA = "stage2-2026-08-16", "stage3-2026-08-12b", 1
# Genres as platforms name them, and words for what isn't listed.
TAXONOMY = {"street": "city and urban", "landscape": "landscape", "portrait": "people", "detail": "abstract", "reportage": "documentary", "night": "city and urban", "architecture": "architecture", "other": "lifestyle"}
OTHER_TAXONOMY = "lifestyle"
# What is declared for each provenance, and for those that aren't named.
DECLARED = {"fully_generated": "Generative AI", "generative_fill_used": "Contains generative AI elements", "partially_generated": "Contains generative AI elements", "ai_assisted_retouch": "AI-assisted retouching only (no generative content)", "unknown": "Undeclared -- confirm before submitting"}
NOT_GENERATIVE = "Not generative AI"
EDIT_WARNINGS = [
    "This edit uses generative tools. Applying it changes the asset's provenance to 'partially generated' and bars it from Alamy, Shutterstock and Getty/iStock.",
    "It also breaks editorial authenticity: a generatively altered frame cannot be submitted as documentary or editorial content anywhere.",
    "The file is currently a camera original, which is its most valuable state. Consider exporting the generative version as a separate asset.",
]
# Names of models that are no longer asked, phrases of notes that say nothing, words that a plain report leaves out.
LEGACY_MODELS = ["gpt-4", "gpt-3", "gpt-5-", "chatgpt-4o", "o1", "o3"]
TEXTBOOK = ["rule of thirds", "golden ratio", "leading lines", "perfectly balanced", "well composed", "technically flawless", "masterful", "iconic", "genius", "breathtaking"]
NOT_SHOWN = ["model release", "property release", "editorial only", "legal readiness", "trademark", "commercial blocker", "routing score", "stock potential", "portfolio potential", "flagship", "stage3", "marketplace", "editorial", "release", "licen", "commercial", "cleared", "rights"]
# Limits of the technical filter and of suggested directions.
LEAST_BLUR_RATIO, MOST_HIGHLIGHTS, MOST_SHADOWS, LOW_SHARPNESS = 2.0, 0.55, 0.75, 60.0
WARM, COOL, LOW_KEY, WIDE_TONES, DOCUMENTARY, LEAST_POTENTIAL = 1.06, 0.95, 92.0, 26.0, 70, 70
# Figures from which on a comparison with people counts.
LEAST_SAMPLES, USEFUL = 20, 0.5
STAR_PILES = {5: "top", 4: "top", 3: "good", 2: "good", 1: "weak"}
LANGUAGES = ["en", "ru"]


def known(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def _lookup(values: dict, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key), default)


def lines(*parts: Column) -> Column:
    """The parts that aren't null, as an array."""
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


# Keys of cached work.


def measurement_key(checksum: Column, version: str) -> Column:
    return F.concat(checksum, F.lit(f":{version}"))


def reply_key(stage: int, checksum: Column, model: Column, effort: Column) -> Column:
    """The key of a stage's reply; no effort is 'none'."""
    shared = STAGE2_PROMPT if stage == 2 else f"{STAGE3_PROMPT}:{STAGE3_SCHEMA}"
    return F.concat(F.lit(f"stage{stage}:"), checksum, F.lit(":"), model, F.lit(f":{shared}:"), F.when(known(effort), effort).otherwise("none"))


def embedding_key(checksum: Column, model: Column) -> Column:
    return F.concat(F.lit("embedding:"), checksum, F.lit(":"), model)


def derivative_key(content: Column, width: int, quality: int) -> Column:
    return F.concat(F.sha1(content), F.lit(f"-{width}-{quality}"))


def cached(asked: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """The asked rows with `value` and `hit`, the latest entry of a key standing for it. Entries: (key, at, value)."""
    latest = cache.groupBy(key).agg(F.max_by("value", "at").alias("value"))
    return asked.join(latest, key, "left").withColumn("hit", F.col("value").isNotNull())


# Names.


def camera_key(make: Column, model: Column) -> Column:
    """Make and model, the make once."""
    make, model = F.trim(F.coalesce(make, F.lit(""))), F.trim(F.coalesce(model, F.lit("")))
    again = (make != "") & F.startswith(F.lower(model), F.lower(make))
    rest = F.when(again, F.trim(F.substring(model, F.length(make) + 1, F.length(model)))).otherwise(model)
    return F.trim(F.concat(make, F.lit(" "), rest))


def stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")


def preview_name(name: Column) -> Column:
    return F.concat(stem(name), F.lit("_"), F.lower(F.regexp_extract(name, r"(?<=[^/])\.([^./]+)$", 1)), F.lit(".jpg"))


def safe_stem(filename: Column, key: Column) -> Column:
    """A file's stem with plain characters and a piece of its key's digest, so that names don't meet."""
    name = stem(F.when(known(filename), filename).otherwise(key))
    return F.concat(F.substring(F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_"), 1, 80), F.lit("-"), F.substring(F.sha1(key), 1, 8))


def language(tag: Column, default: str = "en") -> Column:
    base = F.lower(F.split(F.translate(F.coalesce(tag, F.lit("")), "_", "-"), "-")[0])
    return F.when(base.isin(LANGUAGES), base).otherwise(default)


# Labels and metadata.


def taxonomy(genre: Column) -> Column:
    return _lookup(TAXONOMY, F.lower(F.coalesce(genre, F.lit(""))), F.lit(OTHER_TAXONOMY))


def location(*candidates: Column) -> Column:
    """The first that is known of place, city and part of it."""
    return F.coalesce(*(F.when(known(c), c) for c in candidates), F.lit(""))


def camera_keywords(make: Column, focal: Column) -> Column:
    return lines(F.when(known(make), F.lower(make)), F.when((focal > 0) & (focal <= 24), "wide angle").when(focal >= 85, "telephoto"))


def is_complete(title: Column, description: Column, keywords: Column, category: Column) -> Column:
    return known(title) & known(description) & (F.size(keywords) >= 5) & known(category)


def without_gps(exif: Column) -> Column:
    """A map of facts without the place."""
    return F.map_filter(exif, lambda k, _: ~k.isin("gps_lat", "gps_lon", "gps_altitude"))


def with_edits(metadata: Column, edits: Column) -> Column:
    """A map of fields in which a person's values stand over the others'; fields that don't exist are not added."""
    own = F.map_filter(F.coalesce(edits, F.create_map().cast("map<string,string>")), lambda k, _: F.map_contains_key(metadata, k) & (k != "edited_by_user"))
    return F.map_concat(F.map_filter(metadata, lambda k, _: ~F.map_contains_key(own, k)), own)


def declared(provenance: Column) -> Column:
    return _lookup(DECLARED, provenance, F.lit(NOT_GENERATIVE))


def edit_warnings(provenance: Column, generative: Column) -> Column:
    always = [F.when(generative, w) for w in EDIT_WARNINGS[:2]]
    return lines(*always, F.when(generative & (provenance == "camera_original"), EDIT_WARNINGS[2]))


# Verdicts.


def rejected_for(blur_ratio: Column, highlights: Column, shadows: Column) -> Column:
    percent = lambda x: F.format_string("%.0f%%", F.bround(x * 100))
    return lines(
        F.when(blur_ratio < LEAST_BLUR_RATIO, F.format_string("out of focus (blur ratio %.2f < 2.00)", F.bround(blur_ratio, 2))),
        F.when(highlights > MOST_HIGHLIGHTS, F.concat(F.lit("blown highlights ("), percent(highlights), F.lit(")"))), F.when(shadows > MOST_SHADOWS, F.concat(F.lit("crushed shadows ("), percent(shadows), F.lit(")"))),
    )


def looks_soft(tile: Column) -> Column:
    return tile < LOW_SHARPNESS


def pick_from_burst(df: DataFrame, group: str, key: str = "key", sharpness: str = "sharpness") -> DataFrame:
    """Each burst's sharpest frame, the least key among equals; unknown sharpness counts as none."""
    return df.groupBy(group).agg(F.min_by(key, F.struct(-F.coalesce(F.col(sharpness), F.lit(0.0)), F.col(key))).alias(key))


def deeper_read(route: Column, unrecoverable: Column, intent: Column, uncertainty: Column, faces: Column, corrupt: Column) -> tuple[Column, Column]:
    """Whether a frame gets the artistic read, and why."""
    rules = [
        (corrupt, False, "the file does not decode"), (unrecoverable & (intent < 40), False, "confidently unrecoverable, with no sign the defect was a choice"), (route.isin("flagship", "stock_strong", "stock_standard"), True, "a keep or hero candidate"),
        (faces, True, "a face is present and expression decides the outcome"), (intent >= 55, True, "an apparent defect may be deliberate"), (uncertainty >= 60, True, "too uncertain to route without looking"), (route.isin("review", "duplicate_candidate"), True, "unresolved, and the artistic read may settle it"),
    ]
    runs, why = F.lit(False), F.lit("confidently routed without an artistic judgement")
    for rule, run, text in reversed(rules):
        runs, why = F.when(rule, run).otherwise(runs), F.when(rule, text).otherwise(why)
    return runs, why


def only_rescues(before: Column, after: Column) -> Column:
    return (before == "technical_failure") | (after != "technical_failure")


def artistic_signal(intent: Column, *dimensions: Column) -> Column:
    out = intent >= 55
    for d in dimensions:
        out = out | F.coalesce(d >= 55, F.lit(False))
    return out


def commercial_blocker(present: Column, potential: Column, least: float) -> Column:
    """What stands against selling a frame; null if nothing does."""
    weak = F.concat(F.lit("limited commercial demand (stock potential "), potential.cast("string"), F.lit(f" below {least:.0f})"))
    return F.when(~present, "no content check has run").when(potential < least, weak)


def boundary_reason(final: Column, review_detail: Column, uncertainty: Column) -> Column:
    unsure = F.concat(F.lit("and the artistic read is "), F.coalesce(uncertainty, F.lit(100)).cast("string"), F.lit("% unsure it understood this frame"))
    return F.concat(F.lit("on the boundary at "), final.cast("string"), F.lit(", "), F.when(known(review_detail), F.concat(F.lit("and "), review_detail)).otherwise(unsure))


def nearly_grey(r: Column, g: Column, b: Column) -> Column:
    """Whether the channels are so close that a version without colour is worth offering."""
    most = F.greatest(r, g, b)
    return (most > 1) & ((most - F.least(r, g, b)) / F.greatest(most, F.lit(1.0)) < 0.06)


def tilt_of(steps: Column) -> Column:
    """Degrees by the first step that straightens: clockwise is negative; 0 without one."""
    step = F.try_element_at(F.filter(steps, lambda s: F.contains(s, F.lit("Straighten")) & s.rlike(r"[\d.]+°")), F.lit(1))
    degrees = F.regexp_extract(step, r"([\d.]+)°", 1).try_cast("double")
    back = F.contains(step, F.lit("clockwise")) & ~F.contains(step, F.lit("anticlock"))
    return F.coalesce(F.when(back, -degrees).otherwise(degrees), F.lit(0.0))


def directions(genre: Column, documentary: Column, warmth: Column, luma: Column, stddev: Column) -> Column:
    """Up to three directions in which a frame may be taken, by what it already is."""
    of = lambda *names: F.lower(F.coalesce(genre, F.lit(""))).isin(*names)
    neutral = (warmth > COOL) & (warmth < WARM)
    first = lines(
        F.when((documentary >= DOCUMENTARY) | of("reportage", "street", "architecture"), "documentary_neutral"), F.when((luma > 0) & (luma <= LOW_KEY), "cinematic_low_key"),
        F.when((warmth >= WARM) & of("landscape", "street", "detail", "reportage"), "warm_autumn").when((warmth <= COOL) & (warmth < WARM) & of("landscape", "architecture", "street"), "cool_winter"),
    )
    return F.concat(first, F.when(neutral & (stddev >= WIDE_TONES) & (F.size(first) < 3), F.array(F.lit("restrained_bw"))).otherwise(F.array().cast("array<string>")))


def worth_exporting(final: Column, category: Column) -> Column:
    return (F.coalesce(final, F.lit(0)) >= LEAST_POTENTIAL) & (category != "WEAK")


def plain(text: Column) -> Column:
    """A reason as a plain report shows it: its first clause, or nothing if it speaks of rights and scores."""
    head = text
    for mark in (" -- ", " — ", ". Not for stock"):
        head = F.split(head, F.lit("\\Q" + mark + "\\E"))[0]
    return F.when(F.lower(head).rlike("|".join(NOT_SHOWN)), "").otherwise(F.trim(head))


def explanation(reasons: Column, fallback: Column) -> Column:
    """The first reason that a plain report shows."""
    return F.coalesce(F.try_element_at(F.filter(F.transform(reasons, lambda r: plain(r)), lambda r: r != ""), F.lit(1)), fallback)


def recommendations(steps: Column, most: int = 3) -> Column:
    """The first distinct steps, trimmed, without empty ones."""
    return F.slice(F.array_distinct(F.filter(F.transform(steps, lambda s: F.trim(s)), lambda s: s != "")), 1, most)


def textbook(note: Column) -> Column:
    return F.lower(F.coalesce(note, F.lit(""))).rlike("|".join(TEXTBOOK))


def legacy_model(name: Column) -> Column:
    return F.lower(F.trim(F.coalesce(name, F.lit("")))).rlike("^(" + "|".join(LEGACY_MODELS) + ")")


def truncated(status: Column, detail: Column, stop: Column, finish: Column) -> Column:
    """Whether a reply ended for want of room, by what any of the services says."""
    at = lambda c: F.coalesce(c, F.lit(""))
    return (at(status) == "incomplete") | F.contains(at(detail), F.lit("max_output_tokens")) | (at(stop) == "max_tokens") | (at(finish) == "length") | F.contains(F.upper(at(finish)), F.lit("MAX_TOKENS"))


def failure(error: Column, status: Column) -> Column:
    """The kind of a failed call by its text and its status code, null where there is none."""
    text = F.lower(F.coalesce(error, F.lit("")))
    code = lambda n: F.when(status.isNotNull(), status == n).otherwise(text.rlike(rf"(?:error\s+code|status(?:\s+code)?|http|code)\s*[:=]?\s*({n})\b|^\s*({n})\s+[a-z]"))
    rules = [
        (text.rlike("does not exist|do not have access|model_not_found"), "model_access"), (text.rlike("insufficient_quota|exceeded your current quota"), "quota"), (text.rlike("billing|payment"), "billing"),
        (text.rlike("invalid_api_key|incorrect api key") | code(401), "auth"), (code(403) | text.rlike("permission|not allowed"), "permission"), (code(429), "quota"), (text.rlike("image") & text.rlike("not support|unsupported"), "vision"),
        (text.rlike("connection|timed out|timeout"), "unreachable"), (code(404), "model_access"),
    ]
    out = F.lit("unknown")
    for rule, name in reversed(rules):
        out = F.when(rule, name).otherwise(out)
    return out


def estimated_cost(photographs: Column, per_hundred: Column, default: float = 1.0) -> Column:
    return F.bround(F.coalesce(per_hundred, F.lit(default)) * F.greatest(F.lit(0), photographs) / 100.0, 2)


def validates(n: Column, rho: Column) -> Column:
    """Whether enough rows agree well enough with people's order."""
    return (n >= LEAST_SAMPLES) & (rho >= USEFUL)


def pile_by_stars(stars: Column) -> Column:
    return _lookup(STAR_PILES, stars.cast("int"), F.lit(None).cast("string"))


def automation(checks: Column, problems: Column, least: int = 3000) -> tuple[Column, Column]:
    """Whether acting without a person may begin, and why not."""
    few = F.concat(checks.cast("string"), F.lit(f" holdout checks; {least} are needed before a false-trash rate below 0.1% can be claimed at all"))
    return (checks >= least) & ~known(problems), F.when(checks < least, few).when(known(problems), problems).otherwise("automation enabled")


# Summaries.


def policy_summary(decisions: DataFrame) -> DataFrame:
    """(total, needs_person, automated_share, audited): one row over the decided buckets."""
    person = F.count_if(F.col("bucket").isin("manual_review", "curatorial_review"))
    return decisions.agg(F.count("*").alias("total"), person.alias("needs_person"), F.bround(1 - person / F.greatest(F.count("*"), F.lit(1)), 4).alias("automated_share"), F.count_if("audit_sampled").alias("audited"))


def platform_summary(found: DataFrame, most: int = 3) -> DataFrame:
    """(key, recommended, eligible, blocked): each asset's most suitable platforms, how many take it, and how many don't."""
    order = Window.partitionBy("key").orderBy(F.desc("suitability"), "platform")
    ranked = found.withColumn("_r", F.when(F.col("eligible"), F.row_number().over(order.partitionBy("key", "eligible"))))
    top = F.array_sort(F.collect_list(F.when(F.col("_r") <= most, F.struct("_r", "platform"))))
    return ranked.groupBy("key").agg(F.array_join(F.transform(top, lambda x: x["platform"]), ",").alias("recommended"), F.count_if("eligible").alias("eligible"), F.count_if(~F.col("eligible")).alias("blocked"))


def issue_lines(issues: Column, fixability: dict[str, str], kind: str) -> Column:
    """The issues of one kind as `code: detail`, in their order."""
    own = F.filter(issues, lambda i: _lookup(fixability, i["code"], F.lit("")) == kind)
    return F.transform(own, lambda i: F.when(known(i["detail"]), F.concat(i["code"], F.lit(": "), i["detail"])).otherwise(i["code"]))


def plan_summary(planned: DataFrame) -> DataFrame:
    """(reason, files, megabytes) of planned moves, with a line for all under no reason."""
    return planned.rollup("reason").agg(F.count("*").alias("files"), F.bround(F.sum("size_bytes") / 1048576.0, 1).alias("megabytes"))


def recoverable_bytes(operations: DataFrame) -> DataFrame:
    """(bytes): the size of files whose last operation moved them."""
    last = operations.groupBy("destination").agg(F.max_by(F.struct("status", "size_bytes"), "timestamp").alias("o"))
    return last.where("o.status = 'moved'").agg(F.coalesce(F.sum("o.size_bytes"), F.lit(0)).cast("long").alias("bytes"))


def scope(records: DataFrame, analysed: DataFrame, key: str = "checksum") -> DataFrame:
    """The records that the last run analysed, with `scope` 'new'; all of them, under 'all', if it analysed none of these."""
    own = records.join(analysed.select(key).distinct(), key, "left_semi")
    some = own.limit(1).agg(F.count("*").alias("_n"))
    joined = records.crossJoin(F.broadcast(some)).join(analysed.select(key, F.lit(True).alias("_in")).distinct(), key, "left")
    return joined.where((F.col("_n") == 0) | F.col("_in")).withColumn("scope", F.when(F.col("_n") == 0, "all").otherwise("new")).drop("_n", "_in")


def analysis_mode(requested: Column, completed: Column) -> Column:
    return F.when(~requested, "local_only").when(completed, "local_and_semantic").otherwise("local_only_after_semantic_failure")


def spend(usage: DataFrame, frames: int) -> DataFrame:
    """(stage, tokens_in, tokens_out, in_per_frame, out_per_frame) for each stage and, under 'total', all."""
    out = usage.rollup("stage").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out")).withColumn("stage", F.coalesce("stage", F.lit("total")))
    each = lambda c: F.bround(F.col(c) / float(max(frames, 1)), 2)
    return out.withColumns({"in_per_frame": each("tokens_in"), "out_per_frame": each("tokens_out")})


def mean_likeness(members: DataFrame, group: str, code: str) -> DataFrame:
    """(group, size, mean_likeness): the mean likeness of all pairs of a group's 64-bit codes, from counts of each bit alone.

    Pairs that differ in a bit are the ones that have it times those that haven't; so no pair is formed, whatever the group's size.
    """
    ones = [F.sum(F.shiftright(F.col(code), i).bitwiseAND(1)).alias(f"_{i}") for i in range(64)]
    n = F.col("size")
    apart = sum((F.col(f"_{i}") * (n - F.col(f"_{i}")) for i in range(1, 64)), F.col("_0") * (n - F.col("_0")))
    mean = F.bround(1 - apart / (64.0 * (n * (n - 1) / 2)), 3)
    return members.groupBy(group).agg(F.count("*").alias("size"), *ones).select(group, "size", F.when(n >= 2, mean).otherwise(0.0).alias("mean_likeness"))


def best_names(records: DataFrame, group: str, most: int = 3) -> DataFrame:
    """(group, names): the file names of a group's best records, best first."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("final_score"), "filename"))
    top = records.withColumn("_p", place).where(F.col("_p") <= most)
    return top.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "filename"))), lambda x: x["filename"]), ",").alias("names"))


def is_a_pattern(n: Column, total: Column, least: int = 3, share: float = 0.15) -> Column:
    return (n >= least) & (total > 0) & (n / total >= share)
