"""Queries of stored records: keys, names, labels, verdicts and summaries, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.operators import records
from vellumine.plans.bindings import duck, table
from vellumine.plans.registry import query

def _k():
    return F.col("event_id")


def events(spark: SparkSession, d: str, columns: dict[str, str] | None = None) -> DataFrame:
    e = table(spark, d, "events")
    return e.selectExpr("event_id AS key", "user_id", "ts", "event_type", "value").selectExpr("*", *(f"{sql} AS {name}" for name, sql in columns.items())) if columns else e


def sql_of(columns: dict[str, str], name: str = "N") -> str:
    return f"{name} AS (SELECT key, user_id, ts, event_type, value, " + ", ".join(f"{duck(sql)} AS {n}" for n, sql in columns.items()) + " FROM (SELECT event_id AS key, user_id, ts, event_type, value FROM events))"


# --- keys and names -------------------------------------------------------------------------------


@query("""SELECT doc_id, sha256(text) || ':v3' AS measured, 'stage2:' || sha256(text) || ':' || source || ':stage2-2026-08-16:' || CASE WHEN doc_id % 2 = 0 THEN 'low' ELSE 'none' END AS second, 'stage3:' || sha256(text) || ':' || source || ':stage3-2026-08-12b:1:' || CASE WHEN doc_id % 2 = 0 THEN 'low' ELSE 'none' END AS third,
  'embedding:' || sha256(text) || ':' || lang AS vector, sha1(text) || '-640-80' AS derivative FROM documents""")
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    c, sha = F.col, F.sha2(F.col("text").cast("binary"), 256)
    effort = F.when(c("doc_id") % 2 == 0, "low").when(c("doc_id") % 3 == 0, "")
    return table(spark, d, "documents").select("doc_id", records.measurement_key(sha, "v3").alias("measured"), records.reply_key(2, sha, c("source"), effort).alias("second"), records.reply_key(3, sha, c("source"), effort).alias("third"), records.embedding_key(sha, c("lang")).alias("vector"), records.derivative_key(c("text").cast("binary"), 640, 80).alias("derivative"))


@query("""WITH C AS (SELECT user_id AS k, arg_max(event_type, event_id) AS value FROM events WHERE event_type <> 'view' GROUP BY 1) SELECT c_custkey AS cache_key, value, value IS NOT NULL AS hit FROM customer LEFT JOIN C ON k = c_custkey""")
def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Customers asked for; the last event of each user that isn't a view is what is kept of it."""
    kept = table(spark, d, "events").where("event_type <> 'view'").select(F.col("user_id").alias("cache_key"), F.col("event_id").alias("at"), F.col("event_type").alias("value"))
    return records.cached(table(spark, d, "customer").select(F.col("c_custkey").alias("cache_key")), kept).select("cache_key", "value", "hit")


_NAME = {"make": "CASE key % 4 WHEN 0 THEN 'Canon' WHEN 1 THEN ' NIKON ' WHEN 2 THEN '' ELSE NULL END", "model": "CASE key % 5 WHEN 0 THEN 'Canon EOS R5' WHEN 1 THEN 'nikon Z 6' WHEN 2 THEN 'X-T4' ELSE NULL END", "filename": "CASE WHEN key % 9 = 0 THEN '' ELSE concat('a/IMG ', concat(CAST(key AS STRING), CASE key % 3 WHEN 0 THEN '.RW2' WHEN 1 THEN '.tar.Jpg' ELSE '+x.mp4' END)) END", "tag": "CASE key % 5 WHEN 0 THEN 'ru_RU' WHEN 1 THEN 'EN-us' WHEN 2 THEN 'fr' WHEN 3 THEN '' ELSE NULL END"}
_MODEL = "CASE WHEN trim(coalesce(make, '')) <> '' AND starts_with(lower(trim(coalesce(model, ''))), lower(trim(coalesce(make, '')))) THEN trim(substr(trim(model), length(trim(make)) + 1)) ELSE trim(coalesce(model, '')) END"
_STEM = lambda x: f"regexp_replace(regexp_replace({x}, '^.*/', ''), '(.)\\.[^.]*$', '\\1')"


@query(f"""WITH {sql_of(_NAME)} SELECT key, trim(trim(coalesce(make, '')) || ' ' || {_MODEL}) AS camera, {_STEM("filename")} || '_' || lower(regexp_extract(filename, '[^/]\\.([^./]+)$', 1)) || '.jpg' AS preview,
  substr(regexp_replace({_STEM("CASE WHEN filename = '' THEN 'k' || key ELSE filename END")}, '[^A-Za-z0-9_-]', '_', 'g'), 1, 80) || '-' || substr(sha1('k' || key), 1, 8) AS safe, CASE WHEN lower(split_part(translate(coalesce(tag, ''), '_', '-'), '-', 1)) IN ('en', 'ru') THEN lower(split_part(translate(tag, '_', '-'), '-', 1)) ELSE 'en' END AS language FROM N""")
def record_names(spark: SparkSession, d: str) -> DataFrame:
    c, e = F.col, events(spark, d, _NAME)
    return e.select("key", records.camera_key(c("make"), c("model")).alias("camera"), records.preview_name(c("filename")).alias("preview"), records.safe_stem(c("filename"), F.concat(F.lit("k"), c("key").cast("string"))).alias("safe"), records.language(c("tag")).alias("language"))


# --- labels and metadata --------------------------------------------------------------------------

_META = {
    "genre": "CASE key % 6 WHEN 0 THEN 'Street' WHEN 1 THEN 'portrait' WHEN 2 THEN 'detail' WHEN 3 THEN 'sports' WHEN 4 THEN NULL ELSE 'reportage' END", "place": "CASE WHEN key % 3 = 0 THEN 'Bridge' ELSE '' END", "city": "CASE WHEN key % 2 = 0 THEN 'Oslo' END",
    "make": "CASE WHEN key % 4 = 0 THEN NULL ELSE 'Canon' END", "focal": "CAST(key % 120 AS DOUBLE)", "title": "CASE WHEN key % 7 = 0 THEN '' ELSE 't' END", "n_words": "key % 9", "category": "CASE WHEN key % 5 = 0 THEN NULL ELSE 'travel' END",
    "provenance": "CASE key % 7 WHEN 0 THEN 'camera_original' WHEN 1 THEN 'fully_generated' WHEN 2 THEN 'generative_fill_used' WHEN 3 THEN 'ai_assisted_retouch' WHEN 4 THEN 'unknown' WHEN 5 THEN 'scanned_film' ELSE 'partially_generated' END", "generative": "key % 2 = 0",
}
_case = lambda table_, key, other: f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + f" ELSE '{other}' END"
_list = lambda *parts: "array_to_string(list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL), '|')"
_quoted = lambda text: "'" + text.replace("'", "''") + "'"


@query(f"""WITH {sql_of(_META)} SELECT key, {_case(records.TAXONOMY, "lower(genre)", records.OTHER_TAXONOMY)} AS taxonomy, CASE WHEN place <> '' THEN place WHEN city <> '' THEN city ELSE '' END AS location, {_list("lower(make)", "CASE WHEN focal > 0 AND focal <= 24 THEN 'wide angle' WHEN focal >= 85 THEN 'telephoto' END")} AS camera_words,
  title <> '' AND n_words >= 5 AND coalesce(category, '') <> '' AS complete, {_case(records.DECLARED, "provenance", records.NOT_GENERATIVE)} AS declared, {_list(*(f"CASE WHEN generative THEN {_quoted(w)} END" for w in records.EDIT_WARNINGS[:2]), f"CASE WHEN generative AND provenance = 'camera_original' THEN {_quoted(records.EDIT_WARNINGS[2])} END")} AS warnings FROM N""")
def submission_labels(spark: SparkSession, d: str) -> DataFrame:
    c, e = F.col, events(spark, d, _META)
    words = F.array_repeat(F.lit("w"), c("n_words").cast("int"))
    return e.select(
        "key", records.taxonomy(c("genre")).alias("taxonomy"), records.location(c("place"), c("city")).alias("location"), F.array_join(records.camera_keywords(c("make"), c("focal")), "|").alias("camera_words"), records.is_complete(c("title"), F.lit("d"), words, c("category")).alias("complete"),
        records.declared(c("provenance")).alias("declared"), F.array_join(records.edit_warnings(c("provenance"), c("generative")), "|").alias("warnings"),
    )


@query("""SELECT event_id AS key, CASE WHEN event_id % 3 = 0 THEN 'mine' ELSE 'title ' || event_id END AS title, CASE WHEN event_id % 6 = 0 THEN 'also mine' ELSE event_type END AS note, CAST(2 AS BIGINT) AS n_fields, CAST(1 AS BIGINT) AS n_facts FROM events""")
def metadata_edits(spark: SparkSession, d: str) -> DataFrame:
    """A person's fields over the generated ones; facts without the place."""
    own = F.when(_k() % 6 == 0, F.create_map(F.lit("title"), F.lit("mine"), F.lit("note"), F.lit("also mine"), F.lit("unknown"), F.lit("x"))).when(_k() % 3 == 0, F.create_map(F.lit("title"), F.lit("mine")))
    made = records.with_edits(F.create_map(F.lit("title"), F.concat(F.lit("title "), _k().cast("string")), F.lit("note"), F.col("event_type")), own)
    facts = records.without_gps(F.create_map(F.lit("gps_lat"), _k().cast("string"), F.lit("iso"), F.lit("100"), F.lit("gps_altitude"), F.lit("1")))
    return events(spark, d).select(_k().alias("key"), made["title"].alias("title"), made["note"].alias("note"), F.size(made).cast("long").alias("n_fields"), F.size(facts).cast("long").alias("n_facts"))


# --- verdicts -------------------------------------------------------------------------------------

_VERDICT = {
    "blur_ratio": "CAST(key % 60 AS DOUBLE) / 20", "highlights": "CAST(key % 100 AS DOUBLE) / 100", "shadows": "CAST(key * 3 % 100 AS DOUBLE) / 100", "tile": "CAST(key % 120 AS DOUBLE)", "route": "CASE key % 6 WHEN 0 THEN 'flagship' WHEN 1 THEN 'review' WHEN 2 THEN 'trash' WHEN 3 THEN 'stock_strong' ELSE 'archive_only' END",
    "bad": "key % 5 = 0", "intent": "key * 7 % 101", "uncertainty": "key * 11 % 101", "faces": "key % 8 = 0", "corrupt": "key % 31 = 0", "before": "CASE WHEN key % 2 = 0 THEN 'technical_failure' ELSE 'keep' END", "after": "CASE WHEN key % 3 = 0 THEN 'technical_failure' ELSE 'art' END",
    "one": "CASE WHEN key % 4 = 0 THEN NULL ELSE key * 13 % 101 END", "two": "key * 17 % 101", "potential": "key * 19 % 101", "detail": "CASE WHEN key % 3 = 0 THEN 'the eyes are shut' ELSE '' END",
}
_RULES = [("corrupt", "false", "the file does not decode"), ("bad AND intent < 40", "false", "confidently unrecoverable, with no sign the defect was a choice"), ("route IN ('flagship', 'stock_strong', 'stock_standard')", "true", "a keep or hero candidate"), ("faces", "true", "a face is present and expression decides the outcome"), ("intent >= 55", "true", "an apparent defect may be deliberate"), ("uncertainty >= 60", "true", "too uncertain to route without looking"), ("route IN ('review', 'duplicate_candidate')", "true", "unresolved, and the artistic read may settle it")]


@query(f"""WITH {sql_of(_VERDICT)} SELECT key, {_list("CASE WHEN blur_ratio < 2 THEN 'out of focus (blur ratio ' || printf('%.2f', blur_ratio) || ' < 2.00)' END", "CASE WHEN highlights > 0.55::DOUBLE THEN 'blown highlights (' || printf('%.0f', round_even(highlights * 100, 0)) || '%)' END", "CASE WHEN shadows > 0.75::DOUBLE THEN 'crushed shadows (' || printf('%.0f', round_even(shadows * 100, 0)) || '%)' END")} AS rejected_for,
  tile < 60 AS soft, CASE {" ".join(f"WHEN {r} THEN {v}" for r, v, _ in _RULES)} ELSE false END AS reads, CASE {" ".join(f"WHEN {r} THEN {_quoted(t)}" for r, _, t in _RULES)} ELSE 'confidently routed without an artistic judgement' END AS why, before = 'technical_failure' OR after <> 'technical_failure' AS only_rescues,
  intent >= 55 OR coalesce(one >= 55, false) OR two >= 55 AS signal, CASE WHEN bad THEN 'no content check has run' WHEN potential < 45 THEN 'limited commercial demand (stock potential ' || potential || ' below 45)' END AS blocker,
  'on the boundary at ' || potential || ', ' || CASE WHEN detail <> '' THEN 'and ' || detail ELSE 'and the artistic read is ' || coalesce(one, 100) || '% unsure it understood this frame' END AS boundary FROM N""")
def frame_verdicts(spark: SparkSession, d: str) -> DataFrame:
    c, e = F.col, events(spark, d, _VERDICT)
    runs, why = records.deeper_read(c("route"), c("bad"), c("intent"), c("uncertainty"), c("faces"), c("corrupt"))
    return e.select(
        "key", F.array_join(records.rejected_for(c("blur_ratio"), c("highlights"), c("shadows")), "|").alias("rejected_for"), records.looks_soft(c("tile")).alias("soft"), runs.alias("reads"), why.alias("why"), records.only_rescues(c("before"), c("after")).alias("only_rescues"),
        records.artistic_signal(c("intent"), c("one"), c("two")).alias("signal"), records.commercial_blocker(~c("bad"), c("potential"), 45).alias("blocker"), records.boundary_reason(c("potential"), c("detail"), c("one")).alias("boundary"),
    )


@query("WITH S AS (SELECT event_id // 7 AS burst, event_id AS key, CASE WHEN event_id % 4 = 0 THEN NULL ELSE floor(value) END AS s FROM events) SELECT CAST(burst AS BIGINT) AS burst, arg_min(key, struct_pack(s := -coalesce(s, 0.0), k := key)) AS key FROM S GROUP BY 1")
def burst_pick(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select(F.floor(_k() / 7).alias("burst"), _k().alias("key"), F.when(_k() % 4 != 0, F.floor("value").cast("double")).alias("sharpness"))
    return records.pick_from_burst(e, "burst")


_DIRECTION = {"r": "CAST(key * 7 % 256 AS DOUBLE)", "g": "CAST(key * 7 % 256 AS DOUBLE) + key % 9", "b": "CAST(key * 7 % 256 AS DOUBLE) + key % 23", "genre": "CASE key % 6 WHEN 0 THEN 'Street' WHEN 1 THEN 'landscape' WHEN 2 THEN 'detail' WHEN 3 THEN 'architecture' WHEN 4 THEN NULL ELSE 'reportage' END", "documentary": "key * 3 % 101", "warmth": "CAST(key % 40 AS DOUBLE) / 100 + 0.8D", "luma": "CAST(key % 256 AS DOUBLE)", "stddev": "CAST(key % 60 AS DOUBLE)", "final": "key % 101", "category": "CASE WHEN key % 3 = 0 THEN 'WEAK' ELSE 'TOP' END"}
_DIRECTION_SQL = sql_of(_DIRECTION).replace("0.8D", "0.8::DOUBLE")
_first = "list_filter([CASE WHEN documentary >= 70 OR genre IN ('reportage', 'Street', 'architecture') THEN 'documentary_neutral' END, CASE WHEN luma > 0 AND luma <= 92 THEN 'cinematic_low_key' END, CASE WHEN warmth >= 1.06::DOUBLE AND genre IN ('landscape', 'Street', 'detail', 'reportage') THEN 'warm_autumn' WHEN warmth <= 0.95::DOUBLE AND genre IN ('landscape', 'architecture', 'Street') THEN 'cool_winter' END], lambda x: x IS NOT NULL)"


@query(f"""WITH {_DIRECTION_SQL}, F1 AS (SELECT *, {_first} AS f FROM N) SELECT key, array_to_string(list_concat(f, CASE WHEN warmth > 0.95::DOUBLE AND warmth < 1.06::DOUBLE AND stddev >= 26 AND len(f) < 3 THEN ['restrained_bw'] ELSE [] END), ',') AS directions,
  greatest(r, g, b) > 1 AND (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b, 1.0) < 0.06::DOUBLE AS nearly_grey, final >= 70 AND category <> 'WEAK' AS export, CASE key % 4 WHEN 0 THEN -1.5::DOUBLE WHEN 1 THEN 2.0 ELSE 0.0 END AS tilt FROM F1""")
def edit_directions(spark: SparkSession, d: str) -> DataFrame:
    c, e = F.col, events(spark, d, _DIRECTION)
    steps = F.when(c("key") % 4 == 0, F.array(F.lit("Lift shadows"), F.lit("Straighten by 1.5° clockwise"))).when(c("key") % 4 == 1, F.array(F.lit("Straighten by 2° anticlockwise"))).when(c("key") % 4 == 2, F.array(F.lit("Straighten"))).otherwise(F.array().cast("array<string>"))
    return e.select("key", F.array_join(records.directions(c("genre"), c("documentary"), c("warmth"), c("luma"), c("stddev")), ",").alias("directions"), records.nearly_grey(c("r"), c("g"), c("b")).alias("nearly_grey"), records.worth_exporting(c("final"), c("category")).alias("export"), records.tilt_of(steps).alias("tilt"))


_REASON = {"first": "CASE key % 5 WHEN 0 THEN 'a strong frame -- with detail' WHEN 1 THEN 'Stock potential 40' WHEN 2 THEN ' ' WHEN 3 THEN 'Kept. Not for stock: faces' ELSE 'cleared for sale' END", "second": "CASE WHEN key % 2 = 0 THEN 'light — and air' ELSE 'MARKETPLACE rules' END", "note": "CASE WHEN key % 3 = 0 THEN 'Uses the Rule of Thirds' ELSE 'a dog runs' END", "model": "CASE key % 4 WHEN 0 THEN ' GPT-4o' WHEN 1 THEN 'o1-mini' WHEN 2 THEN 'gpt-5.1' ELSE NULL END"}


@query(f"""WITH {sql_of(_REASON)} SELECT key, CASE WHEN key % 5 = 0 THEN 'a strong frame' WHEN key % 5 = 3 THEN 'Kept' WHEN key % 2 = 0 THEN 'light' ELSE 'none given' END AS explanation, CASE WHEN key % 2 = 0 THEN 'crop|lift' ELSE 'crop|lift|cool' END AS steps, key % 3 = 0 AS textbook, key % 4 < 2 AS legacy FROM N""")
def plain_reports(spark: SparkSession, d: str) -> DataFrame:
    c, e = F.col, events(spark, d, _REASON)
    steps = F.array(F.lit(" crop "), F.lit(""), F.lit("lift"), F.lit("crop"), F.when(c("key") % 2 == 0, "lift").otherwise("cool"), F.lit("lift"))
    return e.select("key", records.explanation(F.array("first", "second"), F.lit("none given")).alias("explanation"), F.array_join(records.recommendations(steps), "|").alias("steps"), records.textbook(c("note")).alias("textbook"), records.legacy_model(c("model")).alias("legacy"))


_ERRORS = [("The model does not exist", None, "model_access"), ("You exceeded your current quota", 429, "quota"), ("Billing hard limit", None, "billing"), ("Incorrect API key provided", None, "auth"), ("error code: 401", None, "auth"), ("bad", 401, "auth"), ("HTTP 403 forbidden", None, "permission"), ("401 unauthorised", 500, "unknown"), ("status code = 429", None, "quota"), ("image input is not supported", None, "vision"), ("Connection reset", None, "unreachable"), ("404 not here", None, "model_access"), ("page 404", None, "unknown"), (None, None, "unknown")]
_nth = lambda i, default: f"CASE event_id % {len(_ERRORS)} " + " ".join(f"WHEN {n} THEN {'NULL' if x[i] is None else repr(x[i])}" for n, x in enumerate(_ERRORS)) + f" ELSE {default} END"


@query(f"""SELECT event_id AS key, {_nth(2, "''")} AS failure, event_id % 6 < 5 AS truncated, round_even(CASE WHEN event_id % 2 = 0 THEN 1.9::DOUBLE ELSE 1.0 END * greatest(0, event_id * 10 - 50) / 100.0::DOUBLE, 2) AS cost, event_id % 40 >= 20 AND (event_id % 10) / 10.0::DOUBLE >= 0.5 AS validates,
  CASE event_id % 7 WHEN 5 THEN 'top' WHEN 4 THEN 'top' WHEN 3 THEN 'good' WHEN 2 THEN 'good' WHEN 1 THEN 'weak' END AS pile, event_id % 4000 >= 3000 AND event_id % 2 = 0 AS may_act, CASE WHEN event_id % 4000 < 3000 THEN event_id % 4000 || ' holdout checks; 3000 are needed before a false-trash rate below 0.1% can be claimed at all' WHEN event_id % 2 = 1 THEN 'drift' ELSE 'automation enabled' END AS because,
  CASE WHEN event_id % 2 = 0 THEN 'local_only' WHEN event_id % 3 = 0 THEN 'local_and_semantic' ELSE 'local_only_after_semantic_failure' END AS mode FROM events""")
def service_facts(spark: SparkSession, d: str) -> DataFrame:
    """Failures by kind, cut replies, costs, and what may be claimed or done."""
    error, status = F.expr(_nth(0, "NULL")), F.expr(_nth(1, "NULL"))
    cut = records.truncated(F.when(_k() % 6 == 0, "incomplete"), F.when(_k() % 6 == 1, "reason: max_output_tokens"), F.when(_k() % 6 == 2, "max_tokens"), F.when(_k() % 6 == 3, "length").when(_k() % 6 == 4, "FinishReason.Max_Tokens"))
    may, because = records.automation(_k() % 4000, F.when(_k() % 2 == 1, "drift").otherwise(""))
    return events(spark, d).select(
        _k().alias("key"), records.failure(error, status).alias("failure"), cut.alias("truncated"), records.estimated_cost(_k() * 10 - 50, F.when(_k() % 2 == 0, 1.9)).alias("cost"), records.validates(_k() % 40, (_k() % 10) / 10.0).alias("validates"), records.pile_by_stars(_k() % 7).alias("pile"),
        may.alias("may_act"), because.alias("because"), records.analysis_mode(_k() % 2 != 0, _k() % 3 == 0).alias("mode"),
    )


# --- summaries ------------------------------------------------------------------------------------


@query("SELECT count(*) AS total, count(*) FILTER (event_id % 9 < 2) AS needs_person, round_even(1 - count(*) FILTER (event_id % 9 < 2) / count(*)::DOUBLE, 4) AS automated_share, count(*) FILTER (event_id % 50 = 0) AS audited FROM events")
def policy_summary(spark: SparkSession, d: str) -> DataFrame:
    bucket = F.when(_k() % 9 == 0, "manual_review").when(_k() % 9 == 1, "curatorial_review").otherwise("auto_archive")
    return records.policy_summary(events(spark, d).select(bucket.alias("bucket"), (_k() % 50 == 0).alias("audit_sampled")))


@query("""WITH X AS (SELECT o_orderkey AS key, l_linenumber AS n, l_suppkey AS platform, l_quantity AS suitability, l_partkey % 3 <> 0 AS eligible FROM lineitem JOIN orders ON l_orderkey = o_orderkey), R AS (SELECT *, row_number() OVER (PARTITION BY key, eligible ORDER BY suitability DESC, lpad(CAST(platform AS VARCHAR), 9, '0') || n) AS r FROM X)
  SELECT key, coalesce(string_agg(lpad(CAST(platform AS VARCHAR), 9, '0') || n, ',' ORDER BY r) FILTER (eligible AND r <= 3), '') AS recommended, count(*) FILTER (eligible) AS eligible, count(*) FILTER (NOT eligible) AS blocked FROM R GROUP BY key""")
def platform_summary(spark: SparkSession, d: str) -> DataFrame:
    """Orders as assets, their lines as platforms."""
    name = F.concat(F.lpad(F.col("l_suppkey").cast("string"), 9, "0"), F.col("l_linenumber").cast("string"))
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), name.alias("platform"), F.col("l_quantity").alias("suitability"), (F.col("l_partkey") % 3 != 0).alias("eligible"))
    return records.platform_summary(x)


_FIX = {"underexposed": "fixable", "soft_focus": "partial", "corrupt_file": "unrecoverable"}


@query("""SELECT event_id AS key, CASE WHEN event_id % 2 = 0 THEN 'underexposed: by ' || event_id % 5 ELSE '' END AS fixable, 'soft_focus' AS partial, CASE WHEN event_id % 3 = 0 THEN 'corrupt_file: x' ELSE '' END AS unrecoverable FROM events""")
def issue_lines(spark: SparkSession, d: str) -> DataFrame:
    one = lambda when, code, detail: F.when(when, F.struct(F.lit(code).alias("code"), detail.alias("detail")))
    found = F.filter(F.array(one(_k() % 2 == 0, "underexposed", F.concat(F.lit("by "), (_k() % 5).cast("string"))), one(F.lit(True), "soft_focus", F.lit("")), one(_k() % 3 == 0, "corrupt_file", F.lit("x")), one(F.lit(True), "other", F.lit("y"))), lambda x: x.isNotNull())
    e = events(spark, d).select(_k().alias("key"), found.alias("i"))
    return e.select("key", *(F.array_join(records.issue_lines(F.col("i"), _FIX, kind), "|").alias(kind) for kind in ("fixable", "partial", "unrecoverable")))


@query("SELECT event_type AS reason, count(*) AS files, round_even(sum(event_id * 1000) / 1048576.0::DOUBLE, 1) AS megabytes FROM events GROUP BY ROLLUP (event_type)")
def move_plan_summary(spark: SparkSession, d: str) -> DataFrame:
    return records.plan_summary(events(spark, d).select(F.col("event_type").alias("reason"), (_k() * 1000).alias("size_bytes")))


@query("WITH L AS (SELECT user_id, arg_max(event_type, event_id) AS status, arg_max(event_id, event_id) AS size FROM events GROUP BY 1) SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM L WHERE status = 'click'")
def quarantine_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Users as files in quarantine; a last click counts as moved."""
    return records.recoverable_bytes(events(spark, d).select(F.col("user_id").alias("destination"), _k().alias("timestamp"), F.when(F.col("event_type") == "click", "moved").otherwise("restored").alias("status"), _k().alias("size_bytes")))


@query("SELECT doc_id, source, 'new' AS scope FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def run_scope(spark: SparkSession, d: str) -> DataFrame:
    docs, done = table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels").where("quality = 1").select("doc_id")
    return records.scope(docs, done, "doc_id").select("doc_id", "source", "scope")


@query("SELECT coalesce(l_returnflag, 'total') AS stage, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS tokens_in, CAST(sum(l_linenumber) AS BIGINT) AS tokens_out, round_even(sum(CAST(l_quantity AS BIGINT)) / 100.0::DOUBLE, 2) AS in_per_frame, round_even(sum(l_linenumber) / 100.0::DOUBLE, 2) AS out_per_frame FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def token_spend(spark: SparkSession, d: str) -> DataFrame:
    return records.spend(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("stage"), F.col("l_quantity").cast("long").alias("tokens_in"), F.col("l_linenumber").cast("long").alias("tokens_out")), 100)


@query("""WITH X AS (SELECT user_id AS g, event_id, event_id * 2654435761 % 1099511627776 AS code FROM events), P AS (SELECT x.g, 1 - bit_count(xor(x.code, y.code)) / 64.0::DOUBLE AS s FROM X x JOIN X y ON x.g = y.g AND x.event_id < y.event_id)
  SELECT g, size, coalesce(round_even(m, 3), 0.0) AS mean_likeness FROM (SELECT g, count(*) AS size FROM X GROUP BY g) LEFT JOIN (SELECT g, avg(s) AS m FROM P GROUP BY g) USING (g)""")
def cluster_likeness(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select(F.col("user_id").alias("g"), (_k() * 2654435761 % 1099511627776).alias("code"))
    return records.mean_likeness(e, "g", "code")


@query("""WITH R AS (SELECT event_type AS g, 'f' || event_id AS filename, event_id % 101 AS s, row_number() OVER (PARTITION BY event_type ORDER BY event_id % 101 DESC, 'f' || event_id) AS p FROM events), T AS (SELECT count(*) AS n FROM events)
  SELECT g, string_agg(filename, ',' ORDER BY p) FILTER (p <= 3) AS names, count(*) >= 3 AND count(*) / (SELECT n FROM T)::DOUBLE >= 0.15 AS pattern FROM R GROUP BY g""")
def insights_names(spark: SparkSession, d: str) -> DataFrame:
    """Each kind's best files, and whether it is often enough to be a pattern."""
    e = events(spark, d).select(F.col("event_type").alias("g"), F.concat(F.lit("f"), _k().cast("string")).alias("filename"), (_k() % 101).alias("final_score"))
    counts = e.groupBy("g").agg(F.count("*").alias("n")).crossJoin(F.broadcast(e.agg(F.count("*").alias("total"))))
    return records.best_names(e, "g").join(counts, "g").select("g", "names", records.is_a_pattern(F.col("n"), F.col("total")).alias("pattern"))
