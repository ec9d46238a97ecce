"""Queries of stored state, of documents that stand beside files, and of tables written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine import params
from vellumine.operators import documents, exports, graph, quarantine, stored
from vellumine.plans.bindings import ASSET_SQL, assets, spread, table
from vellumine.plans.registry import query
from vellumine.sources import keyed_store as keyed_store_module
from vellumine.sources import publication, readers, sinks


def _k():
    return F.col("event_id")


@query("SELECT user_id AS asset_id, value FROM (SELECT user_id, arg_max(CASE WHEN event_id % 5 = 0 THEN 'none' ELSE event_type END, event_id) AS value FROM events GROUP BY 1) WHERE value <> 'none'")
def override_state(spark: SparkSession, d: str) -> DataFrame:
    """Users as assets: the last event stands, every fifth takes back what was said."""
    e = table(spark, d, "events").select(F.col("user_id").alias("asset_id"), _k().alias("seq"), F.when(_k() % 5 != 0, F.col("event_type")).alias("value"))
    return stored.current(e.groupBy("asset_id", "seq").agg(F.first("value").alias("value")).select("asset_id", "seq", "value"))


_CLASS = "CASE event_id % 8 WHEN 0 THEN 'trash' WHEN 1 THEN 'review' WHEN 2 THEN 'archive_only' WHEN 3 THEN 'duplicate_candidate' WHEN 4 THEN 'stock_standard' WHEN 5 THEN 'stock_strong' WHEN 6 THEN 'flagship' ELSE 'other' END"


@query(f"SELECT event_id AS key, {_CLASS} AS tool_said, 'a=' || event_id % 101 || ',b=' || event_id % 7 AS tool_scores, CASE {_CLASS} {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in stored.FOLDERS.items())} ELSE '' END AS destination FROM events")
def captures(spark: SparkSession, d: str) -> DataFrame:
    """What the tool said of each record, and the folder of its class."""
    e = table(spark, d, "events").selectExpr("event_id AS asset_id", "'c' AS checksum", "CAST(event_id AS STRING) AS filename", f"{_CLASS} AS route_class", "map('b', event_id % 7, 'a', event_id % 101) AS scores")
    return stored.captured(e).join(stored.distribution(e), "filename").select(F.col("asset_id").alias("key"), "tool_said", "tool_scores", "destination")


@query("""SELECT 'x' || event_id || '"' AS source_path, CASE WHEN event_id % 16 = 0 THEN 'below every threshold' ELSE 'soft; dark' END AS reason, '"x' || event_id || '\\"' || '"' || chr(9) || CASE WHEN event_id % 16 = 0 THEN 'below every threshold' ELSE 'soft; dark' END AS line FROM events WHERE event_id % 8 = 0""")
def delete_list(spark: SparkSession, d: str) -> DataFrame:
    reasons = F.when(_k() % 16 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("soft"), F.lit("dark")))
    return stored.delete_candidates(table(spark, d, "events").select(F.concat(F.lit("x"), _k().cast("string"), F.lit('"')).alias("source_path"), F.expr(_CLASS).alias("route_class"), reasons.alias("reasons")))


@query("""WITH R AS (SELECT user_id AS c, event_id AS a, floor(value) AS q, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events WHERE event_type <> 'view')
  SELECT x.c AS cluster_id, x.a AS first, y.a AS second, CASE WHEN abs(x.q - y.q) < 5 THEN 1.0::DOUBLE ELSE 0.5 END AS value, abs(x.q - y.q) AS margin FROM R x JOIN R y ON x.c = y.c AND x.p = 1 AND y.p = 2""")
def burst_questions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type <> 'view'").select(F.col("user_id").alias("cluster_id"), F.lit(2).alias("cluster_size"), _k().alias("asset_id"), F.floor("value").cast("double").alias("quality"))
    return stored.burst_questions(e)


@query("SELECT event_id // 3 AS g, count(*) >= 2 AND max(floor(value)) - min(floor(value)) < 30 AS similar FROM events GROUP BY 1")
def similar_alternatives(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.floor(_k() / 3).alias("g"), F.floor("value").cast("double").alias("quality"))
    return stored.alternatives(e, "g", 30.0)


_PCT = lambda r: f"CASE WHEN event_id % 5 = 0 THEN 50 WHEN n < 2 THEN 100 ELSE CAST(greatest(0.0, least(100.0, round_even(100.0::DOUBLE * (n - ({r})) / (n - 1), 0))) AS BIGINT) END"


@query(f"SELECT event_id AS key, {_PCT('event_id % 12 + 1')} AS axis_a, {_PCT('event_id % 7 + 1')} AS axis_b, {_PCT('event_id % 3 + 1')} AS axis_c FROM (SELECT event_id, event_id % 13 AS n FROM events)")
def semantic_axes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(_k().alias("key"), F.when(_k() % 5 != 0, _k() % 13).alias("group_size"), (_k() % 12 + 1).alias("axis_a"), (_k() % 7 + 1).alias("axis_b"), (_k() % 3 + 1).alias("axis_c"))
    return stored.semantic(e).select("key", "axis_a", "axis_b", "axis_c")


@query("""SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id % 8 = 0 THEN 'Kept ' ELSE 'Behalten ' END || event_id || ' of {total}' WHEN 1 THEN 'Plain' WHEN 2 THEN 'own words' ELSE 'unknown' END AS shown FROM events""")
def localised_reasons(spark: SparkSession, d: str) -> DataFrame:
    k = _k()
    rows = table(spark, d, "events").select(k.alias("id"), F.when(k % 4 == 0, "kept").when(k % 4 == 1, "plain").otherwise("unknown").alias("key"), F.when(k % 8 == 0, "en").otherwise("de").alias("language"), F.when(k % 4 == 0, F.create_map(F.lit("n"), k.cast("string"))).alias("params"), F.when(k % 4 == 2, "own words").otherwise("").alias("text"))
    templates = spark.createDataFrame([("kept", "en", "Kept {n} of {total}"), ("kept", "de", "Behalten {n} of {total}"), ("plain", "en", "Plain")], "key string, language string, template string")
    return stored.localised(rows, templates).select("id", "shown")


_W, _H = "(event_id % 300 + 100)", "(event_id * 3 % 300 + 100)"
_f = lambda x: f"CAST(floor({x}) AS BIGINT)"


@query(f"""WITH B AS (SELECT event_id AS key, {_W} AS w, {_H} AS h FROM events), D AS (SELECT *, {_f("w * 0.28::DOUBLE")} AS l, {_f("h * 0.08::DOUBLE")} AS t, {_f("w * 0.72::DOUBLE")} AS r, {_f("h * 0.55::DOUBLE")} AS b FROM B), P AS (SELECT *, {_f("(r - l) * 1.1::DOUBLE")} AS pw, {_f("(b - t) * 1.1::DOUBLE")} AS ph FROM D)
  SELECT key, l || ',' || t || ',' || r || ',' || b AS face, greatest(0, l - pw) || ',' || greatest(0, t - ph) || ',' || least(w, r + pw) || ',' || least(h, b + ph) AS shoulders FROM P""")
def face_boxes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(_k().alias("key"), (_k() % 300 + 100).alias("w"), (_k() * 3 % 300 + 100).alias("h"))
    f = stored.default_face(F.col("w"), F.col("h"))
    s = stored.padded_box(f["left"], f["top"], f["right"], f["bottom"], F.col("w"), F.col("h"), 1.1)
    text = lambda x: F.concat_ws(",", *(x[n].cast("string") for n in ("left", "top", "right", "bottom")))
    return e.select("key", text(f).alias("face"), text(s).alias("shoulders"))


@query("SELECT event_id AS key, event_id % 3 = 0 AS c2pa, event_id % 2 = 0 AS xmp, CASE WHEN event_id % 2 = 0 THEN 'T' || event_id END AS tool FROM events")
def file_markers(spark: SparkSession, d: str) -> DataFrame:
    k = _k()
    head = F.concat(F.when(k % 3 == 0, "..C2PA..").otherwise(".."), F.when(k % 2 == 0, F.concat(F.lit('<x:xmpmeta><a xmp:CreatorTool="T'), k.cast("string"), F.lit('"/></x:xmpmeta>'))).otherwise(""))
    m = stored.markers(head)
    return table(spark, d, "events").select(k.alias("key"), m["c2pa"].alias("c2pa"), m["xmp"].alias("xmp"), m["CreatorTool"].alias("tool"))


# --- documents beside files -----------------------------------------------------------------------

_STARS = "CASE c WHEN 'TOP' THEN '5' WHEN 'GOOD_STOCK' THEN '4' WHEN 'WEAK' THEN '2' ELSE '0' END"
_LABEL = "CASE c WHEN 'TOP' THEN 'Yellow' WHEN 'GOOD_STOCK' THEN 'Green' WHEN 'WEAK' THEN 'Red' ELSE '' END"
_C = "CASE event_id % 4 WHEN 0 THEN 'TOP' WHEN 1 THEN 'GOOD_STOCK' WHEN 2 THEN 'WEAK' ELSE 'UNHEARD' END"


@query(f"""SELECT key, key % 3 < 2 AS exists, CASE key % 3 WHEN 0 THEN '<r><rdf:Description xmlns:xmp="u" xmp:Rating="' || {_STARS} || '" xmp:Label="' || {_LABEL} || '" a="1"/><rdf:Description xmp:Rating="9"/></r>' WHEN 1 THEN '<r><rdf:Description xmp:Label="' || {_LABEL} || '" xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmp:Rating="' || {_STARS} || '" a="1"/></r>'
  ELSE '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmp:Rating="' || {_STARS} || '" xmp:Label="' || c || '"/></rdf:RDF></x:xmpmeta>' END AS document FROM (SELECT event_id AS key, {_C} AS c FROM events)""")
def rating_plans(spark: SparkSession, d: str) -> DataFrame:
    """What each record's rating sidecar would hold, new or merged."""
    e = table(spark, d, "events")
    there = e.where(_k() % 3 < 2).select(_k().alias("key"), F.when(_k() % 3 == 0, '<r><rdf:Description xmlns:xmp="u" xmp:Rating = "1" xmp:Label="x" a="1"/><rdf:Description xmp:Rating="9"/></r>').otherwise('<r><rdf:Description a="1"/></r>').alias("document"))
    return sinks.plan_ratings(e.select(_k().alias("key"), F.expr(_C).alias("category")), there)


@query("""SELECT event_id AS key, CASE WHEN event_id % 2 = 0 THEN 'crs:Contrast2012: ' || event_id % 9 || ' -> 4|' ELSE '' END || 'crs:Tint: - -> 3|xmp:Rating: 5 -> -' AS changes FROM (SELECT event_id FROM events WHERE event_id % 2 = 1 OR event_id % 9 <> 4)
  UNION ALL SELECT event_id, 'crs:Tint: - -> 3|xmp:Rating: 5 -> -' FROM events WHERE event_id % 2 = 0 AND event_id % 9 = 4""")
def settings_differences(spark: SparkSession, d: str) -> DataFrame:
    """Which settings of a sidecar an edit would change."""
    value = F.when(_k() % 2 == 0, (_k() % 9).cast("string")).otherwise("4")
    before = F.concat(F.lit('<a crs:Contrast2012="'), value, F.lit('" xmp:Rating="5"/>'))
    return spread(table(spark, d, "events").select("event_id")).select(_k().alias("key"), F.array_join(exports.differences(before, F.lit('<a crs:Contrast2012="4" crs:Tint="3"/>')), "|").alias("changes"))


@query("""WITH R AS (SELECT event_id AS id, event_id % 6 AS m FROM events) SELECT id AS asset_id, CASE m WHEN 0 THEN 'missing_source' WHEN 1 THEN 'stale' WHEN 2 THEN 'create' WHEN 3 THEN 'replace' WHEN 4 THEN 'overwrite' ELSE 'create' END AS action FROM R""")
def recipe_apply_plan(spark: SparkSession, d: str) -> DataFrame:
    k = _k()
    e = table(spark, d, "events")
    mine = F.concat(F.lit("c"), k.cast("string"))
    targets = e.where(k % 6 > 2).where(k % 6 < 5).select(k.alias("asset_id"), F.when(k % 6 == 3, F.concat(F.lit('<a s="'), mine, F.lit('"/>'))).otherwise('<a s="else"/>').alias("document"))
    now = e.where(k % 6 != 0).select(k.alias("asset_id"), F.when(k % 6 == 1, "other").otherwise(mine).alias("checksum"))
    return exports.apply_plan(e.select(k.alias("asset_id"), mine.alias("checksum")), targets, now)


@query("""SELECT event_id AS key, bool_and(event_id % 11 <> 3 AND event_id % 7 <> 6) OVER (PARTITION BY event_id // 3) AS ok FROM events""")
def verified_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of three files of which none changed or went."""
    k = _k()
    ops = table(spark, d, "events").select(k.alias("key"), F.floor(k / 3).alias("group_id"), k.cast("string").alias("source"), k.alias("size"), F.lit("c").alias("checksum"))
    states = table(spark, d, "events").where(k % 7 != 6).select(k.cast("string").alias("path"), k.alias("size"), F.when(k % 11 == 3, "x").otherwise("c").alias("checksum"))
    return quarantine.verified_groups(ops, states).select("key", "ok")


@query("SELECT 'f' || user_id || CASE WHEN n = 1 THEN '' ELSE '_' || (n - 1) END || '.jpg' AS destination, event_id AS source FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)")
def free_names(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.concat(F.lit("f"), F.col("user_id").cast("string"), F.lit(".jpg")).alias("destination"), _k().alias("source"))
    return quarantine.free_names(e)


@query("SELECT event_id AS asset_id, CASE WHEN event_id % 3 = 0 THEN 'keep' WHEN event_id % 2 = 0 THEN 'trash' END AS actual FROM events")
def resolved_observations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    seen = e.select(_k().alias("asset_id"), F.when(_k() % 3 == 0, "keep").otherwise("").alias("actual"))
    return quarantine.resolved(seen, e.where(_k() % 2 == 0).select(_k().alias("asset_id"), F.lit("trash").alias("actual"))).select("asset_id", "actual")


_PROFILES = "(VALUES " + ", ".join(f"('{p.name}', '{w}', {v!r}::DOUBLE)" for p, weights in ((params.PROFILES["default-photo"], params.WEIGHTS), (params.PROFILES["default-video"], params.WEIGHTS | params.VIDEO_WEIGHTS)) for w, v in weights.items()) + ") t(profile, part, w)"


@query(f"WITH {ASSET_SQL}, P AS (SELECT profile, part, round_even(w / sum(w) OVER (PARTITION BY profile), 9) AS share FROM {_PROFILES}) SELECT key, part, share, CASE kind WHEN 'video' THEN 64.0::DOUBLE ELSE 68.0 END AS strong FROM A JOIN P ON profile = 'default-' || kind")
def profile_parts(spark: SparkSession, d: str) -> DataFrame:
    """For every asset the parts of its kind's default profile and one limit."""
    rows = [(name, part, round(share, 9), params.PROFILES[name].limits["stock_strong"]) for name in ("default-photo", "default-video") for part, share in params.PROFILES[name].parts.items()]
    parts = spark.createDataFrame(rows, "profile string, part string, share double, strong double")
    own = assets(spark, d).select("key", F.concat(F.lit("default-"), "kind").alias("profile"))
    return own.join(F.broadcast(parts), "profile").select("key", "part", "share", "strong")


# --- written and read again -----------------------------------------------------------------------


@query("SELECT doc_id, lang, n_chars, substr(sha256(text), 1, 8) AS digest FROM documents")
def records_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Records written as JSON lines in two appends and read by their schema, texts and all."""
    folder, docs = graph.shared_folder(spark), table(spark, d, "documents").select("doc_id", "lang", "n_chars", "text")
    sinks.write_records(docs.where("doc_id % 2 = 0"), f"{folder}/records")
    sinks.append_log(docs.where("doc_id % 2 = 1"), f"{folder}/records")
    back = readers.json_lines(spark, f"{folder}/records", "doc_id long, lang string, n_chars long, text string")
    return back.select("doc_id", "lang", "n_chars", F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 8).alias("digest"))


@query("SELECT CAST(event_id AS VARCHAR) AS key, event_type || '; x' AS tags, CAST(user_id AS VARCHAR) AS who_id FROM events")
def flat_table_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Arrays and structs flattened into a table of texts and read again."""
    folder = graph.shared_folder(spark)
    e = table(spark, d, "events").select(_k().alias("key"), F.array(F.col("event_type"), F.lit("x")).alias("tags"), F.struct(F.col("user_id").alias("id")).alias("who"))
    sinks.write_csv(e, f"{folder}/flat")
    return spark.read.option("header", "true").csv(f"{folder}/flat").select("key", "tags", "who_id")


@query("SELECT c_mktsegment AS section, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS total FROM customer GROUP BY 1")
def sections_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A folder for each section, counted from the folders."""
    folder = graph.shared_folder(spark)
    sinks.by_section(table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("section")), f"{folder}/sections", "section")
    return spark.read.parquet(f"{folder}/sections").groupBy("section").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("total"))


@query("SELECT 'events' AS name, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events UNION ALL SELECT 'customer', count(*), CAST(sum(c_custkey) AS BIGINT) FROM customer")
def published_versions(spark: SparkSession, d: str) -> DataFrame:
    """Two tables published together; a second version without its manifest is passed over and removed."""
    root = f"{graph.shared_folder(spark)}/published"
    events, customers = table(spark, d, "events").select(F.col("event_id").alias("id")), table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    publication.publish(spark, root, publication.stage(spark, root, {"events": events, "customer": customers}), ("events",))
    events.limit(0).write.parquet(f"{root}/versions/half-made/events")
    publication.recover(spark, root)
    counted = lambda name: publication.read(spark, root, name).agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum("id").alias("total"))
    return counted("events").union(counted("customer"))


@query("""WITH L AS (SELECT user_id AS key, max(event_id) AS latest, max_by(event_type, event_id) AS value FROM events GROUP BY 1) SELECT c_custkey AS key, latest, CASE WHEN latest % 7 <> 0 THEN value END AS value, latest IS NOT NULL AND latest % 7 <> 0 AS hit FROM customer LEFT JOIN L ON key = c_custkey""")
def keyed_store(spark: SparkSession, d: str) -> DataFrame:
    """The latest event of each user, upserted in three batches around a compaction, looked up for every customer; every seventh event removes its key."""
    value = F.when(F.col("event_id") % 7 != 0, F.col("event_type"))
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("at"), value.alias("value"))
    store = keyed_store_of(spark)
    store.put(e.where("at % 3 = 0"))
    store.put(e.where("at % 3 = 1"))
    store.compact()
    store.put(e.where("at % 3 = 2"))
    return store.get(table(spark, d, "customer").select(F.col("c_custkey").alias("key"))).select("key", F.col("at").alias("latest"), "value", "hit")


def keyed_store_of(spark: SparkSession) -> keyed_store_module.Store:
    return keyed_store_module.Store(spark, f"{graph.shared_folder(spark)}/store", "key long, at long, value string", 16)


@query("""WITH P AS (SELECT p_partkey AS key, p_partkey % 3 = 0 AS cropped FROM part)
  SELECT key, 'p' || key AS asset_id, 'faithful' AS variant, (key % 9 - 4) / 4.0::DOUBLE AS exposure_ev, CAST(key % 50 AS INTEGER) AS clarity, CAST(0 AS INTEGER) AS contrast, 'neutral' AS style, CASE WHEN cropped THEN round_even((0.9::DOUBLE - key % 4 / 10.0::DOUBLE) * 0.5::DOUBLE, 4) END AS keeps, CASE WHEN cropped THEN 0.5::DOUBLE END AS bottom, 'a,b' AS preserve, '' AS evidence, key % 2 = 0 AS uses_generative FROM P""")
def recipe_documents(spark: SparkSession, d: str) -> DataFrame:
    """Partial documents with fields of other tools, read with their defaults, written whole, written to files and read again."""
    k = F.col("p_partkey")
    crop = F.when(k % 3 == 0, F.struct((k % 4 / 10.0).alias("left"), F.lit(0.9).alias("right"), F.lit(0.5).alias("bottom"), F.lit("x").alias("other")))
    part = F.struct(F.concat(F.lit("p"), k.cast("string")).alias("asset_id"), F.lit(1).alias("unheard_of"), F.struct(((k % 9 - 4) / 4.0).alias("exposure_ev"), (k % 50).alias("clarity")).alias("global"), F.struct(crop.alias("crop")).alias("geometry"), F.array(F.lit("a"), F.lit("b")).alias("preserve"), (k % 2 == 0).alias("uses_generative"))
    folder = graph.shared_folder(spark)
    whole = spread(table(spark, d, "part").select("p_partkey")).select(k.alias("key"), documents.document_text(documents.document_of(F.to_json(part))).alias("text"))
    whole.write.json(f"{folder}/recipes")
    back = spark.read.schema("key long, text string").json(f"{folder}/recipes").select("key", "text", documents.document_of(F.col("text")).alias("r"))
    return back.select("key", "r.asset_id", "r.variant", "r.global.exposure_ev", "r.global.clarity", "r.global.contrast", "r.color.style", F.get_json_object("text", "$.geometry.crop.keeps").cast("double").alias("keeps"), "r.geometry.crop.bottom", F.array_join("r.preserve", ",").alias("preserve"), F.array_join("r.evidence", ",").alias("evidence"), "r.uses_generative")
