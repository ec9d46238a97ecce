"""Queries of documents and file operations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine import params
from vellumine.operators import documents, moves, recipes, scoring
from vellumine.plans.bindings import table
from vellumine.plans.edits import BASE_SQL, frames
from vellumine.plans.oracle_parts import CLASSES
from vellumine.plans.registry import query

_esc = lambda x: f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_PART = "P AS (SELECT p_partkey AS key, p_name || ' <' || p_partkey || '>&\"' AS filename, CASE p_partkey % 5 WHEN 0 THEN 'TOP' WHEN 1 THEN 'GOOD_STOCK' WHEN 2 THEN 'GOOD_PERSONAL' WHEN 3 THEN 'NEEDS_DECISION' ELSE 'WEAK' END AS category, p_size AS final_score, p_type AS reason, p_partkey % 3 AS n FROM part)"
_CARD = f"""'<div class="card" style="border-color:' || CASE category {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in documents.SECTIONS.items())} END || '"><img src="' || {_esc("filename")} || '" alt=""><h3>' || {_esc("filename")} || '</h3><b>' || final_score || '</b><p>' || {_esc("reason")} || '</p>' || CASE n WHEN 0 THEN '' WHEN 1 THEN '<ul><li>crop</li></ul>' ELSE '<ul><li>crop</li><li>a &lt; b</li></ul>' END || '</div>'"""


def _cards(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    steps = F.slice(F.array(F.lit("crop"), F.lit("a < b")), 1, (k % 3).cast("int"))
    category = F.element_at(F.array(*map(F.lit, documents.SECTIONS)), (k % 5).cast("int") + 1)
    p = table(spark, d, "part").select(k.alias("key"), F.concat("p_name", F.lit(" <"), k.cast("string"), F.lit('>&"')).alias("filename"), category.alias("category"), F.col("p_size").alias("final_score"), F.col("p_type").alias("reason"), steps.alias("steps"))
    return documents.card(p)


@query(f"WITH {_PART} SELECT key, {_CARD} AS card FROM P")
def report_cards(spark: SparkSession, d: str) -> DataFrame:
    return _cards(spark, d).select("key", "card")


@query(f"""WITH {_PART}, C AS (SELECT category, {_CARD} AS card, row_number() OVER (PARTITION BY category ORDER BY final_score DESC, filename) - 1 AS p FROM P)
  SELECT category, CAST(p // 40 AS BIGINT) AS page, count(*) AS n, md5('{documents.HEAD}' || '<h2>' || category || '</h2>' || string_agg(card, '' ORDER BY p) || '{documents.TAIL}') AS digest FROM C GROUP BY 1, 2""")
def report_pages(spark: SparkSession, d: str) -> DataFrame:
    """Each section's pages of forty cards, by their digest."""
    return documents.sections(_cards(spark, d), 40).select("category", "page", "n", F.md5(F.col("html").cast("binary")).alias("digest"))


@query(f"""WITH X AS (SELECT s_suppkey AS p, s_name AS filename, s_name || ' & co' AS label FROM supplier), T AS (SELECT p // 20 AS sheet, p % 20 // 5 AS r, p, '<td><img src="' || {_esc("filename")} || '" alt=""><small>' || {_esc("label")} || '</small></td>' AS cell FROM X),
  R AS (SELECT sheet, r, '<tr>' || string_agg(cell, '' ORDER BY p) || repeat('<td></td>', 5 - count(*)) || '</tr>' AS line FROM T GROUP BY 1, 2) SELECT CAST(sheet AS BIGINT) AS sheet, '<table>' || string_agg(line, '' ORDER BY r) || '</table>' AS html FROM R GROUP BY 1""")
def contact_sheets(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("position"), F.col("s_name").alias("filename"), F.concat("s_name", F.lit(" & co")).alias("label"))
    return documents.contact_sheet(s, 5, 20).select("sheet", "html")


_SHOWN = " || ".join(f"' v:{key}=\"' || {_esc(sql if sql in ('variant', 'intent') else 'CAST(key AS VARCHAR)' if sql == 'checksum' else 'printf(' + chr(39) + '%+.2f' + chr(39) + ', exposure_ev + 0.0)' if 'format_string' in sql else 'CAST(' + sql + ' AS VARCHAR)')} || '\"'" for key, sql in documents.DARKTABLE)


@query(f"""WITH {BASE_SQL} SELECT key, variant, '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" xmlns:darktable="http://darktable.sf.net/" xmlns:v="urn:vellumine:recipe" darktable:import_timestamp="-1" darktable:history_end="0"' || {_SHOWN}
  || '><v:preserve><rdf:Seq>' || array_to_string(list_transform(preserve, lambda x: '<rdf:li>' || {_esc("x")} || '</rdf:li>'), '') || '</rdf:Seq></v:preserve></rdf:Description></rdf:RDF></x:xmpmeta>' AS document FROM R""")
def darktable_documents(spark: SparkSession, d: str) -> DataFrame:
    r = recipes.generate(frames(spark, d)).withColumn("checksum", F.col("key").cast("string"))
    return r.select("key", "variant", documents.darktable_document().alias("document"))


_alt = lambda name, x: f"'<{name}><rdf:Alt><rdf:li xml:lang=\"x-default\">' || {_esc(x)} || '</rdf:li></rdf:Alt></{name}>'"


@query(f"""SELECT p_partkey AS key, '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:photoshop="http://ns.adobe.com/photoshop/1.0/">' || {_alt("dc:title", "p_name")} || {_alt("dc:description", "p_type || ' & more'")}
  || '<dc:subject><rdf:Bag>' || array_to_string(list_transform(string_split(p_type, ' '), lambda x: '<rdf:li>' || {_esc("x")} || '</rdf:li>'), '') || '</rdf:Bag></dc:subject><photoshop:Category>' || {_esc("p_brand")} || '</photoshop:Category><photoshop:City></photoshop:City></rdf:Description></rdf:RDF></x:xmpmeta>' AS document FROM part""")
def stock_sidecars(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("title"), F.concat("p_type", F.lit(" & more")).alias("description"), F.split("p_type", " ").alias("keywords"), F.col("p_brand").alias("category"), F.lit(None).cast("string").alias("location"))
    return p.select("key", documents.stock_sidecar().alias("document"))


@query(f"WITH {BASE_SQL} SELECT key, variant, intent, exposure_ev + 0.0 AS exposure_ev, CAST(highlights AS BIGINT) AS highlights, array_to_string(preserve, '|') AS preserve, CAST(NULL AS BIGINT) AS broken FROM R")
def recipe_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Recipes written as JSON and read again; text that is none gives nulls."""
    r = recipes.generate(frames(spark, d)).withColumns({"asset_id": F.col("key").cast("string"), "source_checksum": F.lit("c"), "uses_generative": F.lit(False)})
    back = r.select("key", documents.recipe_of(documents.recipe_text()).alias("r"), documents.recipe_of(F.lit("{broken")).alias("b"))
    return back.select("key", "r.variant", "r.intent", (F.col("r.exposure_ev") + 0.0).alias("exposure_ev"), "r.highlights", F.array_join("r.preserve", "|").alias("preserve"), F.col("b.highlights").alias("broken"))


@query("""SELECT event_id AS key, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'Canon' END AS make, CASE WHEN event_id % 2 = 0 THEN 'EF 50' ELSE '24-70' END AS lens, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 6400 END AS iso, round_even(event_id % 80 / 10.0::DOUBLE, 4) AS aperture,
  CASE WHEN event_id % 4 = 0 THEN '1/' || (event_id % 500 + 2) WHEN event_id % 4 = 1 THEN printf('%.1f', CAST(event_id % 30 + 1 AS DOUBLE)) || 's' END AS shutter, CASE event_id % 4 WHEN 3 THEN NULL ELSE strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') END AS shot FROM events""")
def exif_facts(spark: SparkSession, d: str) -> DataFrame:
    k, text = F.col("event_id"), lambda x: x.cast("string")
    tags = F.map_from_entries(F.filter(F.array(
        F.struct(F.lit("Make"), F.when(k % 3 == 0, "  ").otherwise(" Canon ")), F.struct(F.lit("LensModel"), F.when(k % 2 == 0, "EF 50").otherwise("")), F.struct(F.lit("LensSpecification"), F.lit("24-70")), F.struct(F.lit("ISOSpeedRatings"), F.when(k % 5 == 0, "auto").otherwise(text(k % 6400))),
        F.struct(F.lit("FNumber"), F.concat(text(k % 80), F.lit("/10"))), F.struct(F.lit("ExposureTime"), F.when(k % 4 == 0, F.concat(F.lit("1/"), text(k % 500 + 2))).when(k % 4 == 1, text(k % 30 + 1)).when(k % 4 == 2, "0/1").otherwise("fast")),
        F.struct(F.lit("DateTime"), F.when(k % 4 == 0, F.date_format("ts", "yyyy:MM:dd HH:mm:ss")).when(k % 4 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(k % 4 == 2, F.date_format("ts", "yyyy/MM/dd HH:mm:ss")).otherwise("yesterday")),
    ), lambda x: F.lit(True)))
    return documents.exif_facts(table(spark, d, "events").select(k.alias("key"), tags.alias("tags"))).select("key", "make", "lens", "iso", "aperture", "shutter", "shot")


@query("""WITH X AS (SELECT event_id % 4 <> 0 AS best, CASE WHEN event_id % 50 = 0 THEN 'reject' ELSE 'keep' END AS verdict, event_id % 2 = 0 AS r, event_id % 101 AS ds, event_id * 7 % 90 AS mo, event_id % 97 AS a, event_id % 89 AS f FROM events),
  O AS (SELECT count(*) AS total, count(*) FILTER (NOT best) AS twins, count(*) FILTER (verdict = 'reject') AS faces, count(*) FILTER (r) AS rd, avg(ds) FILTER (r) AS ds, avg(mo) FILTER (r) AS mo, count(*) FILTER (a < 45 AND f >= 60) AS dark FROM X),
  R AS (SELECT 0 AS i, 'change_before_the_next_frame' AS advice, twins AS weight, twins || ' of ' || total || ' frames were near-duplicates of a better one' AS evidence FROM O WHERE twins > 0 UNION ALL SELECT 1, 'shoot_through_the_moment', faces * 3, faces || ' portrait(s) lost to a blink or a mid-word expression' FROM O WHERE faces > 0
    UNION ALL SELECT 2, 'move_before_the_obvious_view', rd, 'distinctiveness averages ' || CAST(round_even(ds, 0) AS BIGINT) || ' of 100 across the collection' FROM O WHERE rd > 0 AND ds <= 55 UNION ALL SELECT 3, 'wait_in_good_light', CAST(floor(rd * 0.9::DOUBLE) AS BIGINT), 'moment specificity averages ' || CAST(round_even(mo, 0) AS BIGINT) || ' of 100' FROM O WHERE rd > 0 AND mo <= 55
    UNION ALL SELECT 4, 'expose_half_a_stop_more', dark, dark || ' frames scored under 45 as shot but 60+ after editing' FROM O WHERE dark >= 3 AND dark / total::DOUBLE >= 0.15) SELECT advice, weight, evidence FROM R ORDER BY weight DESC, i LIMIT 3""")
def insights_improvements(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    x = table(spark, d, "events").select((k % 4 != 0).alias("best_in_cluster"), F.when(k % 50 == 0, "reject").otherwise("keep").alias("portrait_verdict"), (k % 2 == 0).alias("read_completed"), (k % 101).alias("distinctiveness"), (k * 7 % 90).alias("moment"), (k % 97).alias("as_shot"), (k % 89).alias("final_score"))
    return documents.improvements(x)


# --- file operations ------------------------------------------------------------------------------

_OPS = "O AS (SELECT event_id AS op_id, event_id // 4 AS group_id, event_id % 4 AS seq, 's' || event_id AS source, 'd' || event_id AS destination, 'c' || event_id AS checksum, event_id % 9 <> 8 AS there, event_id % 23 = 5 AS link, event_id % 31 = 7 AS changed, event_id % 11 = 3 AS taken, event_id % 22 = 3 AS same FROM events)"


def _operations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Events as operations, and the files that exist: their sources and some of their destinations."""
    e, k = table(spark, d, "events"), F.col("event_id")
    name = lambda c: F.concat(F.lit(c), k.cast("string"))
    ops = e.select(k.alias("op_id"), F.floor(k / 4).alias("group_id"), (k % 4).alias("seq"), name("s").alias("source"), name("d").alias("destination"), name("c").alias("checksum"))
    own = e.where(k % 9 != 8).select(name("s").alias("path"), F.when(k % 31 == 7, "other").otherwise(name("c")).alias("checksum"), (k % 23 == 5).alias("symlink"))
    goal = e.where(k % 11 == 3).select(name("d").alias("path"), F.when(k % 22 == 3, name("c")).otherwise("else").alias("checksum"), F.lit(False).alias("symlink"))
    return ops, own.union(goal)


@query(f"""WITH {_OPS}, F AS (SELECT *, min(CASE WHEN there AND NOT link AND changed THEN seq END) OVER (PARTITION BY group_id) AS bad FROM O)
  SELECT op_id, CASE WHEN seq = bad THEN 'failed' WHEN bad IS NOT NULL OR link AND there OR NOT there OR (taken AND same) THEN 'skipped' ELSE 'moved' END AS status,
    CASE WHEN seq = bad THEN 'the file changed since it was planned' WHEN seq > bad THEN 'group aborted before this file was touched' WHEN bad IS NOT NULL THEN 'rolled back' WHEN link AND there THEN 'source is a symlink; refusing to move what it points at' WHEN NOT there AND taken THEN 'already at the destination' WHEN NOT there THEN 'source no longer exists' WHEN taken AND same THEN 'identical file already quarantined' ELSE '' END AS error FROM F""")
def quarantine_apply(spark: SparkSession, d: str) -> DataFrame:
    """Operations carried out in groups; one failure rolls its group back."""
    ops, states = _operations(spark, d)
    return moves.applied(ops, states).select("op_id", "status", "error")


@query(f"WITH {_OPS} SELECT op_id, CASE WHEN NOT taken THEN 'failed' WHEN there THEN 'skipped' ELSE 'restored' END AS status, CASE WHEN NOT taken THEN 'quarantined file is gone' WHEN there THEN 'a file already occupies the original path' ELSE '' END AS error FROM O")
def quarantine_restore(spark: SparkSession, d: str) -> DataFrame:
    ops, states = _operations(spark, d)
    return moves.restored(ops, states).select("op_id", "status", "error")


@query("SELECT event_id AS key, CASE event_id % 4 WHEN 0 THEN event_id % 8000 >= 4400 WHEN 1 THEN false WHEN 2 THEN false ELSE false END AS held, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '/out/a.jpg' WHEN 2 THEN NULL ELSE '/out/n' || event_id END AS path FROM events")
def locks_and_paths(spark: SparkSession, d: str) -> DataFrame:
    """Which locks still count, and where names end up inside of a folder."""
    k = F.col("event_id")
    text = F.when(k % 4 == 0, F.concat(F.lit('{"at": '), (k % 8000).cast("string"), F.lit("}"))).when(k % 4 == 1, "{broken").when(k % 4 == 2, '{"by": "x"}')
    name = F.when(k % 5 == 0, "../..").when(k % 5 == 1, "../../etc/a.jpg").when(k % 5 == 2, "/").otherwise(F.concat(F.lit("b/n"), k.cast("string")))
    return table(spark, d, "events").select(k.alias("key"), moves.lock_held(text, F.lit(8000.0)).alias("held"), moves.inside("/out", name).alias("path"))


@query("""WITH C AS (SELECT o_orderkey AS k, unnest(CASE WHEN o_orderkey % 3 = 0 THEN ['x' || o_orderkey] ELSE ['f' || o_orderkey, 'f' || (o_orderkey + 1)] END) AS file FROM orders), D AS (SELECT DISTINCT file FROM C), S AS (SELECT 'f' || o_orderkey AS path, o_orderkey % 7 = 0 AS link FROM orders WHERE o_orderkey % 4 <> 0)
  SELECT file, CASE WHEN link IS NULL THEN 'already gone' WHEN link THEN 'symlink; refusing' ELSE 'move' END AS action FROM D LEFT JOIN S ON path = file""")
def trash_moves(spark: SparkSession, d: str) -> DataFrame:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    name = lambda c, x: F.concat(F.lit(c), x.cast("string"))
    plan = o.select(F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(name("f", k), name("f", k + 1))).alias("files"), name("x", k).alias("source_path"))
    return moves.trash_plan(plan, o.where(k % 4 != 0).select(name("f", k).alias("path"), (k % 7 == 0).alias("symlink")))


# --- another profile ------------------------------------------------------------------------------

_VIDEO = CLASSES.replace("post_edit_potential < 30", "post_edit_potential < 24").replace("stock_potential >= 68", "stock_potential >= 64").replace("stock_potential >= 45", "stock_potential >= 40")


@query(f"""WITH B AS (WITH {CLASSES} SELECT key, kind, route_class FROM C), V AS (WITH {_VIDEO} SELECT key, route_class FROM C)
  SELECT key, B.route_class AS previous, CASE WHEN kind = 'video' THEN V.route_class ELSE B.route_class END AS route_class, kind = 'video' AND V.route_class <> B.route_class AS changed FROM B JOIN V USING (key)""")
def reclassify(spark: SparkSession, d: str) -> DataFrame:
    """A stored run judged anew, each kind by its own profile."""
    from vellumine.plans.catalogue import classed

    stored = classed(spark, d).withColumnRenamed("route_class", "previous").drop("reason_key")
    return scoring.reclassified(stored, params.chosen(None)).select("key", "previous", "route_class", "changed")


