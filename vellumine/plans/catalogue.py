"""Every query of the curation operators by name, with SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.functions import numbers, text, vectors
from vellumine.operators import agreement, curation, exports, graph, history, intent, kernels, media, platforms, provider, quarantine, ranking, reporting, scoring, selection
from vellumine.params import CATEGORIES
from vellumine.plans.bindings import ASSET_SQL, assets, spread, table
from vellumine.plans.oracle_parts import CLASSES, CODES, FINAL, HASH, HASHES, SCORES
from vellumine.plans.registry import QUERIES, SQL, Query, query

def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def scored(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score_dimensions(assets(spark, d))


def classed(spark: SparkSession, d: str) -> DataFrame:
    return scoring.route_class(scored(spark, d))


def judged(spark: SparkSession, d: str) -> DataFrame:
    return curation.categorise(curation.final_score(classed(spark, d)))


def coded(spark: SparkSession, d: str) -> DataFrame:
    return assets(spark, d).withColumn("code", vectors.sign_code(F.col("vector")))


def hashed(spark: SparkSession, d: str) -> DataFrame:
    """The assets with `code`: runs of three frames whose hashes are a bit or two apart."""
    run = F.floor(F.col("key") / 3)
    bit = lambda place: F.call_function("shiftleft", F.lit(1).cast("long"), (place % 61).cast("int"))
    flips = F.when(F.col("key") % 3 > 0, bit(run)).otherwise(F.lit(0).cast("long")).bitwiseXOR(F.when(F.col("key") % 3 == 2, bit(run * 7 + 5)).otherwise(F.lit(0).cast("long")))
    return assets(spark, d).withColumn("code", F.expr(HASH).bitwiseXOR(flips))


def human_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(pile, score): labelled documents as rated frames."""
    pile = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "top").when(F.col("quality") == 1, "good").otherwise("weak")
    return table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select(pile.alias("pile"), F.least(F.lit(100), F.floor(F.col("n_chars") / 40)).cast("long").alias("score"))


PAIRS_SQL = "P AS (SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'top' WHEN quality = 1 THEN 'good' ELSE 'weak' END AS pile, CAST(least(100, floor(n_chars / 40.0)) AS BIGINT) AS score FROM labels JOIN documents USING (doc_id))"
PILE_SQL = "CASE WHEN score >= {t} THEN 'top' WHEN score < {w} THEN 'weak' ELSE 'good' END"


def observations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("at"), F.when(F.col("event_type") == "error", "trash").when(F.col("event_type") == "purchase", "safe_quarantine_candidate").otherwise("keep").alias("predicted"),
        F.when(F.col("user_id") % 4 == 0, None).when(F.col("value") < 20, "trash").otherwise("keep").alias("actual"), F.least(F.lit(1.0), F.col("value") / 100).alias("confidence"), (F.col("user_id") % 3 != 0).alias("in_distribution"),
    )


OBS_SQL = "O AS (SELECT event_id AS at, CASE WHEN event_type = 'error' THEN 'trash' WHEN event_type = 'purchase' THEN 'safe_quarantine_candidate' ELSE 'keep' END AS predicted, CASE WHEN user_id % 4 = 0 THEN NULL WHEN value < 20 THEN 'trash' ELSE 'keep' END AS actual, least(1.0::DOUBLE, value / 100) AS confidence, user_id % 3 <> 0 AS in_distribution FROM events)"
RATE_SQL = "SELECT coalesce(round_even(avg(CASE WHEN predicted IN ('trash', 'safe_quarantine_candidate') AND actual IN ('keep', 'restored', 'portfolio', 'published') THEN 1.0::DOUBLE ELSE 0.0 END), 5), 0.0) AS rate, count(*) AS n FROM O WHERE actual IS NOT NULL"
DRIFT_SQL = "SELECT coalesce(round_even(avg(CASE WHEN in_distribution THEN 0.0::DOUBLE ELSE 1.0 END), 4), 0.0) AS drift FROM (SELECT * FROM O ORDER BY O.at DESC LIMIT 200)"
BINS_SQL = "SELECT least(0.9::DOUBLE, greatest(0.0, round_even(confidence * 10, 0) / 10)) AS claimed, round_even(avg(CASE WHEN predicted = actual THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS actual, count(*) AS n FROM O WHERE actual IS NOT NULL GROUP BY 1"


# --- scans, identity, staleness -------------------------------------------------------------------


@query(f"""WITH {ASSET_SQL}, X AS (SELECT *, row_number() OVER (PARTITION BY genre ORDER BY quality DESC, key) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY genre, md5(CAST(vector AS VARCHAR)) ORDER BY quality DESC, key DESC) AS twin FROM A) WHERE twin = 1)
  SELECT genre, key, quality, place FROM X WHERE place <= 3""")
def best_per_genre(spark: SparkSession, d: str) -> DataFrame:
    """Per genre, the three best assets after equal vectors are taken as one."""
    one = assets(spark, d).groupBy("genre", "vector").agg(F.max_by(F.struct("key", "quality"), F.struct("quality", "key")).alias("w")).select("genre", "w.key", "w.quality")
    return selection.top_per(one, "genre", [F.desc("quality"), "key"], 3).select("genre", "key", "quality", "place")


_FILES = "F AS (SELECT source || '/' || CAST(doc_id // 3 AS VARCHAR) || '.' || CASE WHEN doc_id % 3 = 0 THEN 'JPG' WHEN doc_id % 3 = 1 THEN 'rw2' ELSE 'mp4' END AS path FROM documents)"


@query(f"""WITH {_FILES}, G AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, regexp_extract(path, '([^/]*)\\.[^.]*$', 1) AS stem, path, CASE WHEN path LIKE '%.rw2' THEN 0 WHEN path LIKE '%.mp4' THEN 1 ELSE 2 END AS o FROM F)
  SELECT dir, stem, arg_min(path, struct_pack(o := o, p := path)) AS main, count(*) AS n FROM G GROUP BY 1, 2""")
def scan_assets_grouped(spark: SparkSession, d: str) -> DataFrame:
    """Files of a folder with one stem are one asset."""
    suffix = F.when(F.col("doc_id") % 3 == 0, "JPG").when(F.col("doc_id") % 3 == 1, "rw2").otherwise("mp4")
    files = table(spark, d, "documents").select(F.concat_ws("", "source", F.lit("/"), F.floor(F.col("doc_id") / 3).cast("string"), F.lit("."), suffix).alias("path"))
    return media.group_assets(files).select("dir", "stem", F.col("primary").alias("main"), "n")


@query(f"""WITH {_FILES}, K AS (SELECT lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS s FROM F)
  SELECT CASE WHEN s IN ('jpg', 'rw2') THEN 'photo' ELSE 'video' END AS kind, CASE s WHEN 'jpg' THEN 'JPEG' WHEN 'rw2' THEN 'RAW' ELSE 'OTHER' END AS format, s = 'rw2' AS latitude, count(*) AS n FROM K GROUP BY ALL""")
def file_kind_classify(spark: SparkSession, d: str) -> DataFrame:
    suffix = F.when(F.col("doc_id") % 3 == 0, "JPG").when(F.col("doc_id") % 3 == 1, "rw2").otherwise("mp4")
    p = table(spark, d, "documents").select(F.concat(F.lit("a/b."), suffix).alias("path"))
    return p.groupBy(text.media_kind(F.col("path")).alias("kind"), text.photo_format(F.col("path")).alias("format"), text.has_latitude(F.col("path")).alias("latitude")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, sha256(text) AS checksum, substr(sha256(text), 1, 16) AS asset_id FROM documents")
def content_checksum(spark: SparkSession, d: str) -> DataFrame:
    return media.with_checksum(table(spark, d, "documents"), "text").select("doc_id", "checksum", "asset_id")


@query("SELECT sha256(text) AS checksum, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return media.with_checksum(table(spark, d, "documents"), "text").groupBy("checksum").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")


@query("""WITH B AS (SELECT doc_id AS path, n_chars AS size, sha256(text) AS checksum FROM documents WHERE doc_id % 5 <> 0), N AS (SELECT doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS size, CASE WHEN doc_id % 11 = 0 THEN '' ELSE sha256(text) END AS checksum FROM documents WHERE doc_id % 6 <> 0)
  SELECT coalesce(B.path, N.path) AS path, CASE WHEN N.checksum IS NULL THEN 'missing' WHEN B.checksum IS NULL THEN 'added' WHEN B.size <> N.size OR B.checksum <> N.checksum THEN 'changed' ELSE 'same' END AS state FROM B FULL JOIN N ON B.path = N.path""")
def state_matches(spark: SparkSession, d: str) -> DataFrame:
    docs = media.with_checksum(table(spark, d, "documents"), "text").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"), F.lit(0).alias("modified"), "checksum")
    now = docs.where("path % 6 <> 0").withColumns({"size": F.when(F.col("path") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")), "checksum": F.when(F.col("path") % 11 == 0, "").otherwise(F.col("checksum"))})
    return media.state_changes(docs.where("path % 5 <> 0"), now)


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE round_even((event_id * 1000) / CAST(event_id % 5 * 1001 AS DOUBLE), 4) END AS rate,
  round_even(CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END * ((event_id % 90) + (event_id % 60) / 60.0::DOUBLE + (event_id % 59) / 3600.0::DOUBLE), 6) + 0.0 AS latitude, CAST(ts AS DATE) AS day FROM events""")
def parse_rational_gps_date(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    ratio = F.concat_ws("/", (F.col("event_id") * 1000).cast("string"), (F.col("event_id") % 5 * 1001).cast("string"))
    gps = numbers.dms_to_decimal(F.col("event_id") % 90, F.col("event_id") % 60, F.col("event_id") % 59, F.when(F.col("event_id") % 2 == 0, "S").otherwise("N"))
    stamp = F.coalesce(F.try_to_timestamp(F.date_format("ts", "yyyy:MM:dd HH:mm:ss"), F.lit("yyyy:MM:dd HH:mm:ss")), F.col("ts").cast("timestamp"))
    return e.select("event_id", numbers.parse_ratio(ratio).alias("rate"), gps.alias("latitude"), F.to_date(stamp).alias("day"))


@query("""SELECT page_id, CASE WHEN regexp_extract(html, 'lang="([^"]*)"', 1) <> '' THEN regexp_extract(html, 'lang="([^"]*)"', 1) ELSE regexp_extract(html, '<lang[^>]*>([^<]*)</lang>', 1) END AS lang,
  CASE WHEN regexp_extract(html, 'title="([^"]*)"', 1) <> '' THEN regexp_extract(html, 'title="([^"]*)"', 1) ELSE regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1) END AS title FROM pages""")
def xmp_value_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.markup_value(F.col("html"), "lang").alias("lang"), text.markup_value(F.col("html"), "title").alias("title"))


# --- likeness, clusters, bursts -------------------------------------------------------------------

RADIUS = 8
_PAIRS = f"{HASHES}, Q AS (SELECT x.key AS a, y.key AS b, CAST(bit_count(xor(x.code, y.code)) AS BIGINT) AS distance, x.genre = y.genre AS same_genre, x.vector AS vx, y.vector AS vy FROM H x JOIN H y ON x.key < y.key WHERE bit_count(xor(x.code, y.code)) <= {RADIUS})"


@query(f"WITH {_PAIRS} SELECT a, b, distance, round_even(1 - distance / 64.0::DOUBLE, 4) AS likeness FROM Q")
def hamming_pairs(spark: SparkSession, d: str) -> DataFrame:
    return graph.hamming_pairs(hashed(spark, d), "key", "code", RADIUS).select("a", "b", "distance", F.bround(1 - F.col("distance") / F.lit(64.0), 4).alias("likeness"))


def _pair_facts(spark: SparkSession, d: str) -> DataFrame:
    df = hashed(spark, d).select("key", "code", "genre", "vector")
    x, y = (df.select(*(F.col(c).alias(f"{c}_{s}") for c in df.columns)) for s in "ab")
    return graph.hamming_pairs(df, "key", "code", RADIUS).join(x, F.col("a") == F.col("key_a")).join(y, F.col("b") == F.col("key_b"))


@query(f"WITH {CODES} SELECT key, code FROM H")
def sign_codes(spark: SparkSession, d: str) -> DataFrame:
    return coded(spark, d).select("key", "code")


@query(f"WITH {_PAIRS} SELECT a, b, round_even(least(1.0::DOUBLE, round_even(1 - distance / 64.0::DOUBLE, 4) + CASE WHEN same_genre THEN 0.12::DOUBLE ELSE 0.0 END), 4) AS likeness FROM Q")
def visual_similarity(spark: SparkSession, d: str) -> DataFrame:
    return _pair_facts(spark, d).select("a", "b", vectors.visual_likeness(F.col("code_a"), F.col("code_b"), F.col("genre_a") == F.col("genre_b")).alias("likeness"))


@query(f"""WITH {_PAIRS} SELECT a, b, round_even(list_cosine_similarity(CAST(vx AS DOUBLE[]), CAST(vy AS DOUBLE[])), 6) AS cosine,
  round_even(least(1.0::DOUBLE, greatest(0.0, least(1.0, (round_even(list_cosine_similarity(CAST(vx AS DOUBLE[]), CAST(vy AS DOUBLE[])), 6) - 0.55::DOUBLE) / (1 - 0.55::DOUBLE))) + CASE WHEN same_genre THEN 0.12::DOUBLE ELSE 0.0 END), 4) AS likeness FROM Q""")
def embedding_similarity(spark: SparkSession, d: str) -> DataFrame:
    cos = F.bround(vectors.cosine(F.col("vector_a"), F.col("vector_b")), 6)
    return _pair_facts(spark, d).withColumn("cosine", cos).select("a", "b", "cosine", vectors.embedding_likeness(F.col("cosine"), F.col("genre_a") == F.col("genre_b")).alias("likeness"))


_CLUSTERS = f"""{HASHES}, L AS (SELECT x.key AS a, y.key AS b FROM H x JOIN H y ON x.key <> y.key WHERE bit_count(xor(x.code, y.code)) <= {RADIUS} AND NOT (abs(epoch_us(x.shot) - epoch_us(y.shot)) / 1e6 > 86400)),
  W AS (SELECT key AS v, key AS r FROM H UNION SELECT L.b, W.r FROM W JOIN L ON L.a = W.v), M AS (SELECT v, min(r) AS root FROM W GROUP BY v),
  B AS (SELECT root, arg_max(key, struct_pack(q := quality, k := key)) AS w, arg_max(code, struct_pack(q := quality, k := key)) AS wc, max(quality) AS wq, count(*) AS n FROM M JOIN H ON H.key = M.v GROUP BY root)"""


@query(f"""WITH RECURSIVE {_CLUSTERS} SELECT v AS key, w AS cluster_id, n AS cluster_size, w = v AS is_best, CASE WHEN w = v THEN 0.0::DOUBLE ELSE round_even(1 - bit_count(xor(code, wc)) / 64.0::DOUBLE, 4) END AS similarity, round_even(wq - quality, 2) AS margin FROM M JOIN H ON H.key = M.v JOIN B USING (root)""")
def near_duplicate_clusters(spark: SparkSession, d: str) -> DataFrame:
    return graph.scene_clusters(hashed(spark, d), "key", "code", "quality", "shot", RADIUS, 86_400.0)


_BURST = "Z AS (SELECT event_id, user_id, ts, CAST(event_id * 2654435761 % 4096 AS BIGINT) AS code FROM events), Y AS (SELECT *, CASE WHEN (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 <= 3600 AND bit_count(xor(code, lag(code) OVER w)) <= 6 THEN 0 ELSE 1 END AS nw FROM Z WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


@query(f"WITH {_BURST} SELECT event_id, CAST(sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS burst FROM Y")
def bursts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("code", (F.col("event_id") * 2654435761 % 4096).cast("long"))
    return graph.bursts(e, "user_id", "ts", "event_id", "code", 3600.0, 6).select("event_id", "burst")


def _samples(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as a clip's samples, an hour for a second."""
    e = table(spark, d, "events")
    ts = (F.col("ts").cast("timestamp").cast("double") - 1704067200.0) / 3600.0
    return e.select("event_id", F.col("user_id").alias("clip"), F.bround(ts, 3).alias("ts"), F.least(F.lit(100.0), F.col("value")).alias("quality"), (F.col("event_id") % 255).cast("double").alias("mean_luma"), (F.col("event_id") % 97 + 1).cast("double").alias("sharpness"), F.lit(720.0).alias("duration"))


_SAMPLES = "V AS (SELECT user_id AS clip, round_even((epoch_us(ts) / 1e6 - 1704067200.0::DOUBLE) / 3600.0::DOUBLE, 3) AS ts, least(100.0::DOUBLE, value) AS quality, CAST(event_id % 255 AS DOUBLE) AS mean_luma, CAST(event_id % 97 + 1 AS DOUBLE) AS sharpness FROM events)"


@query(f"""WITH {_SAMPLES}, N AS (SELECT *, 720.0::DOUBLE / count(*) OVER (PARTITION BY clip) AS step FROM V), G AS (SELECT * FROM N WHERE quality >= 35 AND mean_luma > 12), J AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY clip ORDER BY ts) <= step * 1.6::DOUBLE THEN 0 ELSE 1 END AS nw FROM G),
  R AS (SELECT *, sum(nw) OVER (PARTITION BY clip ORDER BY ts) AS run FROM J), E AS (SELECT clip, run, greatest(0.0::DOUBLE, min(ts) - any_value(step) / 2 + 0.5::DOUBLE) AS s, least(720.0::DOUBLE, max(ts) + any_value(step) / 2 - 0.5::DOUBLE) AS e, CAST(sum(CAST(round(quality * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS m FROM R GROUP BY 1, 2)
  SELECT clip, round_even(s, 3) AS "start", round_even(e, 3) AS "end", (cents // m + CASE WHEN 2 * (cents % m) > m OR 2 * (cents % m) = m AND cents // m % 2 = 1 THEN 1 ELSE 0 END) / 100.0::DOUBLE AS mean_quality FROM E WHERE e - s >= 3""")
def usable_segments(spark: SparkSession, d: str) -> DataFrame:
    return media.usable_segments(_samples(spark, d))


@query(f"""WITH {_SAMPLES}, D AS (SELECT *, abs(mean_luma - lag(mean_luma) OVER (PARTITION BY clip ORDER BY ts)) AS dl FROM V)
  SELECT clip, count(*) AS n, round_even(avg(quality), 2) AS mean_quality, round_even(CASE WHEN count(*) < 2 THEN 1.0 ELSE greatest(0.0, 1 - stddev_pop(sharpness) / avg(sharpness)) END, 4) AS focus_consistency, round_even(max(mean_luma) - min(mean_luma), 4) AS exposure_range, round_even(CASE WHEN count(*) >= 3 THEN stddev_pop(dl) ELSE 0.0 END, 4) AS flicker FROM D GROUP BY clip""")
def exposure_stability(spark: SparkSession, d: str) -> DataFrame:
    return media.exposure_stability(_samples(spark, d), key="event_id")


# --- groups, wins, percentiles --------------------------------------------------------------------


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    """Events in groups of 12 that share 3, ranked by value within each."""
    e = table(spark, d, "events").select("event_id", "value")
    at = ranking.numbered(e, [F.col("event_id")])
    return ranking.ranking_groups(at, "position", e.count())


_GROUPS = "T AS (SELECT count(*) AS n FROM events), L AS (SELECT CASE WHEN n <= 12 THEN 0 ELSE CAST(ceil((n - 12) / 9.0) AS BIGINT) END AS last FROM T), PG AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS p FROM events), GG AS (SELECT event_id, value, g AS group_id FROM PG, L, unnest(range(0, last + 1)) AS u(g) WHERE p >= g * 9 AND p < g * 9 + 12)"


@query(f"WITH {_GROUPS} SELECT CAST(group_id AS BIGINT) AS group_id, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM GG GROUP BY 1")
def ranking_groups(spark: SparkSession, d: str) -> DataFrame:
    return _grouped(spark, d).groupBy("group_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("group_id").orderBy(F.desc("value"))
    return _grouped(spark, d).select("group_id", F.col("event_id").alias("item"), F.rank().over(w).cast("long").alias("rank"))


_RANKED = f"{_GROUPS}, RK AS (SELECT CAST(group_id AS BIGINT) AS group_id, event_id AS item, rank() OVER (PARTITION BY group_id ORDER BY value DESC) AS rank FROM GG)"


@query(f"WITH {_RANKED} SELECT x.item AS winner, y.item AS loser, count(*) AS n FROM RK x JOIN RK y USING (group_id) WHERE x.rank < y.rank GROUP BY 1, 2")
def pairwise_wins(spark: SparkSession, d: str) -> DataFrame:
    return ranking.pairwise_wins(_ranked(spark, d))


#: Sixty steps: each item's wins and meetings by the strengths before, then divided by their axis's mean.
_BT = f"""WITH RECURSIVE {ASSET_SQL}, T AS (SELECT CAST(key % 3 AS VARCHAR) AS axis, key // 36 AS g, key AS item, quality FROM A), W AS (SELECT x.axis, x.item AS winner, y.item AS loser FROM T x JOIN T y ON x.axis = y.axis AND x.g = y.g AND x.quality > y.quality),
  E AS (SELECT axis, winner AS i, loser AS j, 1 AS won, 1 AS met FROM W UNION ALL SELECT axis, loser, winner, 0, 1 FROM W),
  Z AS (SELECT 0 AS step, axis, i AS item, 1.0::DOUBLE AS s FROM (SELECT DISTINCT axis, i FROM E)
    UNION ALL SELECT step + 1, axis, item, r / avg(r) OVER (PARTITION BY axis) FROM (SELECT a.step, E.axis, E.i AS item, (sum(E.won) + 0.5::DOUBLE) / (sum(E.met / (a.s + b.s)) + 0.5::DOUBLE) AS r FROM E JOIN Z a ON a.axis = E.axis AND a.item = E.i JOIN Z b ON b.axis = E.axis AND b.item = E.j WHERE a.step < 60 GROUP BY a.step, E.axis, E.i))
  SELECT axis, item, round_even(s, 6) AS strength FROM Z WHERE step = 60"""


@query(_BT)
def bradley_terry_strength(spark: SparkSession, d: str) -> DataFrame:
    """Strengths on three axes of some hundred assets each."""
    df = assets(spark, d).select((F.col("key") % 3).cast("string").alias("axis"), F.floor(F.col("key") / 36).alias("g"), F.col("key").alias("item"), "quality")
    x, y = df.alias("x"), df.alias("y")
    wins = x.join(y, (F.col("x.axis") == F.col("y.axis")) & (F.col("x.g") == F.col("y.g")) & (F.col("x.quality") > F.col("y.quality"))).select(F.col("x.axis").alias("axis"), F.col("x.item").alias("winner"), F.col("y.item").alias("loser"), F.lit(1).cast("long").alias("n"))
    return ranking.bradley_terry(wins, ["axis"]).withColumn("strength", F.bround("strength", 6))


_AXES = {"axis_a": "(key * 37 + 5) % 101", "axis_b": "(key * 53 + 11) % 101", "axis_c": "(key * 71 + 29) % 101"}
#: Replies of groups of twelve that share three with the one before; an item's first group counts.
_STITCH = f"""WITH RECURSIVE {ASSET_SQL}, O AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS p, count(*) OVER () AS n FROM A), G AS (SELECT key, unnest(range(greatest(0, CAST(ceil((p - 11) / 9.0) AS BIGINT)), least(CAST(ceil((n - 12) / 9.0) AS BIGINT), p // 9) + 1)) AS g FROM O),
  R AS (SELECT key, g, unnest([{", ".join(f"struct_pack(axis := '{a}', rank := rank() OVER (PARTITION BY g ORDER BY {sql}))" for a, sql in _AXES.items())}], recursive := true), min(g) OVER (PARTITION BY key) AS first FROM G), T AS (SELECT axis, g, key AS item, rank FROM R WHERE g = first),
  W AS (SELECT x.axis, x.item AS winner, y.item AS loser FROM T x JOIN T y ON x.axis = y.axis AND x.g = y.g AND x.rank < y.rank), E AS (SELECT axis, winner AS i, loser AS j, 1 AS won, 1 AS met FROM W UNION ALL SELECT axis, loser, winner, 0, 1 FROM W),
  Z AS (SELECT 0 AS step, axis, i AS item, 1.0::DOUBLE AS s FROM (SELECT DISTINCT axis, i FROM E)
    UNION ALL SELECT step + 1, axis, item, r / avg(r) OVER (PARTITION BY axis) FROM (SELECT a.step, E.axis, E.i AS item, (sum(E.won) + 0.5::DOUBLE) / (sum(E.met / (a.s + b.s)) + 0.5::DOUBLE) AS r FROM E JOIN Z a ON a.axis = E.axis AND a.item = E.i JOIN Z b ON b.axis = E.axis AND b.item = E.j WHERE a.step < 60 GROUP BY a.step, E.axis, E.i)),
  P AS (SELECT axis, item, CAST(round_even(100.0::DOUBLE * (count(*) OVER own - row_number() OVER (PARTITION BY axis ORDER BY round_even(s, 9) DESC, item)) / (count(*) OVER own - 1), 0) AS BIGINT) AS score FROM Z WHERE step = 60 WINDOW own AS (PARTITION BY axis))
  SELECT item AS key, {", ".join(f"max(score) FILTER (axis = '{a}') AS {a}" for a in _AXES)} FROM P GROUP BY item"""


@query(_STITCH)
def stitched_axes(spark: SparkSession, d: str) -> DataFrame:
    """Three axes over all assets, from ranks within overlapping groups."""
    from pyspark.sql import Window

    placed = ranking.numbered(assets(spark, d).select("key"), [F.col("key")])
    groups = ranking.ranking_groups(placed, "position", placed.count())
    ranks = {a: F.rank().over(Window.partitionBy("group_id").orderBy(F.expr(sql))).cast("long") for a, sql in _AXES.items()}
    members = F.array_sort(F.collect_list("key").over(Window.partitionBy("group_id")))
    return ranking.stitched(groups.select("key", F.col("group_id").alias("at"), members.alias("members"), *(c.alias(a) for a, c in ranks.items())), list(_AXES), "key")


@query(f"WITH {ASSET_SQL}, N AS (SELECT key, row_number() OVER (ORDER BY quality DESC, key) - 1 AS p, count(*) OVER () AS n FROM A) SELECT key, CAST(round_even(100.0::DOUBLE * (n - 1 - p) / (n - 1), 0) AS BIGINT) AS percentile FROM N")
def percentile_scores(spark: SparkSession, d: str) -> DataFrame:
    a = assets(spark, d).select("key", "quality")
    return ranking.percentile_scores(ranking.numbered(a, [F.desc("quality"), F.col("key")]), "position", a.count()).select("key", "percentile")


@query("SELECT event_id, CASE WHEN event_id % 13 < 2 THEN 100 ELSE CAST(greatest(0.0, least(100.0, round_even(100.0::DOUBLE * (event_id % 13 - (event_id % 7 + 1)) / (event_id % 13 - 1), 0))) AS BIGINT) END AS percentile FROM events")
def rank_to_percentile(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", numbers.rank_to_percentile(F.col("event_id") % 7 + 1, F.col("event_id") % 13).alias("percentile"))


_BROKEN = "BR AS (SELECT event_id // 12 AS group_id, event_id % 12 AS place, CAST(CASE WHEN event_id // 12 % 3 = 0 AND event_id % 12 = 4 THEN 4 WHEN event_id // 12 % 3 = 1 AND event_id % 12 < 6 THEN 1 ELSE event_id % 12 + 1 END AS BIGINT) AS rank FROM events), BN AS (SELECT group_id, count(*) AS n, count(*) - count(DISTINCT rank) AS col, count(*) - count(DISTINCT CASE WHEN rank BETWEEN 1 AND (SELECT count(*) FROM BR z WHERE z.group_id = y.group_id) THEN rank END) AS miss FROM BR y GROUP BY group_id)"


@query(f"""WITH {_BROKEN} SELECT CAST(group_id AS BIGINT) AS group_id, CAST(place AS BIGINT) AS place, CASE WHEN greatest(col, miss) > 0 AND greatest(col, miss) <= n * 0.25 THEN row_number() OVER (PARTITION BY group_id ORDER BY rank, place) ELSE rank END AS repaired,
  greatest(col, miss) > 0 AND greatest(col, miss) <= n * 0.25 AS was_repaired, greatest(col, miss) <= n * 0.25 AS is_valid FROM BR JOIN BN USING (group_id)""")
def rank_repair(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 12).alias("group_id"), (F.col("event_id") % 12).alias("place"))
    broken = F.when((F.col("group_id") % 3 == 0) & (F.col("place") == 4), 4).when((F.col("group_id") % 3 == 1) & (F.col("place") < 6), 1).otherwise(F.col("place") + 1).cast("long")
    return ranking.repair_ranks(e.withColumn("rank", broken)).select("group_id", "place", "repaired", "was_repaired", "is_valid")


@query(f"WITH {PAIRS_SQL}, R AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rx, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS ry FROM (SELECT score, CASE pile WHEN 'top' THEN 3 WHEN 'good' THEN 2 ELSE 1 END AS x FROM P)) SELECT count(*) AS n, round_even(corr(rx, ry), 4) AS rho FROM R")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    p = human_pairs(spark, d).withColumn("level", F.when(F.col("pile") == "top", 3).when(F.col("pile") == "good", 2).otherwise(1))
    return ranking.spearman(p, "score", "level")


# --- scores, classes, final score -----------------------------------------------------------------


@query(f"WITH {SCORES} SELECT key, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in scoring.DIMENSIONS)} FROM S")
def score_dimensions(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("key", *scoring.DIMENSIONS)


@query(f"WITH {CLASSES} SELECT key, route_class, reason_key FROM C")
def route_class(spark: SparkSession, d: str) -> DataFrame:
    return classed(spark, d).select("key", "route_class", "reason_key")


@query(f"""WITH {CLASSES} SELECT key, concat_ws(',', 'commercial_ok', CASE WHEN is_best THEN 'best_in_cluster' ELSE 'weaker_duplicate' END, CASE WHEN route_class = 'flagship' THEN 'portfolio' END, CASE WHEN route_class IN ('stock_standard', 'stock_strong') AND stock_potential < 68 THEN 'low_stock_demand' END, CASE WHEN route_class = 'review' AND post_edit_potential >= 30 THEN 'archive_only' END) AS tags,
  concat_ws(',', CASE WHEN post_edit_potential - current_quality >= 8 THEN 'edit_gain' END, CASE WHEN is_raw THEN 'raw_latitude' END, CASE WHEN uniqueness >= 85 THEN 'unique' END, CASE WHEN present AND axis_b >= 70 THEN 'hard_to_repeat' END, CASE WHEN present AND axis_a >= 70 THEN 'strong_content' END, CASE WHEN present AND axis_c >= 70 THEN 'documentary' END, CASE WHEN n_unrecoverable = 0 AND n_partial = 0 THEN 'routine_edit' END) AS strengths FROM C""")
def tags_and_strengths(spark: SparkSession, d: str) -> DataFrame:
    return scoring.strengths(scoring.tags(classed(spark, d))).select("key", "tags", "strengths")


@query(f"WITH {FINAL} SELECT key, blended, final_score, without_read, final_score - without_read AS read_delta, worst_defect, vetoed FROM K".replace("without_read, final", "CAST(without_read AS BIGINT) AS without_read, final").replace("final_score - without_read AS", "final_score - CAST(without_read AS BIGINT) AS"))
def final_score(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).select("key", "blended", "final_score", "without_read", "read_delta", "worst_defect", "vetoed")


@query(f"WITH {FINAL} SELECT key, category, final_score FROM K")
def category(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).select("key", "category", "final_score")


_ORDER = ", ".join(f"({i}, '{c}')" for i, c in enumerate(CATEGORIES))


@query(f"WITH {FINAL}, Z AS (SELECT * FROM (VALUES {_ORDER}) AS t(position, category)) SELECT CAST(position AS BIGINT) AS position, category, count(key) AS n FROM Z LEFT JOIN K USING (category) GROUP BY 1, 2")
def counts_with_zeros(spark: SparkSession, d: str) -> DataFrame:
    return curation.counts(judged(spark, d))


@query(f"""WITH {CLASSES} SELECT key, CASE WHEN key % 97 = 0 THEN 'no_corrupt' WHEN n_unrecoverable > 0 AND axis_a < 40 THEN 'no_unrecoverable' WHEN route_class IN ('flagship', 'stock_strong', 'stock_standard') THEN 'candidate' WHEN key % 10 < 3 THEN 'face' WHEN axis_a >= 55 THEN 'deliberate' WHEN art_uncertainty >= 60 THEN 'uncertain' WHEN route_class IN ('review', 'duplicate_candidate') THEN 'unresolved' ELSE 'no_settled' END AS why FROM C""")
def artistic_read_gate(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return classed(spark, d).select("key", curation.worth_an_artistic_read(c("route_class"), c("n_unrecoverable") > 0, c("axis_a"), c("art.uncertainty"), c("key") % 10 < 3, c("key") % 97 == 0).alias("why"))


_MEASURED = "MP AS (SELECT p_partkey AS key, p_size / 4.0::DOUBLE AS blur_ratio, (p_partkey % 100) / 120.0::DOUBLE AS highlights, (p_partkey * 7 % 100) / 100.0::DOUBLE AS shadows, p_size / 5.0::DOUBLE AS megapixels, CAST(p_partkey % 256 AS DOUBLE) AS mean_luma, CAST(p_partkey * 3 % 90 AS DOUBLE) AS stddev_luma, CAST(p_partkey % 200 AS DOUBLE) AS red, CAST(p_partkey * 3 % 200 AS DOUBLE) AS green, 100.0::DOUBLE AS blue, (p_partkey % 50) / 5.0::DOUBLE AS noise, p_partkey % 2 = 0 AS is_raw FROM part)"


@query(f"""WITH {_MEASURED} SELECT key, concat_ws(',', CASE WHEN blur_ratio < 2 THEN 'missed_focus' WHEN blur_ratio < 6 THEN 'soft_focus' END, CASE WHEN highlights > CASE WHEN is_raw THEN 0.7 ELSE 0.35 END THEN 'blown_highlights' WHEN highlights > 0.03 THEN 'some_clipped_highlights' END, CASE WHEN shadows > 0.7 THEN 'crushed_shadows' WHEN shadows > 0.15 THEN 'some_crushed_shadows' END,
  CASE WHEN megapixels < 1 THEN 'insufficient_resolution' END, CASE WHEN mean_luma < 70 THEN 'underexposed' WHEN mean_luma > 200 THEN 'overexposed' END, CASE WHEN stddev_luma < 28 THEN 'flat_contrast' END, CASE WHEN greatest(red, green, blue) / greatest(least(red, green, blue), 1.0) > 1.18 THEN 'color_cast' END, CASE WHEN noise > 8 THEN 'heavy_noise' WHEN noise > 3 THEN 'mild_noise' END) AS codes FROM MP""")
def photo_issues(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(k.alias("key"), (F.col("p_size") / 4.0).alias("blur_ratio"), (k % 100 / 120.0).alias("highlights"), (k * 7 % 100 / 100.0).alias("shadows"), (F.col("p_size") / 5.0).alias("megapixels"), (k % 256).cast("double").alias("mean_luma"), (k * 3 % 90).cast("double").alias("stddev_luma"), (k % 200).cast("double").alias("red"), (k * 3 % 200).cast("double").alias("green"), F.lit(100.0).alias("blue"), (k % 50 / 5.0).alias("noise"), (k % 2 == 0).alias("is_raw"))
    return media.photo_issues(p).select("key", F.array_join(F.transform("issues", lambda i: i["code"]), ",").alias("codes"))


@query(f"WITH {ASSET_SQL} SELECT CASE WHEN key % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN key % 9 = 3 THEN 1 ELSE 0 END AS fixable, count(*) AS n FROM A GROUP BY 1".replace("SELECT CASE", "SELECT CAST(CASE").replace("END AS fixable", "END AS BIGINT) AS fixable"))
def issue_summary(spark: SparkSession, d: str) -> DataFrame:
    return scoring.with_issue_counts(assets(spark, d)).groupBy(F.col("n_fixable").alias("fixable")).agg(F.count("*").alias("n"))


# --- selection ------------------------------------------------------------------------------------


@query(f"WITH {SCORES} SELECT count(*) AS candidates, CAST(greatest(1.0, least(60.0, round_even(count(*) * 0.1::DOUBLE, 0))) AS BIGINT) AS quota FROM S")
def flagship_quota(spark: SparkSession, d: str) -> DataFrame:
    return selection.flagship_quota(scored(spark, d))


@query(f"WITH {SCORES} SELECT key, CAST(portfolio_potential AS BIGINT) AS portfolio_potential FROM S WHERE portfolio_potential >= 72 AND post_edit_potential >= 60")
def flagship_eligible(spark: SparkSession, d: str) -> DataFrame:
    return scoring.flagship_eligible(scored(spark, d)).select("key", "portfolio_potential")


@query(f"WITH {SCORES}, N AS (SELECT genre, key, portfolio_potential, row_number() OVER (PARTITION BY genre ORDER BY portfolio_potential DESC, key) AS p FROM S) SELECT genre, key, CAST(portfolio_potential AS BIGINT) AS relevance FROM N WHERE p = 1")
def strongest_per_genre(spark: SparkSession, d: str) -> DataFrame:
    return selection.strongest_per_genre(scored(spark, d).withColumn("relevance", F.col("portfolio_potential")))


#: Every step carries all candidates with their likeness to the nearest pick, and marks the best one that is free.
_MMR = f"""WITH RECURSIVE {SCORES}, V AS (SELECT key, genre, portfolio_potential AS rel, CAST(vector AS DOUBLE[]) AS v FROM S), U AS (SELECT key, genre, rel, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM V),
  M AS (SELECT 0 AS step, key, genre, rel, u, 0.0::DOUBLE AS worst, CAST(NULL AS BIGINT) AS pick, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS DOUBLE) AS near FROM U
    UNION ALL SELECT m.step + 1, m.key, m.genre, m.rel, m.u, CASE WHEN m.pick IS NULL THEN greatest(m.worst, round_even(least(1.0::DOUBLE, greatest(0.0, least(1.0, (list_dot_product(m.u, b.u) - 0.55::DOUBLE) / (1 - 0.55::DOUBLE))) + CASE WHEN m.genre = b.genre THEN 0.12::DOUBLE ELSE 0.0 END), 4)) ELSE m.worst END,
      CASE WHEN m.key = b.key THEN m.step + 1 ELSE m.pick END, CASE WHEN m.key = b.key THEN b.value ELSE m.score END, CASE WHEN m.key = b.key THEN b.worst ELSE m.near END
    FROM M m, (SELECT *, 0.65::DOUBLE * (rel / 100.0::DOUBLE) - (1 - 0.65::DOUBLE) * worst AS value FROM M WHERE pick IS NULL AND genre NOT IN (SELECT genre FROM M WHERE pick IS NOT NULL GROUP BY genre HAVING count(*) >= 5) ORDER BY value DESC, key LIMIT 1) b WHERE m.step < 30)
  SELECT key, pick, round_even(score, 6) AS score, round_even(near, 4) AS redundancy FROM M WHERE step = (SELECT max(step) FROM M) AND pick IS NOT NULL"""


@query(_MMR)
def mmr_select(spark: SparkSession, d: str) -> DataFrame:
    """Thirty diverse picks, five of a genre at most."""
    return selection.select_diverse(scored(spark, d).withColumn("relevance", F.col("portfolio_potential")), 30, 0.65, 5)


@query("""WITH X AS (SELECT p_partkey AS key, p_partkey // 8 AS asset, CAST(p_size AS DOUBLE) AS a, p_retailprice AS b, CAST(p_partkey * 7 % 13 AS DOUBLE) AS c, CAST(p_partkey * 11 % 17 AS DOUBLE) AS e FROM part)
  SELECT key, CAST(asset AS BIGINT) AS asset FROM X WHERE NOT EXISTS (SELECT 1 FROM X y WHERE y.asset = X.asset AND y.key <> X.key AND y.a >= X.a - 1e-9 AND y.b >= X.b - 1e-9 AND y.c >= X.c - 1e-9 AND y.e >= X.e - 1e-9 AND (y.a > X.a + 1e-9 OR y.b > X.b + 1e-9 OR y.c > X.c + 1e-9 OR y.e > X.e + 1e-9))""")
def pareto_front(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(k.alias("key"), F.floor(k / 8).alias("asset"), F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"), (k * 7 % 13).cast("double").alias("c"), (k * 11 % 17).cast("double").alias("e"))
    return selection.skyline(p, "asset", "key", ["a", "b", "c", "e"]).select("key", "asset")


@query(f"""WITH {FINAL}, Q AS (SELECT 'undecided' AS kind, key, 1.0::DOUBLE AS value FROM K WHERE axis_c % 17 = 0 UNION ALL SELECT 'new_genre', key, 0.9 FROM K WHERE genre = 'g3' UNION ALL SELECT 'boundary', key, 0.85 FROM K WHERE abs(final_score - 45) <= 6) SELECT kind, key, value FROM Q ORDER BY value DESC, kind, key LIMIT 12""")
def questions_top_k(spark: SparkSession, d: str) -> DataFrame:
    df = judged(spark, d).select("key", F.col("final_score").alias("score"), (F.col("axis_c") % 17 == 0).alias("undecided"), (F.col("genre") != "g3").alias("known_genre"))
    return selection.questions(df)


# --- agreement with a person ----------------------------------------------------------------------


@query(f"WITH {PAIRS_SQL}, Z AS (SELECT pile, {PILE_SQL.format(t=85, w=45)} AS tool FROM P), H AS (SELECT unnest(['top', 'good', 'weak']) AS human) SELECT human, count(*) FILTER (tool = 'top') AS top, count(*) FILTER (tool = 'good') AS good, count(*) FILTER (tool = 'weak') AS weak FROM H LEFT JOIN Z ON Z.pile = H.human GROUP BY human")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return agreement.confusion(human_pairs(spark, d))


_SWEEP = f"{PAIRS_SQL}, G AS (SELECT t, w FROM unnest(range(50, 100)) AS a(t), unnest(range(10, 100)) AS b(w) WHERE w < t), SW AS (SELECT t AS top, w AS weak, CAST(sum(CASE WHEN {PILE_SQL.format(t='t', w='w')} = pile THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM G, P GROUP BY 1, 2)"


@query(f"WITH {_SWEEP} SELECT top, weak, hits FROM SW")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return agreement.sweep(human_pairs(spark, d))


@query(f"""WITH {_SWEEP}, Z AS (SELECT count(*) AS n, count(*) FILTER ({PILE_SQL.format(t=85, w=45)} = pile) AS agreed, count(*) FILTER (score >= 85 AND pile = 'top') AS hit, count(*) FILTER (score >= 85) AS called, count(*) FILTER (pile = 'top') AS human FROM P), B AS (SELECT * FROM SW ORDER BY hits DESC, top, weak LIMIT 1)
  SELECT n, agreed, round_even(CASE WHEN called = 0 THEN 0.0 ELSE hit / CAST(called AS DOUBLE) END, 4) AS top_precision, round_even(CASE WHEN human = 0 THEN 0.0 ELSE hit / CAST(human AS DOUBLE) END, 4) AS top_recall, CASE WHEN hits > agreed THEN hits ELSE agreed END AS best_hits, CASE WHEN hits > agreed THEN top ELSE 85 END AS best_top, CASE WHEN hits > agreed THEN weak ELSE 45 END AS best_weak FROM Z, B""")
def agreement_figures(spark: SparkSession, d: str) -> DataFrame:
    return agreement.agreement(human_pairs(spark, d))


@query("SELECT doc_id, quality FROM labels l WHERE NOT EXISTS (SELECT 1 FROM embeddings x WHERE x.vec_id = l.doc_id)")
def missing_labels_anti(spark: SparkSession, d: str) -> DataFrame:
    """Labels without a vector."""
    return agreement.compare(table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id").select("doc_id"), table(spark, d, "labels"), "doc_id")[1].select("doc_id", "quality")


# --- reports --------------------------------------------------------------------------------------


@query(f"WITH {FINAL} SELECT key, final_score FROM K WHERE kind = 'photo' AND route_class IN ('stock_strong', 'stock_standard', 'review') AND final_score >= 40 AND cluster_size > 1")
def filter_report(spark: SparkSession, d: str) -> DataFrame:
    return reporting.filtered(judged(spark, d), media="photo", classes=["stock_strong", "stock_standard", "review"], least_score=40, clustered=True).select("key", "final_score")


@query(f"WITH {FINAL} SELECT category, key, row_number() OVER (PARTITION BY category ORDER BY final_score DESC, key) AS place FROM K")
def ranked_sections(spark: SparkSession, d: str) -> DataFrame:
    return reporting.ranked_sections(judged(spark, d)).select("category", "key", "place")


@query(f"WITH {CLASSES}, W AS (SELECT cluster_id, max(key) AS winner, arg_max(quality, key) AS wq FROM C WHERE is_best GROUP BY 1) SELECT key, cluster_id, winner, round_even(wq - quality, 2) AS margin FROM C LEFT JOIN W USING (cluster_id) WHERE route_class IN ('duplicate_candidate', 'trash') AND NOT is_best")
def comparison_rows(spark: SparkSession, d: str) -> DataFrame:
    return reporting.comparison_rows(classed(spark, d))


@query(f"""WITH {FINAL} SELECT count(*) AS n, count(*) FILTER (kind = 'video') AS videos, count(*) FILTER (present) AS read, round_even(avg(CASE WHEN present THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS read_share, max(final_score) AS best, count(*) FILTER (cluster_size > 1) AS clustered, count(DISTINCT genre) AS genres, bool_or(is_raw) AS any_raw, bool_and(present) AS all_read,
  count(*) FILTER (post_edit_potential - current_quality >= 8) AS gains, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM K WHERE status = 'ok'""")
def summary(spark: SparkSession, d: str) -> DataFrame:
    return reporting.summary(judged(spark, d))


@query(f"WITH {FINAL} SELECT genre, count(*) AS n, round_even(avg(final_score) - (SELECT avg(final_score) FROM K), 4) AS lead FROM K GROUP BY genre HAVING count(*) >= 3")
def insights_genres(spark: SparkSession, d: str) -> DataFrame:
    return reporting.genre_standing(judged(spark, d))


_DIMS = ["post_edit_potential", "aesthetic_potential", "stock_potential", "portfolio_potential", "uniqueness"]


@query(f"WITH {SCORES}, U AS (" + " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS v FROM S" for c in _DIMS) + ") SELECT dimension, round_even(avg(CASE WHEN v >= 62 THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS strong, round_even(avg(CASE WHEN v <= 42 THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS weak, round_even(avg(v), 4) AS mean FROM U GROUP BY 1")
def insights_dimensions(spark: SparkSession, d: str) -> DataFrame:
    return reporting.dimension_shares(scored(spark, d), _DIMS)


@query(f"WITH {CLASSES}, U AS (SELECT 'dark' AS pattern, count(*) FILTER (key % 4 = 0) AS n, count(*) AS a FROM C UNION ALL SELECT 'duplicates', count(*) FILTER (NOT is_best), count(*) FROM C UNION ALL SELECT 'rejects', count(*) FILTER (route_class = 'trash'), count(*) FROM C) SELECT pattern, n, round_even(n / CAST(a AS DOUBLE), 4) AS share FROM U WHERE n >= 3 AND round_even(n / CAST(a AS DOUBLE), 4) >= 0.15")
def insights_patterns(spark: SparkSession, d: str) -> DataFrame:
    return reporting.patterns(classed(spark, d), {"dark": F.col("key") % 4 == 0, "duplicates": ~F.col("is_best"), "rejects": F.col("route_class") == "trash"})


@query(f"WITH {CLASSES} SELECT key, unnest([1, 2]) - 1 AS number, 'f' || CAST(key AS VARCHAR) || '.' || unnest(['rw2', 'xmp']) AS file, reason_key AS reason FROM C WHERE route_class = 'trash'".replace("unnest([1, 2]) - 1 AS number", "CAST(unnest([0, 1]) AS INTEGER) AS number"))
def move_plan(spark: SparkSession, d: str) -> DataFrame:
    df = classed(spark, d)
    key = F.col("vec_id")
    files = table(spark, d, "embeddings").select(key.alias("key"), F.array(*(F.concat(F.lit("f"), key.cast("string"), F.lit(s)) for s in (".rw2", ".xmp"))).alias("files"))
    return reporting.move_plan(df, files)


@query("SELECT o_orderkey, CASE o_orderpriority[1:1] WHEN '1' THEN 'flagship' WHEN '2' THEN 'stock_standard' WHEN '3' THEN 'trash' WHEN '4' THEN 'stock_standard' ELSE 'review' END AS route_class, CASE WHEN o_orderstatus = 'P' THEN 'keep_me' ELSE 'keep_me,' || o_orderstatus END AS tags FROM orders")
def migrate_rows(spark: SparkSession, d: str) -> DataFrame:
    old = F.element_at(F.create_map(*(F.lit(x) for kv in {"1": "hero", "2": "keep", "3": "reject", "4": "editorial", "5": "review"}.items() for x in kv)), F.substring("o_orderpriority", 1, 1))
    rows = table(spark, d, "orders").select("o_orderkey", old.alias("route_class"), F.array(F.lit("keep_me"), F.when(F.col("o_orderstatus") == "P", "legal_ok").otherwise(F.col("o_orderstatus"))).alias("tags"))
    return reporting.migrated(rows, ["legal_ok"]).withColumn("tags", F.array_join("tags", ","))


# --- platforms ------------------------------------------------------------------------------------

_RULES = "(VALUES " + ", ".join("(" + ", ".join("NULL::DOUBLE" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else "[" + ", ".join(f"'{x}'" for x in v) + "]" if isinstance(v, list) else str(v) for v in r) + ")" for r in platforms.RULES) + ") AS r(platform, photo_min, photo_max, formats, video_min, video_max, ideal_min, ideal_max, min_width, min_height, containers, ai, exclusive)"
_FACTS = "FA AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 4 = 0 THEN 'video' ELSE 'photo' END AS kind, CAST(p_size AS DOUBLE) / 2 AS megapixels, CASE WHEN p_partkey % 5 = 0 THEN 'tiff' ELSE 'jpeg' END AS format, CAST(p_partkey % 130 AS DOUBLE) AS duration, CASE WHEN p_partkey % 3 = 0 THEN 1080 ELSE 1920 END AS width, CASE WHEN p_partkey % 3 = 0 THEN 1920 WHEN p_partkey % 3 = 1 THEN 720 ELSE 1080 END AS height, CASE WHEN p_partkey % 6 = 0 THEN 'avi' WHEN p_partkey % 6 = 1 THEN '' ELSE 'mov, MP4' END AS container, p_partkey * 7 % 101 AS stock_potential, p_partkey % 10 = 0 AS generative, p_partkey % 10 = 1 AS uncertain FROM part)"
_EVAL = f"""{_FACTS}, EV AS (SELECT key, platform, stock_potential, kind, megapixels, duration, photo_min, ideal_min, ideal_max, exclusive, CASE WHEN generative AND ai = 'rejected' THEN 'blocking' WHEN generative AND ai = 'accepted_with_label' THEN 'action_required' WHEN uncertain AND ai = 'rejected' THEN 'advisory' END AS conflict,
  concat_ws(',', CASE WHEN kind = 'photo' AND megapixels < photo_min THEN 'too_small' END, CASE WHEN kind = 'photo' AND megapixels > photo_max THEN 'too_large' END, CASE WHEN kind = 'photo' AND NOT list_contains(formats, upper(format)) THEN 'format' END, CASE WHEN kind = 'video' AND duration < video_min THEN 'too_short' END, CASE WHEN kind = 'video' AND duration > video_max THEN 'too_long' END,
  CASE WHEN kind = 'video' AND NOT (width >= min_width AND height >= min_height OR width >= min_height AND height >= min_width) THEN 'resolution' END, CASE WHEN kind = 'video' AND container = 'avi' THEN 'container' END, CASE WHEN generative AND ai = 'rejected' THEN 'generative' END) AS blockers FROM FA, {_RULES})"""


@query(f"""WITH {_EVAL} SELECT key, platform, blockers, conflict, blockers = '' AS eligible, CAST(CASE WHEN blockers = '' THEN greatest(0, least(100, stock_potential + CASE WHEN kind = 'photo' AND megapixels >= photo_min * 3 THEN 6 WHEN kind = 'video' AND duration >= ideal_min AND duration <= ideal_max THEN 8 ELSE 0 END - CASE WHEN exclusive THEN 10 ELSE 0 END)) ELSE 0 END AS BIGINT) AS suitability FROM EV""")
def platform_eligibility(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    facts = table(spark, d, "part").select(
        k.alias("key"), F.when(k % 4 == 0, "video").otherwise("photo").alias("kind"), (F.col("p_size").cast("double") / 2).alias("megapixels"), F.when(k % 5 == 0, "tiff").otherwise("jpeg").alias("format"), (k % 130).cast("double").alias("duration"),
        F.when(k % 3 == 0, 1080).otherwise(1920).alias("width"), F.when(k % 3 == 0, 1920).when(k % 3 == 1, 720).otherwise(1080).alias("height"), F.when(k % 6 == 0, "avi").when(k % 6 == 1, "").otherwise("mov, MP4").alias("container"),
        (k * 7 % 101).alias("stock_potential"), (k % 10 == 0).alias("generative"), (k % 10 == 1).alias("uncertain_origin"),
    )
    return platforms.evaluate(facts, platforms.rules(spark)).select("key", "platform", "blockers", "conflict", "eligible", "suitability")


@query("""SELECT p_partkey AS key, CASE WHEN p_type LIKE '%ECONOMY%' THEN 'generative' WHEN lower(p_name) LIKE '%red%' THEN 'edited' WHEN p_size > 25 AND p_partkey % 2 = 0 THEN 'camera_original' ELSE 'unknown' END AS provenance FROM part""")
def provenance(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.when(F.col("p_type").contains("ECONOMY"), "trainedAlgorithmicMedia").otherwise("digitalCapture").alias("source_type"), F.when(F.lower("p_name").contains("red"), "Adobe Photoshop 25").otherwise("in camera").alias("software"), (F.col("p_size") > 25).alias("has_camera"), (F.col("p_partkey") % 2 == 0).alias("scanned"))
    return platforms.provenance(p).select("key", "provenance")


# --- text and replies -----------------------------------------------------------------------------


_REDACTED = "text"
for _pattern in text.CREDENTIALS:
    _REDACTED = f"regexp_replace({_REDACTED}, '{_pattern}', '[REDACTED]', 'g')"


@query(f"SELECT doc_id, {_REDACTED} AS redacted FROM documents")
def redact(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.redact(F.col("text")).alias("redacted"))


_WORDS = "list_filter(regexp_extract_all(lower(text), '([a-z][a-z''-]+)', 1), lambda w: length(w) >= 3 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "], w))"


@query(f"WITH W AS (SELECT doc_id, unnest({_WORDS}) AS w, generate_subscripts({_WORDS}, 1) AS i FROM documents), D AS (SELECT doc_id, w, min(i) AS i FROM W GROUP BY 1, 2), N AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM D) SELECT d.doc_id, coalesce(string_agg(w, ',' ORDER BY i) FILTER (n <= 40), '') AS keywords FROM documents d LEFT JOIN N ON N.doc_id = d.doc_id GROUP BY 1")
def keywords(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(text.keywords(F.col("text")), ",").alias("keywords"))


@query(f"WITH W AS (SELECT doc_id, unnest({_WORDS}) AS w, generate_subscripts({_WORDS}, 1) AS i FROM documents), D AS (SELECT doc_id, w, min(i) AS i FROM W GROUP BY 1, 2), N AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM D) SELECT d.doc_id, coalesce(string_agg(w, ',' ORDER BY i) FILTER (n <= 40), '') AS keywords FROM documents d LEFT JOIN N ON N.doc_id = d.doc_id GROUP BY 1")
def keywords_all(spark: SparkSession, d: str) -> DataFrame:
    """The same as `keywords`, which once had English documents alone."""
    return table(spark, d, "documents").select("doc_id", F.array_join(text.keywords(F.col("text")), ",").alias("keywords"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(greatest(0.0, least(100.0, CAST(json_extract_string(props, '$.k') AS DOUBLE))) AS BIGINT) AS score, 'unknown' AS genre FROM events")
def reply_parse(spark: SparkSession, d: str) -> DataFrame:
    """Replies as JSON: unknown keys are dropped, missing ones have defaults."""
    p = table(spark, d, "events").withColumn("r", F.from_json("props", "k string, genre string"))
    return p.select("event_id", F.col("r.k").try_cast("long").alias("k"), numbers.clamp_or(F.col("r.k"), 50).alias("score"), F.coalesce("r.genre", F.lit("unknown")).alias("genre"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'rate_limit' ELSE '' END AS failure, NOT contains(lower(left(trim(text), 20)), 'reject') AS keep FROM conversations""")
def batch_output(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    message = F.when(F.col("turn") % 4 == 3, "HTTP 429: rate limit reached").otherwise("")
    return c.select("conv_id", "turn", F.when(message == "", "").otherwise(text.failure_kind(message)).alias("failure"), (~F.contains(F.lower(F.substring(F.trim("text"), 1, 20)), F.lit("reject"))).alias("keep"))


# --- logs, monitoring, policy ---------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderkey % 7 = 0 AS overridden FROM orders")
def override_overlay(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return history.overlay(o, o.where("o_orderkey % 7 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus")), "o_orderkey", ["o_orderstatus"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def still_trash_semi(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").join(table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey")


@query("SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM documents c WHERE c.doc_id % 2 = 0 AND c.text = d.text) THEN 'reused' WHEN EXISTS (SELECT 1 FROM documents s WHERE s.doc_id % 3 = 0 AND s.doc_id = d.doc_id) THEN 'modified' ELSE 'new' END AS state FROM documents d")
def incremental_split(spark: SparkSession, d: str) -> DataFrame:
    docs = media.with_checksum(table(spark, d, "documents"), "text").select("doc_id", "checksum")
    return history.split_increment(docs, docs.where("doc_id % 2 = 0"), docs.where("doc_id % 3 = 0"), "checksum", "doc_id").select("doc_id", "state")


_LATEST = "LT AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS p FROM orders)"


@query(f"WITH {_LATEST} SELECT o_custkey, o_orderkey, o_orderstatus FROM LT WHERE p = 1")
def manifest_latest(spark: SparkSession, d: str) -> DataFrame:
    return history.latest(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query(f"WITH {_LATEST} SELECT o_orderstatus AS state, count(*) AS n FROM LT WHERE p = 1 GROUP BY 1")
def state_counts(spark: SparkSession, d: str) -> DataFrame:
    return manifest_latest(spark, d).groupBy(F.col("o_orderstatus").alias("state")).agg(F.count("*").alias("n"))


@query(f"WITH {OBS_SQL} {RATE_SQL}")
def false_trash_rate(spark: SparkSession, d: str) -> DataFrame:
    return history.false_trash(observations(spark, d))


@query(f"WITH {OBS_SQL} {DRIFT_SQL}")
def drift_last_200(spark: SparkSession, d: str) -> DataFrame:
    return history.drift(observations(spark, d), "at")


@query(f"WITH {OBS_SQL} {BINS_SQL}")
def calibration_bins(spark: SparkSession, d: str) -> DataFrame:
    return history.calibration(observations(spark, d))


@query(f"WITH {OBS_SQL}, X AS ({RATE_SQL}), Y AS ({DRIFT_SQL}), Z AS (SELECT coalesce(round_even(max(abs(claimed - actual)), 4), 0.0) AS gap FROM ({BINS_SQL}) WHERE n >= 20) SELECT rate, n, drift, gap, (n < 20 OR rate <= 0.001) AND drift <= 0.25 AND gap <= 0.1 AS automation FROM X, Y, Z")
def monitor_alarms(spark: SparkSession, d: str) -> DataFrame:
    return history.alarms(observations(spark, d), "at")


@query(f"""WITH {CLASSES}, D AS (SELECT key, CASE WHEN n_fatal > 0 THEN 'corrupt_file' ELSE '' END AS evidence, cluster_size, is_best, art_uncertainty AS uncertainty, key % 2 = 0 AS keeps, route_class, key % 1500 + 600 AS decisions, key % 7 <> 0 AS in_distribution, key % 8 = 0 AS abstained, (key % 100) / 100.0::DOUBLE AS probability, key % 40 * 100 AS checks, key % 9 <> 0 AS stable, key % 3 = 0 AS shadow FROM C),
  G AS (SELECT *, CASE WHEN decisions < 1000 THEN 'enough_decisions' WHEN NOT in_distribution THEN 'in_distribution' WHEN abstained THEN 'model_committed' WHEN checks < 3000 THEN 'holdout_validated' WHEN NOT (abstained OR ((probability >= 0.5) = keeps)) THEN 'models_agree' WHEN keeps THEN 'no_artistic_rescue' WHEN NOT stable THEN 'stable' WHEN 1.0::DOUBLE - probability < 0.93 THEN 'confident' WHEN shadow THEN 'not_shadow_mode' END AS failed,
  evidence <> '' OR (cluster_size > 1 AND is_best) OR uncertainty >= 60 OR route_class IN ('stock_strong', 'stock_standard', 'flagship') AS early, CAST('0x' || substr(sha256(CAST(key AS VARCHAR)), 1, 2) AS BIGINT) / 255.0::DOUBLE < 0.05 AS aud FROM D)
  SELECT key, CASE WHEN evidence <> '' THEN 'safe_quarantine_candidate' WHEN cluster_size > 1 AND is_best THEN 'burst_winner' WHEN uncertainty >= 60 THEN 'curatorial_review' WHEN route_class IN ('stock_strong', 'stock_standard') THEN 'auto_stock_candidate' WHEN route_class = 'flagship' THEN 'auto_keep_and_edit' WHEN failed IS NULL AND aud THEN 'manual_review' WHEN failed IS NULL THEN 'safe_quarantine_candidate' WHEN keeps THEN 'curatorial_review' ELSE 'auto_archive' END AS bucket,
  CASE WHEN NOT early THEN failed END AS failed_gate, NOT early AND failed IS NULL AND aud AS audit_sampled FROM G""")
def policy_bucket(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("key")
    df = classed(spark, d).select(
        "key", F.when(F.col("n_fatal") > 0, "corrupt_file").otherwise("").alias("evidence"), "cluster_size", "is_best", F.col("art.uncertainty").alias("uncertainty"), (k % 2 == 0).alias("curator_keeps"), "route_class", (k % 1500 + 600).alias("decisions"), (k % 7 != 0).alias("in_distribution"),
        (k % 8 == 0).alias("abstained"), (k % 100 / 100.0).alias("probability"), (k % 40 * 100).alias("checks"), (k % 9 != 0).alias("stable"), (k % 3 == 0).alias("shadow"), F.lit(True).alias("healthy"),
    )
    return history.policy(df).select("key", "bucket", "failed_gate", "audit_sampled")


@query("SELECT event_id FROM events WHERE CAST('0x' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 2) AS BIGINT) <= 12")
def audit_sample(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(history.audited(F.col("event_id"))).select("event_id")


_SIG = "CASE event_type WHEN 'view' THEN 'not_opened' WHEN 'click' THEN 'pairwise_keep' WHEN 'error' THEN 'manual_reject' WHEN 'purchase' THEN 'published' ELSE 'intent_label' END"


@query(f"SELECT event_id, w AS weight, CAST(greatest(1.0, round_even(w, 0)) AS BIGINT) AS repeats FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 0.0::DOUBLE WHEN 'click' THEN 1.5 WHEN 'error' THEN 1.0 WHEN 'purchase' THEN 2.0 ELSE 1.5 END * least(1.0::DOUBLE, greatest(0.0, value / 50)) AS w FROM events)")
def preference_weights(spark: SparkSession, d: str) -> DataFrame:
    w = history.decision_weight(F.expr(_SIG), F.col("value") / 50)
    return table(spark, d, "events").select("event_id", w.alias("weight"), history.repetitions(w).alias("repeats"))


@query("WITH X AS (SELECT c_custkey AS item, greatest(c_acctbal, 0) / 1000 AS s FROM customer) SELECT item, round_even(1 / (1 + exp(-(ln(greatest(s, 1e-6)) - (SELECT avg(ln(greatest(s, 1e-6))) FROM X)))), 5) AS probability FROM X")
def probability_kept(spark: SparkSession, d: str) -> DataFrame:
    return history.probability_kept(table(spark, d, "customer").select(F.col("c_custkey").alias("item"), (F.greatest("c_acctbal", F.lit(0.0)) / 1000).alias("strength")))


_PRICES = {"A": (0.5, 2.0), "N": (1.25, 10.0)}


@query("SELECT l_returnflag AS model, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS prompt, CAST(sum(l_linenumber) AS BIGINT) AS completion, CAST(sum(l_linenumber * 3) AS BIGINT) AS reasoning, round_even(sum(CAST(l_quantity AS BIGINT)) / 1e6 * CASE l_returnflag WHEN 'A' THEN 0.5 WHEN 'N' THEN 1.25 ELSE 0 END + (sum(l_linenumber) + sum(l_linenumber * 3)) / 1e6 * CASE l_returnflag WHEN 'A' THEN 2.0 WHEN 'N' THEN 10.0 ELSE 0 END, 4) AS usd FROM lineitem GROUP BY 1")
def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_quantity").cast("long").alias("prompt"), F.col("l_linenumber").alias("completion"), (F.col("l_linenumber") * 3).alias("reasoning"))
    return history.usage_totals(u, _PRICES)


@query("SELECT coalesce(l_linestatus, 'total') AS stage, count(*) AS calls, CAST(sum(CAST(l_quantity AS BIGINT) + l_linenumber) AS BIGINT) AS tokens FROM lineitem GROUP BY ROLLUP (l_linestatus)")
def stage_rollup(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("stage"), F.col("l_quantity").cast("long").alias("prompt"), F.col("l_linenumber").alias("completion"))
    return history.stage_rollup(u)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 <> 0")
def purge_gate(spark: SparkSession, d: str) -> DataFrame:
    """What may be purged: evidence of nothing but unreadable files."""
    evidence = F.when(F.col("o_orderkey") % 3 == 0, "").when(F.col("o_orderstatus") == "F", "corrupt_file, empty_frame").otherwise("corrupt_file,soft_focus")
    return table(spark, d, "orders").where(history.purgeable(evidence, history.PURGE_EVIDENCE)).select("o_orderkey")


# --- kernels --------------------------------------------------------------------------------------


#: Cells of 8 x 8 pictures; a Gaussian of 13 weights along both sides, edges repeated; the Laplacian inside.
_lap = lambda t: f"(SELECT a.key, var_pop(u.v + d.v + l.v + r.v - 4 * a.v) AS s FROM {t} a JOIN {t} u ON u.key = a.key AND u.x = a.x AND u.y = a.y - 1 JOIN {t} d ON d.key = a.key AND d.x = a.x AND d.y = a.y + 1 JOIN {t} l ON l.key = a.key AND l.y = a.y AND l.x = a.x - 1 JOIN {t} r ON r.key = a.key AND r.y = a.y AND r.x = a.x + 1 WHERE a.x BETWEEN 1 AND 6 AND a.y BETWEEN 1 AND 6 GROUP BY a.key)"
_IMAGE = f"""WITH C AS (SELECT vec_id AS key, i // 8 AS y, i % 8 AS x, least(255.0::DOUBLE, greatest(0.0, 128.0::DOUBLE + CAST(embedding[i + 1] AS DOUBLE) * 300)) AS v FROM embeddings, range(64) t(i)),
  W AS (SELECT o, exp(-0.5::DOUBLE * (o / 2.0::DOUBLE) ** 2) AS e FROM range(-6, 7) t(o)), G AS (SELECT o, e / sum(e) OVER () AS w FROM W),
  B1 AS (SELECT c.key, n.y, c.x, sum(G.w * c.v) AS v FROM range(8) n(y), G, C c WHERE c.y = least(7, greatest(0, n.y + G.o)) GROUP BY 1, 2, 3), B2 AS (SELECT c.key, c.y, n.x, sum(G.w * c.v) AS v FROM range(8) n(x), G, B1 c WHERE c.x = least(7, greatest(0, n.x + G.o)) GROUP BY 1, 2, 3),
  L AS (SELECT key, s AS sharp FROM {_lap("C")}), K AS (SELECT key, s AS soft FROM {_lap("B2")}), T AS (SELECT key, avg(v) AS m, stddev_pop(v) AS d, avg(CASE WHEN v >= 253 OR v <= 2 THEN 1.0::DOUBLE ELSE 0.0 END) AS c FROM C GROUP BY key)
  SELECT key, round_even(sharp, 6) AS sharpness, round_even(CASE WHEN soft > 1e-12 THEN sharp / soft ELSE 0.0 END, 6) AS blur_ratio, 0.0::DOUBLE AS sharpest_tile, round_even(m, 6) AS mean_luma, round_even(d, 6) AS stddev_luma, round_even(c, 6) AS clipped,
    round_even((0.36::DOUBLE * 100 * exp(-(((m - 118.0::DOUBLE) / 45.0::DOUBLE) ** 2)) + 0.28::DOUBLE * 100 * least(1.0, greatest(0.0, (d - 25.0::DOUBLE) / 55.0::DOUBLE)) + 0.36::DOUBLE * least(100.0, greatest(0.0, 42.0::DOUBLE * log10(1.0::DOUBLE + sharp) - 59.5::DOUBLE))) * greatest(0.4::DOUBLE, 1 - 3 * c), 2) AS quality FROM L JOIN K USING (key) JOIN T USING (key)"""


@query(_IMAGE)
def image_measures(spark: SparkSession, d: str) -> DataFrame:
    """Sharpness, blur and quality of the vectors as 8 x 8 pictures."""
    pixels = F.transform("embedding", lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.lit(128.0) + x.cast("double") * 300)))
    return kernels.measure(table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.lit(8).alias("height"), F.lit(8).alias("width"), pixels.alias("pixels")))


# --- intent, clips, file operations, replies ------------------------------------------------------

_INTENT = "I AS (SELECT p_partkey AS key, p_size / 4.0::DOUBLE AS blur_ratio, CAST(p_partkey % 9 AS DOUBLE) AS sharp_global, CAST(p_partkey * 5 % 31 AS DOUBLE) AS sharp_tile, (p_partkey % 10) / 10.0::DOUBLE AS anisotropy, CAST(p_partkey % 256 AS DOUBLE) AS mean_luma, CAST(p_partkey * 3 % 200 AS DOUBLE) AS brightest, (p_partkey % 9) - 4.25::DOUBLE AS tilt, (p_partkey % 30) / 100.0::DOUBLE AS highlights, p_partkey % 40 * 200 AS iso, p_partkey % 2 = 0 AS present FROM part)"


def _intent_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k.alias("key"), (F.col("p_size") / 4.0).alias("blur_ratio"), (k % 9).cast("double").alias("sharp_global"), (k * 5 % 31).cast("double").alias("sharp_tile"), (k % 10 / 10.0).alias("anisotropy"), (k % 256).cast("double").alias("mean_luma"),
        (k * 3 % 200).cast("double").alias("brightest"), (k % 9 - 4.25).alias("tilt"), (k % 30 / 100.0).alias("highlights"), (k % 40 * 200).alias("iso"), (k % 2 == 0).alias("present"),
    )


@query(f"""WITH {_INTENT}, V AS (SELECT *, CASE WHEN blur_ratio < 6 AND sharp_tile > sharp_global * 4 THEN 'softness+' WHEN blur_ratio < 6 AND anisotropy >= 0.7 THEN 'motion blur+' WHEN blur_ratio < 6 THEN 'softness?' END AS a, CASE WHEN mean_luma < 70 AND brightest >= 90 THEN 'darkness+' WHEN mean_luma < 70 THEN 'darkness?' END AS b,
  CASE WHEN abs(tilt) >= 3 THEN 'tilted horizon+' WHEN abs(tilt) >= 0.5 THEN 'tilted horizon?' END AS c, CASE WHEN highlights > 0.1 AND mean_luma >= 60 THEN 'blown highlights+' END AS e, CASE WHEN iso >= 3200 THEN 'grain+' END AS g FROM I),
  W AS (SELECT *, CASE a WHEN 'softness+' THEN 0.75::DOUBLE WHEN 'motion blur+' THEN 0.65 WHEN 'softness?' THEN 0.35 ELSE 0 END AS wa, CASE b WHEN 'darkness+' THEN 0.7::DOUBLE WHEN 'darkness?' THEN 0.4 ELSE 0 END AS wb, CASE WHEN c LIKE '%+' THEN 0.6::DOUBLE WHEN c LIKE '%?' THEN 0.3 ELSE 0 END AS wc, CASE WHEN e IS NOT NULL THEN 0.55::DOUBLE ELSE 0 END AS we, CASE WHEN g IS NOT NULL THEN 0.5::DOUBLE ELSE 0 END AS wg FROM V)
  SELECT key, concat_ws(',', a, b, c, e, g) AS signals, CASE WHEN wa + wb + wc + we + wg > 0 THEN CAST(round_even(100 * ((CASE WHEN a LIKE '%?' THEN 0.55::DOUBLE ELSE 1.0 END) * wa + (CASE WHEN b LIKE '%?' THEN 0.55::DOUBLE ELSE 1.0 END) * wb + (CASE WHEN c LIKE '%?' THEN 0.55::DOUBLE ELSE 1.0 END) * wc + we + wg) / (wa + wb + wc + we + wg), 0) AS BIGINT) ELSE 50 END AS intentionality,
  CAST(least(100, CASE WHEN present THEN 30 ELSE 70 END + 12 * (CASE WHEN a LIKE '%?' THEN 1 ELSE 0 END + CASE WHEN b LIKE '%?' THEN 1 ELSE 0 END + CASE WHEN c LIKE '%?' THEN 1 ELSE 0 END)) AS BIGINT) AS uncertainty FROM W""")
def intent_signals(spark: SparkSession, d: str) -> DataFrame:
    df = intent.signals(_intent_rows(spark, d))
    said = F.array_join(F.transform("signals", lambda x: F.concat(x["defect"], F.when(x["verdict"] == "cannot_tell", "?").otherwise("+"))), ",")
    return df.select("key", said.alias("signals"), intent.intentionality(F.col("signals")).alias("intentionality"), intent.uncertainty(F.col("signals"), F.col("present")).alias("uncertainty"))


@query("""WITH X AS (SELECT p_partkey AS key, p_partkey % 2 = 0 AS raw, (p_partkey % 9 - 4) * 700 AS delta, p_partkey % 7 - 3 AS tint, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 5200 END AS shot FROM part)
  SELECT key, CASE WHEN delta = 0 AND tint = 0 THEN NULL WHEN NOT raw THEN nullif(CAST(greatest(-100, least(100, round_even(delta / 1000.0::DOUBLE * 12.0::DOUBLE, 0))) AS BIGINT), 0) WHEN shot IS NOT NULL THEN CAST(greatest(2000, least(50000, shot + delta)) AS BIGINT) END AS temperature,
  CASE WHEN tint = 0 OR (raw AND shot IS NULL) THEN NULL ELSE CAST(tint AS BIGINT) END AS tint, (delta <> 0 OR tint <> 0) AND raw AND shot IS NULL AS lost FROM X""")
def white_balance_settings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    x = table(spark, d, "part").select(k.alias("key"), intent.white_balance(k % 2 == 0, (k % 9 - 4) * 700, k % 7 - 3, F.when(k % 3 != 0, 5200)).alias("w"))
    return x.select("key", "w.temperature", "w.tint", "w.lost")


_CLIPS = "VI AS (SELECT p_partkey AS key, p_partkey % 31 = 0 AS corrupt, (p_partkey % 700) / 10.0::DOUBLE AS duration, CASE WHEN p_partkey % 5 = 0 THEN 1280 ELSE 1920 END AS width, 1080 AS height, p_partkey % 10 AS samples, p_partkey % 4 AS segments, (p_partkey % 3) / 2.0::DOUBLE AS first_start, (p_partkey % 60) / 10.0::DOUBLE AS jitter, (p_partkey % 40) / 10.0::DOUBLE AS shear, (p_partkey % 100) / 100.0::DOUBLE AS focus, CAST(p_partkey % 80 AS DOUBLE) AS range, CAST(p_partkey % 13 AS DOUBLE) AS flicker, p_partkey % 7 AS black, p_partkey % 2 AS channels FROM part)"


@query(f"""WITH {_CLIPS} SELECT key, CASE WHEN corrupt THEN 'encoding_corruption' ELSE concat_ws(',', CASE WHEN duration < 0.4 THEN 'unusable_duration' WHEN duration < 3 THEN 'short_clip' END, CASE WHEN width * height / 1e6 < 1.9 THEN 'insufficient_resolution' END, CASE WHEN samples = 0 THEN 'encoding_corruption' END,
  CASE WHEN samples > 0 AND segments = 0 THEN 'no_usable_segment' WHEN samples > 0 AND (duration > 60 OR first_start > 0.5) THEN 'needs_trim' END, CASE WHEN samples > 0 AND jitter >= 4.5 THEN 'unusable_shake' WHEN samples > 0 AND jitter >= 1.6 THEN 'moderate_shake' END, CASE WHEN samples > 0 AND shear >= 2.5 THEN 'rolling_shutter' END, CASE WHEN samples > 0 AND focus < 0.45 THEN 'broken_focus_pull' END,
  CASE WHEN samples > 0 AND range > 42 THEN 'exposure_drift' END, CASE WHEN samples > 0 AND flicker > 9 THEN 'exposure_drift' END, CASE WHEN samples > 0 AND black = samples THEN 'empty_frame' WHEN samples > 0 AND black > 0 THEN 'needs_trim' END, CASE WHEN samples > 0 AND channels = 0 THEN 'unusable_audio' END) END AS issues FROM VI""")
def video_issues(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    clips = table(spark, d, "part").select(
        k.alias("key"), (k % 31 == 0).alias("corrupt"), (k % 700 / 10.0).alias("duration"), F.when(k % 5 == 0, 1280).otherwise(1920).alias("width"), F.lit(1080).alias("height"), (k % 10).alias("samples"), (k % 4).alias("segments"), (k % 3 / 2.0).alias("first_start"), (k % 60 / 10.0).alias("jitter"),
        (k % 40 / 10.0).alias("shear"), (k % 100 / 100.0).alias("focus_consistency"), (k % 80).cast("double").alias("exposure_range"), (k % 13).cast("double").alias("flicker"), (k % 7).alias("black"), F.lit(True).alias("audio"), (k % 2).alias("channels"),
    )
    return media.video_issues(clips).select("key", "issues")


@query("""WITH X AS (SELECT p_partkey AS key, CAST(p_size AS DOUBLE) AS du FROM part), Y AS (SELECT *, least(0.5::DOUBLE, du * 0.05::DOUBLE) AS inset FROM X)
  SELECT key, i + 1 AS n, CASE WHEN du <= 2 THEN round_even(du / 2, 3) ELSE round_even(inset + (du - 2 * inset) * i / 8, 3) END AS at FROM Y, unnest(range(0, 9)) AS u(i) WHERE du > 2 OR i = 0""")
def sample_timestamps(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.posexplode(media.sample_times(F.col("p_size").cast("double"))).alias("i", "at"))
    return x.select("key", (F.col("i") + 1).cast("long").alias("n"), "at")


@query("""SELECT CASE WHEN doc_id % 4 = 0 THEN source ELSE 'd' || CAST(doc_id AS VARCHAR) END AS group_id, CASE WHEN doc_id % 9 = 0 THEN '/other/' ELSE '/in/' END || source || '/' || CAST(doc_id AS VARCHAR) || '.jpg' AS source, CASE WHEN doc_id % 9 <> 0 THEN '/q/' || source || '/' || CAST(doc_id AS VARCHAR) || '.jpg' END AS destination, doc_id % 9 = 0 AS refused FROM documents""")
def quarantine_plan(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    files = table(spark, d, "documents").select(F.when(k % 4 == 0, F.col("source")).otherwise("").alias("group_id"), F.concat(F.lit("d"), k.cast("string")).alias("asset_id"), F.concat(F.when(k % 9 == 0, "/other/").otherwise("/in/"), "source", F.lit("/"), k.cast("string"), F.lit(".jpg")).alias("source"))
    return quarantine.plan(files, "/in", "/q")


@query("WITH N AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_returnflag DESC) AS p FROM lineitem) SELECT l_orderkey AS destination, l_linenumber AS line FROM N WHERE p = 1 AND l_returnflag = 'R'")
def restore_candidates(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("destination"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag").alias("seq"), F.when(F.col("l_returnflag") == "R", "moved").otherwise("restored").alias("status"))
    return quarantine.restorable(log).select("destination", F.col("seq.l_linenumber").alias("line"))


@query("""WITH G AS (SELECT event_id // 5 AS group_id, event_id % 5 AS p, event_id AS key FROM events)
  SELECT group_id, key, CASE WHEN group_id % 3 = 2 OR group_id % 4 = 3 OR p = 4 THEN NULL ELSE 'g' || CAST(p AS VARCHAR) END AS genre, CASE WHEN group_id % 3 = 2 OR group_id % 4 = 3 OR p = 4 THEN NULL ELSE p + 1 END AS axis_a, CASE WHEN group_id % 3 = 2 THEN 'no reply' WHEN group_id % 4 = 3 THEN 'unreadable' WHEN p = 4 THEN 'missing' END AS problem FROM G""")
def provider_replay(spark: SparkSession, d: str) -> DataFrame:
    """Groups of five asked for and answered from a table: a third is silent, some replies are unreadable, each misses its last member."""
    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 5).alias("group_id"), (F.col("event_id") % 5).alias("position"), F.col("event_id").alias("key"))
    asked = provider.requests(e, "m")
    good = "Here it is: [" + ", ".join(f'{{"n": {i + 1}, "genre": "g{i}", "axis_a": {i + 1}, "axis_b": 1, "axis_c": 1}}' for i in range(4)) + "] done"
    replay = asked.where("group_id % 3 <> 2").select("group_id", F.when(F.col("group_id") % 4 == 3, "sorry").otherwise(good).alias("text"))
    return provider.replies(asked, replay).select("group_id", "key", "genre", "axis_a", "problem")


@query("SELECT CASE WHEN event_id % 4 = 1 THEN 'a' ELSE 'b' END AS batch, count(DISTINCT user_id) AS keys FROM events GROUP BY 1")
def seen_keys(spark: SparkSession, d: str) -> DataFrame:
    """Distinct keys of ledgers that list them in arrays."""
    runs = table(spark, d, "events").select(F.when(F.col("event_id") % 4 == 1, "a").otherwise("b").alias("batch"), F.array("user_id").alias("keys"))
    return runs.select("batch", F.explode("keys").alias("key")).distinct().groupBy("batch").agg(F.count("*").alias("keys"))


@query("SELECT conv_id, turn, upper(left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1)) || substr(left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 120), 2) AS title, array_to_string(list_slice(string_split_regex(trim(text), '\\s+'), 1, 12), ' ') AS note FROM conversations")
def title_and_note(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", text.title(F.col("text")).alias("title"), text.first_words(F.col("text")).alias("note"))


def _recipes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    whole = {"contrast": 7, "highlights": 11, "shadows": 13, "whites": 17, "blacks": 19, "clarity": 23, "vibrance": 29, "saturation": 31, "denoise": 37, "denoise_color": 41, "sharpening": 43, "masking": 47, "tint": 9}
    return table(spark, d, "part").select(
        k.alias("key"), k.cast("string").alias("asset_id"), F.sha2(F.col("p_name").cast("binary"), 256).alias("checksum"), F.when(k % 2 == 0, "faithful").otherwise("expressive").alias("variant"), F.col("p_type").alias("intent"),
        (k % 9 / 4 - 1).alias("exposure"), (k % 5 / 2.0).alias("rotation"), *((k % m - m // 2).alias(n) for n, m in whole.items()), (k % 9 * 300 - 1200).alias("delta_k"), (k % 8 == 0).alias("monochrome"), (k % 3 == 0).alias("keep_tilt"), (k % 2 == 0).alias("is_raw"),
        F.when(k % 3 != 0, 5200).alias("as_shot"), *(F.when(k % 4 == 0, v).alias(n) for n, v in (("crop_left", 0.1), ("crop_top", 0.0), ("crop_right", 0.9), ("crop_bottom", 1.0))),
    )


@query("SELECT p_partkey AS key, upper(substr(sha1(CAST(p_partkey AS VARCHAR) || ':' || sha256(p_name) || ':' || CASE WHEN p_partkey % 2 = 0 THEN 'faithful' ELSE 'expressive' END), 1, 32)) AS id FROM part")
def preset_ids(spark: SparkSession, d: str) -> DataFrame:
    return _recipes(spark, d).select("key", exports.preset_id().alias("id"))


@query("""WITH X AS (SELECT p_partkey AS key, p_partkey % 2 = 0 AS raw, p_partkey % 9 * 300 - 1200 AS dk, p_partkey % 9 - 4 AS tint, p_partkey % 3 <> 0 AS shot FROM part)
  SELECT key, 13 + 1 + CASE WHEN dk = 0 AND tint = 0 THEN 0 WHEN raw AND NOT shot THEN 0 WHEN raw THEN 1 + CASE WHEN tint <> 0 THEN 1 ELSE 0 END ELSE CASE WHEN round_even(dk / 1000.0::DOUBLE * 12, 0) <> 0 THEN 1 ELSE 0 END + CASE WHEN tint <> 0 THEN 1 ELSE 0 END END
    + CASE WHEN key % 5 <> 0 AND key % 3 <> 0 THEN 1 ELSE 0 END + CASE WHEN key % 4 = 0 THEN 5 ELSE 0 END AS n FROM X""".replace("SELECT key, 13", "SELECT key, CAST(13").replace("END AS n FROM X", "END AS INTEGER) AS n FROM X"))
def recipe_settings(spark: SparkSession, d: str) -> DataFrame:
    """How many settings a recipe writes, counted in its document."""
    return spread(_recipes(spark, d)).select("key", F.size(exports.settings_in(exports.metadata_packet())).alias("n"))


# The other modules register their queries here too.
from vellumine.plans import edits, joined, kept, learned, packed, parsed, pictured, stored, toned, written  # noqa: E402, F401
