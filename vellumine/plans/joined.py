"""Queries of assembled parts over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.operators import assembled
from vellumine.plans.bindings import table
from vellumine.plans.registry import query


def _k():
    return F.col("event_id")


@query("""SELECT event_id AS key, round_even((event_id % 9000) * (event_id % 7000) / 1000000.0::DOUBLE, 2) AS megapixels, CASE WHEN event_id % 3 = 0 THEN 'r/' || event_id ELSE 'n' || event_id END AS asset_key, 'a/n' || event_id || CASE WHEN event_id % 2 = 0 THEN '|s' ELSE '' END || CASE WHEN event_id % 5 = 0 THEN '|x' ELSE '' END AS files,
  CASE WHEN event_id % 4 = 0 THEN 0.5::DOUBLE ELSE 0.25 END AS likeness, CASE WHEN event_id % 2 = 0 THEN 'corrupt_file,dead_moment' ELSE 'dead_moment' END AS evidence, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'ab:c' END AS code, CASE WHEN event_id % 2 = 0 THEN 'x: y' ELSE '' END AS detail FROM events""")
def asset_facts(spark: SparkSession, d: str) -> DataFrame:
    k = _k()
    text = k.cast("string")
    issues = F.array(F.struct(F.lit("dead_moment").alias("code")), F.when(k % 2 == 0, F.struct(F.lit("corrupt_file").alias("code"))).otherwise(F.struct(F.lit("soft_focus").alias("code"))), F.struct(F.lit("dead_moment").alias("code")))
    issue = assembled.described(F.when(k % 2 == 0, "a: x: y").otherwise("ab:c"))
    files = assembled.all_files(F.concat(F.lit("a/n"), text), F.when(k % 2 == 0, F.array(F.lit("s"))), F.when(k % 5 == 0, F.array(F.lit("x"))))
    return table(spark, d, "events").select(
        k.alias("key"), assembled.megapixels(k % 9000, k % 7000).alias("megapixels"), assembled.asset_key(F.when(k % 3 == 0, F.concat(F.lit("r/"), text)).otherwise(""), F.concat(F.lit("a/n"), text)).alias("asset_key"), F.array_join(files, "|").alias("files"),
        assembled.default_likeness(F.when(k % 4 == 0, 0.5), F.lit(0.25)).alias("likeness"), assembled.evidence(issues, ["corrupt_file", "dead_moment"]).alias("evidence"), issue["code"].alias("code"), issue["detail"].alias("detail"),
    )


@query("""SELECT event_id AS key, '{"filename":"f' || event_id || '\\"","class":"review","potential_gain":' || (event_id % 50 - event_id % 30) || ',"strengths":["a"],"reasons":[]}' AS explained FROM events""")
def explanations(spark: SparkSession, d: str) -> DataFrame:
    k = _k()
    e = table(spark, d, "events").select(k.alias("key"), F.concat(F.lit("f"), k.cast("string"), F.lit('"')).alias("filename"), F.lit("review").alias("route_class"), (k % 30).alias("current_quality"), (k % 50).alias("post_edit_potential"), F.array(F.lit("a")).alias("strengths"), F.array().cast("array<string>").alias("reasons"))
    return assembled.explained(e).select("key", "explained")


@query("SELECT event_id AS key, CASE event_id % 3 WHEN 2 THEN 0 ELSE event_id END AS prompt, CASE event_id % 3 WHEN 2 THEN 0 ELSE event_id % 7 END AS completion, CASE event_id % 3 WHEN 0 THEN event_id % 5 ELSE CAST(0 AS BIGINT) END AS reasoning, CAST(0 AS BIGINT) AS cached FROM events")
def usage_rows(spark: SparkSession, d: str) -> DataFrame:
    k = _k()
    body = lambda a, b, more: F.concat(F.lit('{"usage": {"' + a + '": '), k.cast("string"), F.lit(', "' + b + '": '), (k % 7).cast("string"), more, F.lit("}}"))
    details = F.concat(F.lit(', "completion_tokens_details": {"reasoning_tokens": '), (k % 5).cast("string"), F.lit('}, "prompt_tokens_details": {"cached_tokens": "many"}'))
    reply = F.when(k % 3 == 0, body("prompt_tokens", "completion_tokens", details)).when(k % 3 == 1, body("input_tokens", "output_tokens", F.lit(""))).otherwise("{}")
    return table(spark, d, "events").select(k.alias("key"), assembled.usage_row(reply).alias("u")).select("key", "u.*")


@query("""WITH G AS (SELECT user_id AS group_id, list(event_id ORDER BY event_id) AS f, 1 + user_id % 4 AS budget FROM events GROUP BY user_id), H AS (SELECT *, len(f) AS n, len(f) // 2 AS h FROM G)
  SELECT group_id, CAST(0 AS INTEGER) AS part, array_to_string(CASE WHEN n > 1 THEN f[1:h] ELSE f END, ',') AS frames, CASE WHEN n > 1 THEN budget ELSE budget * 2 END AS budget, CASE WHEN n > 1 THEN budget ELSE budget * 2 END > 4 AS failed FROM H
  UNION ALL SELECT group_id, 1, array_to_string(f[h + 1:n], ','), budget, budget > 4 FROM H WHERE n > 1""")
def asked_again(spark: SparkSession, d: str) -> DataFrame:
    """Users as truncated groups of their events."""
    g = table(spark, d, "events").groupBy(F.col("user_id").alias("group_id")).agg(F.array_sort(F.collect_list("event_id")).alias("frames")).withColumn("budget", 1 + F.col("group_id") % 4)
    return assembled.asked_again(g).withColumn("frames", F.array_join(F.transform("frames", lambda x: x.cast("string")), ","))


@query("SELECT c_custkey AS run, concat_ws(',', CASE WHEN c_custkey % 2 = 1 THEN 'report.json' END, CASE WHEN c_custkey % 3 <> 0 THEN 'report.csv' END, 'report.html', CASE WHEN c_custkey % 5 <> 0 THEN 'category folders' END) AS missing FROM customer")
def missing_artefacts(spark: SparkSession, d: str) -> DataFrame:
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    found = lambda rule, path: c.where(rule).select(k.alias("run"), F.lit(path).alias("path"))
    return assembled.missing_artefacts(found(k % 2 == 0, "report.json").union(found(k % 3 == 0, "report.csv")).union(found(k % 5 == 0, "TOP/a.jpg")), c.select(k.alias("run")))


@query("""SELECT count(*) FILTER (event_type <> 'error' AND event_type <> 'view') AS with_image, count(*) FILTER (event_type = 'error' OR event_type = 'view') AS without_image,
  (SELECT string_agg(event_type || ': ' || n, ', ' ORDER BY n DESC, event_type) FROM (SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('error', 'view') GROUP BY 1)) AS reasons FROM events""")
def picture_counts(spark: SparkSession, d: str) -> DataFrame:
    return assembled.build_counts(table(spark, d, "events").select((~F.col("event_type").isin("error", "view")).alias("ok"), F.col("event_type").alias("reason")))


@query("SELECT count(*) = 0 AS ok, coalesce(string_agg(n, ',' ORDER BY n), '') AS failed FROM (SELECT r_name AS n FROM region WHERE r_regionkey % 2 = 0 AND r_regionkey > 1)")
def environment_checks(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "region")
    return assembled.checks_ok(r.select(F.col("r_name").alias("name"), (F.col("r_regionkey") % 2 == 0).alias("required"), (F.col("r_regionkey") <= 1).alias("passed")))


@query("SELECT c_name AS filename, '' AS human_pile FROM customer")
def label_template(spark: SparkSession, d: str) -> DataFrame:
    return assembled.label_template(table(spark, d, "customer").select(F.col("c_name").alias("filename")))


@query("SELECT 'd' || c_custkey AS name FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 4 <> 0")
def stale_documents(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.concat(F.lit("d"), k.cast("string")).alias("name")
    c = table(spark, d, "customer")
    return assembled.stale_documents(c.select(name, F.when(k % 3 == 0, "<a by=vellumine>").otherwise("<a>").alias("document")), c.where(k % 4 == 0).select(name), "vellumine")
