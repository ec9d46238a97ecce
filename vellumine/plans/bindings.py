"""Bindings of the operators' inputs to the driver's tables: one asset for each embedding with its event.

The tables hold no photographs, so measurements and reads are fixed arithmetic on the key; the same
expressions stand in the Spark views and in the SQL that checks them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellumine.params import ARTISTIC

#: Columns of the asset view, as expressions over key, value, event_type, user_id that both engines read alike.
ASSET = {
    "technical_quality": "least(100.0D, value)",
    "quality": "least(100.0D, value)",
    "kind": "CASE WHEN event_type = 'view' THEN 'video' ELSE 'photo' END",
    "camera": "concat('cam', CAST(user_id % 7 AS STRING))",
    "filename": "concat('IMG_', CAST(key AS STRING), '.RW2')",
    "status": "CASE WHEN key % 50 = 49 THEN 'error' ELSE 'ok' END",
    "size_bytes": "(key * 7919) % 100003",
    "uplift": "CAST(key % 23 AS DOUBLE)",
    "is_raw": "key % 2 = 0",
    "present": "key % 5 <> 0",
    "axis_a": "(key * 37 + 5) % 101",
    "axis_b": "(key * 53 + 11) % 101",
    "axis_c": "(key * 71 + 29) % 101",
    "subject_strength": "(key * 13 + 7) % 101",
    "accidental": "(key * 17) % 101",
    "dead_moment": "(key * 19 + 3) % 101",
    "intended": "key % 9 <> 0",
    "is_best": "key % 6 <> 0",
    "semantic_ran": "key % 8 <> 0",
    "cluster_id": "key - key % 6",
    "cluster_size": "1 + key % 4",
    "similarity": "CAST(key % 11 AS DOUBLE) / 10",
    "completeness": "CAST(10 - key % 4 AS DOUBLE) / 10",
    "flagship_selected": "key % 3 = 1",
    "hero_blocked": "key % 4 = 1",
}
#: Issues of an asset: code, certainty, and when it has them.
ISSUES = [("soft_focus", "0.6D", "key % 7 = 0"), ("missed_focus", "1.0D", "key % 10 = 0"), ("underexposed", "1.0D", "key % 4 = 0"), ("corrupt_file", "1.0D", "key % 97 = 0"), ("weaker_duplicate", "1.0D", "key % 6 = 0"), ("color_cast", "0.5D", "key % 9 = 3")]
ISSUE_ARRAY = "filter(array(" + ", ".join(f"CASE WHEN {when} THEN named_struct('code', '{code}', 'certainty', {sure}) END" for code, sure, when in ISSUES) + "), x -> x IS NOT NULL)"
#: The artistic read.
ART = {"usable": "key % 3 <> 0", "confidence": "(key * 23 + 41) % 101", "uncertainty": "(key * 31 + 17) % 101", "candidate": "key % 2 = 1", "says_deliberate": "key % 13 = 0"} | {name: f"(key * {3 + 2 * i} + {40 + 7 * i}) % 101" for i, name in enumerate(ARTISTIC)}
FACE = {
    "applies": "key % 4 <> 1", "area": "CAST(key % 10 AS DOUBLE) / 100", "eyes_shut": "key % 5 = 1", "bad_expression": "key % 6 = 1", "quality": "(key * 7 + 50) % 101", "publishability": "(key * 11 + 50) % 101",
    "pose": "(key * 5 + 33) % 101", "sharpness": "(key * 29 + 60) % 101", "confidence": "(key * 43 + 50) % 101", "blink": "(key * 47) % 101", "grimace": "(key * 59) % 101",
}
NO_FACE = "key % 4 = 3"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows in as many partitions as there are cores twice over, or as shuffles have: for work that costs far more than its few bytes to read, which splits by bytes would leave to a task or two."""
    session = df.sparkSession
    return df.repartition(max(2 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions"))))


def _named(columns: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in columns.items()) + ")"


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, vector, genre, shot, user_id, value, event_type, the ASSET columns, issues and art."""
    e, v = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "events")
    df = e.join(v, e.vec_id == v.event_id).selectExpr("vec_id AS key", "embedding AS vector", "CASE WHEN label = 0 THEN 'portrait' ELSE concat('g', CAST(label AS STRING)) END AS genre", "ts AS shot", "user_id", "value", "event_type")
    face = f"CASE WHEN {NO_FACE} THEN NULL ELSE {_named(FACE)} END"
    return df.selectExpr("*", *(f"{sql} AS {name}" for name, sql in ASSET.items()), f"{ISSUE_ARRAY} AS issues", f"named_struct({_named(ART)[13:-1]}, 'face', {face}) AS art")


def duck(sql: str) -> str:
    """An expression of this module in the checking engine's words."""
    return sql.replace("AS STRING", "AS VARCHAR").replace("100.0D", "100.0::DOUBLE").replace("0.6D", "0.6::DOUBLE").replace("1.0D", "1.0::DOUBLE").replace("0.5D", "0.5::DOUBLE")


#: The asset view in SQL, art_ and face_ columns flat, with issue counts.
ASSET_SQL = (
    "A AS (SELECT *, " + ", ".join(f"{duck(s)} AS {n}" for n, s in ASSET.items()) + ", " + ", ".join(f"{duck(s)} AS art_{n}" for n, s in ART.items()) + ", " + ", ".join(f"CASE WHEN {NO_FACE} THEN NULL ELSE {duck(s)} END AS face_{n}" for n, s in FACE.items())
    + ", CAST(key % 4 = 0 AS BIGINT) + CAST(key % 9 = 3 AS BIGINT) AS n_fixable, CAST(key % 7 = 0 AS BIGINT) AS n_partial, CAST(key % 10 = 0 AS BIGINT) + CAST(key % 97 = 0 AS BIGINT) AS n_unrecoverable, CAST(key % 97 = 0 AS BIGINT) AS n_fatal, CAST(key % 7 = 0 AS BIGINT) + CAST(key % 9 = 3 AS BIGINT) AS n_uncertain"
    + " FROM (SELECT e.vec_id AS key, e.embedding AS vector, CASE WHEN e.label = 0 THEN 'portrait' ELSE 'g' || CAST(e.label AS VARCHAR) END AS genre, v.ts AS shot, v.user_id, v.value, v.event_type FROM embeddings e JOIN events v ON v.event_id = e.vec_id))"
)
