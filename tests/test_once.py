"""Costly values are worked out once a row, however often an expression reads them."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from vellumine.operators import documents, exports, media, pictures
from vellumine.plans import catalogue


def _plan(df):
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", 10000)
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_settings_read_once(spark):
    text = '<a crs:Tint="1" xmp:Rating = "5" crs:Tint="3" crs:x:y="4" dc:t=""/>'
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string").repartition(2)
    out = df.select(exports.settings_in(F.col("t")).alias("m"))
    assert _plan(out).count("regexp_extract_all") == 1
    assert [r.m for r in df.select("t", exports.settings_in(F.col("t")).alias("m")).orderBy(F.col("t").asc_nulls_first()).collect()] == [None, {}, {"xmp:Rating": "5", "crs:Tint": "3", "dc:t": ""}]


def test_differences_read_each_document_once(spark):
    df = spark.createDataFrame([('<a crs:B="1" crs:A="2"/>', '<a crs:B="1" crs:A="3" xmp:C="4"/>'), (None, "")], "a string, b string").repartition(2)
    out = df.select("a", exports.differences(F.col("a"), F.col("b")).alias("lines"))
    assert _plan(out).count("regexp_extract_all") == 2
    assert {r.a: r.lines for r in out.collect()} == {'<a crs:B="1" crs:A="2"/>': ["crs:A: 2 -> 3", "xmp:C: - -> 4"], None: None}


def test_recipe_documents_are_parsed_once(spark):
    df = spark.createDataFrame([('{"asset_id": "p1", "geometry": {"crop": {"left": 0.2, "right": 0.7, "bottom": 0.5}}, "x": 1}',), ("[1]",), (None,)], "t string").repartition(2)
    recipe = documents.document_of(F.col("t"))
    out = df.select("t", recipe.alias("r"), documents.document_text(recipe).alias("text"))
    plan = _plan(df.select(documents.document_text(recipe).alias("text")))
    assert plan.count("from_json(") == 1
    rows = {r.t: r for r in out.collect()}
    assert rows[None].r is None and rows["[1]"].r is None
    whole = next(r for t, r in rows.items() if t and t != "[1]")
    assert whole.r["asset_id"] == "p1" and whole.r["geometry"]["crop"]["top"] == 0.0 and whole.r["variant"] == "faithful"
    assert '"keeps":0.25' in whole.text


def test_move_plan_spells_out_no_scores_in_filters(spark):
    plan = catalogue.move_plan(spark, "/root/testdata/sf0.001")
    assert max(len(line) for line in _plan(plan).splitlines() if "Filter" in line) < 2000
    assert plan.count() == 2 * catalogue.classed(spark, "/root/testdata/sf0.001").select("key", "route_class").collect().__str__().count("route_class='trash'")


def test_samples_of_one_time_follow_their_key(spark):
    rows = [("a", 0.0, 1.0, 10.0, 5.0, 0), ("a", 1.0, 1.0, 90.0, 5.0, 1), ("a", 1.0, 1.0, 20.0, 5.0, 2), ("a", 2.0, 1.0, 30.0, 5.0, 3)]
    flickers = {media.exposure_stability(spark.createDataFrame(r, "clip string, ts double, quality double, mean_luma double, sharpness double, at int").coalesce(1), key="at").first().flicker for r in (rows, rows[::-1], rows[1:] + rows[:1])}
    assert flickers == {30.9121}  # steps of 80, 70 and 10


def test_pictures_are_worked_on_in_small_stacks(spark):
    seen = []
    frame = pd.DataFrame({"key": range(700), "height": 20, "width": 20, "pixels": [np.full(1200, i % 250) for i in range(699)] + [None]})
    out = list(pictures._in_stacks(iter([frame, frame.iloc[:0]]), ["pixels"], ["first"], lambda own, rgb: seen.append(rgb.size) or {"first": rgb[:, 0, 0, 0].tolist()}))
    assert max(seen) <= pictures.STACK and max(map(len, out)) <= pictures.FRAME
    whole = pd.concat(out)
    assert whole["key"].tolist() == list(range(700)) and whole["first"].tolist() == [i % 250 for i in range(699)] + [None]
