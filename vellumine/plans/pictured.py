"""Queries over whole pictures, which are drawn from the driver's vectors and keys: gratings that are off level, patches of detail, coloured gradients."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.operators import kernels, pictures
from vellumine.plans.bindings import spread, table
from vellumine.plans.registry import query


def _drawn(spark: SparkSession, d: str, height: int, width: int, colours: list[str]) -> DataFrame:
    """(key, height, width, pixels) of each vector, colours being SQL over key, the place p and {e}, the vector's number for the place in an 8 x 8 grid."""
    grid = f"cast(p.y div {-(-height // 8)} * 8 + p.x div {-(-width // 8)} + 1 as int)"
    place = "array(" + ", ".join(colours).replace("{e}", f"cast(element_at(embedding, {grid}) as double)") + ")"
    pixels = f"flatten(transform(sequence(0, {height * width - 1}), i -> element_at(transform(array(named_struct('y', i div {width}, 'x', i % {width})), p -> {place}), 1)))"
    return spread(table(spark, d, "embeddings")).selectExpr("vec_id AS key", f"{height} AS height", f"{width} AS width", f"transform({pixels}, v -> least(255, greatest(0, cast(v as int)))) AS pixels")


_blurred = lambda made, source, axis, sigma, most: (
    f"{made} AS MATERIALIZED (SELECT s.key, {'n.p AS y, s.x' if axis == 'y' else 's.y, n.p AS x'}, (sum(w.w * s.v) + 32768) >> 16 AS v FROM range({most}) n(p), (VALUES {', '.join(f'({i - len(k) // 2}, {v})' for i, v in enumerate(k))}) w(o, w), {source} s WHERE s.{axis} = least({most - 1}, greatest(0, n.p + w.o)) GROUP BY ALL)"
    if (k := [int(v) for v in pictures.weights(sigma)])
    else ""
)
_SIDE = 50
_GRATING = "40 + 150 * (((p.y * (30 + key % 5) + p.x * (key % 13 - 6) + 1000) div ((30 + key % 5) * 8)) % 2) + cast(bround({e} * 20) as int)"
_TILT = f"""WITH P AS MATERIALIZED (SELECT vec_id AS key, y, x, CAST(least(255, greatest(0, 40 + 150 * (((y * (30 + vec_id % 5) + x * (vec_id % 13 - 6) + 1000) // ((30 + vec_id % 5) * 8)) % 2) + CAST(round_even(CAST(embedding[y // 7 * 8 + x // 7 + 1] AS DOUBLE) * 20, 0) AS BIGINT))) AS BIGINT) AS v FROM embeddings, range({_SIDE}) a(y), range({_SIDE}) b(x)),
  {_blurred("B1", "P", "y", pictures.TILT_BLUR, _SIDE)}, {_blurred("B2", "B1", "x", pictures.TILT_BLUR, _SIDE)},
  G0 AS (SELECT key, y, x, lead(v) OVER down - lag(v) OVER down AS gy, lead(v) OVER across - lag(v) OVER across AS gx FROM B2 WINDOW down AS (PARTITION BY key, x ORDER BY y), across AS (PARTITION BY key, y ORDER BY x)),
  G AS (SELECT key, (y - 1) // 24 AS ty, (x - 1) // 24 AS tx, gx, gy FROM G0 WHERE y BETWEEN 1 AND 48 AND x BETWEEN 1 AND 48),
  T AS (SELECT key, CAST(sum(gx * gx) AS BIGINT) AS xx, CAST(sum(gy * gy) AS BIGINT) AS yy, CAST(sum(gx * gy) AS BIGINT) AS xy FROM G GROUP BY key, ty, tx),
  C AS (SELECT key, xx + yy AS strength, 0.5::DOUBLE * degrees(atan2(2.0::DOUBLE * xy, CAST(xx - yy AS DOUBLE))) + 45 AS m FROM T WHERE xx + yy > 0 AND sqrt(CAST(xx - yy AS DOUBLE) ** 2 + 4.0::DOUBLE * CAST(xy AS DOUBLE) ** 2) >= 0.55::DOUBLE * (xx + yy)),
  V AS (SELECT key, CAST(least(179, floor((m - 90 * floor(m / 90)) * 2)) AS BIGINT) AS bin, strength FROM C WHERE key IN (SELECT key FROM C GROUP BY key HAVING count(*) >= 4)),
  N AS (SELECT key, b, sum(strength) AS votes FROM V, range(180) r(b) WHERE bin BETWEEN b - 2 AND b + 2 GROUP BY key, b), W AS (SELECT key, b / 2.0::DOUBLE - 44.75 AS peak FROM N QUALIFY row_number() OVER (PARTITION BY key ORDER BY votes DESC, b) = 1)
  SELECT vec_id AS key, CASE WHEN abs(peak) <= 8 THEN peak ELSE 0.0::DOUBLE END AS tilt FROM embeddings LEFT JOIN W ON key = vec_id""".replace("CASE WHEN abs(peak)", "CASE WHEN peak IS NULL THEN 0.0::DOUBLE WHEN abs(peak)")


@query(_TILT)
def tilt_estimates(spark: SparkSession, d: str) -> DataFrame:
    """How far gratings are off level."""
    return pictures.tilts(_drawn(spark, d, _SIDE, _SIDE, [_GRATING] * 3))


_H, _W = 24, 32
_PATCH = "cast(128 + bround({e} * 60) as int) + CASE WHEN abs(p.x - 6 - key % 20) < 7 AND abs(p.y - 4 - key % 15) < 6 THEN 60 * ((p.x + p.y) div 2 % 2) ELSE 0 END"
_span = lambda name, lo, hi: f"CASE WHEN least(x{hi} - x{lo}, y{hi} - y{lo}) >= 16 AND (x{hi} - x{lo}) * (y{hi} - y{lo}) / {_H * _W}.0::DOUBLE >= 0.45 THEN '{name}:' || x{lo} || ',' || y{lo} || ',' || x{hi} || ',' || y{hi} END"


def _shape(name: str, ratio: float) -> str:
    box = pictures.box_of(_W, _H, 0, 0, ratio)
    w, h = box[2], box[3]
    left, top = f"greatest(0, least({_W - w}, x50 - {w // 2}))", f"greatest(0, least({_H - h}, y50 - {h // 2}))"
    return f"'{name}:' || {left} || ',' || {top} || ',' || ({left} + {w}) || ',' || ({top} + {h})" if w * h / (_H * _W) >= pictures.LEAST_KEEP else "NULL"


_shares = lambda axis: ", ".join(f"count(*) FILTER (s < {p / 100}::DOUBLE) AS {axis}{p:02d}" for p in (4, 10, 50, 90, 96))
_SALIENCY = f"""WITH P AS (SELECT vec_id AS key, y, x, CAST(least(255, greatest(0, CAST(128 + round_even(CAST(embedding[y // 3 * 8 + x // 4 + 1] AS DOUBLE) * 60, 0) AS BIGINT) + CASE WHEN abs(x - 6 - vec_id % 20) < 7 AND abs(y - 4 - vec_id % 15) < 6 THEN 60 * ((x + y) // 2 % 2) ELSE 0 END)) AS BIGINT) AS v FROM embeddings, range({_H}) a(y), range({_W}) b(x)),
  {_blurred("B1", "P", "y", pictures.DETAIL_BLUR, _H)}, {_blurred("B2", "B1", "x", pictures.DETAIL_BLUR, _W)},
  E AS (SELECT c.key, c.y, c.x, CAST(least(255, abs(c.v - up.v) + abs(c.v - lt.v)) AS BIGINT) AS v FROM B2 c JOIN B2 up ON up.key = c.key AND up.x = c.x AND up.y = greatest(0, c.y - 1) JOIN B2 lt ON lt.key = c.key AND lt.y = c.y AND lt.x = greatest(0, c.x - 1)),
  {_blurred("S1", "E", "y", pictures.SPREAD_BLUR, _H)}, {_blurred("S2", "S1", "x", pictures.SPREAD_BLUR, _W)},
  R AS (SELECT key, sum(v) OVER (PARTITION BY key ORDER BY y) / CAST(sum(v) OVER (PARTITION BY key) AS DOUBLE) AS s FROM (SELECT key, y, CAST(sum(v) AS BIGINT) AS v FROM S2 GROUP BY key, y)), L AS (SELECT key, sum(v) OVER (PARTITION BY key ORDER BY x) / CAST(sum(v) OVER (PARTITION BY key) AS DOUBLE) AS s FROM (SELECT key, x, CAST(sum(v) AS BIGINT) AS v FROM S2 GROUP BY key, x)),
  RY AS (SELECT key, {_shares("y")} FROM R GROUP BY key), LX AS (SELECT key, {_shares("x")} FROM L GROUP BY key)
  SELECT key, concat_ws(';', {_span("tight crop", "10", "90")}, {_span("gentle crop", "04", "96")}, {", ".join(_shape(n, r) for n, r in pictures.SHAPES.items())}) AS boxes FROM RY JOIN LX USING (key)"""


@query(_SALIENCY)
def saliency_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes around patches of detail."""
    found = pictures.crop_candidates(_drawn(spark, d, _H, _W, [_PATCH] * 3))
    one = lambda b: F.concat(b["name"], F.lit(":"), F.concat_ws(",", *(b[s].cast("string") for s in ("left", "top", "right", "bottom"))))
    return found.select("key", F.array_join(F.transform("crops", one), ";").alias("boxes"))


_COLOURED = ["cast(30 + key % 90 + 2 * p.x + bround({e} * 80) as int)", "cast(20 + key % 70 + p.x + p.y + bround({e} * 60) as int)", "cast(10 + key % 110 + 2 * p.y + bround({e} * 40) as int)"]


@query()
def edit_search(spark: SparkSession, d: str) -> DataFrame:
    """The best edit of coloured gradients; tested against every candidate tried one by one."""
    k = F.col("key")
    found = pictures.edit_search(_drawn(spark, d, 48, 56, _COLOURED).withColumns({"is_raw": k % 2 == 0, "noisy": k % 3 == 0}))
    return found.withColumn("steps", F.array_join("steps", " | "))


def _recipe(k: Column) -> dict[str, Column]:
    whole = {"temperature": (k % 9 - 4) * 150, "tint": k % 7 - 3, "highlights": k % 11 * 10 - 60, "shadows": k % 10 * 8 - 30, "whites": k % 5 * 6 - 12, "blacks": k % 6 * 6 - 15, "contrast": k % 8 * 6 - 18, "clarity": k % 4 * 15 - 15, "saturation": k % 9 * 5 - 20, "vibrance": k % 12 * 4 - 20}
    return {n: c.cast("double") for n, c in whole.items()} | {
        "exposure_ev": (k % 9 - 4) / 4.0, "denoise": F.when(k % 3 == 0, 20.0).when(k % 3 == 1, 60.0), "sharpening": (k % 5 * 20).cast("double"), "masking": (k % 4 * 25).cast("double"), "rotation": F.when(k % 2 == 0, (k % 11 - 5).cast("double")),
        **{n: F.when(k % 4 == 1, v) for n, v in (("crop_left", 0.1), ("crop_top", 0.05), ("crop_right", 0.9), ("crop_bottom", 1.0))}, "monochrome": k % 10 == 0, "keep_tilt": k % 8 == 0,
    }


@query()
def rendered_pictures(spark: SparkSession, d: str) -> DataFrame:
    """Sizes and sums of pictures after whole recipes; tested against loops over places."""
    out = pictures.render(_drawn(spark, d, 40, 52, _COLOURED).withColumns(_recipe(F.col("key"))))
    return out.select("key", "out_height", "out_width", F.aggregate("out_pixels", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"), F.xxhash64("out_pixels").alias("name"))


@query()
def picture_damage(spark: SparkSession, d: str) -> DataFrame:
    """Rims and drift of skin after whole recipes; tested against loops over places."""
    k = F.col("key")
    before = _drawn(spark, d, 40, 52, ["cast(150 + key % 60 + p.x div 13 * 10 + bround({e} * 20) as int)", "cast(100 + key % 50 + p.x div 13 * 10 + bround({e} * 20) as int)", "cast(80 + key % 40 + p.y div 10 * 8 as int)"])
    plain = {n: F.lit(None).cast("double") for n in ("rotation", *pictures.CROP)} | {"keep_tilt": F.lit(False), "monochrome": F.lit(False)}
    after = pictures.render(before.withColumns(_recipe(k) | plain)).select("key", F.col("out_pixels").alias("after"))
    found = pictures.damage(before.withColumnRenamed("pixels", "before").join(after, "key").withColumn("faces", k % 2 == 0))
    return found.withColumn("violations", F.array_join("violations", ","))


@query("""WITH E AS (SELECT event_id AS key, CAST(event_id * 37 % 256 AS DOUBLE) AS v, (event_id % 17 - 8) / 4.0::DOUBLE AS ev FROM events), X AS (SELECT *, v / 255 AS x, greatest(v / 255 - 0.72::DOUBLE, 0.0) AS above, greatest(0.28::DOUBLE - v / 255, 0.0) AS below FROM E)
  SELECT key, round_even(255 * pow(least(1.0::DOUBLE, pow(x, 2.2::DOUBLE) * pow(2.0::DOUBLE, ev)), 1 / 2.2::DOUBLE), 6) AS exposed,
    round_even(255 * least(1.0::DOUBLE, greatest(0.0, x - 0.45::DOUBLE * least(above / 0.28::DOUBLE, 1.0) * above + 0.35::DOUBLE * least(below / 0.28::DOUBLE, 1.0) * below)), 6) AS recovered,
    round_even(255 * least(1.0::DOUBLE, greatest(0.0, x + 0.36::DOUBLE * (x - 0.5) * (1 - 2 * abs(x - 0.5)))), 6) AS contrasted FROM X""")
def pixel_edits(spark: SparkSession, d: str) -> DataFrame:
    """The search's edits of single values: stops in linear light, recovery at both ends, contrast."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            v, ev = frame["v"].to_numpy(), frame["ev"].to_numpy()
            yield pd.DataFrame({"key": frame["key"], "exposed": kernels.exposure(v, ev), "recovered": pictures.recovered(v), "contrasted": pictures.contrasted(v)})

    k = F.col("event_id")
    rows = table(spark, d, "events").select(k.alias("key"), (k * 37 % 256).cast("double").alias("v"), ((k % 17 - 8) / 4.0).alias("ev"))
    return rows.mapInPandas(run, "key long, exposed double, recovered double, contrasted double").select("key", *(F.bround(c, 6).alias(c) for c in ("exposed", "recovered", "contrasted")))


@query("SELECT vec_id AS key, round_even(CAST(embedding[1] AS DOUBLE) / n, 6) AS first, round_even(CAST(embedding[64] AS DOUBLE) / n, 6) AS last FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings)")
def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of length 1, by their ends."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            unit = kernels.normalised(np.stack(frame["embedding"].to_list()).astype(float)) if len(frame) else np.zeros((0, 64))
            yield pd.DataFrame({"key": frame["key"], "first": unit[:, 0], "last": unit[:, -1]})

    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "embedding").mapInPandas(run, "key long, first double, last double")
    return rows.select("key", F.bround("first", 6).alias("first"), F.bround("last", 6).alias("last"))


@query(f"""WITH P AS (SELECT vec_id AS key, i // 8 AS y, i % 8 AS x, CAST(round_even(CAST(embedding[i + 1] AS DOUBLE) * 100, 0) AS BIGINT) AS v FROM embeddings, range(64) t(i)),
  M AS (SELECT a.key, a.y, a.x, CAST(median(b.v) AS DOUBLE) AS m FROM P a JOIN range(-1, 2) p(o) ON true JOIN range(-1, 2) q(o) ON true JOIN P b ON b.key = a.key AND b.y = least(7, greatest(0, a.y + p.o)) AND b.x = least(7, greatest(0, a.x + q.o)) GROUP BY ALL)
  SELECT key, sum(m) AS total, max(m) AS most FROM M GROUP BY key""")
def median_pictures(spark: SparkSession, d: str) -> DataFrame:
    """Medians of 3 x 3 neighbourhoods in the vectors as 8 x 8 pictures."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            flat = pictures.median(np.stack(frame["v"].to_list()).astype(float).reshape(-1, 8, 8), 3).reshape(-1, 64) if len(frame) else np.zeros((0, 64))
            yield pd.DataFrame({"key": frame["key"], "total": flat.sum(axis=1), "most": flat.max(axis=1) if len(frame) else []})

    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.transform("embedding", lambda x: F.bround(x.cast("double") * 100)).alias("v"))
    return rows.mapInPandas(run, "key long, total double, most double")
