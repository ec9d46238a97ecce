"""Queries over files' bytes, which are written from the driver's rows and read back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.operators import containers, documents, stored, tags
from vellumine.plans.bindings import table
from vellumine.plans.registry import query


def _packet(key: int) -> str:
    return f'<x:xmpmeta><rdf:Description xmp:CreatorTool="Tool {key % 5}"><Iptc4xmpExt:DigitalSourceType>source{key % 4}</Iptc4xmpExt:DigitalSourceType></rdf:Description></x:xmpmeta>'


def _picture(key: int) -> bytes | None:
    if key % 50 == 7:
        return None
    values: dict[str, object] = {"Make": f"Maker {key % 3}", "Model": f"M{key % 20}", "DateTimeOriginal": f"20{10 + key % 15}:0{1 + key % 9}:1{key % 10} 10:11:1{key % 10}", "ExposureTime": (1, 10 + key % 4000), "FNumber": (14 + key % 200, 10), "ISOSpeedRatings": 100 + key % 6400, "FocalLength": (24 + key % 100, 1), "LensModel": f"L {key % 11} é"}
    if key % 3 == 0:
        values |= {"GPSLatitude": [(key % 90, 1), (key % 60, 1), (key % 50 * 36, 1)], "GPSLatitudeRef": "S" if key % 2 else "N", "GPSLongitude": [(key % 180, 1), (key * 7 % 60, 1), (0, 1)], "GPSLongitudeRef": "W" if key % 5 else "E"}
    if key % 4 == 0:
        return tags.block(values, key % 8 == 0)
    whole = tags.jpeg(values, key % 2 == 0, _packet(key) if key % 3 else None, key % 10 == 1)
    return whole[:40] if key % 100 == 9 else whole


def _written(spark: SparkSession, d: str, made) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"key": frame["key"], "content": pd.Series([made(k) for k in frame["key"]], index=frame.index, dtype=object)})

    return table(spark, d, "events").select(F.col("event_id").alias("key")).mapInPandas(run, "key long, content binary")


_SCAN = "key % 50 <> 7 AND NOT (key % 4 <> 0 AND key % 100 = 9)"


@query(f"""WITH E AS (SELECT event_id AS key, event_id % 50 <> 7 AS there FROM events), S AS (SELECT *, {_SCAN} AS whole, {_SCAN} AND key % 3 = 0 AS placed, {_SCAN} AND key % 4 <> 0 AND key % 3 <> 0 AS packed FROM E)
  SELECT key, CASE WHEN whole THEN 'Maker ' || key % 3 END AS make, CASE WHEN whole THEN 'M' || key % 20 END AS model, CASE WHEN whole THEN 'L ' || key % 11 || ' é' END AS lens, CASE WHEN whole THEN 100 + key % 6400 END AS iso, CASE WHEN whole THEN round_even((14 + key % 200) / 10.0::DOUBLE, 4) END AS aperture,
    CASE WHEN whole THEN CAST(24 + key % 100 AS DOUBLE) END AS focal_length, CASE WHEN whole THEN '1/' || (10 + key % 4000) END AS shutter, CASE WHEN whole THEN '20' || (10 + key % 15) || '-0' || (1 + key % 9) || '-1' || key % 10 || 'T10:11:1' || key % 10 END AS shot,
    CASE WHEN placed THEN round_even((key % 90 + key % 60 / 60.0::DOUBLE + key % 50 * 36 / 3600.0::DOUBLE) * CASE WHEN key % 2 = 1 THEN -1 ELSE 1 END, 5) END AS latitude, CASE WHEN placed THEN round_even((key % 180 + key * 7 % 60 / 60.0::DOUBLE) * CASE WHEN key % 5 <> 0 THEN -1 ELSE 1 END, 5) END AS longitude,
    CASE WHEN packed THEN 'Tool ' || key % 5 END AS tool, CASE WHEN packed THEN 'source' || key % 4 END AS source, CASE WHEN there THEN whole AND key % 4 <> 0 AND key % 10 = 1 END AS signed, CASE WHEN there THEN NOT whole END AS broken FROM S""")
def tag_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of pictures, by their tags, packets and credentials; every hundredth file is cut off, every fiftieth missing."""
    found = documents.exif_facts(tags.file_tags(_written(spark, d, _picture))).withColumn("_m", stored.markers(F.coalesce("xmp", F.lit(""))))
    return found.select("key", "make", "model", "lens", "iso", "aperture", "focal_length", "shutter", "shot", F.bround("latitude", 5).alias("latitude"), F.bround("longitude", 5).alias("longitude"), F.col("_m.CreatorTool").alias("tool"), F.col("_m.DigitalSourceType").alias("source"), F.col("c2pa").alias("signed"), "broken")


def _clip(key: int) -> bytes:
    runs = [(10 + key % 500, 1001 if key % 2 else 1000)] + ([(5, 2000)] if key % 6 == 0 else [])
    whole = containers.movie("isom" if key % 3 else "qt", 24_000 if key % 4 else 30_000, 1000 * (key % 977), (640 + key % 5 * 320, 360 + key % 3 * 180), ("avc1", "hvc1", "apch")[key % 3], runs, key % 3, key % 5 == 0, key % 7 == 0)
    return whole[:200] if key % 100 == 9 else whole


@query("""WITH E AS (SELECT event_id AS key, event_id % 100 <> 9 AS whole, CASE WHEN event_id % 4 <> 0 THEN 24000 ELSE 30000 END AS scale, 10 + event_id % 500 AS f, CASE WHEN event_id % 2 = 1 THEN 1001 ELSE 1000 END AS unit, event_id % 6 = 0 AS twice FROM events), N AS (SELECT *, f + CASE WHEN twice THEN 5 ELSE 0 END AS frames, f * unit + CASE WHEN twice THEN 10000 ELSE 0 END AS units FROM E)
  SELECT key, CASE WHEN key % 3 <> 0 THEN 'isom' ELSE 'qt' END AS brand, CASE WHEN whole THEN round_even(1000 * (key % 977) / scale::DOUBLE, 6) ELSE 0.0::DOUBLE END AS duration, CAST(CASE WHEN whole THEN 640 + key % 5 * 320 ELSE 0 END AS INTEGER) AS width, CAST(CASE WHEN whole THEN 360 + key % 3 * 180 ELSE 0 END AS INTEGER) AS height,
    CASE WHEN whole THEN CASE key % 3 WHEN 0 THEN 'avc1' WHEN 1 THEN 'hvc1' ELSE 'apch' END END AS codec, CASE WHEN whole THEN frames ELSE 0 END AS frames, CASE WHEN whole THEN (frames * scale // gcd(frames * scale, units)) || '/' || (units // gcd(frames * scale, units)) END AS frame_rate, whole AND twice AS variable, CAST(CASE WHEN whole THEN key % 3 ELSE 0 END AS INTEGER) AS channels, NOT whole AS broken FROM N""")
def container_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of clips by their boxes; every hundredth file is cut off."""
    found = containers.container_facts(_written(spark, d, _clip))
    return found.select("key", "brand", F.bround("duration", 6).alias("duration"), "width", "height", "codec", "frames", "frame_rate", "variable", "channels", "broken")
