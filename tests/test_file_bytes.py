"""Tags and boxes: round trips, both byte orders, and bytes that are cut off or changed anywhere."""

import random
import struct

import pytest

from vellumine.operators import containers, tags

VALUES = {"Make": "Maker", "Model": "M", "DateTime": "2020:01:02 03:04:05", "ISOSpeedRatings": 400, "ExposureTime": (1, 250), "LensSpecification": [(24, 1), (70, 1), (28, 10), (4, 1)], "LensModel": "Lens é", "GPSLatitude": [(10, 1), (30, 1), (0, 1)], "GPSLatitudeRef": "S", "GPSLongitude": [(1, 1), (0, 1), (36, 1)], "GPSLongitudeRef": "E"}
WANT = {"Make": "Maker", "Model": "M", "DateTime": "2020:01:02 03:04:05", "ISOSpeedRatings": "400", "ExposureTime": "1/250", "LensSpecification": "24/1, 70/1, 28/10, 4/1", "LensModel": "Lens é", "GPSLatitude": "10/1, 30/1, 0/1", "GPSLatitudeRef": "S", "GPSLongitude": "1/1, 0/1, 36/1", "GPSLongitudeRef": "E"}


@pytest.mark.parametrize("big", [False, True])
def test_tags_round_trip(big):
    for data in (tags.block(VALUES, big), tags.jpeg(VALUES, big, "<x:xmpmeta/>", True)):
        found = tags.read(data)
        assert found.tags == WANT and not found.broken
    assert found.xmp == "<x:xmpmeta/>" and found.c2pa
    panasonic = b"IIU\0" + tags.block(VALUES)[4:]
    assert tags.read(panasonic).tags == WANT


def test_tags_in_boxes():
    inner = containers.box("CMT1", tags.block({"Make": "C", "Model": "R"})) + containers.box("CMT4", b"MM\0*" + struct.pack(">IHHHI4sI", 8, 1, 1, 2, 2, b"N\0\0\0", 0))
    data = containers.box("ftyp", b"crx \0\0\0\0") + containers.box("moov", containers.box("uuid", tags.CANON_BOX + inner)) + containers.box("uuid", tags.PACKET_BOX + b"<x:xmpmeta>", True) + containers.box("jumb", b"c2pa")
    found = tags.read(data)
    assert (found.tags, found.xmp, found.c2pa, found.broken) == ({"Make": "C", "Model": "R", "GPSLatitudeRef": "N"}, "<x:xmpmeta>", True, False)


def test_damaged_tags():
    """Whatever is cut off or changed, nothing raises, and what is found was there or is marked."""
    random.seed(1)
    for whole in (tags.block(VALUES), tags.jpeg(VALUES, True, "<x:xmpmeta/>", True)):
        for cut in range(len(whole)):
            found = tags.read(whole[:cut])
            assert all(WANT[k].startswith(v) or found.broken for k, v in found.tags.items())
        for _ in range(2000):
            data = bytearray(whole)
            for _ in range(random.randint(1, 4)):
                data[random.randrange(len(data))] = random.choice([0, 1, 8, 0x7F, 0xFF, random.randrange(256)])
            tags.read(bytes(data))
    assert tags.read(b"").broken and tags.read(b"GIF89a").broken
    loop = b"II*\0" + struct.pack("<IHHHIII", 8, 1, tags.DETAILS, 4, 1, 8, 0)
    assert tags.read(loop).tags == {}
    far = b"II*\0" + struct.pack("<IHHHIII", 8, 1, 0x010F, 2, 0xFFFFFFFF, 0xFFFFFFF0, 0)
    assert tags.read(far).broken and tags.read(far).tags == {}


def test_degrees():
    assert tags.degrees("10/1, 30/1, 36/1", "s") == -10.51 and tags.degrees("1/1, 0/1, 0/1", "E") == 1.0
    assert [tags.degrees(*x) for x in ((None, "N"), ("1/0, 0/1, 0/1", "N"), ("1/1, 0/1", "N"), ("x", "N"), ("1/1, 0/1, 0/1", None), ("1/1, 0/1, 0/1", " "))] == [None] * 6


@pytest.mark.parametrize(("late", "wide"), [(False, False), (True, True)])
def test_movie_round_trip(late, wide):
    data = containers.movie("isom", 30_000, 90_000, (1920, 1080), "avc1", [(30, 1001), (0, 5)], 2, late, wide)
    assert containers.probe(data) == {"brand": "isom", "duration": 3.0, "has_video": True, "width": 1920, "height": 1080, "codec": "avc1", "frames": 30, "frame_rate": "30000/1001", "variable": False, "has_audio": True, "channels": 2, "broken": False}
    assert containers.probe(containers.movie("qt", 0, 5, (1, 1), "apch", [(1, 2), (3, 4)], 0))["variable"]


def test_unknown_boxes_are_stepped_over():
    plain = containers.movie("isom", 1000, 2000, (64, 32), "hvc1", [(50, 40)], 1)
    for where in (0, len(containers.box("ftyp", b"isom\0\0\0\0"))):
        more = plain[:where] + containers.box("abcd", b"x" * 99, True) + plain[where:]
        assert containers.probe(more) == containers.probe(plain)
    to_the_end = plain[: plain.index(b"mdat") - 4] + struct.pack(">I4s", 0, b"mdat") + b"rest"
    assert not containers.probe(to_the_end)["broken"]


def test_damaged_movies():
    random.seed(2)
    whole = containers.movie("isom", 1000, 2000, (64, 32), "hvc1", [(50, 40)], 1)
    for cut in range(len(whole) - 17):
        assert containers.probe(whole[:cut])["broken"]
    for _ in range(3000):
        data = bytearray(whole)
        for _ in range(random.randint(1, 4)):
            data[random.randrange(len(data))] = random.choice([0, 1, 0xFF, random.randrange(256)])
        containers.probe(bytes(data))
    many = whole.replace(struct.pack(">III", 1, 50, 40), struct.pack(">III", 0xFFFFFFFF, 50, 40))
    assert containers.probe(many)["broken"] and containers.probe(many)["frames"] == 50


def test_files_as_rows(spark):
    """Null and odd bytes, repeated keys, extra columns, no rows."""
    rows = [(1, bytearray(tags.jpeg(VALUES)), "a"), (1, bytearray(tags.jpeg(VALUES)), "a"), (None, None, "b"), (2, bytearray(b""), "c")]
    df = spark.createDataFrame(rows, "key long, content binary, tags string")
    got = {r.key: r for r in tags.file_tags(df).collect()}
    assert got[1].tags == WANT and (got[1].latitude, got[1].longitude) == (-10.5, 1.01) and got[None].tags is None and got[2].broken
    assert tags.file_tags(df).count() == 4 and tags.file_tags(df.limit(0)).isEmpty()
    facts = {r.key: r for r in containers.container_facts(df).collect()}
    assert facts[None].broken is None and facts[2].broken and containers.container_facts(df.limit(0)).isEmpty()


def test_recipe_documents(spark):
    """Defaults for what is absent, nothing for what is unknown, nulls for what is no object; whole documents come back as they were."""
    from pyspark.sql import functions as F

    from vellumine.operators import documents

    texts = ['{}', '{"asset_id": "x", "geometry": {"crop": {"right": 0.5}}, "color": {"hsl": [{"hue": "red"}]}, "other": {"a": 1}}', "no json", "", None, "[1]", '{"global": {"contrast": "high"}}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "key long, t string").select("key", documents.document_of(F.col("t")).alias("r"))
    got = {r.key: r.r for r in rows.collect()}
    assert got[0].variant == "faithful" and got[0]["global"].contrast == 0 and got[0].geometry.crop is None and got[0].evidence == []
    assert got[1].geometry.crop.right == 0.5 and got[1].geometry.crop.bottom == 1.0 and got[1].color.hsl == [{"hue": "red"}]
    assert got[2] is None and got[3] is None and got[4] is None and got[5] is None and got[6]["global"].contrast == 0
    again = {r.key: r.r for r in rows.where("r IS NOT NULL").select("key", documents.document_of(documents.document_text(F.col("r"))).alias("r")).collect()}
    assert again == {k: v for k, v in got.items() if v is not None}
    assert '"keeps":0.5' in rows.where("key = 1").select(documents.document_text(F.col("r"))).first()[0]
