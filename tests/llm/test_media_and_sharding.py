"""MPEG audio columns and lookup-table sharding."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumine.llm import maglev, media_mpeg


def slow_crc(data: bytes) -> int:
    crc = 0xFFFF
    for byte in data:
        for bit in range(7, -1, -1):
            top = crc >> 15 ^ (byte >> bit & 1)
            crc = (crc << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return crc


@given(st.binary(max_size=6000))
@settings(max_examples=60, deadline=None)
def test_round_trip(data):
    blob = media_mpeg.encode(data)
    found = media_mpeg.parse(blob)
    assert media_mpeg.payload(blob, found) == data + bytes(-len(data) % 64 if data else 64)
    assert found["crc_bad"] == found["skipped"] == 0 and found["crc_ok"] == found["n_frames"] == found["vbr"]["frames"]
    assert found["samples"] == 1152 * found["n_frames"] and found["duration_ns"] == found["samples"] * 10**9 // 32000


@pytest.mark.parametrize("mark", [b"TAG", b"APETAGEX"])
def test_data_that_look_like_a_tag(mark):
    """At every place in the last frame, so also where a tag at the stream's end would begin."""
    for n in (64, 300, 1417, 3000):
        for at in range(max(0, n - 200), n - len(mark) + 1):
            data = b"x" * at + mark + b"y" * (n - at - len(mark))
            blob = media_mpeg.encode(data)
            found = media_mpeg.parse(blob)
            assert media_mpeg.payload(blob, found) == media_mpeg.padded(data) and found["audio_end"] == len(blob) and found["n_frames"] == found["vbr"]["frames"]


def test_checksums_are_those_of_the_format():
    blob = media_mpeg.encode(b"x" * 3000)
    found = media_mpeg.parse(blob)
    for at, h in zip(found["offsets"], found["facts"], strict=True):
        assert slow_crc(blob[at + 2 : at + 4] + blob[at + 6 : at + 6 + h[7]]) == struct.unpack(">H", blob[at + 4 : at + 6])[0]
    at = found["offsets"][1]
    broken = blob[: at + 10] + b"\x55" + blob[at + 11 :]
    assert media_mpeg.parse(broken)["crc_bad"] == 1 and media_mpeg.parse(broken)["n_frames"] == found["n_frames"]


def test_resynchronises_after_damage_and_skips_tags():
    blob = media_mpeg.encode(b"y" * 9000)
    found = media_mpeg.parse(blob)
    at = found["offsets"][2]
    noisy = blob[:at] + b"\xff\xfb\x00garbage\xff" * 3 + blob[at:] + b"TAG" + b"Title".ljust(30, b"\0") + bytes(95)
    again = media_mpeg.parse(noisy)
    assert again["n_frames"] == found["n_frames"] and again["skipped"] == 33 and again["resyncs"] == 1 and again["tags"]["v1_title"] == "Title"
    cut = blob[: found["offsets"][3]] + blob[found["offsets"][3] + 100 :]
    assert media_mpeg.parse(cut)["n_frames"] == found["n_frames"] - 1
    for junk in (b"", b"\xff", b"ID3", bytes(500), b"\xff\xfb" * 40):
        assert media_mpeg.parse(junk)["n_frames"] == 0


def test_headers_of_other_versions_and_layers():
    assert media_mpeg.header(b"\xff\xfb\x90\x00")[2:7] == (False, 128, 44100, 417, 1152)
    assert media_mpeg.header(b"\xff\xf3\x80\xc0")[2:7] == (False, 64, 22050, 208, 576)
    assert media_mpeg.header(b"\xff\xff\xc8\x00")[3:7] == (384, 32000, 576, 384)
    assert media_mpeg.header(b"\xff\xfb\x00\x00") is None and media_mpeg.header(b"\xff\xfb\xf0\x00") is None


def test_vbri_table():
    frame = bytearray(417)
    frame[36:40] = b"VBRI"
    frame[40:62] = struct.pack(">HHHIIHHHH", 1, 0, 75, 5000, 12, 3, 2, 2, 4)
    frame[62:68] = struct.pack(">HHH", 10, 20, 30)
    assert media_mpeg.vbr_table(bytes(frame), 32, False) == {"kind": "VBRI", "frames": 12, "bytes": 5000, "toc": [0, 20, 60, 120], "delay": 0, "padding": 0}


def test_columns_of_odd_rows(spark):
    rows = [(1, "é" * 5000), (2, ""), (3, None), (None, "a"), (1, "é" * 5000)]
    got = media_mpeg.features(media_mpeg.media_column(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert len(got) == 5
    for (key, text), r in zip(rows, got, strict=True):
        data = (text or "").encode()
        pad = data + bytes(-len(data) % 64 if data else 64)
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (key, len(data), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
    assert got[0].feature == got[4].feature and got[0].media_sha256 == got[4].media_sha256
    assert media_mpeg.features(media_mpeg.media_column(spark.createDataFrame([], "doc_id long, text string"))).isEmpty()


def slow_table(shards, size):
    order = [[(maglev._number(s, "offset") % size + j * (maglev._number(s, "stride") % (size - 1) + 1)) % size for j in range(size)] for s in shards]
    table, at = [None] * size, [0] * len(shards)
    while None in table:
        for i in range(len(shards)):
            while table[order[i][at[i]]] is not None:
                at[i] += 1
            table[order[i][at[i]]] = i
            if None not in table:
                break
    return table


def test_lookup_table():
    shards = [f"s{i}" for i in range(7)]
    table = maglev.lookup_table(shards, 211)
    assert table.tolist() == slow_table(shards, 211)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    fewer = maglev.lookup_table(shards, 211, {"s3": 0})
    kept = table != 3
    assert (fewer != 3).all() and (fewer[kept] == table[kept]).mean() > 0.7
    heavy = np.bincount(maglev.lookup_table(shards, 211, {"s1": 3}))
    assert heavy[1] > 2 * heavy[0]
    for bad in ((shards, 210, None), ([], 211, None), (["a", "a"], 211, None), (shards, 211, dict.fromkeys(shards, 0))):
        with pytest.raises(ValueError):
            maglev.lookup_table(*bad)


def test_placement(spark):
    rows = [(i % 50, f"t{i}", "old") for i in range(300)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = maglev.place(df, "doc_id", ["a", "b", "c"], 101)
    assert got.count() == 301 and sorted(got.columns) == ["doc_id", "shard", "shard_id", "slot", "text"]
    assert got.groupBy("doc_id").agg({"shard": "approx_count_distinct"}).where("`approx_count_distinct(shard)` > 1").isEmpty()
    assert maglev.place(df.limit(0), "doc_id", ["a"], 2).isEmpty()
