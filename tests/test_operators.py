"""Operators against small brute-force versions and named edge cases."""

import json
import math
import random

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from vellumine import params
from vellumine.functions import numbers, text, vectors
from vellumine.operators import agreement, clips, curation, graph, history, kernels, ranking, selection
from vellumine.sources import readers, sinks
from vellumine.streaming import logs


def test_hamming_of_texts(spark):
    df = spark.createDataFrame([("ffff", "fff0", 4), ("", "ab", 64), ("zzzz", "zzzz", 64), ("8000000000000000", "0000000000000000", 1), ("ab", "abc", 64)], "a string, b string, want long")
    assert df.where(vectors.hamming_hex(F.col("a"), F.col("b")) != F.col("want")).isEmpty()


def test_hamming_join_is_exact(spark):
    random.seed(3)
    codes = [random.getrandbits(64) for _ in range(40)]
    codes += [c ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 10))) for c in codes * 3]
    signed = [c - (1 << 64) if c >= 1 << 63 else c for c in codes]
    got = graph.hamming_pairs(spark.createDataFrame(list(enumerate(signed)), "k long, c long"), "k", "c", 8).collect()
    want = {(i, j, (a ^ b).bit_count()) for i, a in enumerate(codes) for j, b in enumerate(codes) if i < j and (a ^ b).bit_count() <= 8}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (205, 203)]
    random.seed(1)
    random.shuffle(edges)
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100 and got[205] == 203


def test_groups_cover_and_overlap(spark):
    for n in (1, 5, 12, 13, 21, 22, 100):
        df = spark.range(n).select(F.col("id").alias("position"))
        groups = {}
        for g, p in ranking.ranking_groups(df, "position", n).select("group_id", "position").collect():
            groups.setdefault(g, set()).add(p)
        assert set().union(*groups.values()) == set(range(n)) and all(len(v) <= 13 for v in groups.values())
        assert all(len(groups[g] & groups[g + 1]) >= 3 for g in range(len(groups) - 1))


def test_strengths_recover_the_order_and_stay_finite(spark):
    wins = [(f"i{a:02d}", f"i{b:02d}", 1) for a in range(12) for b in range(a + 1, 12)]
    df = spark.createDataFrame(wins, "winner string, loser string, n long")
    big = dict(ranking.bradley_terry(df, iterations=10).collect())
    small = {r.item: r.strength for r in ranking.bradley_terry_small(df.withColumn("axis", F.lit("a")), "axis", iterations=10).collect()}
    assert sorted(big, key=big.get, reverse=True) == [f"i{a:02d}" for a in range(12)]
    assert all(abs(big[k] - small[k]) < 1e-9 for k in big) and abs(np.mean(list(big.values())) - 1) < 1e-9
    table = dict(ranking.bradley_terry(df, iterations=3, most_at_driver=0).collect())
    three = dict(ranking.bradley_terry(df, iterations=3).collect())
    assert all(abs(table[k] - three[k]) < 1e-9 for k in three)
    # Two axes apart, edges of both directions, loops and nothing.
    axes = df.withColumn("axis", F.lit("a")).union(spark.createDataFrame([("x", "y", 2, "b"), ("y", "x", 1, "b"), ("x", "x", 9, "b")], "winner string, loser string, n long, axis string"))
    both = {(r.axis, r.item): r.strength for r in ranking.bradley_terry(axes, ["axis"], iterations=3).collect()}
    again = {(r.axis, r.item): r.strength for r in ranking.bradley_terry(axes, ["axis"], iterations=3, most_at_driver=0).collect()}
    assert both.keys() == again.keys() and all(abs(both[k] - again[k]) < 1e-9 for k in both) and both["b", "x"] > both["b", "y"]
    assert all(abs(both["a", k] - three[k]) < 1e-9 for k in three) and ranking.bradley_terry(df.limit(0)).isEmpty()


def test_strengths_by_blocks_take_no_items_to_the_driver(spark, monkeypatch):
    rows = [(a, b, 1 + (a * b) % 3, axis) for axis in "xy" for a in range(14) for b in range(14) if (a * 7 + b * 5 + ord(axis)) % 4 == 0 or (a, b) == (0, 1)]
    df = spark.createDataFrame(rows, "winner long, loser long, n long, axis string").where("winner <> loser")
    want = {(r.axis, r.item): r.strength for r in ranking.bradley_terry_small(df, "axis", iterations=4).collect()}

    def refused(*_):
        raise AssertionError("a table of items at the driver")

    monkeypatch.setattr(type(df), "toPandas", refused)
    got = ranking.bradley_terry(df, ["axis"], iterations=4)
    cut = ranking.bradley_terry(df, ["axis"], iterations=4, edges_a_block=5)
    for out in (got, cut):
        out = {(r.axis, r.item): r.strength for r in out.collect()}
        assert out.keys() == want.keys() and all(abs(out[k] - want[k]) < 1e-12 for k in want)


def test_skylines_work_their_rows_out_once(spark):
    rows = [(g, k, (k * 7 + g * 3) % 5, (k * 11 + g) % 4) for g in range(9) for k in range(4)] + [(None, 0, 1, 1), (None, 1, 2, 2), (3, 9, None, 9), (3, None, 9, 9), (4, 8, 9, 9)]
    df = spark.createDataFrame(rows, "g long, k long, a long, b long")
    beats = lambda y, x: None not in (*x, *y) and x[0] == y[0] and x[1] != y[1] and y[2] >= x[2] and y[3] >= x[3] and (y[2] > x[2] or y[3] > x[3])
    got = selection.skyline(df, "g", "k", ["a", "b"])
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(x) for x in rows if not any(beats(y, x) for y in rows))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def slow_scale(entries):
    """One axis of stored replies as percentiles, by loops: first reply of a name, wins within what is left of each group, sixty steps."""
    first = {}
    for name, _, members, rank in sorted(entries, key=lambda e: e[1]):
        first.setdefault(name, (tuple(members), rank))
    wins = Counter((a, b) for a, (ga, ra) in first.items() for b, (gb, rb) in first.items() if ga == gb and ra is not None and rb is not None and ra < rb)
    items = {x for pair in wins for x in pair}
    s = dict.fromkeys(items, 1.0)
    for _ in range(60):
        new = {i: (sum(n for (a, _), n in wins.items() if a == i) + 0.5) / (0.5 + sum(n / (s[a] + s[b]) for (a, b), n in wins.items() if i in (a, b))) for i in items}
        mean = sum(new.values()) / len(new) if new else 1
        s = {k: v / mean for k, v in new.items()}
    order = sorted(s, key=lambda k: (-round(s[k], 9), k))
    out = {k: 100 if len(order) == 1 else round(100 * (len(order) - 1 - i) / (len(order) - 1)) for i, k in enumerate(order)}
    for name, (members, rank) in first.items():
        if name not in out:
            out[name] = None if rank is None else 100 if len(members) < 2 else max(0, min(100, round(100 * (len(members) - rank) / (len(members) - 1))))
    return out


def test_replies_of_overlapping_groups_make_one_scale(spark):
    """Gaps, equal ranks, repeated replies, a group of one, and a group that overlaps left alone."""
    rows, names = [], [f"n{i:02d}" for i in range(16)]
    for at, members in enumerate((names[:6], names[4:10], names[8:14], ["n14"], names[12:16])):
        rows += [(m, at, members, None if (i + at) % 5 == 4 else 1 + (i * 7 + at) % len(members), 1 + i // 2) for i, m in enumerate(members)]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "name string, at long, members array<string>, a long, b long")
    got = {r.name: (r.a, r.b) for r in ranking.stitched(df, ["a", "b"]).collect()}
    a, b = slow_scale([(r[0], r[1], r[2], r[3]) for r in rows]), slow_scale([(r[0], r[1], r[2], r[4]) for r in rows])
    assert got == {n: (a[n], b[n]) for n in names}
    assert ranking.stitched(df.limit(0), ["a", "b"]).isEmpty()


def test_near_permutations_are_repaired(spark):
    values = [1, 2, 3, 4, 4, 5, 6, 7, 8, 9, 10, 12]
    got = ranking.repair_ranks(spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "group_id long, place long, rank long")).orderBy("place").collect()
    assert [r.repaired for r in got] == list(range(1, 13)) and all(r.was_repaired for r in got)
    bad = ranking.repair_ranks(spark.createDataFrame([(0, i, 1) for i in range(6)], "group_id long, place long, rank long")).collect()
    assert not any(r.is_valid for r in bad)


def test_degenerate_correlation(spark):
    df = spark.createDataFrame([(1, 2), (1, 3)], "x long, y long")
    assert ranking.spearman(df, "x", "y").first().rho == 0.0
    assert ranking.spearman(df.limit(0), "x", "y").first().rho == 0.0


def test_blend_drops_what_is_missing(spark):
    df = spark.createDataFrame([(80, None), (80, 40), (None, None)], "a long, b long")
    got = [r[0] for r in df.select(curation.blend({"a": F.col("a"), "b": F.col("b")}, {"a": 0.5, "b": 0.5})).collect()]
    assert got == [80, 60, 0]


def test_sweep_keeps_thresholds_unless_better(spark):
    pairs = [("top", s) for s in (72, 75, 78, 80)] + [("good", s) for s in (50, 55, 60)] + [("weak", s) for s in (20, 25, 30)]
    got = agreement.agreement(spark.createDataFrame(pairs, "pile string, score long")).first()
    assert got.best_hits == 10 and got.agreed == 6 and got.best_top < 85
    assert agreement.agreement(spark.createDataFrame([], "pile string, score long")).first().best_top == 85


def test_diverse_selection(spark):
    rows = [(i, 90.0, "g", [1.0, 0.0]) for i in range(20)] + [(50, 50.0, "h", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "key long, relevance double, genre string, vector array<double>")
    assert [r.key for r in selection.select_diverse(df, 2, 0.5).orderBy("pick").collect()] == [0, 50]
    assert selection.select_diverse(df, 0).isEmpty() and selection.select_diverse(df.limit(0), 3).isEmpty()
    assert selection.select_diverse(df, 10, 0.9, 3).where("key < 20").count() == 3


def test_diverse_selection_looks_at_all_rows(spark):
    """More near copies than any pool, and a row of another look far below them; then any look-ahead against plain rounds."""
    n = 5200
    df = spark.range(n).selectExpr("id AS key", "100D AS relevance", "'g' AS genre", "array(1D, 0D) AS vector").union(spark.sql("SELECT 9000L, 50D, 'g', array(0D, 1D)"))
    assert [r.key for r in selection.select_diverse(df, 2, 0.5).orderBy("pick").collect()] == [0, 9000]

    random.seed(2)
    rows = [(k, float(random.randint(0, 100)), random.choice("abc"), [random.gauss(1, 1) for _ in range(4)]) for k in range(300)]
    worst, left, used, want = {r[0]: 0.0 for r in rows}, list(rows), {}, []
    while left and len(want) < 25:
        k, _, g, v = max((r for r in left if used.get(r[2], 0) < 10), key=lambda r: (0.65 * (r[1] / 100) - 0.35 * worst[r[0]], -r[0]), default=[None] * 4)
        if k is None:
            break
        want.append(k)
        used[g] = used.get(g, 0) + 1
        left = [r for r in left if r[0] != k]
        for r in left:
            cos = sum(a * b for a, b in zip(r[3], v, strict=True)) / math.sqrt(sum(a * a for a in r[3]) * sum(b * b for b in v))
            worst[r[0]] = max(worst[r[0]], round(min(1, max(0, min(1, (cos - 0.55) / 0.45)) + 0.12 * (r[2] == g)), 4))
    df = spark.createDataFrame(rows, "key long, relevance double, genre string, vector array<double>").repartition(3)
    for ahead in (1, 8, 64, 1000):
        assert [r.key for r in selection.select_diverse(df, 25, 0.65, 10, ahead).orderBy("pick").collect()] == want


def test_monitor_of_nothing(spark):
    empty = spark.createDataFrame([], "at long, predicted string, actual string, confidence double, in_distribution boolean")
    got = history.alarms(empty, "at").first()
    assert (got.rate, got.n, got.drift, got.gap, got.automation) == (0.0, 0, 0.0, 0.0, True)


def test_repetitions(spark):
    df = spark.createDataFrame([(1.4, 1), (1.5, 2), (2.5, 2), (0.0, 1)], "w double, want long")
    assert df.where(history.repetitions(F.col("w")) != F.col("want")).isEmpty()


def test_texts(spark):
    df = spark.createDataFrame([("a password=abc123 sk-abcdefghijklmnop1 https://u:p@h/ ghp_abcdefghij0123456789 sk-short",)], "t string")
    assert df.select(text.redact(F.col("t"))).first()[0] == "a [REDACTED] [REDACTED] [REDACTED]h/ [REDACTED] sk-short"
    got = df.select(numbers.parse_ratio(F.lit("30000/1001")), numbers.parse_ratio(F.lit("1/0")), numbers.parse_ratio(F.lit("x"))).first()
    assert tuple(got) == (29.97, 0.0, 0.0)


def test_kernels_against_loops(spark):
    rng = np.random.default_rng(5)
    img = rng.integers(0, 256, (12, 9)).astype(float)
    lap = [img[y - 1, x] + img[y + 1, x] + img[y, x - 1] + img[y, x + 1] - 4 * img[y, x] for y in range(1, 11) for x in range(1, 8)]
    assert abs(kernels.sharpness(img[None])[0] - np.var(lap)) < 1e-6
    df = spark.createDataFrame([(1, 12, 9, img.ravel().tolist()), (2, 3, 3, None), (3, 4, 4, [1.0])], "key long, height int, width int, pixels array<double>")
    got = {r.key: r for r in kernels.measure(df).collect()}
    assert abs(got[1].sharpness - np.var(lap)) < 1e-5 and got[2].sharpness is None and got[3].quality is None
    assert kernels.phase_shift(np.roll(img, (2, -1), (0, 1))[None], img[None]).tolist() == [[2, -1]]
    assert kernels.blur_ratio(img[None])[0] > 1


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.RW2").write_bytes(b"1")
    (tmp_path / "a/x.xmp").write_text('<rdf:Description xmp:Rating="4" b="1"/>')
    (tmp_path / "a/y.xmp").write_text("<xmp:Rating>0</xmp:Rating>")
    assert {(r.path.split("/")[-1], r.kind) for r in readers.media_files(spark, str(tmp_path)).collect()} == {("x.RW2", "photo"), ("x.xmp", "unsupported"), ("y.xmp", "unsupported")}
    assert [tuple(r) for r in readers.ratings(spark, str(tmp_path)).collect()] == [("x", 4)]
    (tmp_path / "labels.csv").write_text("filename,human_pile,human_score,human_rank\na,Top,,3\nb,,junk,\na,weak,5,\n")
    assert {(r.filename, r.pile, r.score) for r in readers.labels(spark, str(tmp_path / "labels.csv")).collect()} == {("a", "weak", 5.0)}
    (tmp_path / "log.json").write_text('{"k": 1, "z": 2}\nnot json\n{"k": 3}\n')
    assert sorted(r.k for r in readers.json_lines(spark, str(tmp_path / "log.json"), "k long").collect() if r.k) == [1, 3]
    df = spark.createDataFrame([(1, ["a", "b"], "TOP")], "k long, t array<string>, category string")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).first().t == "a; b"
    assert 'Rating="5"' in df.select(sinks.rating_sidecar(F.col("category"))).first()[0]
    merged = lambda text, pile: df.select(sinks.merged_rating(F.lit(text), F.lit(pile))).first()[0]
    assert merged('<rdf:Description xmlns:xmp="u" xmp:Rating = "1" b="2"/><rdf:Description xmp:Rating="4"/>', "NEEDS_DECISION") == '<rdf:Description xmp:Label="Purple" xmlns:xmp="u" xmp:Rating="3" b="2"/><rdf:Description xmp:Rating="4"/>'
    assert merged('<rdf:Description b="$2"/>', "top") == '<rdf:Description xmp:Label="Yellow" xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmp:Rating="5" b="$2"/>'


def test_override_stream_keeps_the_last(spark, tmp_path):
    log, out = tmp_path / "log", str(tmp_path / "out")
    log.mkdir()
    (log / "1.json").write_text('{"asset_id": "a", "route_class": "trash", "decided_at": "2024-01-01"}\n{"asset_id": "b", "route_class": "review", "decided_at": "2024-01-01"}\n')
    schema = "asset_id string, route_class string, decided_at string"
    logs.latest_overrides(logs.log_stream(spark, str(log), schema), out, str(tmp_path / "cp")).awaitTermination()
    (log / "2.json").write_text('{"asset_id": "a", "route_class": "flagship", "decided_at": "2024-02-01"}\n')
    logs.latest_overrides(logs.log_stream(spark, str(log), schema), out, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(f"{out}/version=1").count() == 1
    logs.compact_overrides(spark, out)
    assert {(r.asset_id, r.route_class) for r in logs.current_overrides(spark, out).collect()} == {("a", "flagship"), ("b", "review")}


def test_profiles():
    assert abs(sum(params.PROFILES["stock-first"].parts.values()) - 1) < 1e-12
    assert params.PROFILES["default-video"].limits["stock_strong"] == 64.0 and params.PROFILES["default-video"].limits["diversity_lambda"] == 0.65
    assert params.fingerprint(params.chosen("stock-first")) == "stock-first@0.1.0-provisional+default-video@0.1.0-provisional"
    assert params.chosen("default-video") == params.chosen(None) == params.chosen("nobody")


def test_render_curves():
    x = np.linspace(0, 1, 101)
    for curve in (kernels.highlights, kernels.shadows, kernels.contrast):
        assert np.allclose(curve(x, 0), x) and (np.diff(curve(x, 40)) >= -1e-9).all() and curve(x, -60).min() >= 0 and curve(x, 60).max() <= 1
    assert kernels.shadows(x, 50)[10] > x[10] and kernels.shadows(x, 50)[60] == x[60] and kernels.highlights(x, -50)[90] < x[90]
    rgb = np.full((4, 4, 3), 100.0)
    assert np.allclose(kernels.exposure(rgb, 0), rgb) and (kernels.exposure(rgb, 1) > rgb).all()
    assert np.allclose(kernels.normalised(np.array([[3.0, 4.0], [0.0, 0.0]])), [[0.6, 0.8], [0.0, 0.0]])
    assert kernels.channel_percentiles(np.full((8, 8), 50.0), 100.0)["headroom"] == 1.0


def test_pictures():
    rng = np.random.default_rng(4)
    flat = np.full((1, 64, 64), 100.0)
    grain = flat + rng.normal(0, 5, flat.shape)
    assert kernels.noise(flat)[0] == 0 and 3 < kernels.noise(grain)[0] < 7 and kernels.noise(np.ones((2, 8, 8))).tolist() == [0, 0]
    slow = [np.median(np.floor(np.pad(grain[0], 1, mode="edge"))[i : i + 3, j : j + 3]) for i in range(64) for j in range(64)]
    assert np.allclose(kernels._median3(np.floor(grain))[0].ravel(), slow)
    lines = np.tile(rng.uniform(0, 255, 64), (64, 1))[None]
    share, angle = kernels.anisotropy(np.concatenate([lines, lines.transpose(0, 2, 1), flat]))
    assert share[0] > 0.9 and share[1] > 0.9 and share[2] == 0 and angle.tolist() == [0.0, 90.0, 0.0]


def test_burst_motion(spark):
    rng = np.random.default_rng(8)
    base = rng.uniform(0, 255, (32, 32))
    pan = [np.roll(base, (0, 3 * i), (0, 1)).ravel().tolist() for i in range(4)]
    still = [base.ravel().tolist()] * 3
    leaning = np.concatenate([base[:16], np.roll(base[16:], 2, axis=1)])
    df = spark.createDataFrame([(1, 0, 32, 32, pan), (1, 1, 32, 32, still), (2, 0, 32, 32, [base.ravel().tolist(), leaning.ravel().tolist()]), (3, 0, 32, 32, [still[0]]), (4, 0, 32, 32, None)], "clip int, burst int, height int, width int, frames array<array<double>>")
    pairs = kernels.burst_motion(df)
    worst = {r.clip: r for r in clips.combined_motion(clips.motion(pairs)).collect()}
    assert set(worst) == {1, 2} and (worst[1].pan, worst[1].jitter, worst[1].frozen, worst[1].movement) == (3.0, 0.0, 2, "pan or tilt") and worst[2].shear == 2.0


def test_file_operations(spark):
    from vellumine.operators import quarantine

    files = spark.createDataFrame([("g", "", "/in/a/x.jpg"), ("", "k", "/in/../etc/y"), ("", "", "/out/z")], "group_id string, asset_id string, source string")
    got = {r.source: (r.group_id, r.destination, r.refused) for r in quarantine.plan(files, "/in/", "/q").collect()}
    assert got == {"/in/a/x.jpg": ("g", "/q/a/x.jpg", False), "/in/../etc/y": ("k", None, True), "/out/z": ("/out/z", None, True)}
    ops = spark.createDataFrame([("g", "a", 1, "c"), ("g", "b", 1, "c"), ("h", "a", 1, "c")], "group_id string, source string, size long, checksum string")
    states = spark.createDataFrame([("a", 1, "c"), ("b", 2, "c")], "path string, size long, checksum string")
    assert {(r.group_id, r.source, r.ok) for r in quarantine.verified_groups(ops, states).collect()} == {("g", "a", False), ("g", "b", False), ("h", "a", True)}
    names = spark.createDataFrame([("/q/a.jpg", "1"), ("/q/a.jpg", "2"), ("/q/b", "3"), ("/q/b", "4")], "destination string, source string")
    assert [r.destination for r in quarantine.free_names(names).orderBy("source").collect()] == ["/q/a.jpg", "/q/a_1.jpg", "/q/b", "/q/b_1"]
    met = spark.createDataFrame([("1", "a.jpg"), ("2", "a.jpg"), ("3", "a_1.jpg"), ("4", "a.jpg"), ("5", "a_1.jpg")], "source string, destination string")
    assert [r.destination for r in quarantine.free_names(met).orderBy("source").collect()] == ["a.jpg", "a_3.jpg", "a_1.jpg", "a_2.jpg", "a_1_1.jpg"]
    seen = spark.createDataFrame([("a", ""), ("b", "keep")], "asset_id string, actual string")
    assert {tuple(r) for r in quarantine.resolved(seen, spark.createDataFrame([("a", "trash"), ("b", "trash")], "asset_id string, actual string")).collect()} == {("a", "trash"), ("b", "keep")}


def test_probe_facts(spark):
    from vellumine.operators import media

    good = '{"format": {"duration": "12.5"}, "streams": [{"codec_type": "audio"}, {"codec_type": "video", "width": 1080, "height": 1920, "r_frame_rate": "30000/1001"}]}'
    got = media.parse_probe(spark.createDataFrame([(1, good), (2, "{}"), (3, None), (4, "junk")], "k long, t string"), "t").orderBy("k").collect()
    assert (got[0].width, got[0].duration, got[0].frame_rate, got[0].orientation, got[0].corrupt) == (1080, 12.5, 29.97, "vertical", False)
    assert all(r.corrupt for r in got[1:])


def test_exported_documents(spark):
    from xml.etree import ElementTree

    from vellumine.operators import exports
    from vellumine.plans.catalogue import _recipes

    rows = _recipes(spark, "/root/testdata/sf0.001").limit(40).withColumn("variant", F.lit('a <"&"> b'))
    for r in rows.select(exports.metadata_packet().alias("p"), exports.preset("IMG").alias("s"), exports.profile().alias("f"), "exposure", "key").collect():
        packet = ElementTree.fromstring(r.p)[0][0].attrib
        assert float(packet["{http://ns.adobe.com/camera-raw-settings/1.0/}Exposure2012"]) == round(r.exposure, 2)
        assert ElementTree.fromstring(r.s)[0][0][0][0][0].text == 'IMG - a <"&"> b'
        assert f"Compensation={r.exposure:.2f}\n" in r.f and "[Rotation]\nDegree=" in r.f
    got = spark.range(1).select(exports.differences(F.lit('crs:A="1" crs:B="2" crs:B="3"'), F.lit('crs:B="3" crs:C="x" z:D="1"'))).first()[0]
    assert got == ["crs:A: 1 -> -", "crs:C: - -> x"]
    recipes = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1"), ("e", "1")], "asset_id string, checksum string")
    targets = spark.createDataFrame([("b", "# 1"), ("c", "hand")], "asset_id string, document string")
    now = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "2")], "asset_id string, checksum string")
    assert {tuple(r) for r in exports.apply_plan(recipes, targets, now).collect()} == {("a", "create"), ("b", "replace"), ("c", "overwrite"), ("d", "stale"), ("e", "missing_source")}


def test_bursts_over_ranges(spark):
    """A long stream cut into ranges numbers its bursts as one loop does; null streams and times, ties and repeated rows."""
    random.seed(6)
    base = 1_700_000_000
    rows, at = [], base
    for i in range(300):
        at += random.choice([0, 1, 1, 2, 5])
        rows.append(("a", at, i, random.choice([0, 0, 1, 255, -1])))
    rows += [("b", base, 1, 0), ("b", base + 1, 2, 0), ("b", base + 9, 3, 0), (None, base, 1, 0), (None, base + 1, 2, 0), ("c", None, 1, 0), ("c", base, 2, None), ("c", base + 1, 3, 0)]
    df = spark.createDataFrame(rows, "stream string, s long, key long, code long").withColumn("shot", F.timestamp_seconds("s"))
    got = {(r.stream, r.key): r.burst for r in graph.bursts(df.repartition(5), "stream", "shot", "key", "code").collect()}
    want = {}
    for stream in ("a", "b", "c", None):
        before, n = None, 0
        for _, s, key, code in sorted((r for r in rows if r[0] == stream), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            near = before is not None and None not in (s, code, *before) and s - before[0] <= 3 and bin((code ^ before[1]) & (2**64 - 1)).count("1") <= 8
            n += not near
            want[stream, key], before = n, (s, code)
    assert got == want and len(set(want.values())) > 20
    assert graph.bursts(df.limit(0), "stream", "shot", "key", "code").isEmpty()


def test_the_monitor_as_a_stream(spark, tmp_path):
    """After every batch the figures of the batch operators over all rows so far, across a restart; what is switched off stays off until it is asked for with enough checks."""
    random.seed(13)
    folder, out, files = tmp_path / "log", tmp_path / "out", []
    folder.mkdir()
    for k in range(5):
        rows = []
        for i in range(90):
            said = random.choice(["keep", "trash"])
            true = random.choice([said, said, said, None, ""]) if k < 2 else random.choice([said, "keep", "trash", None])
            rows.append({"model": "m", "at": 1000 * k + i, "predicted": said, "actual": true, "confidence": random.choice([0.5, 0.9, 1.0]) if k else 1.0, "in_distribution": random.random() < (0.9 if k < 3 else 0.4)})
        if k == 1:
            rows.append({"model": "m", "at": 0, "holdout_checks": 10})
        files.append(rows)
    files.append([{"model": "fresh", "at": 5, "predicted": "keep", "actual": None, "confidence": 0.5, "in_distribution": True}, {"model": "m", "at": 1, "holdout_checks": 9000}])
    wrote = lambda k: (folder / f"{k}.json").write_text("\n".join(map(json.dumps, files[k])))

    def run():
        figures = logs.monitored(logs.log_stream(spark, str(folder), logs.MONITORED, 1))
        store = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        figures.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    for k in range(2):
        wrote(k)
        run()
    for k in range(2, 6):
        wrote(k)
        run()
    found = spark.read.parquet(str(out)).where("model = 'm'").orderBy("batch").collect()
    assert len(found) == 6
    off = False
    for k, r in enumerate(found):
        rows = [x for f in files[: k + 1] for x in f if x["model"] == "m" and "holdout_checks" not in x]
        df = spark.createDataFrame([(x["at"], x["predicted"], x["actual"], x["confidence"], x["in_distribution"]) for x in rows], "at long, predicted string, actual string, confidence double, in_distribution boolean")
        want = history.alarms(df, "at").first()
        assert (r.rate, r.n, r.drift) == (want.rate, want.n, want.drift) and abs(r.gap - want.gap) < 1e-9
        off = off or not want.automation
        assert r.enabled == (not off) and bool(r.reason) == off
    assert off
    fresh = spark.read.parquet(str(out)).where("model = 'fresh'").first()
    assert fresh.enabled and (fresh.n, fresh.drift) == (0, 0.0)
