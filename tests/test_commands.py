"""Commands over small stored runs, and the driver's moves of files."""

import pytest
from pyspark.sql import functions as F

from vellumine import commands


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("run") / "run")
    rows = [(1, "a", "TOP", 90, "fine & light", ["crop"], "g", "/r/x/a.jpg"), (2, "b", "WEAK", 20, "soft", [], "h", "/r/y/a.jpg"), (3, "c", "TOP", 80, "a <b>", [], "", "/elsewhere/c.jpg")]
    spark.createDataFrame(rows, "key long, filename string, category string, final_score long, reason string, steps array<string>, group_id string, source string").withColumn("asset_id", F.col("filename")).write.parquet(path)
    return path


def test_reports(spark, run, tmp_path):
    assert [r.filename for r in commands.report(spark, run, str(tmp_path / "pages"), "50").collect()] == ["a", "c"]
    text = "".join(r.value for r in spark.read.text(str(tmp_path / "pages")).collect())
    assert "fine &amp; light" in text and "a &lt;b&gt;" in text and "soft" not in text
    assert {r.category: (r.n, r.mean_score) for r in commands.summary(spark, run).collect()} == {"TOP": (2, 85.0), "WEAK": (1, 20.0)}
    assert commands.export(spark, run, str(tmp_path / "csv")).count() == 2


def test_labels_and_ratings(spark, run, tmp_path):
    (tmp_path / "labels.csv").write_text("filename,human_pile,human_score,human_rank\na,top,,\nb,good,,\n")
    assert sorted((r.pile, r.said, r.n) for r in commands.bench_quality(spark, run, str(tmp_path / "labels.csv")).collect()) == [("good", "weak", 1), ("top", "top", 1)]
    (tmp_path / "scored.csv").write_text("filename,human_pile,human_score,human_rank\na,top,9,\nb,weak,1,\nc,good,5,\n")
    figures = commands.bench_figures(spark, run, str(tmp_path / "scored.csv")).first()
    assert (figures.n, figures.scored, figures.rho) == (3, 3, 1.0) and figures.agreed <= figures.best_hits == 3
    assert {r.human: (r.top, r.good, r.weak) for r in commands.bench_confusion(spark, run, str(tmp_path / "scored.csv")).collect()}["weak"] == (0, 0, 1)
    swept = commands.bench_sweep(spark, run, str(tmp_path / "scored.csv"))
    assert swept.first().hits == 3 and swept.where("hits > 3").isEmpty()
    spark.createDataFrame([(1, '<rdf:Description a="1"/>')], "key long, document string").write.parquet(str(tmp_path / "side"))
    got = {r.key: r for r in commands.apply_ratings(spark, run, str(tmp_path / "side"), str(tmp_path / "out")).collect()}
    assert got[1].exists and 'xmp:Rating="5"' in got[1].document and not got[2].exists


def test_logs(spark, tmp_path):
    log = str(tmp_path / "log")
    commands.record(spark, log, "pairwise_keep", "a", "b", "street", "x")
    facts = commands.record(spark, log, "restored_from_quarantine", "a", "c").first()
    assert (facts.decisions, facts.pairs, facts.corrections, facts.genres) == (2, 2, 1, 1)
    assert [r.item for r in commands.learned(spark, log).collect()][0] == "a"
    commands.override(spark, str(tmp_path / "o"), "a", "trash", "2024-01-01")
    assert [(r.asset_id, r.route_class) for r in commands.override(spark, str(tmp_path / "o"), "a", "flagship", "2024-02-01").collect()] == [("a", "flagship")]
    assert commands.profiles(spark, "stock-first").count() == 12 + 5
    assert commands.main([]) == 2


def test_moves(spark, run, tmp_path):
    planned = commands.quarantine_plan(spark, run, "/r", "/q").collect()
    assert sorted((r.source, r.destination) for r in planned) == [("/r/x/a.jpg", "/q/x/a.jpg"), ("/r/y/a.jpg", "/q/y/a.jpg")]
    for name in "abc":
        (tmp_path / name).write_text(name)
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "b").write_text("taken")
    ops = spark.createDataFrame([(1, 0, f"{tmp_path}/a", f"{tmp_path}/q/a"), (1, 1, f"{tmp_path}/b", f"{tmp_path}/q/b"), (1, 2, f"{tmp_path}/c", f"{tmp_path}/q/c"), (2, 0, f"{tmp_path}/c", f"{tmp_path}/q/d")], "group_id long, seq long, source string, destination string")
    assert {r[2] for r in commands.carry_out(ops)} == {"planned"} and (tmp_path / "a").exists()
    assert [r[2] for r in commands.carry_out(ops, dry_run=False)] == ["rolled back", "failed", "skipped", "moved"]
    assert (tmp_path / "a").read_text() == "a" and (tmp_path / "q" / "d").read_text() == "c" and (tmp_path / "q" / "b").read_text() == "taken"


def test_two_runs(spark, tmp_path):
    for name, rows in (("x", [("a", "trash"), ("b", "review")]), ("y", [("a", "review"), ("b", "review"), ("c", "trash")])):
        spark.createDataFrame(rows, "filename string, route_class string").write.parquet(str(tmp_path / name))
    assert sorted((r.filename, r.was, r.now) for r in commands.compare(spark, str(tmp_path / "x"), str(tmp_path / "y")).collect()) == [("a", "trash", "review"), ("c", None, "trash")]
