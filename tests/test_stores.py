"""Publication and the keyed store: killed writers, damaged files, readers beside writers, pruned buckets."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from vellumine.sources import keyed_store, publication


def test_publication(spark, tmp_path):
    root = f"file://{tmp_path}/p"
    assert publication.current(spark, root) is None
    with pytest.raises(ValueError, match="nothing"):
        publication.read(spark, root, "a")
    one = publication.stage(spark, root, {"a": spark.range(10), "b": spark.range(3)})
    assert publication.current(spark, root) is None and publication.problems(spark, root, one) == []
    publication.publish(spark, root, one, ("a", "b"))
    held = publication.read(spark, root, "a")
    assert held.count() == 10 and publication.current(spark, root) == one
    with pytest.raises(ValueError, match="c: missing"):
        publication.publish(spark, root, one, ("c",))
    two = publication.stage(spark, root, {"a": spark.range(20), "b": spark.range(0)})
    publication.publish(spark, root, two)
    assert publication.read(spark, root, "a").count() == 20 and publication.read(spark, root, "b").count() == 0
    assert held.count() == 10 and publication.read(spark, root, "a", one).count() == 10  # a reader holds on to its version
    assert publication.recover(spark, root) == [one] and publication.read(spark, root, "a").count() == 20


def test_killed_and_damaged_writers(spark, tmp_path):
    root = f"file://{tmp_path}/p"
    good = publication.stage(spark, root, {"a": spark.range(100)})
    publication.publish(spark, root, good)
    spark.range(5).write.parquet(f"{root}/versions/killed/a")  # its writer never came to the manifest
    with pytest.raises(ValueError, match="no manifest"):
        publication.publish(spark, root, "killed")
    bad = publication.stage(spark, root, {"a": spark.range(100).repartition(4), "b": spark.range(9)})
    for f in glob.glob(f"{tmp_path}/p/versions/{bad}/a/*.parquet")[:1]:
        os.remove(f)
    for f in glob.glob(f"{tmp_path}/p/versions/{bad}/b/*.parquet"):
        with open(f, "wb") as out:
            out.write(b"cut off")
    found = publication.problems(spark, root, bad)
    assert found[0] == "a: differs" and found[1].startswith("b: unreadable")
    with pytest.raises(ValueError, match="differs"):
        publication.publish(spark, root, bad)
    assert publication.current(spark, root) == good and publication.read(spark, root, "a").count() == 100
    (tmp_path / "p" / "CURRENT.left").write_text("half a pointer")
    assert sorted(publication.recover(spark, root)) == sorted(["killed", bad]) and not (tmp_path / "p" / "CURRENT.left").exists()
    assert publication.read(spark, root, "a").count() == 100


def upserts(spark, rows):
    return spark.createDataFrame(rows, "key long, at long, value string")


def test_store(spark, tmp_path):
    store = keyed_store.Store(spark, f"file://{tmp_path}/s", "key long, at long, value string", 8)
    asked = spark.createDataFrame([(1,), (2,), (2,), (9,), (None,)], "key long")
    look = lambda: sorted(((r.key, r.at, r.value, r.hit) for r in store.get(asked).collect()), key=str)
    assert look() == sorted([(1, None, None, False), (2, None, None, False), (2, None, None, False), (9, None, None, False), (None, None, None, False)], key=str)
    store.put(upserts(spark, [(1, 1, "a"), (2, 1, "b"), (2, 2, "c"), (3, 1, "d"), (2, 2, "bb"), (4, 1, "gone")]))
    want = sorted([(1, 1, "a", True), (2, 2, "c", True), (2, 2, "c", True), (9, None, None, False), (None, None, None, False)], key=str)
    assert look() == want
    state = store.state()
    beside = store.rows(state)
    store.put(upserts(spark, [(4, 2, None)]))
    store.compact()
    assert look() == want and beside.count() == 6  # a reader of before sees what it saw
    assert sorted(r.key for r in store.all().collect()) == [1, 2, 3]
    store.put(upserts(spark, [(1, 5, "new"), (3, 0, "older"), (4, 1, "older")]))
    assert sorted((r.key, r.value) for r in store.all().collect()) == [(1, "new"), (2, "c"), (3, "d")]
    again = keyed_store.Store(spark, store.root, store.schema)
    assert sorted((r.key, r.value) for r in again.all().collect()) == [(1, "new"), (2, "c"), (3, "d")]


def test_upserts_that_come_during_compaction(spark, tmp_path):
    store = keyed_store.Store(spark, f"file://{tmp_path}/s", "key long, at long, value string", 4)
    store.put(upserts(spark, [(1, 1, "a"), (2, 1, "b")]))
    late = store.state()["generation"]
    store.compact()
    upserts(spark, [(1, 2, "late")]).withColumn("bucket", store._bucket(4)).write.partitionBy("bucket").parquet(f"{store.root}/upserts/{late}/batch")
    spark.range(1).write.parquet(f"{store.root}/upserts/{late}/killed")
    os.remove(f"{tmp_path}/s/upserts/{late}/killed/_SUCCESS")  # a batch that was never finished
    want = [(1, "late"), (2, "b")]
    assert sorted((r.key, r.value) for r in store.all().collect()) == want
    store.compact()
    store.clean()
    assert sorted((r.key, r.value) for r in store.all().collect()) == want
    store.compact()
    store.clean()
    assert sorted((r.key, r.value) for r in store.all().collect()) == want and len(store.files.names("base")) == 1


def test_only_the_asked_buckets_are_read(spark, tmp_path):
    store = keyed_store.Store(spark, f"file://{tmp_path}/s", "key long, at long, value string", 16)
    store.put(spark.range(2000).select(F.col("id").alias("key"), F.lit(1).cast("long").alias("at"), F.lit("v").alias("value")))
    store.compact()
    found = store.get(spark.createDataFrame([(7,)], "key long"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert found.collect()[0].value == "v"
