"""A store of values by key in buckets: upserts are appended, the latest of a key counts, and compaction folds them beside readers.

A generation is a folder of one base and the upserts appended to it, both partitioned by a bucket of the key's hash, so that keys that are asked for read their buckets alone. Compaction
writes the folded rows as the base of a new generation and replaces the pointer at once. It removes nothing, so that readers keep what they began with; the pointer names the batches that are
folded, and those that came meanwhile to an earlier generation still count. `clean` removes folded batches and old bases once no reader needs them. A null value stands for a removed key and is
kept, so that older upserts that come later don't bring the key back.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.sources.publication import POINTER, Files

BUCKETS = 64


class Store:
    """(key, at, value) rows under a root; `at` orders the upserts of a key, later ones of the same `at` by value."""

    def __init__(self, spark: SparkSession, root: str, schema: str, buckets: int = BUCKETS):
        self.spark, self.root, self.schema, self.files = spark, root.rstrip("/"), schema, Files(spark, root)
        if self.files.read(POINTER) is None:
            self.files.write(POINTER, json.dumps({"generation": uuid.uuid4().hex, "buckets": buckets, "base": None, "late": [], "folded": []}))

    def state(self) -> dict:
        return json.loads(self.files.read(POINTER))

    def put(self, rows: DataFrame) -> None:
        """Append upserts; a batch is visible as a whole once Spark's committer has moved its folder's files."""
        state = self.state()
        out = rows.select("key", "at", "value").withColumn("bucket", self._bucket(state["buckets"]))
        out.write.partitionBy("bucket").parquet(f"{self.root}/upserts/{state['generation']}/{uuid.uuid4().hex}")

    @staticmethod
    def _bucket(buckets: int):
        return F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")

    def _folders(self, state: dict) -> list[str]:
        found = [f"{self.root}/base/{state['base']}"] if state["base"] else []
        for generation in [*state["late"], state["generation"]]:
            folder = f"upserts/{generation}"
            found += [f"{self.root}/{folder}/{b}" for b in self.files.names(folder) if f"{folder}/{b}" not in state["folded"] and "_SUCCESS" in self.files.names(f"{folder}/{b}")]
        return found

    def rows(self, state: dict | None = None) -> DataFrame:
        """All rows, folded or not, with their bucket; each folder is a Parquet table partitioned by it."""
        out = self.spark.createDataFrame([], f"{self.schema}, bucket int")
        columns = out.columns
        for folder in self._folders(state or self.state()):
            out = out.unionByName(self.spark.read.schema(f"{self.schema}, bucket int").parquet(folder).select(*columns))
        return out

    @staticmethod
    def folded(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(F.max_by(F.struct("at", "value"), F.struct("at", "value")).alias("last")).select("key", "last.at", "last.value")

    def all(self) -> DataFrame:
        """(key, at, value): the latest of each key that isn't removed."""
        return self.folded(self.rows()).where("value IS NOT NULL")

    def get(self, asked: DataFrame) -> DataFrame:
        """The asked rows with `at`, `value` and `hit`; of the store only the buckets of the asked keys are read."""
        state = self.state()
        wanted = asked.select("key").distinct()
        buckets = [r[0] for r in wanted.select(self._bucket(state["buckets"]).alias("b")).distinct().collect()]  # as many as there are buckets, at most
        own = self.rows(state).where(F.col("bucket").isin(buckets)) if buckets else self.rows(state).limit(0)
        latest = self.folded(own.join(wanted, "key", "left_semi"))
        return asked.join(latest, "key", "left").withColumn("hit", F.col("value").isNotNull())

    def compact(self) -> None:
        """Fold what is there into a new base."""
        before = self.state()
        seen = [f.removeprefix(f"{self.root}/") for f in self._folders(before)]
        base = uuid.uuid4().hex
        out = self.folded(self.rows(before)).withColumn("bucket", self._bucket(before["buckets"]))
        out.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/base/{base}")
        after = before | {"generation": uuid.uuid4().hex, "base": base, "late": [*before["late"], before["generation"]], "folded": before["folded"] + [f for f in seen if f.startswith("upserts/")]}
        self.files.write(POINTER, json.dumps(after))

    def clean(self) -> None:
        """Remove folded batches and old bases; for when no reader holds on to them."""
        state = self.state()
        for folder in state["folded"]:
            self.files.delete(folder)
        for base in self.files.names("base"):
            if base != state["base"]:
                self.files.delete(f"base/{base}")
        late = [g for g in state["late"] if self.files.names(f"upserts/{g}")]
        self.files.write(POINTER, json.dumps(state | {"folded": [], "late": late}))
