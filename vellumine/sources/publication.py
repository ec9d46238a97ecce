"""Tables published together: staged as a version, held against its manifest, and made visible by one pointer that is replaced at once.

Executors write the tables; the driver writes a manifest of a row a table and the pointer. A version without a manifest, or whose tables don't agree with it, is never made
visible, so a writer that is killed leaves the version before readable. Readers hold on to the version that they began with; old ones stay until `recover` removes them.
All goes through Hadoop's file systems, so that any store that renames at once will do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER, MANIFEST = "CURRENT", "manifest.json"


class Files:
    """A folder of any of Hadoop's file systems, seen from the driver."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self.path().getFileSystem(self.conf)

    def path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.path(name)):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Whole or not at all: written beside and renamed over what is there."""
        beside = f"{name}.{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(beside), True)
        stream.write(text.encode())
        stream.close()
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        array = self.jvm.java.lang.reflect.Array.newInstance(options.OVERWRITE.getClass(), 1)
        array[0] = options.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path().toUri(), self.conf).rename(self.path(beside), self.path(name), array)

    def names(self, folder: str = "") -> list[str]:
        if not self.fs.exists(self.path(folder)):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder)))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def _sums(df: DataFrame) -> dict:
    """The number of rows and the sum of their hashes, whatever their order."""
    row = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum")).first()
    return {"rows": row["rows"], "sum": row["sum"]}


def stage(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> str:
    """Write the tables as a new version and its manifest last; the version's name."""
    files, version = Files(spark, root), uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{files.root}/versions/{version}/{name}")
    sums = {name: _sums(spark.read.parquet(f"{files.root}/versions/{version}/{name}")) for name in tables}
    files.write(f"versions/{version}/{MANIFEST}", json.dumps(sums, sort_keys=True))
    return version


def problems(spark: SparkSession, root: str, version: str, required: tuple[str, ...] = ()) -> list[str]:
    """What speaks against a version: no manifest, tables that are required and absent, or that don't agree with it. Empty if it may be published."""
    files = Files(spark, root)
    text = files.read(f"versions/{version}/{MANIFEST}")
    if text is None:
        return ["no manifest"]
    out, manifest = [], json.loads(text)
    for name in sorted({*manifest, *required}):
        if name not in manifest or name not in files.names(f"versions/{version}"):
            out.append(f"{name}: missing")
            continue
        try:
            found = _sums(spark.read.parquet(f"{files.root}/versions/{version}/{name}"))
        except Exception as e:  # a file of it is cut off or gone
            out.append(f"{name}: unreadable ({type(e).__name__})")
            continue
        if found != manifest[name]:
            out.append(f"{name}: differs")
    return out


def publish(spark: SparkSession, root: str, version: str, required: tuple[str, ...] = ()) -> None:
    """Make a version the one that readers get, or raise and leave things as they are."""
    if found := problems(spark, root, version, required):
        raise ValueError(f"version {version} can't be published: {'; '.join(found)}")
    Files(spark, root).write(POINTER, version)


def current(spark: SparkSession, root: str) -> str | None:
    return Files(spark, root).read(POINTER)


def read(spark: SparkSession, root: str, name: str, version: str | None = None) -> DataFrame:
    """A table of the published version, or of another that the caller has held on to."""
    version = version or current(spark, root)
    if version is None:
        raise ValueError(f"nothing is published in {root}")
    return spark.read.parquet(f"{root.rstrip('/')}/versions/{version}/{name}")


def recover(spark: SparkSession, root: str, keep: tuple[str, ...] = ()) -> list[str]:
    """Remove half-made and superseded versions, but the published one and those to keep; what was removed."""
    files = Files(spark, root)
    held = {current(spark, root), *keep}
    gone = [v for v in files.names("versions") if v not in held]
    for version in gone:
        files.delete(f"versions/{version}")
    for name in files.names():
        if name.startswith(f"{POINTER}.") and not name.endswith(".crc"):
            files.delete(name)
    return gone
