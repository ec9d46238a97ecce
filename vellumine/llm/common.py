"""Shared pieces of the corpus operators: byte-level word kernels, batch slicing, shared-folder files.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. Both sets are ASCII, so working on
the UTF-8 bytes of an Arrow string column is exact for every text. Word and shingle identities are
64-bit hashes; two different words share one with a probability of about 2**-64.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Texts are handled in slices of about this many bytes, so that a worker's memory does not follow the batch size.
SLICE_BYTES = 1 << 20

U64 = np.uint64
_rng = np.random.default_rng(0x5EED)
_BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_LOWER_CODE = _BYTE_CODE.copy()
_LOWER_CODE[65:91] = _BYTE_CODE[97:123]
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of unsigned 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_pow_cache: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _pow_cache.get("b")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + (SLICE_BYTES >> 1))
        for key, base in (("b", _BASE), ("i", _BASE_INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _pow_cache[key] = np.multiply.accumulate(p)
    return _pow_cache["b"][:n], _pow_cache["i"]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n+1 offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) else column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(lengths: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes in all, or of one row."""
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if len(lengths) > start:
        yield start, len(lengths)


def text_slices(batches: Iterator[pa.RecordBatch], name: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch cut into slices of bounded size, with the text's bytes and offsets."""
    for batch in batches:
        raw, offsets = utf8(batch.column(batch.schema.get_field_index(name)))
        for a, b in slices(np.diff(offsets), most):
            yield batch.slice(a, b - a), raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


class Words:
    """The words of a slice of texts: byte spans, owning row, and 64-bit hashes (A-Z folded to a-z if asked). `gap` marks the bytes between words."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, fold: bool = True, gap: np.ndarray = IS_SPACE):
        n = len(raw)
        solid = np.zeros(n + 1, dtype=bool)
        np.logical_not(gap[raw], out=solid[:n])
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty(n + 1, dtype=bool)
        before[0] = False
        before[1:] = solid[:n]
        self.starts = np.flatnonzero(solid & (~before | edge))
        self.ends = np.flatnonzero(before & (~solid | edge))
        self.offsets, self.raw = offsets, raw
        self.bounds = np.searchsorted(self.starts, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))
        self.sums = prefix_sums(raw, _LOWER_CODE if fold else _BYTE_CODE)
        self.hash = span_hash(self.sums, self.starts, self.ends)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, owning row and first word of every window of k words within one text."""
        m = len(self.hash) - k + 1
        if m <= 0:
            return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = np.zeros(m, dtype=U64)
        for j in range(k):
            h = h * U64(0xD6E8FEB86659FD93) + self.hash[j : j + m]
        first = np.flatnonzero(self.row[:m] == self.row[k - 1 :])
        return mix64(h[first]), self.row[first], first


def prefix_sums(raw: np.ndarray, code: np.ndarray) -> np.ndarray:
    out = np.zeros(len(raw) + 1, dtype=U64)
    np.cumsum(code[raw] * _powers(len(raw))[0], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, inverse = _powers(max(len(sums), 1))
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64))


#: Where the folders made in the current context are listed, for the caller that asked for it with `folders`.
_listed: ContextVar[list[str] | None] = ContextVar("folders", default=None)


@contextmanager
def folders() -> Iterator[list[str]]:
    """A list of the folders that operators make while the block runs, in this thread alone, so that its caller can `sweep` them and no others."""
    made: list[str] = []
    before = _listed.set(made)
    try:
        yield made
    finally:
        _listed.reset(before)


def checkpoint_dir(spark: SparkSession) -> str:
    """A new folder in the shared place that the cluster names. A local one only where none is named and all runs on one machine, as in tests."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        current = sc._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = current.get() if current.isDefined() else "file:///tmp/vellumine-checkpoints"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/vellumine-{uuid.uuid4().hex}"
    if (made := _listed.get()) is not None:
        made.append(folder)
    return folder


def sweep(spark: SparkSession, made: list[str]) -> None:
    """Remove the listed folders, once what was made from them is written elsewhere."""
    while made:
        delete(spark, made.pop())


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder; later plans start from them."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again with their columns."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def local_path(uri: str) -> str | None:
    """The path of a folder that every executor mounts, or None for a remote store."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def put_bytes(uri: str, parts: list) -> None:
    """Write a file whole or not at all, under another name first: a task that runs again replaces its own earlier file, whose content is the same."""
    path = local_path(uri)
    if path is None:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(os.path.dirname(path), recursive=True)
        temporary = f"{path}.{uuid.uuid4().hex}"
        with store.open_output_stream(temporary) as out:
            for p in parts:
                out.write(memoryview(p).cast("B") if len(p) else b"")
        try:
            store.move(temporary, path)
        except OSError:  # some stores don't rename onto a file
            if store.get_file_info(path).type != fs.FileType.File:
                raise
            store.delete_file(temporary)
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "wb") as out:
        for p in parts:
            out.write(memoryview(p).cast("B") if len(p) else b"")
    os.replace(temporary, path)


def map_file(uri: str, dtype) -> np.ndarray:
    """A file of fixed-size records, memory-mapped. From a remote store it is copied once and the copy unlinked."""
    path = local_path(uri)
    if path is None:
        import tempfile

        from pyarrow import fs

        store, remote = fs.FileSystem.from_uri(uri)
        handle, path = tempfile.mkstemp()
        with store.open_input_stream(remote) as src, os.fdopen(handle, "wb") as out:
            while block := src.read(1 << 24):
                out.write(block)
        mapped = np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)
        os.unlink(path)
        return mapped
    return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)


def with_text_columns(df: DataFrame, fields: str, make, text: str = "text", keep: list[str] | None = None, most: int = SLICE_BYTES) -> DataFrame:
    """The `keep` columns (all by default) and new ones that `make(raw, offsets)` gives as Arrow arrays for a slice of texts.

    Columns of the new names are replaced. Rows are neither added nor lost, and nothing is shuffled.
    """
    from pyspark.sql.types import StructType, _parse_datatype_string

    added = _parse_datatype_string(f"struct<{fields}>") if ":" in fields else StructType.fromDDL(fields)
    kept = [f for f in df.schema.fields if f.name not in added.names and (keep is None or f.name in keep)]
    names = [f.name for f in kept]
    hidden = "\x00text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in text_slices(batches, hidden, most):
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), *make(raw, offsets)], [*names, *added.names])

    # A column of extra names may clash in letter case only; positions, not names, carry them through.
    return df.select(*names, df[text].alias(hidden)).mapInArrow(run, StructType([*kept, *added.fields]))


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of each row's values, rows being cut at the offsets."""
    total = np.zeros(len(values) + 1, dtype=np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (row, value): whether the same was met before, and whether it is there twice or more. Rows ascend."""
    later, twice = np.zeros(len(row), dtype=bool), np.zeros(len(row), dtype=bool)
    if len(row) < 2:
        return later, twice
    key = value ^ mix64(row.astype(U64) + U64(1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return later, twice


def delete(spark: SparkSession, uri: str) -> None:
    """Remove a folder of the shared place once what was made from it is written elsewhere."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def guarded(df: DataFrame, keep: list[str]):
    """The rows with all columns but those kept under names that can't clash, and a function that gives them back by name and order."""
    hidden = {c: f"__{i}" for i, c in enumerate(df.columns) if c not in keep}
    inside = df.select(*(df[c].alias(hidden[c]) if c in hidden else df[c] for c in df.columns))
    return inside, lambda out: out.select(*(out[hidden[c]].alias(c) if c in hidden else out[c] for c in df.columns))
