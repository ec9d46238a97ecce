"""Token counts by a separator scan over flat token files.

A flat token file is a run of fixed-width identifiers with an end-of-document identifier after each
document and no index. `scan` cuts each file into blocks at arbitrary places, finds the separators
of every block with one vectorised comparison, and stitches the blocks with a prefix scan over their
short summaries: a prefix sum of separator counts numbers the documents, a prefix maximum of the
last separator's place tells where a document open at a block's start began.

Blocks of a file meet in one window, which sees a row of integers for each block and none of its
tokens; files are bounded by their writer, so a window is too. Files without tokens have no rows.

Null and empty texts have 0 tokens; null and repeated keys, and repeated rows, are counted each for itself; an empty table gives
no rows. An identifier that doesn't fit the width, or is the separator, is an error.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import local_path

#: Tokens in a block.
BLOCK_TOKENS = 1 << 20
#: Keys in a row of the manifest.
KEYS_A_ROW = 4096


def list_files(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(file, n_tokens) of the flat files under a path. A size that isn't a multiple of the width is rounded down."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("file"), F.floor(F.col("length") / width).alias("n_tokens"))


def write_files(docs: DataFrame, folder: str, encoder: Callable[[], Callable[[str | None], np.ndarray]], eod: int, dtype: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write each partition's documents as one flat file; returns the manifest (file, n_tokens, first, keys).

    A row of the manifest has the keys of up to KEYS_A_ROW documents from number `first` on. A file is
    renamed into place when it is whole, so a partition that runs again replaces its file.
    `encoder()` is called once a task. Null and empty texts give a separator alone.
    """
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, keys, total = encoder(), [], 0
        uri = f"{folder}/part-{TaskContext.get().partitionId():06d}.bin"
        end = np.array([eod], dtype=dtype)
        path = local_path(uri)
        if path is None:
            from pyarrow import fs

            store, remote = fs.FileSystem.from_uri(uri)
            store.create_dir(os.path.dirname(remote), recursive=True)
            temporary = f"{remote}.{uuid.uuid4().hex}"
            out, place = store.open_output_stream(temporary), lambda: store.move(temporary, remote)
        else:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            temporary = f"{path}.{uuid.uuid4().hex}"
            out, place = open(temporary, "wb"), lambda: os.replace(temporary, path)
        with out:
            for batch in batches:
                keys.append(batch.column(0))
                for value in batch.column(1):
                    ids = np.asarray(encode(value.as_py()), dtype=np.int64)
                    if len(ids) and not (0 <= ids.min() and ids.max() <= np.iinfo(dtype).max):
                        raise ValueError(f"an identifier doesn't fit {dtype}")
                    if (ids == eod).any():
                        raise ValueError("a text has the separator among its identifiers")
                    ids = ids.astype(dtype)
                    out.write(ids.tobytes() + end.tobytes())
                    total += len(ids) + 1
        place()
        known = pa.chunked_array(keys).combine_chunks() if keys else None
        for first in range(0, len(known) if known is not None else 0, KEYS_A_ROW):
            own = known.slice(first, KEYS_A_ROW)
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([total], pa.int64()), pa.array([first], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)], ["file", "n_tokens", "first", "keys"])

    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, f"file string, n_tokens long, first long, keys array<{kind}>")


def _read(file: str, dtype: str, start: int, n: int) -> np.ndarray:
    path, width = local_path(file), np.dtype(dtype).itemsize
    if path is not None:
        with open(path, "rb") as f:
            f.seek(start * width)
            return np.frombuffer(f.read(n * width), dtype=dtype)
    from pyarrow import fs

    store, remote = fs.FileSystem.from_uri(file)
    with store.open_input_file(remote) as f:
        return np.frombuffer(f.read_at(n * width, start * width), dtype=dtype)


def scan(files: DataFrame, eod: int, dtype: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, doc_index, start_token, n_tokens, terminated) of every document in files given as (file, n_tokens).

    Counts leave out the separator. What follows a file's last separator is a document with
    terminated = false; files that end with a separator have none.
    """
    ranges = files.where("n_tokens > 0").select("file", F.col("n_tokens").alias("total"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / block_tokens))).alias("block"))

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                start = int(row.block) * block_tokens
                ids = _read(row.file, dtype, start, min(block_tokens, int(row.total) - start))
                places = np.flatnonzero(ids == eod) + start
                yield pd.DataFrame({"file": [row.file], "block": [row.block], "total": [row.total], "places": [places]})

    found = ranges.repartition(F.col("file"), F.col("block")).mapInPandas(find, "file string, block long, total long, places array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = (
        found.withColumn("n", F.size("places").cast("long"))
        .withColumn("last", F.when(F.col("n") > 0, F.element_at("places", -1)))
        .withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
        .withColumn("open", F.coalesce(F.max(F.col("last") + 1).over(before), F.lit(0).cast("long")))
        .withColumn("is_end", F.col("block") == F.floor((F.col("total") - 1) / block_tokens))
    )
    # The file's end closes a document that no separator closes.
    ends = F.when(F.col("is_end") & (F.coalesce(F.col("last") + 1, F.col("open")) < F.col("total")), F.concat("places", F.array("total"))).otherwise(F.col("places"))
    each = stitched.select("file", "base", "open", "total", ends.alias("ends")).select("file", "base", "open", "ends", "total", F.posexplode("ends").alias("i", "end"))
    begin = F.when(F.col("i") == 0, F.col("open")).otherwise(F.try_element_at("ends", F.greatest(F.col("i"), F.lit(1))) + 1)
    return each.select("file", (F.col("base") + F.col("i")).alias("doc_index"), begin.alias("start_token"), (F.col("end") - begin).alias("n_tokens"), (F.col("end") < F.col("total")).alias("terminated"))


def with_keys(found: DataFrame, manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents of `scan` with the keys that a manifest of `write_files` has for them."""
    keys = manifest.select("file", "first", F.posexplode("keys").alias("i", key)).select("file", (F.col("first") + F.col("i")).alias("doc_index"), key)
    # Both sides have a row for each document: neither may be broadcast, however small the planner takes it to be.
    return found.hint("merge").join(keys, ["file", "doc_index"])
