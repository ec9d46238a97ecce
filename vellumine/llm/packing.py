"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Documents are cut only if they are longer than a sequence: all pieces but the first are full. What
is to be packed is then a histogram of at most `size` lengths. The packer works on that histogram,
whose size does not depend on the data: it fills a bin greedily with the longest pieces that fit, then
replaces the bin's smallest piece by the two unpacked pieces that fit the expanded gap more tightly,
and repeats this bin for as long as the lengths it needs last. Pieces find their place by their rank
among the pieces of their length, without being gathered anywhere.

Null and empty texts are a piece of the end identifier alone; repeated rows and keys are packed each
for itself; an empty table has no sequences.
"""

from __future__ import annotations

import json
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Coder, encode
from .common import checkpoint_dir, written

SIZE = 1024


@lru_cache(maxsize=2)
def json_encoding(path: str) -> Coder:
    """The byte-level BPE of a `tokenizers` JSON file as a coder with the same identifiers.

    Merges must stand in the order of their identifiers, so that both libraries merge alike. The file's added
    tokens are identifiers of their own where their string stands in a text, as that library has it.
    """
    import public_tokenizers

    with open(path) as f:
        whole = json.load(f)
    model, added = whole["model"], whole.get("added_tokens") or []
    if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that take neighbours along aren't supported")
    # The printable stand-ins of bytes in such files: printable Latin-1 bytes stand for themselves, others follow from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ids = [model["vocab"][m] for m in made]
    if ids != sorted(ids):
        raise ValueError("the merges are not in the order of their identifiers")
    known = set(made) | set(of)
    ranks = {bytes(of[c] for c in token): i for token, i in model["vocab"].items() if token in known}
    return Coder(ranks, public_tokenizers.PATTERN, {t["content"]: t["id"] for t in added})


PIECES = "piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, PIECES): each document's pieces. `nth` numbers the pieces of one length in one partition `part`."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = json_encoding(tokenizer), TaskContext.get().partitionId()
        seen = [0] * (size + 1)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for i, value in enumerate(batch.column(1)):
                ids = encode(value.as_py(), enc)
                ids.append(end_id)
                raw, start, n = memoryview(ids).cast("B"), 0, len(ids)
                length = (n - 1) % size + 1
                for piece in range((n + size - 1) // size):
                    for column, x in zip(out, (i, piece, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), seen[length]), strict=True):
                        column.append(x)
                    seen[length] += 1
                    start, length = start + length, size
            keys = batch.column(0).take(pa.array(out[0], pa.int64()))
            columns = [pa.array(c, t) for c, t in zip(out[1:5], (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([keys, *columns, pa.array([part] * len(keys), pa.int32()), pa.array(out[5], pa.int64())], ["k", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, f"k {kind}, {PIECES}").withColumnRenamed("k", key)


class _Lengths:
    """The lengths that are left, ascending, with their counts."""

    def __init__(self, counts: dict[int, int]):
        self.count = {n: c for n, c in counts.items() if c > 0}
        self.left = sorted(self.count)

    def most(self, room: int, taken: dict[int, int]) -> int:
        """The longest length of at most `room` of which one is left beside those taken; 0 if there is none."""
        at = bisect_right(self.left, room) - 1
        while at >= 0 and self.count[self.left[at]] <= taken.get(self.left[at], 0):
            at -= 1
        return self.left[at] if at >= 0 else 0

    def best_two(self, room: int, more_than: int, taken: dict[int, int]) -> tuple[int, int] | None:
        """Two lengths with the largest sum in (more_than, room]."""
        free = [n for n in self.left[: bisect_right(self.left, room)] if self.count[n] > taken.get(n, 0)]
        low, high, best, found = 0, len(free) - 1, more_than, None
        while low <= high:
            total = free[low] + free[high]
            if total > room:
                high -= 1
                continue
            if total > best and (low < high or self.count[free[low]] - taken.get(free[low], 0) >= 2):
                best, found = total, (free[high], free[low])
                if best == room:
                    break
            low += 1
        return found


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, list[int]]]:
    """Bins as (how many alike, their lengths, longest first) for a histogram of lengths from 1 to `size`."""
    if any(not 1 <= n <= size for n, c in counts.items() if c):
        raise ValueError(f"lengths must be from 1 to {size}")
    have, bins = _Lengths(counts), []
    while have.left:
        taken: dict[int, int] = {}
        room = size
        while room and (n := have.most(room, taken)):
            taken[n] = taken.get(n, 0) + 1
            room -= n
        if room and len(taken) + max(taken.values()) > 2:
            smallest = min(taken)
            rest = taken | {smallest: taken[smallest] - 1}
            if two := have.best_two(room + smallest, smallest, taken):
                for n in two:
                    rest[n] = rest.get(n, 0) + 1
                taken = {n: c for n, c in rest.items() if c}
        times = max(1, min(have.count[n] // c for n, c in taken.items()))
        bins.append((times, sorted((n for n, c in taken.items() for _ in range(c)), reverse=True)))
        for n, c in taken.items():
            have.count[n] -= c * times
            if not have.count[n]:
                have.left.remove(n)
    return bins


def places(bins: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """For each length in each kind of bin: the first rank it takes, the first bin, and the offsets within the bin."""
    used: dict[int, int] = {}
    rows, offsets, first_bin = [], [], 0
    for times, lengths in bins:
        at, by_length = 0, {}
        for n in lengths:
            by_length.setdefault(n, []).append(at)
            at += n
        for n, own in by_length.items():
            rows.append((n, used.get(n, 0), first_bin, len(own), len(offsets)))
            offsets.extend(own)
            used[n] = used.get(n, 0) + times * len(own)
        first_bin += times
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return {"length": table[:, 0], "rank": table[:, 1], "bin": table[:, 2], "many": table[:, 3], "at": table[:, 4], "offsets": np.array(offsets, dtype=np.int64)}


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    The pieces are written once, so that their ranks stay as they are when a task runs again.
    """
    cut = written(pieces(docs, tokenizer, end_id, size, key, text), f"{checkpoint_dir(docs.sparkSession)}/pieces")
    by_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r[0]: r[1] for r in cut.groupBy("length").agg(F.count("*")).collect()}  # at most `size` rows
    shared = docs.sparkSession.sparkContext.broadcast(places(plan(counts, size)))  # a few rows for each length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        # Ranks stay below 2**50; a row's place in the table is the last with its length and no larger rank.
        keys = p["length"].astype(np.uint64) << np.uint64(50) | p["rank"].astype(np.uint64)
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            row = np.searchsorted(keys, length.astype(np.uint64) << np.uint64(50) | rank.astype(np.uint64), side="right") - 1
            nth = rank - p["rank"][row]
            many = p["many"][row]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(p["bin"][row] + nth // many), pa.array(p["offsets"][p["at"][row] + nth % many])], ["k", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = dict(docs.dtypes)[key]
    ranked = cut.join(base, ["part", "length"]).select(F.col(key).alias("k"), "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(run, f"k {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("k", key)
