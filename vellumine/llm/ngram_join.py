"""Exact Jaccard self-join of word-shingle sets with adaptive multi-match prefixes, and its components.

All sets are ordered alike, frequent shingles last and else by hash, and a set's prefix is what lies below one of five lines, its level. Of
two sets both show all that lies below the lower of their lines, so the shingles that they share there are
counted exactly, and each may leave out no more of its own than it can lack altogether: of sets of n and m
shingles, similar ones share o = t (n + m) / (1 + t), so a set that shows s of its n must find s - n + o of them in the other.
Longer prefixes thus ask for more matches. Each document picks the level for which the estimated cost is least: the
postings it will meet, plus the pairs that reach so many matches (by Markov's inequality no more than the
matches divided by those needed) times what a verification costs. A document of whose shingles too few are
in any other document's prefix can't be similar to any and takes no further part.

Groups of any size, without listing all pairs of a group:
- Equal sets are one class, by hash, and take part once for each task that reads them.
- Lists of up to SHORT classes give their pairs, which are counted. How many of its shown shingles lie in longer lists, or are known to be frequent,
  each class is told; so many fewer matches are asked of its pairs. Only a class that might be similar to another by such
  shingles alone is tied, along each of its long lists, to the list's least such class. The components of pairs and ties hold every pair that may be
  similar: sets that share a common passage and have enough text of their own are not tied.
- Each component's sets are put into bands of sizes, so that similar ones are in the same band or in neighbours, and each band is cut into blocks of
  bounded size; a tile of two blocks verifies all its pairs by one matrix product over their shared shingles and returns one row for each set, not for each pair.
- Components of the verified ties are the result.

The table of frequent shingles only serves estimates, and ties without a shuffle, so that it may hold the most frequent alone; it changes no result.
Words are lower-cased in A-Z only. Texts with fewer words than a shingle have one shingle, the whole; null and
blank texts have none and are linked with nothing. Repeated rows are members of one class. Ids are integers or null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, checkpoint_dir, checkpointed, guarded, mix64, row_sums, text_slices, written
from .components import components

WORDS, PERCENT = 5, 80
#: The lines of the levels: shares of the hashes of shingles that aren't known to be frequent, and of those that are.
LINES = [(1 / 3, 0.0), (2 / 3, 0.0), (1.0, 0.0), (1.0, 0.5), (1.0, 1.0)]
#: Estimated classes from which on a shingle counts as frequent.
FREQUENT = 8
#: Lists up to this long give pairs.
SHORT = 64
#: What is added to the level of a class that is tied along its long lists.
TIED = 8
#: Frequent shingles in the broadcast table, and bits of the broadcast id filter (16 MB), at most.
MOST_FREQUENT, MOST_BITS = 1 << 17, 1 << 27
#: A verification costs about this many postings.
VERIFY_COST = 4.0
BLOCK_SETS, BLOCK_SHINGLES = 256, 1 << 20
_COUNT_CHUNK = 1 << 21
#: Postings of one shingle that are looked at together.
RUN = 100_000


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a slice's texts, sorted within each text, and the cuts between texts."""
    words = Words(raw, offsets)
    h, row, _ = words.shingles(k)
    n_words = np.diff(words.bounds)
    few = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(few):
        whole = np.zeros(len(few), dtype=U64)
        for j in range(k - 1):
            has = n_words[few] > j
            whole[has] = whole[has] * U64(0xD6E8FEB86659FD93) + words.hash[words.bounds[few[has]] + j]
        h, row = np.concatenate([h, mix64(whole + n_words[few].astype(U64))]), np.concatenate([row, few])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(offsets)))


def classes(h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; equal sets have the same."""
    total = np.zeros(len(h) + 1, dtype=U64)
    np.cumsum(mix64(h), out=total[1:])
    return mix64(total[cuts[1:]] - total[cuts[:-1]] + np.diff(cuts).astype(U64) * U64(0x9E3779B97F4A7C15)).view(np.int64)


def frequent(docs: DataFrame, text: str = "text", k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, ascending, with estimates of how many classes have them.

    Tasks count the distinct sets of a few MB of text at a time and pass on what they met twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        size, met = 0, set()

        def counted():
            values, n = np.unique(np.concatenate(kept), return_counts=True)
            twice = n > 1
            return pa.RecordBatch.from_arrays([pa.array(values[twice].view(np.int64)), pa.array(n[twice])], ["token", "n"])

        for _, raw, offsets in text_slices(batches, "t"):
            h, cuts = shingle_sets(raw, offsets, k)
            for name, a, b in zip(classes(h, cuts).tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b > a and name not in met:
                    met.add(name)
                    kept.append(h[a:b])
                    size += b - a
            if size >= _COUNT_CHUNK:
                yield counted()
                kept, size, met = [], 0, set()
        if kept:
            yield counted()

    counts = docs.select(docs[text].alias("t")).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") > 3).orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).collect()
    table = sorted((r[0] & 0xFFFFFFFFFFFFFFFF, r[1]) for r in top)
    return np.array([t for t, _ in table], dtype=U64), np.array([n for _, n in table], dtype=np.int64)


def estimate(h: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many classes have each shingle, 0 for those that aren't frequent."""
    tokens, n = table
    if not len(tokens):
        return np.zeros(len(h), dtype=np.int64)
    at = np.minimum(np.searchsorted(tokens, h), len(tokens) - 1)
    return np.where(tokens[at] == h, n[at], 0)


def allowed(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """How many of its shingles a set may lack in any similar one."""
    return n - (percent * n + 99) // 100


def _below(h: np.ndarray, often: np.ndarray, line: int) -> np.ndarray:
    rare_share, often_share = LINES[line]
    bound = lambda share: U64(min((1 << 64) - 1, int(share * (1 << 64))))
    return np.where(often, (h <= bound(often_share)) & (often_share > 0), h <= bound(rare_share))


def prefixes(h: np.ndarray, cuts: np.ndarray, table: tuple[np.ndarray, np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each set its level (from 1) and how many shingles lie below each line; for each shingle whether it is shown, and whether it is frequent."""
    n = np.diff(cuts)
    row = np.repeat(np.arange(len(n)), n)
    df = estimate(h, table)
    often = df >= FREQUENT
    shows = [_below(h, often, i) for i in range(len(LINES))]
    below = np.stack([row_sums(x, cuts) for x in shows], axis=1)
    level, least = np.full(len(n), len(LINES)), np.full(len(n), np.inf)
    for i, x in enumerate(shows):
        met = row_sums(np.where(x, df, 0), cuts).astype(float)
        need = below[:, i] - allowed(n, percent)
        cost = np.where(need > 0, below[:, i] + met + VERIFY_COST * met / np.maximum(need, 1), np.inf)
        better = cost < least
        level[better], least[better] = i + 1, cost[better]
    return level, below, np.choose(level[row] - 1, shows) if len(h) else often, often


def matches_needed(n: np.ndarray, below: np.ndarray, other_n: np.ndarray, other_below: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """How many shingles below a line two similar sets share, given what each has below it."""
    overlap = -(-percent * (n + other_n) // (100 + percent))
    return np.maximum(1, np.maximum(below - n, other_below - other_n) + overlap)


def packed(below: np.ndarray, long_: np.ndarray) -> np.ndarray:
    """Two counts of up to 2**31 in one number: how many shingles are below a line, and how many of these lie in long lists."""
    return below | long_ << 32


def _lists(token: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of postings sorted by token and class: which to keep (each class once a list), and of these each list's start, its size, and whether it is long.

    A list of more than RUN postings is long however few classes it has, as it may be a piece of one.
    """
    new = np.ones(len(token), dtype=bool)
    new[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
    ends = np.append(np.flatnonzero(token[1:] != token[:-1]) + 1, len(token)) if len(token) else np.zeros(0, np.int64)
    rows = np.diff(np.append(0, ends))
    sizes = np.add.reduceat(new.astype(np.int64), ends - rows) if len(ends) else rows
    starts = np.cumsum(sizes) - sizes
    return new, np.repeat(starts, sizes), np.repeat(sizes, sizes), np.repeat((sizes > SHORT) | (rows > RUN), sizes)


def _pairs(token: np.ndarray, cls: np.ndarray, n: np.ndarray, level: np.ndarray, *below: np.ndarray) -> list[tuple]:
    """(a, b, need, n) for the pairs of short lists, and for ties of long ones with need 0. A level of TIED more marks classes to be tied."""
    new, start_of, size_of, long_ = _lists(token, cls)
    cls, n, level, token = cls[new], n[new], level[new], token[new]
    both = np.stack([b[new] for b in below], axis=1)
    below, common = both & 0xFFFFFFFF, both >> 32
    found = [_ties(token[long_], cls[long_], level[long_])]
    level = level % TIED
    for step in range(1, SHORT):
        i = np.flatnonzero((size_of > step) & ~long_)
        i = i[i + step < start_of[i] + size_of[i]]
        j = i + step
        small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        ok = 100 * small >= PERCENT * large
        if ok.any():
            i, j = i[ok], j[ok]
            line = np.minimum(level[i], level[j]) - 1
            need = matches_needed(n[i], below[i, line], n[j], below[j, line]) - np.minimum(common[i, line], common[j, line])
            found.append((cls[i], cls[j], np.maximum(1, need), np.ones(len(i), np.int64)))
    return found


def _ties(token: np.ndarray, cls: np.ndarray, level: np.ndarray) -> tuple:
    """(a, b, 0, 0) that ties each marked class of a list to the list's first marked one; rows are sorted by token."""
    own = level >= TIED
    token, cls = token[own], cls[own]
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
    head = np.repeat(cls[first], np.diff(np.append(first, len(token))))
    zero = np.zeros(len(cls), np.int64)
    return cls, head, zero, zero


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Batches sorted by their first column, cut so that its runs stay whole. A run of more than RUN rows comes in pieces, each after the first
    opened again by the run's first row; the flag tells so."""
    rest: list[np.ndarray] | None = None
    cut_run = False
    for batch in batches:
        now = [c.to_numpy() for c in batch.columns]
        now = [np.concatenate(x) for x in zip(rest, now, strict=True)] if rest is not None else now
        if not len(now[0]):
            rest = now
            continue
        first_of_last = int(np.searchsorted(now[0], now[0][-1]))
        if first_of_last > 0:
            yield [x[:first_of_last] for x in now], cut_run
            cut_run = False
        rest = [x[first_of_last:] for x in now]
        if len(rest[0]) > RUN:
            yield rest, cut_run
            rest, cut_run = [x[:1] for x in rest], True
    if rest is not None and len(rest[0]):
        yield rest, cut_run


def candidates(sets: DataFrame) -> DataFrame:
    """(a, b): pairs of classes with enough matches, and ties along long lists."""
    shown = sets.where("shown IS NOT NULL")
    postings = shown.select("cls", F.explode("shown").alias("token"))

    # Shingles that aren't known to be frequent lie between lines by their hash alone.
    edges = np.array([min((1 << 64) - 1, int(share * (1 << 64))) for share, _ in LINES[:3]], dtype=U64)

    def live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (token, cls), again in _whole_lists(batches):
            new, _, size_of, long_ = _lists(token, cls)
            token, cls = token[new], cls[new]
            long_ |= again & (token == token[0])
            name, at = np.unique(cls[(size_of > 1) | long_], return_inverse=True)
            line = np.searchsorted(edges, token.view(U64))[(size_of > 1) | long_]
            own = long_[(size_of > 1) | long_]
            counts = [np.bincount(at[own & (line == i)], minlength=len(name)) for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(np.bincount(at, minlength=len(name))), *(pa.array(c) for c in counts)], ["cls", "live", "l0", "l1", "l2"])

    # A long run's pieces name its first class once more; counts may be too high by that, never too low.
    sorted_ = postings.select("token", "cls").repartition("token").sortWithinPartitions("token", "cls")
    counted = sorted_.mapInArrow(live, "cls long, live long, l0 long, l1 long, l2 long").groupBy("cls").agg(*(F.sum(c).alias(c) for c in ("live", "l0", "l1", "l2")))
    facts = shown.groupBy("cls").agg(F.max("known").alias("known"), F.max("n").alias("n"), F.max(F.col("below")[0]).alias("s"))
    # A partner may show less than the set itself: what must be found is bounded by the lowest line.
    fit = facts.join(counted, "cls", "left").where(F.coalesce("live", F.lit(0)) + F.col("known") >= F.greatest(F.lit(1), F.col("s") - (F.col("n") - F.floor((PERCENT * F.col("n") + 99) / 100))))
    zero = F.lit(0).cast("long")
    alive = shown.join(fit.select("cls", *(F.coalesce(c, zero).alias(c) for c in ("l0", "l1", "l2"))), "cls")
    # For each line, how many of the shingles below it are long or frequent, and whether a similar set might share these alone.
    below = [F.col("below")[i] for i in range(len(LINES))]
    common = [F.col("l0"), F.col("l0") + F.col("l1"), *(F.col("l0") + F.col("l1") + F.col("l2") + more for more in (zero, below[3] - below[2], below[4] - below[2]))]
    allowed_ = F.col("n") - F.floor((PERCENT * F.col("n") + 99) / 100)
    tied = F.lit(False)
    for i in range(len(LINES)):
        tied = tied | ((F.col("level") > i) & (common[i] >= F.greatest(F.lit(1), below[i] - allowed_)))
    both = F.array(*(b.bitwiseOR(F.call_function("shiftleft", c, F.lit(32))) for b, c in zip(below, common, strict=True)))
    alive = checkpointed(alive.select("cls", "n", "shown", "frequent", both.alias("both"), (F.col("level") + F.when(tied, TIED).otherwise(0)).alias("level")))
    # Tokens known to be frequent: the least tied class of each, at most MOST_FREQUENT rows, meets the postings without a shuffle of them.
    often = alive.where(F.col("level") >= TIED).select("cls", F.explode("frequent").alias("token"))
    heads = F.broadcast(often.groupBy("token").agg(F.min("cls").alias("head")))
    ties = often.join(heads, "token").where("cls <> head").select(F.col("cls").alias("a"), F.col("head").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None  # of the run that may be cut: its token and the class that its marked classes are tied to
        for columns, again in _whole_lists(batches):
            first, last = columns[0][0], columns[0][-1]
            own = np.full(len(columns[0]), again) & (columns[0] == first)  # the rest of a cut run is long, however short
            found = _pairs(*(x[~own] for x in columns))
            if again:
                tied = columns[1][own & (columns[3] >= TIED)]
                head = head if head is not None and head[0] == first else (first, tied[0]) if len(tied) else None
                if head is not None:
                    found.append((tied, np.full(len(tied), head[1]), np.zeros(len(tied), np.int64), np.zeros(len(tied), np.int64)))
            if not (again and last == first):
                tied = columns[1][(columns[0] == last) & (columns[3] >= TIED)]
                head = (last, tied[0]) if len(tied) else None
            a, b, need, n = (np.concatenate(c) for c in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(need), pa.array(n)], ["a", "b", "need", "n"])

    rare = alive.select(F.explode("shown").alias("token"), "cls", "n", "level", *(F.col("both")[i].alias(f"b{i}") for i in range(len(LINES)))).repartition("token").sortWithinPartitions("token", "cls")
    met = rare.mapInArrow(run, "a long, b long, need long, n long").where("a <> b").groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("need").alias("need"), F.min("need").alias("tie"))
    # Matches in long lists and of frequent tokens aren't counted here; so many fewer are needed, and classes that need no others are tied.
    return met.where("tie = 0 OR n >= need").select("a", "b").union(ties).distinct()


def _bits_of(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(ids.astype(np.int64).view(U64)) & U64(bits - 1)).astype(np.int64)


def passes(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether a filter has a bit for each of the ids."""
    at = _bits_of(ids, 64 * len(words))
    return (words[at >> 6] >> (at & 63)) & 1 == 1


#: Words of a filter that come to the driver together.
_CHUNK = 1 << 13
#: Rows of 64 bits in the broadcast table of dropped and repeated keys, at most (some 10 MB).
MOST_SLOTS = 1 << 18


def id_filter(ids: DataFrame, key: str, most: int = MOST_BITS) -> np.ndarray:
    """A bit set, 16 MB at most, that has a bit for each of the ids and may have it for others too."""
    n = ids.count()
    bits = 1 << 16
    while bits < most and bits < 16 * n:
        bits <<= 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, dtype=bool)
        for batch in batches:
            own[_bits_of(batch.column(0).drop_null().to_numpy(), bits)] = True
        words = np.packbits(own, bitorder="little").view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], ["at", "word"])

    def packed_words(table: pa.Table) -> pa.Table:
        words = np.zeros(_CHUNK, dtype=np.int64)
        at = table.column("at").to_numpy()
        words[at % _CHUNK] = table.column("word").to_numpy()
        return pa.table({"chunk": [int(at[0]) // _CHUNK], "words": pa.array([words.tobytes()], pa.binary())})

    found = ids.select(F.col(key).cast("long")).mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word"))
    chunks = found.groupBy(F.floor(F.col("at") / _CHUNK).alias("c")).applyInArrow(packed_words, "chunk long, words binary")
    words = np.zeros(max(bits // 64, _CHUNK), dtype=np.int64)
    for chunk, own in chunks.toLocalIterator():  # 256 rows of 64 KB at most
        words[chunk * _CHUNK : (chunk + 1) * _CHUNK] = np.frombuffer(own, np.int64)
    return words[: bits // 64]


def links(rows: list[tuple[int, int, int, np.ndarray]], left: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Of sets as (class, copies, side, sorted shingles): the root and number of linked documents of each within the tile.

    With left < len(rows) only pairs of one set before `left` and one from it on count, as others have a tile of their own.
    """
    m = len(rows)
    size = np.array([len(r[3]) for r in rows], dtype=np.int64)
    owner = np.repeat(np.arange(m), size)
    tokens, column, n = np.unique(np.concatenate([r[3] for r in rows]), return_inverse=True, return_counts=True)
    shared = n > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    overlap = np.zeros((m, m), dtype=np.float32)
    width = 2048
    for first in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, (first, first + width))
        dense = np.zeros((m, min(width, int(shared.sum()) - first)), dtype=np.float32)
        dense[owner[a:b], column[a:b] - first] = 1
        overlap += dense @ dense.T
    both = overlap.astype(np.int64)
    alike = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    names = np.array([r[0] for r in rows], dtype=np.int64)
    alike &= (size[:, None] > 0) & (names[:, None] != names[None, :])
    if left < m:
        alike[:left, :left] = False
        alike[left:, left:] = False
    copies = np.array([r[1] for r in rows], dtype=np.int64)
    degree = alike @ copies
    root = np.full(m, -1, dtype=np.int64)
    for i in range(m):
        if root[i] < 0:
            root[i], front = i, np.array([i])
            while len(front):
                front = np.flatnonzero(alike[front].any(axis=0) & (root < 0))
                root[front] = i
    return names[root], degree


#: Blocks of one band have numbers below this.
_BAND = 1 << 40


def tiles(members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(cluster, i, j, right, cls, copies): the tiles in which each class of (cluster, cls, copies, n) is compared, and on which side.

    Sets whose sizes differ by more than the least similarity allows are never more than one band apart, and bands further apart have no tile.
    """
    whole = members.groupBy("cluster").agg(((F.count("*") <= BLOCK_SETS) & (F.sum("n") <= BLOCK_SHINGLES)).alias("small"))
    # A little wider than the similarity asks for, so that rounding can't put a pair two bands apart. What fits one block needs no bands.
    band = F.floor(F.log("n") / F.lit(math.log(100 / percent) * 1.000001)).cast("long")
    banded = members.join(whole, "cluster").withColumn("band", F.when(F.col("small"), F.lit(0).cast("long")).otherwise(band)).drop("small")
    sizes = banded.groupBy("cluster", "band").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long").alias("blocks"))
    # A row for each band and neighbour that exists, the band itself included.
    near = sizes.select("cluster", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.col("band").alias("other_band"), F.col("blocks").alias("other_blocks"))
    placed = banded.join(sizes, ["cluster", "band"]).withColumn("block", F.col("band") * _BAND + F.pmod(F.xxhash64("cls"), F.col("blocks"))).join(near, ["cluster", "band"])
    placed = placed.withColumn("other", F.explode(F.sequence(F.col("other_band") * _BAND, F.col("other_band") * _BAND + F.col("other_blocks") - 1)))
    return placed.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).alias("right"), "cls", "copies")


def verify(dealt: DataFrame) -> DataFrame:
    """(v, root, n_links): for (cluster, i, j, right, cls, copies, set binary), each class's root within its tile and its linked documents.

    A class has a row for each tile in which it is linked. A set that comes twice counts once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows, met = None, [], set()

        def done():
            if len(rows) < 2:
                return
            sides = sorted(rows, key=lambda r: r[2])
            left = sum(1 for r in rows if not r[2]) if tile[1] != tile[2] else len(rows)
            if tile[1] != tile[2] and left in (0, len(rows)):  # one block is empty; pairs within the other have a tile of their own
                return
            root, degree = links(sides, left)
            names = np.array([r[0] for r in sides], dtype=np.int64)
            has = degree > 0
            if has.any():
                yield pa.RecordBatch.from_arrays([pa.array(names[has]), pa.array(root[has]), pa.array(degree[has])], ["v", "root", "n_links"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True)
            for (cluster, i, j, right, cls, copies), value in zip(keys, batch.column(6), strict=True):
                if tile != (cluster, i, j):
                    yield from done()
                    tile, rows, met = (cluster, i, j), [], set()
                if cls not in met:
                    met.add(cls)
                    rows.append((cls, copies, right, np.frombuffer(value.as_buffer(), dtype=U64)))
        yield from done()

    ordered = dealt.select("cluster", "i", "j", "right", "cls", "copies", "set").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return ordered.mapInArrow(run, "v long, root long, n_links long")


def _classified(docs: DataFrame, key: str, text: str, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(key, mark, n, cls, ...) of every row, and of every class (cls, root, first, copies, component_id, n_links), both kept in the shared folder. `mark` is the text's
    hash, `first` the least (key is null, key, mark) of the class."""
    sc = docs.sparkSession.sparkContext
    folder = checkpoint_dir(docs.sparkSession)
    table = sc.broadcast(frequent(docs, text, k))
    source = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("t"), F.xxhash64(docs[text]).alias("mark"))

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for part, raw, offsets in text_slices(batches, "t"):
            h, cuts = shingle_sets(raw, offsets, k)
            names = classes(h, cuts)
            level, below, shown, often = prefixes(h, cuts, table.value, percent)
            fresh = np.zeros(len(names), dtype=bool)
            for i, name in enumerate(names.tolist()):
                if name not in met and cuts[i + 1] > cuts[i]:
                    met.add(name)
                    fresh[i] = True
            row = np.repeat(np.arange(len(names)), np.diff(cuts))
            shown &= fresh[row]
            known = row_sums(shown & often, cuts)

            def lists(which: np.ndarray, row=row, h=h, fresh=fresh) -> pa.Array:
                at = np.searchsorted(row[which], np.arange(len(fresh) + 1)).astype(np.int32)
                return pa.ListArray.from_arrays(pa.array(at), pa.array(h[which].view(np.int64)), mask=pa.array(~fresh))

            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(np.diff(cuts)), pa.array(names), pa.array(level.astype(np.int64)), pa.array(known), pa.array(below.tolist(), pa.list_(pa.int64())), lists(shown & ~often), lists(shown & often)],
                ["key", "mark", "n", "cls", "level", "known", "below", "shown", "frequent"],
            )

    sets = written(source.mapInArrow(show, "key long, mark long, n long, cls long, level long, known long, below array<long>, shown array<long>, frequent array<long>"), f"{folder}/sets")
    full = sets.where("n > 0")
    near = components(candidates(full))
    by_class = full.groupBy("cls").agg(F.min("key").alias("least"), F.count("*").alias("copies"), F.max("n").alias("n"), F.min(F.struct(F.col("key").isNull(), "key", "mark")).alias("first"))
    involved = checkpointed(near.select(F.col("v").alias("cls"), F.col("root").alias("cluster")).join(by_class.drop("first"), "cls"))
    bits = sc.broadcast(id_filter(involved.select("least"), "least"))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            wanted = passes(bits.value, ids.fill_null(0).to_numpy()) | ids.is_null().to_numpy(zero_copy_only=False)
            for _, raw, offsets in text_slices(iter([batch.filter(pa.array(wanted))]), "t"):
                h, cuts = shingle_sets(raw, offsets, k)
                packed = pa.array([h[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(classes(h, cuts)), packed], ["cls", "set"])

    # The ids' filter passes one row of each class, at times more. Only sets of involved classes are shuffled: to their class, then to its tiles.
    dealt = tiles(involved).join(source.select("key", "t").mapInArrow(again, "cls long, set binary"), "cls")
    linked = checkpointed(verify(dealt))
    root = components(linked, "v", "root").withColumnRenamed("v", "cls")
    known = by_class.join(root, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    degree = linked.groupBy(F.col("v").alias("cls")).agg(F.sum("n_links").alias("other"))
    facts = known.join(least, "root").join(degree, "cls", "left").select("cls", "root", "first", "copies", "component_id", (F.col("copies") - 1 + F.coalesce("other", F.lit(0))).alias("n_links"))
    # Kept apart, so that the join of all rows has plain shuffles on both sides and adaptive execution can split a class of many copies.
    return sets, checkpointed(facts)


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id, n_links) of every row: the set's size, the least key it is connected with, and how many other rows it is linked with."""
    sets, facts = _classified(docs, key, text, k, percent)
    some = sets.where("n > 0").select("key", "n", "cls").join(facts, "cls").select("key", "n", "component_id", "n_links")
    none = sets.where("n = 0").select("key", "n", F.col("key").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return some.union(none).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", "n_links")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows with exactly one of each component: of its least key (null last) the row of the least class, once. Rows without words stay, as they are linked with nothing.

    Keys may be null or repeated, with the same text or others. What is dropped or comes more than once is listed by key and the text's hash; only rows whose key may be
    in that list, by a bit set, or is null are looked up in it.
    """
    sets, facts = _classified(docs, key, text, k, percent)
    first = F.struct(F.col("first.col1").alias("none"), F.col("first.key").alias("key"), "cls", F.col("first.mark").alias("mark"))
    groups = facts.groupBy("root").agg(F.sum("copies").alias("rows"), F.min(first).alias("kept")).where("rows > 1").select("root", "kept")
    grouped = facts.select("cls", "root").join(groups, "root").select("cls", "kept")
    rows = sets.where("n > 0").select("key", "mark", "cls").join(grouped, "cls")
    pairs = rows.groupBy("key", "mark").agg(F.count("*").alias("n"), F.max(F.col("key").eqNullSafe(F.col("kept.key")) & (F.col("cls") == F.col("kept.cls")) & (F.col("mark") == F.col("kept.mark"))).alias("survives"))
    listed = checkpointed(pairs.where("n > 1 OR NOT survives").select(F.col("key").alias("_key"), F.col("mark").alias("_mark"), "survives"))
    inside, restored = guarded(docs, [key, text])
    number = inside[key].cast("long")
    # The bit set is a table of 64-bit words, MOST_SLOTS at most, so that rows are looked up in the JVM.
    n, slots = listed.count(), 64
    while slots < MOST_SLOTS and 4 * slots < n:
        slots <<= 1
    slot = lambda k: F.pmod(F.xxhash64(k), F.lit(slots))
    bit = lambda k: F.shiftright(F.xxhash64(k), 40).bitwiseAND(F.lit(63)).cast("int")
    known = listed.where("_key IS NOT NULL").select(slot(F.col("_key")).alias("_slot"), bit(F.col("_key")).alias("_bit"))
    words = known.groupBy("_slot").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_word"))
    flagged = inside.join(F.broadcast(words), slot(number) == F.col("_slot"), "left").withColumn("_maybe", number.isNull() | (F.coalesce(F.getbit("_word", bit(number)), F.lit(0)) == 1))
    suspects = flagged.where("_maybe").join(listed, number.eqNullSafe(F.col("_key")) & (F.xxhash64(inside[text]) == F.col("_mark")), "left")
    # Without what is dropped, so a few rows; written, as they are read twice.
    kept = written(suspects.where("survives IS NULL OR survives"), f"{checkpoint_dir(docs.sparkSession)}/kept")
    return restored(flagged.where("NOT _maybe")).union(restored(kept.where("survives IS NULL"))).union(restored(kept.where("survives").dropDuplicates(["_key", "_mark"])))
