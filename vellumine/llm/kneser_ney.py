"""An interpolated modified Kneser-Ney bigram model, counted in Spark and scored from memory-mapped sorted arrays.

Counting deals packed arrays, not rows: each task sends, for every part of the key space, its distinct
pairs (previous token, token) with their counts; a part's task merges them, stores the pairs' hashes in
ascending order with their counts and each context's totals, and passes on in how many contexts it met
each token; the second deal brings these together by token. Files lie in the shared folder, are renamed into place when
whole, and are mapped, not read, by the workers that score. The model's size follows the corpus;
nothing is pruned. Contexts of at least HEAVY tokens, which would fill much of a part, are spread over parts by their token, and
their totals are added up at the driver; there are fewer of them than twice the parts. A part has one file for its pairs and contexts and one for its tokens;
a worker keeps OPEN of them mapped at most, however many parts there are.

p(w|v) = max(n(vw) - D, 0) / n(v) + share(v) * p(w);  p(w) = max(m(w) - D', 0) / m + share * 1 / (V + 1),
where m(w) counts the contexts that w follows, and D depends on whether a count is 1, 2, or 3 and more.
Tokens are words, lower-cased in A-Z, and one end for each text; a text's first token follows a start mark. Null
and empty texts are an end alone. Without training texts every probability is 1 / (V + 1) = 1.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, U64, Words, checkpoint_dir, delete, map_file, mix64, put_bytes, row_sums, text_slices, with_text_columns

START, END = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
#: Tokens that a task counts at a time, and tokens for each part.
CHUNK, PART_TOKENS = 1 << 21, 1 << 20
#: Tokens from which on a context is spread, how often a task must meet it to count it, and over how many places of the key space it is spread.
HEAVY, LEAST_SEEN, SPREAD = PART_TOKENS // 2, 4, 64
#: Files that a worker keeps mapped.
OPEN = 96


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token's context and hash in order, and the cuts between texts; a text of n words has n + 1 tokens."""
    words = Words(raw, offsets)
    n = np.diff(words.bounds)
    cuts = np.concatenate([[0], np.cumsum(n + 1)])
    token = np.empty(cuts[-1], dtype=U64)
    last = np.zeros(len(token), dtype=bool)
    last[cuts[1:] - 1] = True
    token[~last] = words.hash
    token[last] = END
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[cuts[:-1]] = START
    return context, token, cuts


def pair_hash(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix64(context * U64(0x9E3779B97F4A7C15) + token)


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    return (mix64(key ^ U64(0xA0761D6478BD642F)) % U64(parts)).astype(np.int64)


def pair_part(context: np.ndarray, token: np.ndarray, heavy: np.ndarray, parts: int) -> np.ndarray:
    spread = np.isin(context, heavy) if len(heavy) else np.zeros(len(context), dtype=bool)
    return part_of(np.where(spread, context + (token % U64(SPREAD)) * U64(0xE7037ED1A0B428DB), context), parts)


def merged(keys: tuple[np.ndarray, ...], counts: tuple[np.ndarray, ...]) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Distinct keys, ascending, the first key being the main one, with their counts added up."""
    if not len(keys[0]):
        return keys, counts
    order = np.lexsort(keys[::-1])
    keys = tuple(k[order] for k in keys)
    new = np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
    at = np.flatnonzero(new)
    return tuple(k[at] for k in keys), tuple(np.add.reduceat(c[order].astype(np.int64), at) for c in counts)


def _frequent(docs: DataFrame, text: str, heavy: int) -> tuple[np.ndarray, int]:
    """Contexts of at least `heavy` tokens, and the number of tokens.

    What a task meets fewer than LEAST_SEEN times in CHUNK tokens isn't passed on, so a context that is missed adds no more for each CHUNK to its part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0

        def counted():
            word, n = np.unique(np.concatenate(kept), return_counts=True)
            top = n >= (LEAST_SEEN if size >= CHUNK else 1)
            return pa.RecordBatch.from_arrays([pa.array(np.append(word[top].view(np.int64), 0)), pa.array(np.append(n[top], 0)), pa.array(np.append(np.zeros(top.sum(), np.int64), size))], ["w", "n", "size"])

        for _, raw, offsets in text_slices(batches, "t"):
            context, _, _ = tokens(raw, offsets)
            kept.append(context)
            size += len(context)
            if size >= CHUNK:
                yield counted()
                kept, size = [], 0
        if kept:
            yield counted()

    seen = docs.select(docs[text].alias("t")).mapInArrow(run, "w long, n long, size long").groupBy("w").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    # One pass: the heavy ones, and the tokens of all; fewer than twice the parts.
    rows = seen.where((F.col("n") >= heavy) | (F.col("size") > 0)).select("w", "n", "size").collect()
    found = [r[0] & 0xFFFFFFFFFFFFFFFF for r in rows if r[1] >= heavy]
    return np.array(sorted(found), dtype=U64), sum(r[2] for r in rows)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What is taken from counts of 1, 2, and 3 or more; where the counts of counts don't allow it, 1/2, 1 and 3/2."""
    out = (0.5, 1.0, 1.5)
    if min(n1, n2, n3) > 0:
        y = n1 / (n1 + 2 * n2)
        found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        out = tuple(f if 0 < f < i + 1 else d for i, (f, d) in enumerate(zip(found, out, strict=True)))
    return out


@dataclass
class Model:
    """Where the arrays lie, and the numbers that hold for the whole corpus."""

    folder: str
    parts: int
    heavy: np.ndarray
    heavy_totals: np.ndarray  # rows of n, n1, n2, n3 for each heavy context
    total: int  # N
    distinct: int  # V
    types: int
    pair_discounts: tuple[float, float, float]
    token_discounts: tuple[float, float, float]
    classes: tuple[int, int, int]  # tokens that follow 1, 2, or more contexts
    pair_parts: np.ndarray  # parts that hold pairs; only these have files
    token_parts: np.ndarray
    maps: OrderedDict = field(default_factory=OrderedDict)

    def __getstate__(self):
        return self.__dict__ | {"maps": OrderedDict()}

    def arrays(self, name: str, part: int) -> list[np.ndarray]:
        """A file's arrays, mapped; the file that was used longest ago is let go."""
        key = (name, part)
        if key in self.maps:
            self.maps.move_to_end(key)
            return self.maps[key]
        if len(self.maps) >= OPEN:
            self.maps.popitem(last=False)
        whole = map_file(f"{self.folder}/{name}-{part:08d}", U64)
        self.maps[key] = [whole[a:b] for a, b in zip(*_places(whole), strict=True)]
        return self.maps[key]


def _places(whole: np.ndarray) -> tuple[list[int], list[int]]:
    """Where a file's arrays begin and end: its head has their number and lengths, in 64-bit words."""
    sizes = np.asarray(whole[1 : 1 + int(whole[0])]).astype(np.int64)
    ends = np.cumsum(sizes) + 1 + len(sizes)
    return (ends - sizes).tolist(), ends.tolist()


def _put(uri: str, arrays: list[np.ndarray]) -> None:
    words = [np.frombuffer(a.tobytes() + bytes(-a.nbytes % 8), dtype=U64) for a in arrays]
    put_bytes(uri, [np.array([len(words), *map(len, words)], dtype=U64), *words])


def _deal(df: DataFrame, columns: int) -> DataFrame:
    return df.repartition("part").sortWithinPartitions("part")


def _gather(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Each part's arrays, put together from its rows, which stand next to each other."""
    part, kept = None, [[] for _ in range(columns)]
    for batch in batches:
        for number, *values in zip(batch.column(0).to_pylist(), *(batch.column(i + 1) for i in range(columns)), strict=True):
            if number != part:
                if part is not None:
                    yield part, [np.concatenate(k) for k in kept]
                part, kept = number, [[] for _ in range(columns)]
            for k, v in zip(kept, values, strict=True):
                k.append(np.frombuffer(v.as_buffer(), dtype=U64))
    if part is not None:
        yield part, [np.concatenate(k) for k in kept]


def _packed(part: np.ndarray, parts: int, arrays: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each part that has keys, with its share of the arrays."""
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    has = np.flatnonzero(np.diff(cuts))
    columns = [[a[order[cuts[p] : cuts[p + 1]]].astype(U64).tobytes() for p in has] for a in arrays]
    return pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], ["part", *(f"c{i}" for i in range(len(arrays)))])


def train(docs: DataFrame, text: str = "text", parts: int | None = None, heavy_from: int = HEAVY) -> Model:
    """Count all rows and store the model in a new folder of the shared place, in so many parts as the tokens need, or as are given."""
    folder = f"{checkpoint_dir(docs.sparkSession)}/kneser-ney"
    heavy, total = _frequent(docs, text, heavy_from)
    parts = parts or max(64, 1 << math.ceil(math.log2(max(PART_TOKENS, total) / PART_TOKENS)))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0

        def counted():
            context, token = (np.concatenate(c) for c in zip(*kept, strict=True))
            (context, token), (n,) = merged((context, token), (np.ones(len(token), dtype=np.int64),))
            return _packed(pair_part(context, token, heavy, parts), parts, [context, token, n])

        for _, raw, offsets in text_slices(batches, "t"):
            context, token, _ = tokens(raw, offsets)
            kept.append((context, token))
            size += len(token)
            if size >= CHUNK:
                yield counted()
                kept, size = [], 0
        if kept:
            yield counted()

    def merge_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (context, token, n) in _gather(batches, 3):
            (context, token), (n,) = merged((context, token), (n,))
            h = pair_hash(context, token)
            order = np.argsort(h)
            (own,), totals = merged((context,), (n, n == 1, n == 2, n >= 3))
            spread = np.isin(own, heavy)
            plain = np.ascontiguousarray(np.stack([t[~spread] for t in totals], axis=1))
            _put(f"{folder}/pair-{part:08d}", [h[order], np.minimum(n[order], 0xFFFFFFFF).astype(np.uint32), own[~spread], plain])
            facts = np.concatenate([[part, len(n)], *((n == k).sum(keepdims=True) for k in (1, 2, 3, 4))]).astype(np.int64)
            (word,), (raw_n, contexts) = merged((token,), (n, np.ones(len(n), dtype=np.int64)))
            out = _packed(part_of(word, parts), parts, [word, raw_n, contexts])
            notes = pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (facts.view(U64), own[spread], np.stack([t[spread] for t in totals], axis=1).astype(U64)))], out.schema.names)
            yield out
            yield notes

    schema = "part int, c0 binary, c1 binary, c2 binary"
    first = docs.select(docs[text].alias("t")).mapInArrow(pairs, schema)
    # Written, so that a part's files and what it passes on are made once, whoever reads them.
    met = f"{folder}/met"
    _deal(first, 3).mapInArrow(merge_pairs, schema).write.mode("overwrite").parquet(met)
    met = docs.sparkSession.read.schema(schema).parquet(met)
    facts, totals, pair_parts = np.zeros(5, dtype=np.int64), np.zeros((len(heavy), 4), dtype=np.int64), []
    for row in met.where("part < 0").toLocalIterator():  # a row of a few numbers for each part
        own_facts = np.frombuffer(row[1], np.int64)
        pair_parts.append(own_facts[0])
        facts += own_facts[1:]
        own = np.frombuffer(row[2], U64)
        totals[np.searchsorted(heavy, own)] += np.frombuffer(row[3], np.int64).reshape(-1, 4)

    def merge_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (word, n, contexts) in _gather(batches, 3):
            (word,), (n, contexts) = merged((word,), (n, contexts))
            _put(f"{folder}/token-{part:08d}", [word, np.ascontiguousarray(np.stack([n, contexts], axis=1))])
            numbers = [len(word), n.sum(), contexts.sum(), *((contexts == k).sum() for k in (1, 2, 3, 4)), (contexts >= 3).sum()]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([int(x)], pa.int64()) for x in numbers)], ["part", *(f"x{i}" for i in range(8))])

    sums = _deal(met.where("part >= 0"), 3).mapInArrow(merge_tokens, "part int, " + ", ".join(f"x{i} long" for i in range(8)))
    rows = np.array([tuple(r) for r in sums.collect()], dtype=np.int64).reshape(-1, 9)  # a row of numbers for each part
    x = rows[:, 1:].sum(axis=0).tolist()
    delete(docs.sparkSession, f"{folder}/met")
    return Model(folder, parts, heavy, totals, x[1], x[0], x[2], discounts(*facts[1:].tolist()), discounts(*x[3:7]), (x[3], x[4], x[7]), np.array(pair_parts, dtype=np.int64), rows[:, 0])


#: Of each kind of key: the file it is in, the places of keys and numbers in it, and the numbers' type and how many a key has.
STORED = {"pair": ("pair", 0, np.uint32, 1), "context": ("pair", 2, np.int64, 4), "token": ("token", 0, np.int64, 2)}


def _look_up(model: Model, asked: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
    """For (keys, parts) of each kind, the rows of numbers stored for the keys, zeros for those that aren't there. Each file is visited once."""
    out, orders = {}, {}
    for kind, (key, part) in asked.items():
        out[kind] = np.zeros((len(key), STORED[kind][3]), dtype=np.int64)
        order = np.lexsort((key, part))
        orders[kind] = order, part[order]
    for file, has in (("pair", model.pair_parts), ("token", model.token_parts)):
        kinds = [k for k in asked if STORED[k][0] == file]
        for p in np.intersect1d(np.concatenate([orders[k][1] for k in kinds]), has).tolist():
            arrays = model.arrays(file, p)
            for kind in kinds:
                _, at, dtype, width = STORED[kind]
                order, parts = orders[kind]
                rows = order[slice(*np.searchsorted(parts, (p, p + 1)))]
                stored = arrays[at]
                if len(stored) and len(rows):
                    key = asked[kind][0][rows]
                    place = np.minimum(np.searchsorted(stored, key), len(stored) - 1)
                    hit = stored[place] == key
                    numbers = arrays[at + 1].view(dtype)[: len(stored) * width].reshape(-1, width)
                    out[kind][rows[hit]] = numbers[place[hit]]
    return out


def probabilities(model: Model, context: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token, its probability after its context, and its count in training."""
    if not model.total:
        return np.ones(len(token)), np.zeros(len(token), dtype=np.int64)
    cut = np.array([0.0, *model.token_discounts])
    word, word_at = np.unique(token, return_inverse=True)
    own, own_at = np.unique(context, return_inverse=True)
    pair, first, pair_at = np.unique(pair_hash(context, token), return_index=True, return_inverse=True)
    asked = {"token": (word, part_of(word, model.parts)), "context": (own, part_of(own, model.parts)), "pair": (pair, pair_part(context[first], token[first], model.heavy, model.parts))}
    found = _look_up(model, asked)
    n, contexts = found["token"].T
    share = sum(d * c for d, c in zip(model.token_discounts, model.classes, strict=True)) / model.types
    lower = np.maximum(contexts - cut[np.minimum(contexts, 3)], 0) / model.types + share / (model.distinct + 1)
    totals = found["context"]
    if len(model.heavy):
        i = np.minimum(np.searchsorted(model.heavy, own), len(model.heavy) - 1)
        is_heavy = model.heavy[i] == own
        totals[is_heavy] = model.heavy_totals[i[is_heavy]]
    count = found["pair"][pair_at, 0]
    cut = np.array([0.0, *model.pair_discounts])
    whole = np.maximum(totals[:, 0], 1)
    left = np.where(totals[:, 0] > 0, (totals[:, 1:] @ np.array(model.pair_discounts)) / whole, 1.0)
    return np.maximum(count - cut[np.minimum(count, 3)], 0) / whole[own_at] + left[own_at] * lower[word_at], n[word_at]


FIELDS = "n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The rows with FIELDS: the log10 probability of the text by this model and by smoothed token counts, and its perplexity."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few numbers for each part and heavy context

    def make(raw: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        model = shared.value
        context, token, cuts = tokens(raw, offsets)
        p, known = probabilities(model, context, token)
        n = np.diff(cuts)
        base = row_sums(np.log10((known + 0.5) / (model.total + 0.5 * (model.distinct + 1))), cuts)
        total = row_sums(np.log10(p), cuts)
        return [pa.array(n), pa.array(row_sums(known > 0, cuts)), pa.array(np.full(len(n), model.total)), pa.array(base), pa.array(total), pa.array(10 ** (-total / n))]

    # The more parts there are, the more text is scored at a time, up to 4 times a slice, so that files are opened less often.
    return with_text_columns(docs, FIELDS, make, text=text, keep=keep, most=SLICE_BYTES * min(4, max(1, model.parts // OPEN)))


def is_held_out(key: Column, folds: int = 5, fold: int = 1) -> Column:
    """A fixed fold by the CRC-32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == fold
