"""Ranked lexical search by inverted treaps: each term's postings as a tree in search order of documents and heap order of impacts.

Documents are indexed where they lie: a task turns its rows into shards of bounded size, sorted by their id, with the postings of the terms that
are asked for; shards are a table in the shared folder and nothing of a text is shuffled. With the whole table's counts known, each shard's postings get their
impacts and each term its treap. A treap's node is a run of up to NODE postings with the greatest impact of the run; no node below has a greater one, so
the root of a term's postings in any range of documents bounds what the term can add there. Nodes of equal impact are put in order by a hash, so that trees stay flat.

A search walks the treaps of all its terms at once, from the whole shard down: a range of documents whose roots' impacts, times their terms' weights, don't
sum to the score of the k-th best document so far is left out with all below; others are halved, each term's root descending into either half. Ranges of LEAF documents
are scored whole. Shards of one task share what they know of the best. All ranges of a level go through NumPy together.

Scores are 64-bit integers and exact, whatever is pruned: a range that could only tie is walked, as ties go to the lesser id (null last).
Terms are known by 64-bit hashes. Null texts have no terms; items without terms have no rows; rows of the same id are documents of their own. Items that agree in id and
terms are one; others of the same id are ranked each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, checkpoint_dir, mix64, text_slices, written

SHOWN = 20
#: Documents and postings of a shard, about; postings of a node; documents of a range that is scored whole.
SHARD_DOCS, SHARD_POSTINGS, NODE, LEAF = 1 << 15, 1 << 21, 32, 128
#: Terms of the items that are searched together, and so broadcast (20 bytes each); more items take several passes.
MOST_TERMS = 1 << 20
_GAP = np.ones(256, dtype=bool)
_GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def length_norm(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """What a document's length weighs, 100 at the mean."""
    return 75 + (25 * n * docs) // total


def impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * norm)


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def asked(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, terms, counts, block): the terms of each item, ascending by hash, and a block of at most about MOST_TERMS terms in all."""
    kind = dict(items.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in text_slices(batches, "t"):
            words = Words(raw, offsets, gap=_GAP)
            found = [np.unique(words.hash[a:b], return_counts=True) for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
            lists = [pa.array([x[j].astype(np.int64) if j else x[j].view(np.int64) for x in found], pa.list_(pa.int64())) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column(0), *lists], ["item", "terms", "counts"])

    found = items.select(items[key].alias("item"), items[text].alias("t")).mapInArrow(run, f"item {kind}, terms array<long>, counts array<long>")
    return found.where(F.size("terms") > 0).dropDuplicates(["item", "terms", "counts"])


class _Shard:
    """What a task has gathered of documents and their postings of asked terms."""

    def __init__(self):
        self.keys, self.lengths, self.postings, self.docs, self.size, self.n, self.total = [], [], [], 0, 0, 0, 0

    def add(self, keys: pa.Array, words: Words, vocabulary: np.ndarray) -> None:
        n = np.diff(words.bounds)
        self.n += int((n > 0).sum())
        self.total += int(n.sum())
        at = np.minimum(np.searchsorted(vocabulary, words.hash), len(vocabulary) - 1)
        known = np.flatnonzero(vocabulary[at] == words.hash)
        pair, tf = np.unique(words.row[known] * len(vocabulary) + at[known], return_counts=True)
        row, term = np.divmod(pair, len(vocabulary))
        rows, doc = np.unique(row, return_inverse=True)
        self.keys.append(keys.take(pa.array(rows)))
        self.lengths.append(n[rows])
        self.postings.append((term, doc + self.docs, tf))
        self.docs += len(rows)
        self.size += len(pair)

    def row(self) -> pa.RecordBatch:
        keys = pa.concat_arrays(self.keys)
        order = pc.sort_indices(keys, null_placement="at_end").to_numpy()
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        term, doc, tf = (np.concatenate(x) for x in zip(*self.postings, strict=True))
        doc = place[doc]
        by = np.lexsort((doc, term))
        terms, df = np.unique(term, return_counts=True)
        lists = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        packed = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
        columns = [pa.array([self.n]), pa.array([self.total]), lists(keys.take(pa.array(order))), packed(np.concatenate(self.lengths)[order], np.int64), lists(pa.array(terms, pa.int32())), lists(pa.array(df, pa.int32())), packed(doc[by], np.int32), packed(tf[by], np.int32)]
        return pa.RecordBatch.from_arrays(columns, ["n", "total", "ids", "lengths", "terms", "dfs", "docs", "tfs"])


def shards(docs: DataFrame, vocabulary: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(n, total, ids, lengths, terms, dfs, docs, tfs): shards of documents that have any of the terms, given by ascending hash. `n` and `total` count all documents
    with terms and all their terms; postings lie by term and document."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for part, raw, offsets in text_slices(batches, "t"):
            shard.add(part.column(0), Words(raw, offsets, gap=_GAP), shared.value)
            if shard.docs >= SHARD_DOCS or shard.size >= SHARD_POSTINGS:
                yield shard.row()
                shard = _Shard()
        if shard.keys:
            yield shard.row()

    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, f"n long, total long, ids array<{kind}>, lengths binary, terms array<int>, dfs array<int>, docs binary, tfs binary")


class Treaps:
    """The treaps of one shard: nodes of up to `node` postings with their first and last document, greatest impact and children; -1 is no node."""

    def __init__(self, terms: np.ndarray, dfs: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_docs: int, node: int = NODE):
        self.terms, self.docs, self.impacts, self.n_docs = terms, docs, impacts, n_docs
        self.bounds = np.concatenate([[0], np.cumsum(dfs)])
        nodes = -(-dfs // node)
        edges = np.concatenate([[0], np.cumsum(nodes)])
        starts = np.repeat(self.bounds[:-1], nodes) + node * (np.arange(edges[-1]) - np.repeat(edges[:-1], nodes))
        ends = np.minimum(starts + node, np.repeat(self.bounds[1:], nodes))
        best = np.maximum.reduceat(impacts, starts) if len(starts) else np.zeros(0, np.int64)
        # The last place of each array stands for -1, no node: it adds nothing and never descends.
        self.first = np.append(docs[starts], -1)
        self.last = np.append(docs[ends - 1], np.int64(1) << 40)
        self.best = np.append(best, 0)
        heap = ((best << 20) | (mix64(np.arange(len(best), dtype=np.uint64)) & np.uint64((1 << 20) - 1)).astype(np.int64)).tolist()
        left, right, roots = [-1] * (len(heap) + 1), [-1] * (len(heap) + 1), []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            spine: list[int] = []
            for i in range(a, b):
                under = -1
                while spine and heap[spine[-1]] < heap[i]:
                    under = spine.pop()
                left[i] = under
                if spine:
                    right[spine[-1]] = i
                spine.append(i)
            roots.append(spine[0])
        self.left, self.right, self.roots = np.array(left), np.array(right), np.array(roots, dtype=np.int64)

    def descend(self, nodes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """For each range and term the root of what the term's treap has between lo and hi, from a node above."""
        lo, hi = lo[:, None], hi[:, None]
        while True:
            before, after = self.first[nodes] >= hi, self.last[nodes] < lo
            if not (before.any() or after.any()):
                return nodes
            nodes = np.where(before, self.left[nodes], np.where(after, self.right[nodes], nodes))

    def scores(self, which: np.ndarray, weights: np.ndarray, leaves: np.ndarray, into: np.ndarray) -> None:
        """Add up the scores of all documents in the leaves."""
        most = len(into) // LEAF
        for t, w in zip(which.tolist(), weights.tolist(), strict=True):
            a, b = self.bounds[t], self.bounds[t + 1]
            docs, impacts = self.docs[a:b], self.impacts[a:b]
            if len(leaves) < most:
                c, d = np.searchsorted(docs, leaves * LEAF), np.searchsorted(docs, (leaves + 1) * LEAF)
                n = d - c
                at = np.repeat(c - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                docs, impacts = docs[at], impacts[at]
            into[docs] += w * impacts

    def search(self, which: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best of at least `least`, best first, ties to the first document. `which` are places of terms."""
        height = max(0, math.ceil(math.log2(max(1, self.n_docs) / LEAF))) if self.n_docs > LEAF else 0
        into = np.zeros(LEAF << height, dtype=np.int64)
        done = np.zeros(1 << height, dtype=bool)
        if not least and height:
            # Before anything is known: the leaves where the terms' roots begin.
            leaves = np.unique(self.first[self.roots[which]] // LEAF)
            self.scores(which, weights, leaves, into)
            done[leaves] = True
            if len(into) > k:
                least = max(least, int(np.partition(into, len(into) - k)[len(into) - k]))
        lo, nodes = np.zeros(1, np.int64), self.roots[which][None, :]
        for level in range(height + 1):
            alive = self.best[nodes] @ weights >= max(1, least)
            lo, nodes = lo[alive], nodes[alive]
            if level == height or not len(lo):
                break
            half = len(into) >> (level + 1)
            lo, nodes = np.concatenate([lo, lo + half]), np.concatenate([nodes, nodes])
            nodes = self.descend(nodes, lo, lo + half)
        leaves = np.sort(lo // LEAF)
        self.scores(which, weights, leaves[~done[leaves]], into)
        found = np.flatnonzero(into >= max(1, least))
        if len(found) > k:
            edge = np.partition(into[found], len(found) - k)[len(found) - k]
            found = found[into[found] >= edge]
        found = found[np.lexsort((found, -into[found]))][:k]
        return found, into[found]


def _searched(index: DataFrame, kind: str, items: pa.Table, item_kind: str, vocabulary: np.ndarray, weights: np.ndarray, docs: int, total: int, k: int) -> DataFrame:
    """(nth, item, doc, score): the best documents of each item in each task's shards."""
    ends = np.cumsum(pc.list_value_length(items.column("terms")).to_numpy())
    term = np.searchsorted(vocabulary, items.column("terms").combine_chunks().flatten().to_numpy().view(np.uint64))
    times = items.column("counts").combine_chunks().flatten().to_numpy()
    shared = index.sparkSession.sparkContext.broadcast((items.column("item").combine_chunks(), ends, term, weights[term] * times))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ends, term, weights = shared.value
        best: list[list[tuple]] = [[] for _ in range(len(ends))]
        order = lambda x: (-x[0], x[1] is None, x[1])
        for batch in batches:
            for i in range(batch.num_rows):
                ids, lengths, terms, dfs, doc, tf = (batch.column(c)[i] for c in range(6))
                own, norm = terms.values.to_numpy(), length_norm(np.frombuffer(lengths.as_buffer(), np.int64), docs, total)
                doc, tf = (np.frombuffer(x.as_buffer(), np.int32).astype(np.int64) for x in (doc, tf))
                treaps = Treaps(own, dfs.values.to_numpy().astype(np.int64), doc, impact(tf, norm[doc]), len(norm))
                for q, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
                    at = np.minimum(np.searchsorted(own, term[a:b]), max(len(own) - 1, 0))
                    has = own[at] == term[a:b] if len(own) else np.zeros(0, bool)
                    if has.any():
                        found, score = treaps.search(at[has], weights[a:b][has], k, best[q][-1][0] if len(best[q]) == k else 0)
                        if len(found):
                            best[q] = sorted(best[q] + list(zip(score.tolist(), ids.values.take(pa.array(found)).to_pylist(), strict=True)), key=order)[:k]
        nth = np.repeat(np.arange(len(best)), [len(x) for x in best])
        flat = [x for own in best for x in own]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(nth), names.take(pa.array(nth)), pa.array([x[1] for x in flat], doc_type), pa.array([x[0] for x in flat], pa.int64())], ["nth", "item", "doc", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    doc_type = to_arrow_type(index.schema["ids"].dataType.elementType)
    return index.select("ids", "lengths", "terms", "dfs", "docs", "tfs").mapInArrow(run, f"nth long, item {item_kind}, doc {kind}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = SHOWN, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", most_terms: int = MOST_TERMS) -> DataFrame:
    """(item_key, rank, doc_key, score): for each item its k documents of highest score above 0."""
    spark = docs.sparkSession
    kind, item_kind = dict(docs.dtypes)[doc_key], dict(items.dtypes)[item_key]
    folder = checkpoint_dir(spark)
    wanted = written(asked(items, item_key, text), f"{folder}/asked")
    blocks = -(-(wanted.agg(F.sum(F.size("terms"))).first()[0] or 0) // most_terms)
    out = spark.createDataFrame([], f"nth long, item {item_kind}, doc {kind}, score long")
    parts = []
    for block in range(blocks):
        own = wanted.where(F.pmod(F.xxhash64("item", "terms"), F.lit(blocks)) == block).select("item", "terms", "counts").toArrow()
        if not own.num_rows:
            continue
        vocabulary = np.unique(own.column("terms").combine_chunks().flatten().to_numpy().view(np.uint64))
        index = written(shards(docs, vocabulary, doc_key, text), f"{folder}/shards-{block}")
        n, total = index.agg(F.sum("n"), F.sum("total")).first()
        if not total:
            continue
        counted = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.dfs").alias("df")).toArrow()  # a row for each term of the block at most
        weights = np.zeros(len(vocabulary), dtype=np.int64)
        weights[counted.column("terms").to_numpy()] = [weight(n, df) for df in counted.column("df").to_pylist()]
        parts.append(_searched(index, kind, own, item_kind, vocabulary, weights, n, total, k).withColumn("nth", F.col("nth") * blocks + block))
    for part in parts:
        out = out.union(part)
    order = Window.partitionBy("nth").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_key), "rank", F.col("doc").alias(doc_key), "score")


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: DuckDB SQL for `search`, over `documents` and `benchmark` with ids of their own.
SQL = f"""
WITH listed AS (SELECT doc_id, row_number() OVER () AS rid, {_TERMS} AS t FROM documents),
counts AS (SELECT count(*) AS nd, CAST(sum(len(t)) AS BIGINT) AS total FROM listed WHERE len(t) > 0),
norms AS (SELECT rid, doc_id, 75 + (25 * len(t) * nd) // total AS m FROM listed, counts),
tfs AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(t) AS term FROM listed) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, counts GROUP BY term, nd),
asked AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
scores AS (
  SELECT item_id, rid, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN norms USING (rid) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {SHOWN}"""
