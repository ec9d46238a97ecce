"""Phrase collocations: counts of all phrases of up to five words by depth-limited tries, and the score of each phrase's weakest cut.

Three passes over the texts, each counting in its tasks first. A phrase is no more frequent than its parts, so a pass counts what the
one before leaves possible: words; pairs of frequent words; tries of what consists of frequent pairs. What is frequent is known to the tasks by
a bit set of bounded size, which may let others pass, never fewer; a full one costs time and changes no count.

A task's trie has pairs of words as roots and paths of three to five words below. Its levels are sorted arrays (parent, word, count), roots by
the hash of their words, nodes by their parent; so it is cut into ranges of roots, and a range's pieces of all tasks are merged level by level. In the
merged trie a phrase's ancestors are its left parts, with their counts (the first word has its own). Its right parts are what its suffix links reach:
the nodes of the phrase without its first word, its first two words, and so on, which lie in other ranges and are joined by their hash.

Words and phrases are known by 64-bit hashes of their words; two of m frequent ones and M others meet with a probability of about m M / 2**64.
Texts are split into pieces at BREAKS and these into words at blanks and tabs; A-Z are lower-cased. Null texts are empty, a null lang is `und`. Repeated
rows count each. Languages without candidates have no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Words, checkpoint_dir, checkpointed, mix64, text_slices, written
from .ngram_join import id_filter, passes

BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
MOST_WORDS = 5
#: A candidate's least count, and how many a language shows.
LEAST, SHOWN = 100, 2000
#: Entries that a task gathers before it passes them on.
GATHERED = 1 << 20
#: Bytes of text for each range in which counts are merged, and ranges at least.
RANGE_BYTES, LEAST_RANGES = 1 << 25, 16
#: Words of the shown phrases up to which they are broadcast to find their spelling; beyond, both sides are shuffled.
MOST_BROADCAST = 1 << 20
_STEP = U64(0xD6E8FEB86659FD93)
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, 0x09, *BREAKS]] = True
_BREAK = np.zeros(256, dtype=np.int32)
_BREAK[[*BREAKS]] = 1


def below(ids: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The hash of each phrase that is one word longer."""
    return mix64(ids * _STEP + words)


def path(words: np.ndarray) -> np.ndarray:
    """The hash of phrases, a row of word hashes each."""
    ids = np.zeros(len(words), dtype=U64)
    for column in words.T:
        ids = below(ids, column)
    return ids


def code(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def marks(ids: np.ndarray, codes: np.ndarray | int) -> np.ndarray:
    """Names of phrases within languages, for bit sets."""
    return (ids ^ (U64(codes) if isinstance(codes, int) else codes)).view(np.int64)


def summed(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids ascending, their summed counts, where each was first, and the place of every given one among them."""
    order = np.argsort(ids, kind="stable")
    new = np.ones(len(ids), dtype=bool)
    new[1:] = ids[order][1:] != ids[order][:-1]
    starts = np.flatnonzero(new)
    at = np.empty(len(ids), dtype=np.int64)
    at[order] = np.cumsum(new) - 1
    return ids[order][starts], np.add.reduceat(counts[order], starts) if len(starts) else counts, order[starts], at


class Found:
    """The words of a slice of (lang, text) rows: hash, language by number, and whether the next is in the same piece."""

    def __init__(self, part: pa.RecordBatch, raw: np.ndarray, offsets: np.ndarray):
        self.words = Words(raw, offsets, gap=_GAP)
        encoded = part.column(0).dictionary_encode()
        self.langs = encoded.dictionary.to_pylist()
        self.lang = encoded.indices.to_numpy()[self.words.row]
        self.code = np.array([code(x) for x in self.langs], dtype=U64)[self.lang]
        self.hash = self.words.hash
        piece = np.cumsum(_BREAK[raw])[self.words.starts] if len(raw) else np.zeros(0, np.int64)
        self.joined = (self.words.row[1:] == self.words.row[:-1]) & (piece[1:] == piece[:-1])
        self.id = mix64(self.hash)  # of the word as a phrase

    def spelled(self, i: int) -> bytes:
        return self.words.raw[self.words.starts[i] : self.words.ends[i]].tobytes().lower()


class Counts:
    """Counts of phrases for each language, passed on as sorted arrays cut into ranges of their hash."""

    def __init__(self, bits: int, most: int = GATHERED):
        self.bits, self.most, self.kept, self.size = bits, most, {}, 0

    def add(self, langs: list[str], lang: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k, name in enumerate(langs):
            own, n = np.unique(ids[lang == k], return_counts=True)
            if len(own):
                self.kept.setdefault(name, []).append((own, n))
                self.size += len(own)
        if self.size >= self.most:
            self.kept = {name: [self._merged(x)] for name, x in self.kept.items()}
            self.size = sum(len(x[0][0]) for x in self.kept.values())
            if self.size >= self.most // 2:
                yield from self.rows()

    @staticmethod
    def _merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        return summed(*(np.concatenate(x) for x in zip(*runs, strict=True)))[:2]

    def rows(self) -> Iterator[pa.RecordBatch]:
        for name, runs in self.kept.items():
            ids, n = self._merged(runs)
            edges = range_edges(ids, self.bits)
            for r, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if b > a:
                    yield pa.RecordBatch.from_pylist([{"lang": name, "range": r, "n": int(n[a:b].sum()), "ids": ids[a:b].tobytes(), "counts": n[a:b].astype(np.uint32).tobytes()}], COUNTED)
        self.kept, self.size = {}, 0


COUNTED = pa.schema([("lang", pa.string()), ("range", pa.int32()), ("n", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])


def range_edges(ids: np.ndarray, bits: int) -> list[int]:
    """Where each of 2**bits ranges of ascending hashes begins, and the end."""
    return [*np.searchsorted(ids, np.arange(1 << bits, dtype=U64) << U64(64 - bits)).tolist(), len(ids)]


def counted(docs: DataFrame, bits: int, frequent=None, most: int = GATHERED) -> DataFrame:
    """(lang, range, n, ids, counts) of the words of (lang, text) rows, or of their pairs of frequent words, as tasks have counted them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(bits, most)
        for part, raw, offsets in text_slices(batches):
            found = Found(part, raw, offsets)
            if frequent is None:
                yield from counts.add(found.langs, found.lang, found.id)
            elif len(found.hash) > 1:
                known = passes(frequent.value, marks(found.id, found.code))
                i = np.flatnonzero(found.joined & known[1:] & known[:-1])
                yield from counts.add(found.langs, found.lang[i], below(found.id[i], found.hash[i + 1]))
        yield from counts.rows()

    return docs.mapInArrow(run, "lang string, range int, n long, ids binary, counts binary")


def frequent_ids(runs: DataFrame, least: int) -> DataFrame:
    """(lang, id, mark, f) of what all tasks together have counted often enough."""

    def merged(table: pa.Table) -> pa.Table:
        lang = table.column("lang")[0].as_py()
        ids, n = Counts._merged([(np.frombuffer(i.as_buffer(), U64), np.frombuffer(c.as_buffer(), np.uint32).astype(np.int64)) for i, c in zip(table.column("ids"), table.column("counts"), strict=True)])
        ids, n = ids[n >= least], n[n >= least]
        return pa.table([pa.array([lang] * len(ids), pa.string()), pa.array(ids.view(np.int64)), pa.array(marks(ids, code(lang))), pa.array(n)], ["lang", "id", "mark", "f"])

    return runs.groupBy("lang", "range").applyInArrow(merged, "lang string, id long, mark long, f long")


class Trie:
    """Counts of paths of two to five words. `root` has a row of two word hashes for each pair; levels hold (parent, word, count), and `counts` the pairs' own."""

    def __init__(self, root: np.ndarray, counts: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.root, self.counts, self.levels = root, counts, levels

    @classmethod
    def of_paths(cls, words: np.ndarray, length: np.ndarray) -> Trie:
        """The trie of rows of five word hashes, of which the first `length` count, with all their beginnings of two words or more."""
        rows, levels = np.arange(len(words)), []
        for depth in range(3, MOST_WORDS + 1):
            longer = np.flatnonzero(length[rows] >= depth)
            rows = rows[longer]
            levels.append((longer, words[rows, depth - 1], np.ones(len(rows), np.int64)))
        return cls.merge([cls(words[:, :2], np.ones(len(words), np.int64), levels)])

    @classmethod
    def merge(cls, tries: list[Trie]) -> Trie:
        """One trie of several, level by level: what has the same parent and word is one node. Roots ascend by hash, nodes by parent."""
        root = np.concatenate([t.root for t in tries])
        ids, counts, first, at = summed(path(root), np.concatenate([t.counts for t in tries]))
        sizes, levels = [len(t.counts) for t in tries], []
        out = cls(root[first], counts, levels)
        for depth in range(MOST_WORDS - 2):
            shift = np.concatenate([[0], np.cumsum(sizes)])
            parent = at[np.concatenate([t.levels[depth][0] + s for t, s in zip(tries, shift, strict=False)]).astype(np.int64)]
            word = np.concatenate([t.levels[depth][1] for t in tries])
            own, counts, first, at = summed(below(ids[parent], word), np.concatenate([t.levels[depth][2] for t in tries]))
            order = np.argsort(parent[first], kind="stable")
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            ids, at = own[order], place[at]
            levels.append((parent[first][order], word[first][order], counts[order]))
            sizes = [len(t.levels[depth][0]) for t in tries]
        return out

    def cut(self, bits: int) -> Iterator[tuple[int, Trie]]:
        """The trie's part for each range of roots that has any."""
        edges = range_edges(path(self.root), bits)
        for r, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if b > a:
                root, counts, levels = self.root[a:b], self.counts[a:b], []
                for parent, word, n in self.levels:
                    c, d = np.searchsorted(parent, (a, b)).tolist()
                    levels.append((parent[c:d] - a, word[c:d], n[c:d]))
                    a, b = c, d
                yield r, Trie(root, counts, levels)

    def stored(self) -> dict[str, bytes]:
        narrow = [self.root, self.counts.astype(np.uint32)] + [x for p, w, n in self.levels for x in (p.astype(np.uint32), w, n.astype(np.uint32))]
        return {"root": narrow[0].tobytes(), "nodes": np.array([len(x) for x in narrow[2::3]], np.uint32).tobytes() + b"".join(x.tobytes() for x in narrow[1:])}

    @classmethod
    def loaded(cls, root: bytes, nodes: bytes) -> Trie:
        pairs = np.frombuffer(root, U64).reshape(-1, 2)
        sizes = np.frombuffer(nodes, np.uint32, MOST_WORDS - 2).tolist()
        at = 4 * len(sizes)

        def take(n: int, kind) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(nodes, kind, n, at)
            at += out.nbytes
            return out

        counts = take(len(pairs), np.uint32).astype(np.int64)
        return cls(pairs, counts, [(take(n, np.uint32).astype(np.int64), take(n, U64), take(n, np.uint32).astype(np.int64)) for n in sizes])

    def walk(self, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each depth from two on, the nodes counted often enough: their words, their counts, and the counts of their ancestors from two words on."""
        words, counts, left = self.root, self.counts, np.zeros((len(self.root), 0), np.int64)
        yield words[counts >= least], counts[counts >= least], left[counts >= least]
        for parent, word, n in self.levels:
            own = n >= least
            words, left = np.column_stack([words[parent], word]), np.column_stack([left[parent], counts[parent]])
            counts = n
            yield words[own], counts[own], left[own]


def grown(docs: DataFrame, bits: int, frequent, most: int = GATHERED) -> DataFrame:
    """(lang, range, root, nodes) of the tasks' tries of what consists of frequent pairs; and (hashes, spelled) of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size, known = 0, np.zeros(0, U64)

        def tries() -> Iterator[pa.RecordBatch]:
            for name, runs in kept.items():
                trie = Trie.of_paths(*(np.concatenate(x) for x in zip(*runs, strict=True)))
                for r, piece in trie.cut(bits):
                    yield pa.RecordBatch.from_pylist([{"lang": name, "range": r, **piece.stored()}], GROWN)
            kept.clear()

        for part, raw, offsets in text_slices(batches):
            found = Found(part, raw, offsets)
            if len(found.hash) < 2:
                continue
            pair = found.joined.copy()
            i = np.flatnonzero(pair)
            pair[i] = passes(frequent.value, marks(below(found.id[i], found.hash[i + 1]), found.code[i]))
            chain = np.concatenate([pair, np.zeros(MOST_WORDS, bool)])
            i = np.flatnonzero(pair)
            length, runs_on = np.full(len(i), 2), np.ones(len(i), bool)
            for step in range(1, MOST_WORDS - 1):
                runs_on &= chain[i + step]
                length += runs_on
            padded = np.concatenate([found.hash, np.zeros(MOST_WORDS, U64)])
            words = padded[i[:, None] + np.arange(MOST_WORDS)]
            for k, name in enumerate(found.langs):
                own = found.lang[i] == k
                if own.any():
                    kept.setdefault(name, []).append((words[own], length[own]))
            # The spelling of words that this task has not told yet.
            fresh, at = np.unique(found.hash[np.union1d(i, i + 1)], return_index=True)
            at = np.union1d(i, i + 1)[at]
            new = ~np.isin(fresh, known, assume_unique=True)
            if new.any():
                known = np.union1d(known, fresh[new])
                yield pa.RecordBatch.from_pylist([{"hashes": fresh[new].view(np.int64).tolist(), "spelled": [found.spelled(x) for x in at[new]]}], GROWN)
            size += len(i)
            if size >= most:
                yield from tries()
                size = 0
        yield from tries()

    return docs.mapInArrow(run, "lang string, range int, root binary, nodes binary, hashes array<long>, spelled array<binary>")


GROWN = pa.schema([("lang", pa.string()), ("range", pa.int32()), ("root", pa.binary()), ("nodes", pa.binary()), ("hashes", pa.list_(pa.int64())), ("spelled", pa.list_(pa.binary()))])


def candidates(runs: DataFrame, least: int) -> DataFrame:
    """(lang, id, words, a, left, first, parent, links): phrases of two words or more in the merged tries, with their ancestors' counts, the hashes of their
    first word and of their parent, and their suffix links, the hashes of the phrase without its first words."""

    def merged(table: pa.Table) -> pa.Table:
        lang = table.column("lang")[0].as_py()
        trie = Trie.merge([Trie.loaded(r.as_py(), n.as_py()) for r, n in zip(table.column("root"), table.column("nodes"), strict=True)])
        parts = []
        for words, a, left in trie.walk(least):
            k = words.shape[1]
            links = np.column_stack([path(words[:, j:]) for j in range(1, k)]).view(np.int64)
            parts.append(pa.table([pa.array([lang] * len(a), pa.string()), pa.array(path(words).view(np.int64)), _lists(words.view(np.int64)), pa.array(a), _lists(left), pa.array(mix64(words[:, 0]).view(np.int64)), pa.array(path(words[:, :-1]).view(np.int64)), _lists(links)], ["lang", "id", "words", "a", "left", "first", "parent", "links"]))
        return pa.concat_tables(parts)

    return runs.where("root IS NOT NULL").groupBy("lang", "range").applyInArrow(merged, "lang string, id long, words array<long>, a long, left array<long>, first long, parent long, links array<long>")


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(np.ascontiguousarray(rows).ravel()))


def scored(phrases: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, id, words, a, l, r, n, score) of the phrases' lowest cuts, for (lang, id, f) of frequent words and (lang, n)."""
    nodes = words.select("lang", "id", "f").union(phrases.select("lang", "id", F.col("a").alias("f")))
    left = phrases.join(words.select("lang", F.col("id").alias("first"), F.col("f").alias("one")), ["lang", "first"])
    cuts = left.select("lang", "id", "a", F.concat(F.array("one"), "left").alias("left"), F.posexplode("links").alias("at", "link"))
    cuts = cuts.join(nodes.select("lang", F.col("id").alias("link"), F.col("f").alias("r")), ["lang", "link"]).join(totals, "lang")
    cuts = cuts.withColumn("l", F.element_at("left", F.col("at") + 1)).withColumn("score", F.expr("(CAST(1000 AS DECIMAL(4,0)) * (CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0)))) DIV (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"))
    lowest = cuts.groupBy("lang", "id").agg(F.min(F.struct("score", "at", "l", "r", "n")).alias("low"))
    return phrases.select("lang", "id", "words", "a").join(lowest, ["lang", "id"]).select("lang", "id", "words", "a", "low.l", "low.r", "low.n", "low.score")


def mine(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, shown: int = SHOWN, gathered: int = GATHERED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases."""
    spark = docs.sparkSession
    sc, folder = spark.sparkContext, checkpoint_dir(spark)
    rows = docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), docs[text].alias("text")).where("text IS NOT NULL")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = (max(LEAST_RANGES, size // RANGE_BYTES) - 1).bit_length()
    runs = written(counted(rows, bits, most=gathered), f"{folder}/words")
    totals = checkpointed(runs.groupBy("lang").agg(F.sum("n").alias("n")))
    words = checkpointed(frequent_ids(runs, least))
    pairs = checkpointed(frequent_ids(counted(rows, bits, sc.broadcast(id_filter(words, "mark")), gathered), least))
    tries = written(grown(rows, bits, sc.broadcast(id_filter(pairs, "mark")), gathered), f"{folder}/tries")
    phrases = checkpointed(candidates(tries, least))
    # A candidate of k words has two parts of k - 1: its parent in the trie and its first suffix link.
    parts = phrases.where(F.size("words") > 2).select("lang", "a", F.explode(F.array("parent", F.col("links")[0])).alias("id"))
    longer = parts.groupBy("lang", "id").agg(F.max("a").alias("most"))
    kept = scored(phrases, words, totals).join(longer, ["lang", "id"], "left").where("most IS NULL OR 100 * most < 100 * a").drop("most")
    first = kept.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("place") <= shown)
    first = checkpointed(first.drop("place"))
    asked = first.select(F.explode("words").alias("hash")).distinct()
    asked = F.broadcast(asked) if asked.count() <= MOST_BROADCAST else asked
    told = tries.where("hashes IS NOT NULL").select(F.explode(F.arrays_zip("hashes", "spelled")).alias("x")).select(F.col("x.hashes").alias("hash"), F.col("x.spelled").alias("word"))
    spelled = told.join(asked, "hash", "left_semi").groupBy("hash").agg(F.min("word").alias("word"))
    letters = first.select("lang", "id", F.posexplode("words").alias("at", "hash")).join(spelled, "hash").groupBy("lang", "id").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w"))
    phrase = F.array_join(F.transform("w", lambda x: F.decode(x["word"], "UTF-8")), " ")
    named = first.join(letters, ["lang", "id"]).withColumn("phrase", phrase)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= shown)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: DuckDB SQL for `mine`, over `documents`.
SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM listed, range(1, {MOST_WORDS + 1}) AS r(k))),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM listed GROUP BY lang),
freq AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.f AS a, j, l.f AS l, r.f AS r, n, (CAST(1000 AS HUGEINT) * c.f * n) // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM freq c JOIN range(1, {MOST_WORDS}) AS x(j) ON j < c.k
  JOIN freq l ON l.lang = c.lang AND l.phrase = array_to_string(string_split(c.phrase, ' ')[1 : j], ' ')
  JOIN freq r ON r.lang = c.lang AND r.phrase = array_to_string(string_split(c.phrase, ' ')[j + 1 :], ' ')
  JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
kept AS (SELECT * FROM lowest c WHERE NOT EXISTS (SELECT 1 FROM freq g WHERE g.lang = c.lang AND g.k > c.k AND 100 * g.f >= 100 * c.a AND contains(' ' || g.phrase || ' ', ' ' || c.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= {SHOWN}"""
