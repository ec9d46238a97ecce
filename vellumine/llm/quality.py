"""Quality rules: whole-text counts, and a calibrated logistic regression over hashed word and character n-grams.

A text's features are the shares of its hashed words, word pairs and 4-character windows; each of
these families is divided by its number of occurrences, so a text's length doesn't matter. Weights
are fitted on at most MOST_LABELLED labelled rows of at most LONGEST_LABELLED bytes (those first by the MD5 of their id, one
for each id), a quarter of which is held back to calibrate probabilities by a two-parameter logistic curve. Scoring is one pass over the
documents in Arrow batches, against the fixed threshold LEAST_GOOD.

Null and empty texts have no words and so fail the base rule. Repeated rows are judged alike. Without
labels of both kinds there is no model, and the base rule alone decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, U64, Words, guarded, mix64, repeated, row_sums, span_hash, text_slices, with_text_columns

#: The most labelled rows that are fitted, and the most bytes that such a row's text has: together they bound what the driver gathers.
MOST_LABELLED, LONGEST_LABELLED = 2_000, 1 << 15
#: A document stays if its calibrated probability of being good is this or more.
LEAST_GOOD = 0.3
#: Hashed features, by power of two.
BITS = 18
LEAST_WORDS, WINDOW, MOST_REPEATED_PERCENT = 20, 8, 30
FAMILIES = 3

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CHAR_MUL = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_SEEDS = [U64(0x243F6A8885A308D3), U64(0x13198A2E03707344)]


@dataclass(frozen=True)
class Model:
    """Weights of the hashed features, the bias, and the calibration's slope and shift."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def counts(words: Words) -> dict[str, np.ndarray]:
    """The base counts of each text of a slice; `words` keeps letter case."""
    raw, offsets = words.raw, words.offsets
    n_words = np.diff(words.bounds)
    word_chars = row_sums(~IS_SPACE[raw] & ((raw & 0xC0) != 0x80), offsets)
    n_symbols = row_sums(_SYMBOL[raw], offsets)
    # Lines: a text's start or the byte after a newline, up to the next newline or the text's end.
    breaks = np.flatnonzero(raw == 10)
    row_of_break = np.searchsorted(offsets, breaks, side="right") - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    row = np.concatenate([np.arange(len(offsets) - 1), row_of_break])
    order = np.lexsort((starts, row))
    starts, row = starts[order], row[order]
    last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
    ends = np.where(last, offsets[1:][row], np.append(starts[1:], 0) - 1) if len(row) else starts
    word_at = np.zeros(len(raw) + 1, dtype=np.int64)
    word_at[words.starts] = 1
    before = np.concatenate([[0], np.cumsum(word_at)])
    solid = before[ends] - before[starts] > 0
    later, _ = repeated(row[solid], span_hash(words.sums, starts[solid], ends[solid]))
    n_dup_lines = np.bincount(row[solid][later], minlength=len(n_words)) if len(n_words) else n_words
    h, owner, first = words.shingles(WINDOW)
    _, twice = repeated(owner, h)
    cover = np.zeros(len(words.hash) + 1, dtype=np.int64)
    np.add.at(cover, first[twice], 1)
    np.add.at(cover, first[twice] + WINDOW, -1)
    n_repeat = row_sums(np.cumsum(cover[:-1]) > 0, words.bounds)
    failed = (n_words < LEAST_WORDS) | (100 * n_repeat > MOST_REPEATED_PERCENT * n_words)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat, "base_failed": failed}


def families(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family, the feature of every occurrence and the cuts between texts: words, word pairs, 4-character windows."""
    shift = U64(64 - BITS)
    one = mix64(words.hash + _SEEDS[0]) >> shift
    pair = np.zeros(len(words.hash), dtype=U64)
    if len(pair) > 1:
        pair[:-1] = mix64(words.hash[:-1] * _CHAR_MUL[0] + words.hash[1:] + _SEEDS[1]) >> shift
    chars = np.frombuffer(words.raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32).astype(U64)
    heads = np.zeros(len(words.raw) + 1, dtype=np.int64)
    np.cumsum((words.raw & 0xC0) != 0x80, out=heads[1:])
    cuts = heads[words.offsets]
    m = max(0, len(chars) - 3)
    window = np.zeros(len(chars), dtype=U64)
    for j in range(4):
        window[:m] += chars[j : m + j] * _CHAR_MUL[j]
    window[:m] >>= shift
    return [(one, words.bounds), (pair, words.bounds), (window, cuts)]


#: Occurrences at the end of a text that belong to no pair or window.
_TAILS = (0, 1, 3)


def margins(words: Words, model: Model) -> np.ndarray:
    """The uncalibrated log odds of each text of a slice."""
    out = np.full(len(words.offsets) - 1, model.bias)
    for (feature, cuts), tail in zip(families(words), _TAILS, strict=True):
        total = np.concatenate([[0.0], np.cumsum(model.weights[feature].astype(np.float64))])
        n = np.maximum(np.diff(cuts) - tail, 0)
        out += np.where(n > 0, (total[cuts[:-1] + n] - total[cuts[:-1]]) / np.maximum(n, 1), 0.0)
    return out


def labelled(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """(text, quality) of the bounded sample that is fitted. An id that is labelled twice has its least quality, one that several rows have its least text; null labels don't count."""
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").where(F.octet_length(F.coalesce("text", F.lit(""))) <= LONGEST_LABELLED).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("text", "quality")


def _sample_features(sample: DataFrame) -> DataFrame:
    """(quality, index, value): each row's features and their shares, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in text_slices(batches):
            words = Words(raw, offsets, fold=False)
            rows = []
            found = families(words)
            for i in range(len(offsets) - 1):
                index, value = [], []
                for (feature, cuts), tail in zip(found, _TAILS, strict=True):
                    own = feature[cuts[i] : max(cuts[i], cuts[i + 1] - tail)]
                    if len(own):
                        at, n = np.unique(own, return_counts=True)
                        index.append(at.astype(np.int32))
                        value.append((n / len(own)).astype(np.float32))
                rows.append((np.concatenate(index).tobytes(), np.concatenate(value).tobytes()) if index else (b"", b""))
            yield pa.RecordBatch.from_arrays([part.column(1).cast(pa.int32()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["quality", "index", "value"])

    return sample.mapInArrow(run, "quality int, index binary, value binary")


#: Features that the fit looks at together.
_BLOCK = 1 << 19


def _weighed(index, value, row, w: np.ndarray, n: int) -> np.ndarray:
    """Each row's sum of its features' weights, a block of features at a time."""
    z = np.zeros(n)
    for a in range(0, len(index), _BLOCK):
        z += np.bincount(row[a : a + _BLOCK], weights=w[index[a : a + _BLOCK]] * value[a : a + _BLOCK], minlength=n)
    return z


def _descend(index, value, row, y, penalty: float, rounds: int) -> tuple[np.ndarray, float]:
    """Adam over the whole sample, classes weighted alike."""
    size = 1 << BITS
    w, b = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    for t in range(1, rounds + 1):
        z = _weighed(index, value, row, w, len(y)) + b
        err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * share
        g = penalty * w
        for a in range(0, len(index), _BLOCK):
            g += np.bincount(index[a : a + _BLOCK], weights=err[row[a : a + _BLOCK]] * value[a : a + _BLOCK], minlength=size)
        gb = err.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.3 * (1 - t / (rounds + 1))
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w, b


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through held-out log odds, by Newton steps; smoothed targets keep it finite."""
    pos = y.sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (len(y) - pos + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -40, 40)))
        s = p * (1 - p) + 1e-9
        g = np.array([((p - target) * z).sum() + 1e-3 * (a - 1), (p - target).sum()])
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, c = a - step[0], c - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return (float(a), float(c)) if a > 0 else (1.0, 0.0)


def _fitted(rows: list[tuple[int, np.ndarray, np.ndarray]], penalty: float, rounds: int) -> Model | None:
    y = np.array([q for q, _, _ in rows], dtype=np.int64)
    held = np.arange(len(rows)) % 4 == 3
    if len(rows) < 8 or len(set(y[~held].tolist())) < 2:
        return None

    def flat(which):
        own = [rows[i] for i in np.flatnonzero(which)]
        return np.concatenate([r[1] for r in own]), np.concatenate([r[2] for r in own]), np.repeat(np.arange(len(own), dtype=np.int32), [len(r[1]) for r in own])

    w, b = _descend(*flat(~held), y[~held], penalty, rounds)
    slope, shift = 1.0, 0.0
    if len(set(y[held].tolist())) == 2:
        index, value, row = flat(held)
        slope, shift = _calibrate(_weighed(index, value, row, w, int(held.sum())) + b, y[held])
    return Model(w.astype(np.float32), float(b), slope, shift)


def fit(sample: DataFrame, penalty: float = 1e-6, rounds: int = 60) -> Model | None:
    """The model of a bounded labelled sample, or None if a class is missing in it. One task gathers the sample and fits; the driver gets the weights alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = [(bytes(i), int(q > 0), bytes(v)) for batch in batches for q, i, v in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        packed.sort()
        model = _fitted([(q, np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for i, q, v in packed], penalty, rounds)
        if model is not None:
            yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), *(pa.array([x]) for x in (model.bias, model.slope, model.shift))], ["weights", "bias", "slope", "shift"])

    found = _sample_features(sample).repartition(1).mapInArrow(run, "weights binary, bias double, slope double, shift double").collect()  # one row of 2**BITS numbers
    return Model(np.frombuffer(found[0][0], np.float32), *found[0][1:]) if found else None


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, p_good double, kept boolean"


def score(docs: DataFrame, model: Model | None, least_good: float = LEAST_GOOD, keep: list[str] | None = None) -> DataFrame:
    """The rows with FIELDS; `p_good` is null without a model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**18 numbers of 4 bytes

    def make(raw: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        words = Words(raw, offsets, fold=False)
        base = counts(words)
        failed = base.pop("base_failed")
        if shared.value is None:
            p, good = pa.nulls(len(failed), pa.float64()), ~failed
        else:
            probability = shared.value.probability(margins(words, shared.value))
            p, good = pa.array(np.round(probability, 6)), ~failed & (probability >= least_good)
        return [*(pa.array(x.astype(np.int64)) for x in base.values()), pa.array(failed), p, pa.array(good)]

    return with_text_columns(docs, FIELDS, make, keep=keep)


def judge(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Fit on the labelled rows among the documents, then score all of them."""
    return score(docs, fit(labelled(docs, labels)), keep=keep)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the rules keep, with their own columns, whatever these are called."""
    inside, restored = guarded(docs, ["text"])
    return restored(score(inside, fit(labelled(docs, labels))).where("kept"))
