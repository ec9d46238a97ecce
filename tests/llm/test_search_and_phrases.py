"""Inverted treaps against scores of every document; collocations against counts of every phrase; both against their SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from vellumine.llm import collocations, treaps

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def slow_search(docs, items, k=20):
    bags = [Counter(terms(t)) for _, t in docs]
    n, total = sum(map(bool, bags)), sum(b.total() for b in bags)
    df = Counter(t for b in bags for t in b)
    out = []
    for item, text in items:
        asked, scored = Counter(terms(text)), []
        for (doc, _), bag in zip(docs, bags, strict=True):
            m = 75 + (25 * bag.total() * n) // total if total else 0
            score = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m)) for t, c in asked.items() if bag[t])
            if score:
                scored.append((-score, doc is None, doc, score))
        out += [(item, r + 1, s[2], s[3]) for r, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def some_docs(n=600):
    random.seed(4)
    words = [f"w{i}" for i in range(60)] + ["É", "日本", "a1"]
    chance = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(random.choices(words, chance, k=random.randint(0, 40)))) for i in range(n)]
    docs += [(n + i, "W3, w4!w5") for i in range(90)] + [(None, "w3 w4 w5"), (None, None), (7, "w3 w4 w5"), (7, "w3 w4 w5"), (n + 200, "w9 " * 5000), (n + 201, "..\x00 \n")]
    return docs


def run_search(spark, docs, items, **more):
    got = treaps.search(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, term string"), spark.createDataFrame(items, "item_id long, text string"), **more)
    return sorted(((r.item_id, r[1], r.doc_id, r.score) for r in got.collect()), key=str)


ITEMS = [(1, "w1 w2 w3"), (2, "w50 É w50 日本"), (3, "nothing here"), (4, None), (5, "..."), (None, "w9 w59"), (6, "W3 w4 w5"), (8, " ".join(f"w{i}" for i in range(60)))]


def test_search(spark):
    docs = some_docs()
    want = slow_search(docs, ITEMS)
    assert run_search(spark, docs, ITEMS) == want
    assert run_search(spark, docs, ITEMS + ITEMS[:3], most_terms=20) == want
    documents = pd.DataFrame({"doc_id": range(len(docs)), "text": [t for _, t in docs]})  # noqa: F841
    benchmark = pd.DataFrame(ITEMS[:5], columns=["item_id", "text"])  # noqa: F841
    own = slow_search([(i, t) for i, (_, t) in enumerate(docs)], ITEMS[:5])
    assert sorted(duckdb.sql(treaps.SQL).fetchall(), key=str) == own


def test_search_of_little(spark):
    assert run_search(spark, [], ITEMS) == run_search(spark, [(1, None), (2, "...")], ITEMS) == run_search(spark, [(1, "a")], []) == []
    assert run_search(spark, [(3, "b"), (1, "a b"), (2, "b")], [(1, "a"), (1, "b")]) == slow_search([(3, "b"), (1, "a b"), (2, "b")], [(1, "a"), (1, "b")])


@pytest.mark.parametrize("shape", ["random", "rising", "equal"])
def test_treaps(shape):
    """Heap order and search order hold, nothing that counts is pruned, and something is."""
    rng = np.random.default_rng(1)
    n, scanned = 5000, []
    dfs = np.array([n, 700, 33, 1])
    docs = np.concatenate([np.sort(rng.choice(n, d, replace=False)) for d in dfs])
    impacts = {"random": lambda: rng.integers(1, 10**6, len(docs)), "rising": lambda: docs + 1, "equal": lambda: np.full(len(docs), 9)}[shape]()
    t = treaps.Treaps(np.arange(4), dfs, docs, impacts, n)
    for i in range(len(t.best) - 1):
        for child, side in ((t.left[i], -1), (t.right[i], 1)):
            assert child == -1 or (t.best[child] <= t.best[i] and (t.first[child] - t.first[i]) * side > 0)
    weights = np.array([3, 10, 500, 7])
    full = np.zeros(n, np.int64)
    for k in range(4):
        full[docs[t.bounds[k] : t.bounds[k + 1]]] += weights[k] * impacts[t.bounds[k] : t.bounds[k + 1]]
    order = np.lexsort((np.arange(n), -full))[:20]
    plain = t.scores
    t.scores = lambda which, w, leaves, into: (scanned.append(len(leaves)), plain(which, w, leaves, into))
    for least in (0, int(full[order[-1]])):
        found, score = t.search(np.arange(4), weights, 20, least)
        assert found.tolist() == order.tolist() and score.tolist() == full[order].tolist()
    if shape == "random":
        assert scanned[-1] < n // treaps.LEAF


def slow_phrases(rows, least, shown):
    counts, n = {}, Counter()
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            own = counts.setdefault(lang, Counter())
            own.update(tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    out = []
    for lang, own in counts.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in found.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, _, left, right = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows_)[:shown])]
    return sorted(out)


def phrase_rows(n=120):
    random.seed(11)
    words = ["the", "of", "a", "é", "x\x00y", "日本", "end", "Word"]
    chance = [8, 4, 3, 2, 1, 1, 1, 1]

    def text():
        return "".join(random.choices(words, chance)[0] + random.choice([" ", " ", " ", "\t", ". ", "\x0b", ", "]) for _ in range(random.randint(0, 60)))

    rows = [(i, random.choice(["en", "en", "fr", None]), text()) for i in range(n)]
    return rows + [(1, "en", None), (None, "en", "Once upon a Time there was"), *[(n + i, "de", "once upon a time there was") for i in range(12)], (n + 50, "fr", "the of " * 3000), (n + 51, "zz", "only one"), (n + 52, "zz", ""), (n + 53, None, " .. \n")]


@pytest.mark.parametrize("gathered", [collocations.GATHERED, 300])
def test_phrases(spark, gathered):
    rows = phrase_rows()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, lang string, text string, id string").repartition(3)
    for least, shown in ((5, 15), (12, 2000)):
        got = sorted(tuple(r) for r in collocations.mine(docs, least=least, shown=shown, gathered=gathered).collect())
        assert got == slow_phrases(rows, least, shown) and got


def test_phrases_by_sql(spark):
    rows = [r for r in phrase_rows() if r[2] is not None and "\x00" not in r[2]] * 3
    documents = pd.DataFrame({"lang": [r[1] for r in rows], "text": [r[2] for r in rows]})  # noqa: F841
    assert sorted(duckdb.sql(collocations.SQL).fetchall()) == slow_phrases(rows, collocations.LEAST, collocations.SHOWN)


def test_phrases_of_little(spark):
    kind = "lang string, text string"
    assert collocations.mine(spark.createDataFrame([], kind)).collect() == collocations.mine(spark.createDataFrame([("en", None), (None, "a b")], kind)).collect() == []
    got = collocations.mine(spark.createDataFrame([(None, "a b. " * 100)], kind)).collect()
    assert [tuple(r) for r in got] == [("und", 1, "a b", 100, 100, 100, 200, 2000)]


def test_tries_merge_alike():
    """Tries of parts, cut into ranges, stored and merged, count what one trie of all counts."""
    rng = np.random.default_rng(2)
    words, length = rng.integers(1, 4, (500, 5)).astype(np.uint64), rng.integers(2, 6, 500)
    whole = Counter(tuple(w[:k].tolist()) for w, n in zip(words, length, strict=True) for k in range(2, n + 1))
    pieces = {}
    for part in range(4):
        for r, piece in collocations.Trie.of_paths(words[part::4], length[part::4]).cut(2):
            pieces.setdefault(r, []).append(collocations.Trie.loaded(**piece.stored()))
    got, lefts = Counter(), {}
    for tries in pieces.values():
        for w, a, left in collocations.Trie.merge(tries).walk(1):
            for x, n, above in zip(w.tolist(), a.tolist(), left.tolist(), strict=True):
                assert tuple(x) not in got
                got[tuple(x)], lefts[tuple(x)] = n, above
    assert got == whole and all(lefts[p] == [whole[p[:k]] for k in range(2, len(p))] for p in whole)
