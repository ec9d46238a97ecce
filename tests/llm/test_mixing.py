"""Weighted fair queueing against a queue served document by document, and against its SQL."""

import hashlib
import random
import re

import duckdb
import pandas as pd

from vellumine.llm import mixing


def slow_mix(rows):
    """(key, text, source): epochs of each row, by one queue."""
    size = [len(re.findall(mixing.WORD, t or "")) for _, t, _ in rows]
    total = sum(size)
    names = sorted({s for _, _, s in rows if s is not None}) + [None] * any(s is None for _, _, s in rows)
    whole = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in names}
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    stopped = set()
    while True:
        rest, shares = total - 3 * sum(whole[s] for s in stopped), sum(weight[s] for s in names if s not in stopped)
        more = {s for s in names if s not in stopped and rest * weight[s] > 3 * whole[s] * shares}
        if not more:
            break
        stopped |= more
    target = {s: float(3 * whole[s]) if s in stopped else rest * weight[s] / shares if total else 0.0 for s in names}

    def draw(key, text):
        inner = hashlib.md5(text.encode()).hexdigest() if text is not None else ""
        return int(hashlib.md5(f"{'' if key is None else key}:{inner}".encode()).hexdigest()[:15], 16)

    queue = []
    for place, s in enumerate(names):
        upto = 0
        for i in sorted((i for i, r in enumerate(rows) if r[2] == s), key=lambda i: (draw(*rows[i][:2]), rows[i][0] is None, rows[i][0] or 0, size[i])):
            upto += size[i]
            queue += [((e * whole[s] + upto) / target[s], place, e * whole[s] + upto, i) for e in range(3)] if size[i] else []
    out, used = [0] * len(rows), 0
    for *_, i in sorted(queue):
        used += size[i]
        if used > total:
            break
        out[i] += 1
    return sorted(((r[0], n, whole[r[2]], target[r[2]], e, e * n) for r, n, e in zip(rows, size, out, strict=True)), key=str), target


def some_rows(n=400):
    random.seed(3)
    rows = [(i, " ".join("w" * random.randint(1, 4) for _ in range(random.randint(0, 60))), random.choice(["a", "a", "a", "é", "z", None])) for i in range(n)]
    return rows + [(n, "x " * 3000, "a"), (None, "one two", None), (None, None, "b"), (5, "one two", "a"), (5, "one two", "a"), (n + 1, "tiny", "tiny"), (n + 2, " \x0b\n", "blank")]


def as_rows(df):
    return sorted(((r.doc_id, r.size, r.source_size, r.target, r.epochs, r.taken) for r in df.collect()), key=str)


def test_mix(spark):
    rows = some_rows()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, size string, place int")
    want, target = slow_mix(rows)
    got = as_rows(mixing.mix(docs))
    assert got == want and got == as_rows(mixing.mix(docs.repartition(7)))
    assert target["tiny"] == 3.0 and abs(sum(target.values()) - sum(r[1] for r in got)) < 1e-6
    documents = pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": [r[1] for r in rows], "source": [r[2] for r in rows]})  # noqa: F841
    sql = duckdb.sql(mixing.SQL).fetchall()
    assert sorted(sql, key=str) == want


def test_each_source_comes_near_its_target(spark):
    rows = some_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    queued = mixing.queue(docs).collect()
    _, target = slow_mix(rows)
    for source, aim in target.items():
        own = [r for r in queued if r.source == source]
        assert abs(sum(r["size"] for r in own) - aim) <= max([0, *(r["size"] for r in own)])
    assert [r.finish for r in queued] == sorted(r.finish for r in queued) and max(r.epoch for r in queued) <= 2


def test_mix_of_little(spark):
    kind = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], kind)).collect() == []
    assert as_rows(mixing.mix(spark.createDataFrame([(1, None, None), (2, "", "a")], kind))) == [(1, 0, 0, 0.0, 0, 0), (2, 0, 0, 0.0, 0, 0)]
    assert as_rows(mixing.mix(spark.createDataFrame([(1, "a b", "s")], kind))) == [(1, 2, 2, 2.0, 1, 2)]


def test_no_python_on_the_main_path(spark):
    plan = mixing.mix(spark.createDataFrame(some_rows(20), "doc_id long, text string, source string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
