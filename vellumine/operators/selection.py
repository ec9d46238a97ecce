"""Selections: diverse greedy picks, quotas, skylines, questions for a person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine import params


def flagship_quota(df: DataFrame, profile: params.Profile = params.PROFILES["default-photo"]) -> DataFrame:
    """(candidates, quota): a share of all rows rounded half to even, between 1 and a most."""
    share, most = profile.limits["flagship_top_fraction"], profile.limits["flagship_max_total"]
    return df.agg(F.count("*").alias("candidates")).select("candidates", F.greatest(F.lit(1.0), F.least(F.lit(most), F.bround(F.col("candidates") * share))).cast("long").alias("quota"))


def strongest_per_genre(df: DataFrame, genre: str = "genre", relevance: str = "relevance", key: str = "key") -> DataFrame:
    """(genre, key, relevance): the most relevant of each genre, the least key among equals."""
    return df.groupBy(genre).agg(F.max_by(F.struct(key, relevance), F.struct(relevance, -F.col(key))).alias("b")).select(genre, f"b.{key}", f"b.{relevance}")


def select_diverse(df: DataFrame, limit: int, lambda_: float = 0.65, most_per_genre: int | None = None, ahead: int = 64) -> DataFrame:
    """(key, pick, score, redundancy): greedy maximal marginal relevance over (key, relevance, genre, vector), keys unique.

    Every row is a candidate in every round. A pass over all rows values them against the picks so far and brings
    the best `ahead` to the driver with the next one's value. Values only fall, so what is better than that
    one there is the best of all, and is picked without another pass; each pass gives one pick at least.
    Likeness is that of the vectors, with a shared genre's addition.
    """
    import numpy as np
    import pandas as pd

    from vellumine.functions.vectors import EMBEDDING_FLOOR, SAME_GENRE
    from vellumine.operators.graph import checkpointed

    schema = "key long, pick long, score double, redundancy double"
    if limit <= 0:
        return df.sparkSession.createDataFrame([], schema)

    def units(vectors: list) -> np.ndarray:
        v = np.stack(vectors).astype(float)
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)

    def likeness(v: np.ndarray, genre: np.ndarray, pick: tuple[np.ndarray, object]) -> np.ndarray:
        # Row sums, so that a row's value doesn't depend on the others in its batch.
        near = np.clip(((v * pick[0]).sum(axis=1) - EMBEDDING_FLOOR) / (1 - EMBEDDING_FLOOR), 0, 1) + np.where(genre == pick[1], SAME_GENRE, 0)
        return np.round(np.minimum(1, near), 4)

    def value(relevance: np.ndarray, worst: np.ndarray) -> np.ndarray:
        return lambda_ * (relevance / 100) - (1 - lambda_) * worst

    def best(keys: set, picks: list, full: set):
        def run(batches):
            top = None
            for pdf in batches:
                pdf = pdf[~pdf["key"].isin(keys) & ~pdf["genre"].isin(full)]
                if pdf.empty:
                    continue
                v, genre, worst = units(pdf["vector"].to_list()), pdf["genre"].to_numpy(), np.zeros(len(pdf))
                for pick in picks:
                    worst = np.maximum(worst, likeness(v, genre, pick))
                pdf = pdf.assign(worst=worst, value=value(pdf["relevance"].to_numpy(float), worst))
                top = (pdf if top is None else pd.concat([top, pdf])).sort_values(["value", "key"], ascending=[False, True]).head(ahead + 1)
            if top is not None:
                yield top

        return run

    rows = checkpointed(df.select("key", F.col("relevance").cast("double").alias("relevance"), "genre", F.col("vector").cast("array<double>").alias("vector")))
    wide = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes) + ", worst double, value double"
    keys, picks, used, full, out = set(), [], {}, set(), []
    while len(out) < limit:
        found = rows.mapInPandas(best(keys, picks, full), wide).orderBy(F.desc("value"), "key").limit(ahead + 1).collect()
        if not found:
            break
        # Others are at most as good as the last one found; it stands for them.
        bound = (-found[-1].value, found[-1].key) if len(found) > ahead else None
        v, genre, key = units([r.vector for r in found]), np.array([r.genre for r in found], dtype=object), np.array([r.key for r in found])
        relevance, worst, free = np.array([r.relevance for r in found]), np.array([r.worst for r in found]), np.ones(len(found), dtype=bool)
        first = True
        while len(out) < limit and free.any():
            now = np.where(free, value(relevance, worst), -np.inf)
            i = int(np.lexsort((key, -now))[0])
            if not first and bound is not None and (-now[i], key[i]) > bound:
                break
            first = False
            free[i] = False
            out.append((int(key[i]), len(out) + 1, round(float(now[i]), 6), round(float(worst[i]), 4)))
            keys.add(int(key[i]))
            picks.append((v[i], genre[i]))
            used[genre[i]] = used.get(genre[i], 0) + 1
            if most_per_genre and used[genre[i]] >= most_per_genre:
                full.add(genre[i])
                free &= genre != genre[i]
            worst = np.maximum(worst, likeness(v, genre, picks[-1]))
    return df.sparkSession.createDataFrame(out, schema)


def skyline(df: DataFrame, group: str, key: str, larger_is_better: list[str], tolerance: float = 1e-9) -> DataFrame:
    """The rows of each group that no other row of it dominates: at least as good everywhere and better somewhere.

    Groups are candidate sets of one asset, so a group is small: each row is compared with the group's values beside it. The rows are worked out and shuffled once, as a join with themselves would not.
    """
    them = F.collect_list(F.struct(key, *larger_is_better)).over(Window.partitionBy(group))

    def dominates(other: Column) -> Column:
        met, above = F.lit(True), F.lit(False)
        for c in larger_is_better:
            met = met & (other[c] >= F.col(c) - tolerance)
            above = above | (other[c] > F.col(c) + tolerance)
        return (other[key] != F.col(key)) & met & above

    beaten = F.col(group).isNotNull() & F.exists("_them", dominates)
    return df.withColumn("_them", them).where(~F.coalesce(beaten, F.lit(False))).drop("_them")


def top_per(df: DataFrame, group: str, order: list, n: int, name: str = "place") -> DataFrame:
    """The first n rows of each group with their place."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).where(F.col(name) <= n)


def questions(df: DataFrame, limit: int = 12) -> DataFrame:
    """(kind, key, value): what to ask about, most valuable first, each once. Reads key, score, undecided, known_genre."""
    kinds = [("undecided", F.col("undecided"), 1.0), ("new_genre", ~F.col("known_genre"), 0.9), ("boundary", F.abs(F.col("score") - 45) <= 6, 0.85)]
    each = F.filter(F.array(*(F.when(rule, F.struct(F.lit(k).alias("kind"), F.lit(v).alias("value"))) for k, rule, v in kinds)), lambda x: x.isNotNull())
    return df.select("key", F.explode(each).alias("q")).select("q.kind", "key", "q.value").distinct().orderBy(F.desc("value"), "kind", "key").limit(limit)
