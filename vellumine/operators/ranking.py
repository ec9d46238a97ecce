"""Overlapping groups, pairwise wins, strengths, percentiles, and the repair of rankings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions.numbers import clamp_score

ITERATIONS, PRIOR = 60, 0.5
#: Axes up to which their mean strengths go through the driver between steps.
MOST_AT_DRIVER = 100_000
#: Edges that make up one row in `bradley_terry`, some 40 bytes each, and rows of which a task gets some.
EDGES_A_BLOCK, BLOCKS_A_PART = 1 << 14, 16


def numbered(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """The rows with their global position from 0, without gathering them: ranges are sorted apart and shifted by the counts before them."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    local = ranged.withColumn("_nth", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    from vellumine.operators.graph import checkpointed

    local = checkpointed(local)  # so that ranges are cut once
    sizes = local.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return local.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_nth")).drop("_part", "_nth", "_start")


def numbered_within(df: DataFrame, group: str, order: list[Column], name: str = "place") -> DataFrame:
    """The rows with their place from 1 within their group, of which one may hold most rows: global positions less where the group begins."""
    placed = numbered(df, [F.col(group), *order], "_position")
    starts = placed.groupBy(F.col(group).alias("_group")).agg(F.min("_position").alias("_start"))
    return placed.join(starts, F.col(group).eqNullSafe(F.col("_group"))).withColumn(name, (F.col("_position") - F.col("_start") + 1).cast("long")).drop("_position", "_group", "_start")


def ranking_groups(df: DataFrame, position: str, total: int, size: int = 12, overlap: int = 3) -> DataFrame:
    """A row for each member of each group: consecutive runs of `size` that share `overlap` with the one before.

    The last group ends with the rows; a remainder of one joins the group before it.
    """
    step = size - max(0, min(overlap, size - 1))
    last = 0 if total <= size else -(-(total - size) // step)
    p = F.col(position)
    least = F.greatest(F.lit(0), F.ceil((p - size + 1) / step)).cast("long")
    most = F.least(F.lit(last), F.floor(p / step)).cast("long")
    return df.withColumn("group_id", F.explode(F.sequence(F.least(least, F.lit(last).cast("long")), most)))


def pairwise_wins(ranked: DataFrame, group: str = "group_id", item: str = "item", rank: str = "rank") -> DataFrame:
    """(winner, loser, n): how often one item stands before another in a group; equal ranks give no pair. Groups are of bounded size."""
    a = ranked.select(group, F.col(item).alias("winner"), F.col(rank).alias("ra"))
    b = ranked.select(group, F.col(item).alias("loser"), F.col(rank).alias("rb"))
    return a.join(b, group).where("ra < rb").groupBy("winner", "loser").agg(F.count("*").alias("n"))


def bradley_terry(wins: DataFrame, axis: list[str] | None = None, iterations: int = ITERATIONS, prior: float = PRIOR, most_at_driver: int = MOST_AT_DRIVER, edges_a_block: int = EDGES_A_BLOCK) -> DataFrame:
    """(axis columns, item, strength) of (axis columns, winner, loser, n) by fixed majorisation steps, each axis by itself; after each step an axis's mean strength is 1.

    Two items that met have one edge, whichever won. Edges, in their ends' order, are cut into blocks of bounded size, which stay where they lie; a step sends each block its items' strengths and sums what the
    blocks give for an item, so no task sees an axis or an item whole. The driver gets the means of up to `most_at_driver` axes, to broadcast them; those of more are joined. Nothing else is broadcast between steps.
    """
    from vellumine.operators.graph import checkpointed

    axis = axis or []
    n = F.col("n").cast("double")
    ends = wins.select(*axis, F.least("winner", "loser").alias("i"), F.greatest("winner", "loser").alias("j"), n.alias("met"), F.when(F.col("winner") <= F.col("loser"), n).otherwise(0.0).alias("won_i")).where("i <> j")
    edges = checkpointed(ends.groupBy(*axis, "i", "j").agg(F.sum("met").alias("met"), F.sum("won_i").alias("won_i")))
    both = edges.select(*axis, F.explode(F.array(F.struct(F.col("i").alias("item"), F.col("won_i").alias("won")), F.struct(F.col("j").alias("item"), (F.col("met") - F.col("won_i")).alias("won")))).alias("x"))
    won = both.groupBy(*axis, F.col("x.item").alias("item")).agg((F.sum("x.won") + prior).alias("w"))
    items = checkpointed(numbered(won, [*map(F.col, axis), F.col("item")], "v"))
    for end in "ij":
        edges = edges.join(items.select(*axis, F.col("item").alias(end), F.col("v").alias(f"v{end}")).hint("merge"), [*axis, end])
    cut = numbered(edges.select("vi", "vj", "met"), [F.col("vi"), F.col("vj")], "nth").withColumn("block", F.floor(F.col("nth") / edges_a_block))
    blocks = checkpointed(cut.groupBy("block").applyInPandas(_packed, "block long, vs array<long>, i array<int>, j array<int>, met array<double>"))
    total = blocks.count()
    parts = max(1, min(total, max(edges.sparkSession.sparkContext.defaultParallelism, total // BLOCKS_A_PART)))
    # Kept by the keys that steps join by, so that only strengths and sums move.
    by_block, own = blocks.repartition(parts, "block").persist(), items.select("v", *axis, "w").repartition(parts, "v").persist()
    needs = blocks.select("block", F.posexplode("vs").alias("at", "v")).repartition(parts, "v").persist()
    few = not axis or items.select(*axis).distinct().count() <= most_at_driver
    shares = F.pandas_udf(_shares, "array<double>")
    strength = items.select("v", F.lit(1.0).alias("s"))
    for _ in range(iterations if total else 0):
        sent = needs.join(strength.repartition(parts, "v").hint("merge"), "v").select("block", F.struct("at", "s").alias("x")).repartition(parts, "block")
        told = by_block.join(sent.groupBy("block").agg(F.collect_list("x").alias("x")).hint("merge"), "block")
        given = told.select(F.explode(F.arrays_zip("vs", shares("i", "j", "met", "x.at", "x.s").alias("d"))).alias("x")).select(F.col("x.vs").alias("v"), F.col("x.d").alias("d"))
        sums = given.repartition(parts, "v").groupBy("v").agg(F.sum("d").alias("d"))
        raw = checkpointed(own.join(sums.hint("merge"), "v").select("v", *axis, (F.col("w") / (F.col("d") + prior)).alias("r")))
        means = raw.groupBy(*axis).agg(F.avg("r").alias("mean"))
        means = F.broadcast(means) if few else means.hint("merge")
        strength = (raw.join(means, axis) if axis else raw.crossJoin(means)).select("v", (F.col("r") / F.col("mean")).alias("s"))
    for kept in (by_block, own, needs):
        kept.unpersist()
    return items.join(strength.hint("merge"), "v").select(*axis, "item", F.col("s").alias("strength"))


def _packed(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block of edges as one row: the items in it, and its edges by their places among these."""
    vs, ends = np.unique(pdf[["vi", "vj"]].to_numpy(), return_inverse=True)
    i, j = ends.reshape(-1, 2).T.astype("int32")
    return pd.DataFrame({"block": pdf["block"].iloc[:1], "vs": [vs], "i": [i], "j": [j], "met": [pdf["met"].to_numpy()]})


def _shares(i: pd.Series, j: pd.Series, met: pd.Series, at: pd.Series, s: pd.Series) -> pd.Series:
    """For each item of a block the sum over its edges there of meetings by the ends' strengths."""
    out = []
    for i_, j_, met_, at_, s_ in zip(i, j, met, at, s, strict=True):
        own = np.empty(len(s_))
        own[at_] = s_
        share = met_ / (own[i_] + own[j_])
        out.append(np.bincount(i_, share, len(own)) + np.bincount(j_, share, len(own)))
    return pd.Series(out)


def bradley_terry_small(wins: DataFrame, axis: str, iterations: int = ITERATIONS, prior: float = PRIOR) -> DataFrame:
    """The same for many axes at once, each of some thousand edges: one NumPy kernel a group. (axis, item, strength)."""
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(np.concatenate([pdf["winner"], pdf["loser"]]))
        i, j, n = np.searchsorted(names, pdf["winner"]), np.searchsorted(names, pdf["loser"]), pdf["n"].to_numpy(float)
        won, s = np.bincount(i, n, len(names)) + prior, np.ones(len(names))
        for _ in range(iterations):
            share = n / (s[i] + s[j])
            s = won / (np.bincount(i, share, len(names)) + np.bincount(j, share, len(names)) + prior)
            s /= s.mean()
        return pd.DataFrame({axis: pdf[axis].iloc[0], "item": names, "strength": s})

    kinds = dict(wins.dtypes)
    return wins.groupBy(axis).applyInPandas(fit, f"{axis} {kinds[axis]}, item {kinds['winner']}, strength double")


def stitched(entries: DataFrame, axes: list[str], name: str = "name") -> DataFrame:
    """(name, axes): one scale from 0 to 100 over all items for each axis, rebuilt from stored replies (name, at, members, axes).

    A reply holds an item's ranks within the group that it was asked with, `members`. An item's first reply counts; so a group is what is left of it. Groups of two ranked items or more give
    wins, wins give strengths, and these, to 9 places and then by name, give percentiles. Items without a comparison keep the percentile of their rank within their group; a null rank with none stays null.
    The number of shuffles doesn't grow with the groups. Joins by name are merges, so that the driver gets no table of names to broadcast.
    """
    from vellumine.functions.numbers import rank_to_percentile
    from vellumine.operators.graph import checkpointed

    first = checkpointed(entries.groupBy(name).agg(F.min_by(F.struct("members", *axes), F.struct("at", "members")).alias("e")).select(F.col(name).alias("name"), "e.*"))
    ranks = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).cast("long").alias("rank")) for a in axes)))
    flat = first.select("name", F.xxhash64("members").alias("group_id"), F.size("members").alias("size"), ranks.alias("x")).select("name", "group_id", "size", "x.axis", "x.rank").where("rank IS NOT NULL")
    one = flat.select("axis", "group_id", F.col("name").alias("winner"), F.col("rank").alias("ra"))
    other = flat.select("axis", "group_id", F.col("name").alias("loser"), F.col("rank").alias("rb"))
    wins = one.join(other.hint("merge"), ["axis", "group_id"]).where("ra < rb").groupBy("axis", "winner", "loser").agg(F.count("*").alias("n"))
    strength = bradley_terry(wins, ["axis"]).withColumn("strength", F.bround("strength", 9))
    placed = numbered(strength, [F.col("axis"), F.desc("strength"), F.col("item")])
    ends = placed.groupBy("axis").agg(F.min("position").alias("start"), F.count("*").alias("total"))
    last = F.col("total") - 1
    score = F.when(last < 1, 100).otherwise(F.bround(100.0 * (last - (F.col("position") - F.col("start"))) / last)).cast("long")
    scored = placed.join(F.broadcast(ends), "axis").select("axis", F.col("item").alias("name"), score.alias("score"))
    own = flat.join(scored.hint("merge"), ["axis", "name"], "left").withColumn("score", F.coalesce("score", rank_to_percentile(F.col("rank"), F.col("size")).cast("long")))
    by_axis = own.groupBy("name").agg(*(F.max(F.when(F.col("axis") == a, F.col("score"))).alias(a) for a in axes))
    return first.select("name").join(by_axis.hint("merge"), "name", "left").withColumnRenamed("name", name)


def percentile_scores(df: DataFrame, position: str, total: int) -> DataFrame:
    """The rows with `percentile`: 100 for the first position, 0 for the last; 100 for a single row."""
    value = F.lit(100).cast("long") if total < 2 else clamp_score(100.0 * (total - 1 - F.col(position)) / (total - 1))
    return df.withColumn("percentile", value)


def repair_ranks(df: DataFrame, group: str = "group_id", value: str = "rank", place: str = "place", share: float = 0.25) -> DataFrame:
    """The rows with `repaired` and `was_repaired`: near-permutations are ranked anew by value and place, others stay."""
    g = Window.partitionBy(group)
    n = F.count("*").over(g)
    distinct = F.size(F.collect_set(value).over(g))
    df = df.withColumns({"_n": n, "_d": distinct.cast("long")})
    ok = F.size(F.array_intersect(F.collect_set(value).over(g), F.sequence(F.lit(1).cast("long"), F.col("_n")))).cast("long")
    df = df.withColumn("_missing", F.col("_n") - ok)
    collisions = F.col("_n") - F.col("_d")
    perfect = (F.col("_missing") == 0) & (collisions == 0)
    near = ~perfect & (F.greatest(collisions, F.col("_missing")) <= F.col("_n") * share)
    again = F.row_number().over(g.orderBy(value, place)).cast("long")
    return df.withColumns({"repaired": F.when(near, again).otherwise(F.col(value)), "was_repaired": near, "is_valid": perfect | near}).drop("_n", "_d", "_missing")


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """The rows with the average rank of their value (1 is least) among all rows, from counts of distinct values."""
    from vellumine.operators.graph import checkpointed

    # Ranges of values are summed apart and shifted by what lies before them, so that no task sees all values.
    counts = df.groupBy(value).agg(F.count("*").alias("_c")).repartitionByRange(F.col(value)).withColumn("_part", F.spark_partition_id())
    counts = checkpointed(counts)
    order = Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("_part").agg(F.sum("_c").alias("_n"))
    starts = parts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))  # a row for each partition
    ranks = counts.withColumn("_local", F.coalesce(F.sum("_c").over(order), F.lit(0))).join(F.broadcast(starts), "_part")
    return df.join(ranks.select(value, (F.col("_start") + F.col("_local") + (F.col("_c") + 1) / 2.0).alias(name)), value)


def spearman(df: DataFrame, x: str, y: str, degenerate: float = 0.0) -> DataFrame:
    """(n, rho): rank correlation with average ties, 4 places; `degenerate` where a side is constant or rows are fewer than two."""
    r = average_ranks(average_ranks(df.select(x, y), x, "_rx"), y, "_ry")
    s = r.agg(F.count("*").alias("n"), F.covar_pop("_rx", "_ry").alias("c"), F.var_pop("_rx").alias("vx"), F.var_pop("_ry").alias("vy"))
    rho = F.bround(F.try_divide(F.col("c"), F.sqrt(F.col("vx") * F.col("vy"))), 4)
    return s.select("n", F.coalesce(F.when(F.col("n") >= 2, rho), F.lit(degenerate)).alias("rho"))
