"""Mixing sources to target weights by weighted fair queueing, in DataFrame expressions only.

A document's size is its number of words. Sources by code point, null last, weigh 1, 2, 3 and so on around, and share all
words; no source's target passes MOST_EPOCHS times its size, and what is cut off there is shared out again by weight, until no
source is above. Each source's documents are shuffled by a hash; one that ends after c of its source's S words has, in the
source's e-th round, the virtual finish time (e S + c) / target. At time 1 every source has served its target. All rounds'
documents, in the order of (finish, source, words served), are taken until the next one would pass the total budget.

No task sees a whole source, and nothing is sorted that need not be:
- A source is cut into ranges of the hash, about as many as a range has documents; sums of ranges give each range's start, and
  a window within a range the rest.
- Virtual time is cut into ranges of equal length, which hold about equally many words whatever the sources' sizes. These are the
  partitions of the global order; their sums show in which the budget ends, and that one alone is sorted to find the last place taken.
`queue` gives the taken documents in the global order, range-sorted.

Null texts have no words; documents of size 0 are never taken. Null sources are one source, null keys are allowed. Rows of the
same key and text count each; which of them is taken once more than the other is open, as they are equal. An empty table gives no rows.
Virtual times are doubles of exact sums, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint_dir, written

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in their order, around and around.
WEIGHTS = (1, 2, 3)
#: How often a document may be taken.
MOST_EPOCHS = 3
#: Sources up to which their table (some 50 bytes a row) is broadcast; beyond, rows are joined by a shuffle.
MOST_BROADCAST = 100_000
_DRAW_BITS = 60


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, size, draw): the words of each text, and 60 bits by which its source is shuffled."""
    name = F.concat(F.coalesce(docs[key].cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(docs[text].cast("binary")), F.lit("")))
    draw = F.conv(F.substring(F.md5(name.cast("binary")), 1, _DRAW_BITS // 4), 16, 10).cast("long")
    return docs.select(docs[key].alias("key"), docs[source].alias("source"), F.coalesce(F.regexp_count(docs[text], F.lit(WORD)), F.lit(0)).cast("long").alias("size"), draw.alias("draw"))


def numbered(sources: DataFrame, folder: str) -> DataFrame:
    """The rows (source, ...) with `place`, from 0, by code point, null last: ranges are numbered apart and shifted by what lies before."""
    order = [F.col("source").isNull(), F.col("source")]
    ranged = written(sources.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), f"{folder}/ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return ranged.join(F.broadcast(starts), "range").withColumn("place", F.col("start") + F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1).drop("range", "start")


def targets(rows: DataFrame, folder: str) -> DataFrame:
    """(source, place, source_size, weight, target) for rows (source, size)."""
    sources = numbered(rows.groupBy("source").agg(F.sum("size").alias("source_size")), folder)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int")).cast("long")
    sources = written(sources.withColumn("weight", weight), f"{folder}/sources")
    most, wide = MOST_EPOCHS * F.col("source_size"), "decimal(38,0)"
    shared, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    total, above = shared, None
    # Shares only grow when others stop, so each round stops what is above and no source is freed again.
    while shared:
        above = most.cast("decimal(19,0)") * F.lit(weights).cast("decimal(19,0)") < F.lit(shared).cast("decimal(19,0)") * F.col("weight").cast("decimal(19,0)")
        rest = sources.agg((F.lit(total) - F.coalesce(F.sum(F.when(above, most)), F.lit(0))).cast("long"), F.sum(F.when(~above, F.col("weight")))).first()
        if rest == (shared, weights):
            break
        shared, weights = rest
    target = F.lit(0.0) if above is None else F.when(above, most.cast("double")).otherwise((F.lit(shared) * F.col("weight")).cast("double") / F.lit(float(weights)))
    return sources.withColumn("target", target)


def ranges_for(n: int) -> int:
    """Bits of a cut into about as many ranges as a range has rows."""
    return math.ceil(math.log2(max(n, 1)) / 2)


def served(rows: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    """The rows (key, source, size, draw) with what `targets` says of their source and `served`: its words up to the row's end, in the order of the draw."""
    few = sources.select(F.col("source").alias("_source"), "place", "source_size", "target")
    few = F.broadcast(few) if sources.count() <= MOST_BROADCAST else few
    cut = rows.join(few, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("cell", F.shiftright("draw", _DRAW_BITS - ranges_for(n)))
    sums = cut.groupBy("place", "cell").agg(F.sum("size").alias("_sum"))
    starts = sums.select("place", "cell", F.coalesce(F.sum("_sum").over(Window.partitionBy("place").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    order = Window.partitionBy("place", "cell").orderBy("draw", F.asc_nulls_last("key"), "size").rowsBetween(Window.unboundedPreceding, 0)
    return cut.join(starts, ["place", "cell"]).withColumn("served", F.col("_start") + F.sum("size").over(order)).drop("cell", "_start", "draw")


def _progress(epoch: Column | int) -> Column:
    return (F.lit(epoch) if isinstance(epoch, int) else epoch) * F.col("source_size") + F.col("served")


def _finish(progress: Column) -> Column:
    return progress.cast("double") / F.col("target")


def copies(placed: DataFrame) -> DataFrame:
    """A row for each document with words and each round, with its virtual `finish` time."""
    rounds = placed.where("size > 0").withColumn("epoch", F.explode(F.array(*(F.lit(e).cast("long") for e in range(MOST_EPOCHS)))))
    return rounds.withColumn("progress", _progress(F.col("epoch"))).withColumn("finish", _finish(F.col("progress")))


def last_place(placed: DataFrame, budget: int, n: int) -> tuple[int, float, tuple | None] | None:
    """(ranges a unit of time, first range not taken whole, last (finish, place, progress) taken in it); None where all is taken."""
    parts = 1 << ranges_for(n)
    cell = F.floor(F.col("finish") * parts)
    slowest = placed.where("size > 0").agg(F.max(MOST_EPOCHS * F.col("source_size") / F.col("target"))).first()[0]
    until = 2.0  # the budget ends a little after time 1, unless single documents are as large as their source's target
    while slowest is not None:
        sums = copies(placed).where(F.col("finish") <= until).groupBy(cell.alias("cell")).agg(F.sum("size").alias("n"))
        running = sums.select("cell", "n", F.sum("n").over(Window.orderBy("cell")).alias("upto"))  # a row for each range
        ends = running.where(F.col("upto") > budget).orderBy("cell").first()
        if ends is not None:
            inside = copies(placed).where(cell == ends["cell"])
            upto = F.sum("size").over(Window.orderBy("finish", "place", "progress"))
            taken = inside.select("finish", "place", "progress", upto.alias("upto")).where(F.col("upto") <= budget - (ends["upto"] - ends["n"]))
            last = taken.agg(F.max(F.struct("finish", "place", "progress"))).first()[0]
            return parts, ends["cell"], tuple(last) if last is not None else None
        if until >= slowest:
            break
        until *= 2
    return None


def _is_taken(cut: tuple | None, finish: Column, progress: Column) -> Column:
    if cut is None:
        return F.lit(True)
    parts, first, last = cut
    whole = F.floor(finish * parts) < first
    if last is None:
        return whole
    return whole | (F.struct(finish.alias("finish"), F.col("place").alias("place"), progress.alias("progress")) <= F.struct(F.lit(last[0]).alias("finish"), F.lit(last[1]).cast("long").alias("place"), F.lit(last[2]).cast("long").alias("progress")))


def _scheduled(docs: DataFrame, key: str, text: str, source: str) -> tuple[DataFrame, tuple | None]:
    folder = checkpoint_dir(docs.sparkSession)
    rows = written(sized(docs, key, text, source), f"{folder}/sized")
    n, budget = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    placed = written(served(rows, targets(rows, folder).withColumn("place", F.col("place").cast("long")), n), f"{folder}/served")
    return placed, last_place(placed, budget, n)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, size, source_size, target, epochs, taken) of every row: how often the mix takes it, and how many words that makes."""
    placed, cut = _scheduled(docs, key, text, source)
    times = sum((_is_taken(cut, _finish(_progress(e)), _progress(e)).cast("long") for e in range(MOST_EPOCHS)), F.lit(0).cast("long"))
    out = placed.withColumn("epochs", F.when(F.col("size") > 0, times).otherwise(0).cast("long"))
    return out.select(F.col("key").alias(key), "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size")).alias("taken"))


def queue(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, size, epoch, finish) of what the mix takes, in its order: partitions are ranges of virtual time, sorted within."""
    placed, cut = _scheduled(docs, key, text, source)
    taken = copies(placed).where(_is_taken(cut, F.col("finish"), F.col("progress")))
    order = ["finish", "place", "progress"]
    return taken.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("key").alias(key), "source", "size", "epoch", "finish")


#: DuckDB SQL for `mix`, over `documents`.
SQL = f"""
WITH sized AS (
  SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')), 1, 15) AS BIGINT) AS draw
  FROM documents),
grouped AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source),
weighed AS (SELECT *, place % 3 + 1 AS weight, sum(source_size) OVER () AS total FROM grouped),
levels AS (
  SELECT *, total - 3 * coalesce(sum(source_size) OVER earlier, 0) AS shared, sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS weights, row_number() OVER (ORDER BY source_size * 6 // weight, place) AS turn
  FROM weighed WINDOW earlier AS (ORDER BY source_size * 6 // weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT shared, weights FROM levels WHERE 3 * source_size * weights >= shared * weight ORDER BY turn LIMIT 1),
sources AS (
  SELECT source, place, source_size, total, CASE WHEN total = 0 THEN 0.0 WHEN 3 * source_size * weights < shared * weight THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(shared * weight AS DOUBLE) / CAST(weights AS DOUBLE) END AS target
  FROM weighed, level),
placed AS (
  SELECT s.rid, s.doc_id, s.size, t.place, t.source_size, t.target, t.total, sum(s.size) OVER (PARTITION BY t.place ORDER BY s.draw, s.doc_id NULLS LAST, s.size ROWS UNBOUNDED PRECEDING) AS served
  FROM sized s JOIN sources t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT rid, size, total, place, epoch * source_size + served AS progress, CAST(epoch * source_size + served AS DOUBLE) / target AS finish FROM placed, range({MOST_EPOCHS}) AS r(epoch) WHERE size > 0),
queued AS (SELECT rid, size, total, sum(size) OVER (ORDER BY finish, place, progress ROWS UNBOUNDED PRECEDING) AS upto FROM copies),
taken AS (SELECT rid, count(*) AS epochs FROM queued WHERE upto <= total GROUP BY rid)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(coalesce(epochs, 0) AS BIGINT) AS epochs, CAST(coalesce(epochs, 0) * size AS BIGINT) AS taken
FROM placed LEFT JOIN taken USING (rid)"""
