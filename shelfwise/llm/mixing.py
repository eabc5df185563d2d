"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only.

Every source's documents are shuffled by a hash of their id. A document's virtual finish time is the
number of source tokens served up to and including it, divided by the source's target, so all sources
reach time 1 when their targets are used up; a second and third pass over a source go on from there. All
copies are put in order of finish time, and the mix is what fits into the total budget.

Running sums come in two steps, sums per (source, hash bucket) and a window within each bucket, so a
source with a third of all rows is spread over as many tasks as it has buckets. The cut is found in the
same way: sums per slice of finish time, then the running sum within the one slice in which the budget
ends. Sizes and places are written once, so the texts are read once.

Rows: a missing text has size 0; a missing source is a source of its own, last in order; a source without
words takes nothing and has target 0; documents with equal ids are ordered by size and each keep a row;
rows alike in everything are alike in the order, too, and are taken together. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import stored, word_count

WEIGHTS = (5, 2, 1)
REPEATS = 3
BUCKET_DIGITS = 3  # hex digits of the shuffle key: 4096 buckets a source
SLICES, LAST_SLICE = 2048, 8191  # of finish time: so many a unit, and the last one for all later times


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``(source, number, source_size, target)`` from ``(source, size)`` rows.

    Weights repeat along the sources in code-point order. A target stops at ``repeats`` times the
    source's size. What is over is shared again by weight: with the sources in order of the level at
    which they fill up, the first that is not full at the common level fixes that level for the rest.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.col("number") - 1) % len(weights) + 1).cast("int"))
    numbered = by_source.withColumn("number", F.row_number().over(place)).withColumn("weight", weight)
    cap = F.col("source_size") * repeats
    fill = Window.orderBy(cap / F.col("weight"), "number")
    everything = Window.partitionBy()
    levels = numbered.select(
        "*",
        F.row_number().over(fill).alias("turn"),
        F.sum("source_size").over(everything).alias("budget"),
        F.coalesce(F.sum(cap).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("full"),
        F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)).alias("open"),
    )
    left = F.col("budget") - F.col("full")
    open_turn = F.when(left * F.col("weight") <= cap * F.col("open"), F.struct("turn", left.alias("left"), "open"))
    found = levels.withColumn("level", F.min(open_turn).over(everything))
    share = F.col("level.left").cast("double") * F.col("weight") / F.col("level.open")
    return found.select(
        "source", "number", "source_size",
        F.when(F.col("turn") < F.col("level.turn"), cap.cast("double")).otherwise(share).alias("target"),
    )


def _finish(turn: int) -> Column:
    served = (F.col("source_size") * turn + F.col("served")).cast("double")
    return F.when(F.col("target") > 0, F.try_divide(served, F.col("target")))


def _order(turn: int) -> Column:
    return F.struct(
        _finish(turn).alias("finish"), "number", F.lit(turn).alias("turn"), "key", "size", F.coalesce("doc_id", F.lit(-1)).alias("id")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: str = "mix") -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``, one row per document."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sized = stored(
        docs.select(
            F.col("doc_id").cast("long"), F.col("source").cast("string"),
            word_count(F.col("text").cast("string")).alias("size"), key.alias("key"),
        ),
        "sizes",
    )
    plan = stored(targets(sized, weights, repeats), "targets")
    rows = sized.join(plan, sized["source"].eqNullSafe(plan["source"])).select(
        "doc_id", "size", "key", "number", "source_size", "target", F.substring("key", 1, BUCKET_DIGITS).alias("bucket")
    )
    sums = rows.groupBy("number", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("number", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("offset"))
    placed = rows.withColumn("in_bucket", F.sum("size").over(Window.partitionBy("number", "bucket").orderBy("key", "size", "doc_id")))
    placed = placed.join(offsets, ["number", "bucket"]).withColumn("served", F.col("offset") + F.col("in_bucket"))
    queue = stored(placed.select("doc_id", "size", "key", "number", "source_size", "target", "served"), "queue")
    last = _last_taken(queue, repeats)
    times = [F.lit(0).cast("long")] if last is None else [_taken(turn, last) for turn in range(repeats)]
    taken = sum(times[1:], times[0])
    return queue.select("doc_id", "size", "source_size", "target", (F.col("size") * taken).alias("taken"))


def _last_taken(queue: DataFrame, repeats: int):
    """The place in the order of the last copy within the budget, ``None`` if there is none."""
    budget = queue.agg(F.sum("size")).first()[0] or 0
    copies = queue.select("size", F.explode(F.array(*[_order(t) for t in range(repeats)])).alias("at")).where("at.finish IS NOT NULL")
    part = F.least(F.floor(F.col("at.finish") * SLICES), F.lit(LAST_SLICE).cast("long"))
    slices = copies.groupBy(part.alias("part")).agg(F.sum("size").alias("slice_size"), F.max("at").alias("last"))
    running = slices.withColumn("used", F.sum("slice_size").over(Window.orderBy("part")))
    cut = running.where(F.col("used") > budget).agg(F.min(F.struct("part", "used", "slice_size")).alias("c")).first()["c"]
    if cut is None:
        return running.agg(F.max("last").alias("last")).first()["last"]
    inside = copies.where(part == cut["part"])
    at = inside.withColumn("used", F.sum("size").over(Window.orderBy("at")) + (cut["used"] - cut["slice_size"]))
    best = at.where(F.col("used") <= budget).agg(F.max("at").alias("last")).first()["last"]
    return best or slices.where(F.col("part") < cut["part"]).agg(F.max("last").alias("last")).first()["last"]


def _taken(turn: int, last) -> Column:
    bound = F.struct(
        F.lit(last["finish"]).alias("finish"), F.lit(last["number"]).alias("number"), F.lit(last["turn"]).alias("turn"),
        F.lit(last["key"]).alias("key"), F.lit(last["size"]).cast("long").alias("size"), F.lit(last["id"]).cast("long").alias("id"),
    )
    return F.when(_finish(turn).isNotNull() & (_order(turn) <= bound), 1).otherwise(0).cast("long")


def op5_mixing(docs: DataFrame) -> DataFrame:
    return mix(docs)


OP5_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || COALESCE(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM documents),
by_source AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
numbered AS (SELECT *, ROW_NUMBER() OVER (ORDER BY source NULLS LAST) AS number FROM by_source),
weighed AS (SELECT *, [5, 2, 1][(number - 1) % 3 + 1] AS weight, 3 * source_size AS cap FROM numbered),
levels AS (SELECT *, SUM(source_size) OVER () AS budget, cap / weight AS fills,
    ROW_NUMBER() OVER f AS turn, COALESCE(SUM(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
    SUM(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM weighed WINDOW f AS (ORDER BY cap / weight, number)),
level AS (SELECT turn, CAST(budget - full_before AS DOUBLE) AS spare, CAST(open_weight AS DOUBLE) AS open_weight FROM levels
  WHERE (budget - full_before) * weight <= cap * open_weight ORDER BY turn LIMIT 1),
plan AS (SELECT source, number, source_size, budget,
    CASE WHEN l.turn < v.turn THEN CAST(cap AS DOUBLE) ELSE v.spare * weight / v.open_weight END AS target
  FROM levels l, level v),
queue AS (SELECT doc_id, size, key, number, source_size, target, budget,
    SUM(size) OVER (PARTITION BY number ORDER BY key, size, doc_id) AS served
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
copies AS (SELECT *, CAST(source_size * t + served AS DOUBLE) / target AS finish
  FROM queue, (SELECT unnest([0, 1, 2]) AS t) WHERE target > 0),
ordered AS (SELECT *, SUM(size) OVER (ORDER BY finish, number, t, key, size, doc_id) AS used FROM copies),
kept AS (SELECT doc_id, number, key, SUM(size) AS taken FROM ordered WHERE used <= budget GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(COALESCE(k.taken, 0) AS BIGINT) AS taken
FROM queue q LEFT JOIN kept k ON q.doc_id IS NOT DISTINCT FROM k.doc_id AND q.number = k.number AND q.key = k.key
"""
