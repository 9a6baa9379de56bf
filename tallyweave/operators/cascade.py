"""Readings by paid models under a budget: a cache by text, a cascade of models, a stop at a day's calls and a month's cost.

Documents come in order. One whose text was read before is a hit; else its cascade runs, unless the day's calls or the month's cost are used up:
then it is refused, costs nothing, and its text may be read another day. What a cascade does (calls, cost, success) depends on the text alone, so it is
worked out first, for all. What is left depends on the order, but is small whatever the number of documents: a day has at most `calls` calls, so
only so many texts that aren't cached yet can be read in it, and at most calls * days are cached by then. So each day's first
calls * (days before + 1) texts decide, and one pass over these, in order, finds the readings. All documents then look up whether, and when,
their text was read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cascades(readings: DataFrame, tries: int = 2) -> DataFrame:
    """key, calls, cost, read (whether one succeeded), tier and score (of the best reading, the first of equals) of readings (key, tier, ok, complete,
    score, cost): models are asked in order until a reading is complete or `tries` have succeeded; failed calls count but cost what they cost."""
    order = Window.partitionBy("key").orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)
    before = readings.withColumns({
        "won": F.coalesce(F.sum(F.col("ok").cast("int")).over(order), F.lit(0)), "full": F.coalesce(F.max((F.col("ok") & F.col("complete")).cast("int")).over(order), F.lit(0)),
    })
    made = before.filter((F.col("won") < tries) & (F.col("full") == 0))
    good = F.when(F.col("ok"), F.struct("score", (-F.col("tier")).alias("early")))
    return made.groupBy("key").agg(
        F.count(F.lit(1)).alias("calls"), F.sum(F.coalesce("cost", F.lit(0)).cast("decimal(18,6)")).alias("cost"), F.max("ok").alias("read"),
        F.max_by("tier", good).alias("tier"), F.max_by("score", good).alias("score"),
    )


def _taken(calls: int, budget: float) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached: set[str] = set()
        day = month = None
        used, spent = 0, 0
        for b in batches:
            took = []
            for seq, d, m, key, n, cost, read in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if d != day:
                    day, used = d, 0
                if m != month:
                    month, spent = m, 0
                if key in cached or used >= calls or spent >= budget:
                    continue
                used, spent = used + n, spent + cost
                took.append((seq, key, read))
                if read:
                    cached.add(key)
            yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in took], pa.int64()), pa.array([t[1] for t in took], pa.string()), pa.array([t[2] for t in took], pa.bool_())], ["seq", "key", "read"])

    return run


def read_under_budget(documents: DataFrame, readings: DataFrame, calls: int = 300, budget: float = 1.0, tries: int = 2, block: int = 4096) -> DataFrame:
    """seq, key and outcome of documents (seq, at, key): cache (read before), read, failed (asked, but no reading), refused, or none where no model
    is there for the key. at is a timestamp, seq unique and in its order; the day and the month of at have the limits; a task
    ranks the documents of `block` values of seq."""
    plans = cascades(readings, tries)
    rows = documents.select("seq", F.to_date("at").alias("day"), F.col("key").cast("string").alias("key"))
    known = rows.join(plans, "key")
    # a text that will be read counts once a day, one that won't be is tried each time
    first = Window.partitionBy("day", "key").orderBy("seq")
    candidates = known.withColumn("nth", F.row_number().over(first)).filter((F.col("nth") == 1) | ~F.col("read"))
    # ranks within the blocks of a day, after the counts of its earlier blocks, so that no day is one task
    part = F.floor(F.col("seq") / block)
    inside = candidates.withColumn("block", part).withColumn("rank", F.row_number().over(Window.partitionBy("day", "block").orderBy("seq")))
    counts = candidates.groupBy("day", part.alias("block")).agg(F.count(F.lit(1)).alias("n"))
    earlier = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("day").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    days = rows.select("day").distinct().withColumn("d", F.row_number().over(Window.orderBy("day"))).withColumnRenamed("day", "of")
    near = inside.join(earlier, ["day", "block"]).join(days, F.col("day") == F.col("of")).filter(F.col("rank") + F.col("before") <= F.lit(calls) * F.col("d"))
    in_order = near.select("seq", F.col("day").cast("string").alias("day"), F.date_format("day", "yyyy-MM").alias("month"), "key", "calls", F.col("cost").cast("double").alias("cost"), "read")
    taken = in_order.repartition(1).sortWithinPartitions("seq").mapInArrow(_taken(calls, budget), "seq long, key string, read boolean")
    since = taken.groupBy("key").agg(F.min(F.when(F.col("read"), F.col("seq"))).alias("since"))
    asked = taken.select(F.col("seq").alias("asked"), F.col("read").alias("worked"))
    out = rows.join(plans.select("key", F.lit(True).alias("planned")), "key", "left").join(since, "key", "left").join(asked, F.col("seq") == F.col("asked"), "left")
    outcome = F.when(F.col("planned").isNull(), "none").when(F.col("worked"), "read").when(F.col("worked") == F.lit(False), "failed").when(F.col("seq") > F.col("since"), "cache").otherwise("refused")
    return out.select("seq", "key", outcome.alias("outcome"))
