"""Where on the page the evidence for a failed check is printed: ordered needles against the lines of a document.

The first needle that is found anywhere decides, in its first line or, if the lowest is wanted (a grand total stands below the items), in the
one lowest on the last page. White space is ignored on both sides; a numeric needle must not be part of a longer number. Needles meet
only their own document's lines, by an equi-join; the best place is one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 3


def bare(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", ""))


def amount_forms(amount: Column) -> Column:
    """The ways in which an amount is printed, each once, in the order in which they are looked for. Some printers part the last thousands only,
    which differs from a million on."""
    grouped = F.format_number(amount, 2)
    plain = F.replace(grouped, F.lit(","), F.lit(""))
    parted = F.regexp_replace(plain, r"(\d)(\d{3}\.\d\d)$", "$1,$2")
    swapped = lambda c: F.translate(c, ",.", ".,")
    return F.array_distinct(F.array(grouped, swapped(grouped), plain, swapped(plain), parted, swapped(parted)))


def find(needles: DataFrame, lines: DataFrame, width: float, height: float) -> DataFrame:
    """doc_id, item, needle, page and the box (x, y, w, h, as shares of the page) of the words that hold the needle; items that are not
    found have no row. needles: doc_id, item, needles (an array, in order), numeric, lowest; lines as operators.layout makes them."""
    asked = needles.select("doc_id", "item", "numeric", "lowest", F.posexplode(F.transform("needles", bare)).alias("k", "needle")).filter(F.length("needle") >= LEAST)
    # a line is shuffled as it is and meets its document's needles once, all together
    packed = asked.groupBy("doc_id").agg(F.collect_list(F.struct("item", "numeric", "lowest", "k", "needle")).alias("asked"))
    met = packed.join(lines.select("doc_id", "line", "page", "words"), "doc_id").withColumn("letters", F.array_join(F.transform("words", lambda w: bare(w["text"])), ""))
    held = met.select("doc_id", "line", "page", "words", "letters", F.inline(F.filter("asked", lambda n: F.contains(F.col("letters"), n["needle"]))))
    pattern = F.concat(F.when(F.col("numeric"), r"(?<!\d)").otherwise(""), F.lit(r"\Q"), "needle", F.lit(r"\E"), F.when(F.col("numeric"), r"(?!\d)").otherwise(""))
    at = F.regexp_instr("letters", pattern) - 1
    # each word of a line with the place of its letters in the line without white space
    hits = held.withColumn("at", at).filter("at >= 0").withColumn("sizes", F.transform("words", lambda w: F.length(bare(w["text"]))))
    hits = hits.withColumn("begins", F.transform("sizes", lambda n, i: F.aggregate(F.slice(F.col("sizes"), F.lit(1), i), F.lit(0), lambda a, m: a + m)))
    pairs = F.arrays_zip(F.col("words").alias("word"), F.col("sizes").alias("size"), F.col("begins").alias("begin"))
    inside = F.filter(pairs, lambda p: (p["begin"] < F.col("at") + F.length("needle")) & (p["begin"] + p["size"] > F.col("at")))
    box = lambda side: F.transform(inside, lambda p: p["word"][side])
    placed = hits.withColumns({"x0": F.array_min(box("x0")), "y0": F.array_min(box("y0")), "x1": F.array_max(box("x1")), "y1": F.array_max(box("y1")), "top": F.get(box("y0"), F.lit(0))})
    # the first needle; then the lowest place or the first line
    order = F.struct(-F.col("k"), F.when(F.col("lowest"), F.col("page")).otherwise(0), F.when(F.col("lowest"), F.col("top")).otherwise(0.0), -F.col("line"))
    best = placed.groupBy("doc_id", "item").agg(F.max_by(F.struct("needle", "page", "x0", "y0", "x1", "y1"), order).alias("b"))
    return best.select(
        "doc_id", "item", "b.needle", "b.page", (F.col("b.x0") / width).alias("x"), (F.col("b.y0") / height).alias("y"), ((F.col("b.x1") - F.col("b.x0")) / width).alias("w"), ((F.col("b.y1") - F.col("b.y0")) / height).alias("h")
    )
