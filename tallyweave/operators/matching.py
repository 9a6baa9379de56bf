"""Fuzzy vendor and duplicate matching.

Similarity isn't transitive and names of which one holds the other score 100, so it is no group key. Scores
are computed once for distinct pairs of normalised names; everything else is equi-joins on these. Vendor
lists are the small side (their distinct names), invoices' names are reduced to distinct ones first.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import fuzzy, text
from tallyweave.sources.shared import by_key, folder

SAME_VENDOR, SAME_RECORD, NEAR_NUMBER = 80, 85, 85


#: Distinct names of a side that a task compares with as many of the other.
AT_ONCE = 8192


def _words(c: str) -> Column:
    return F.array_sort(F.array_distinct(F.split(c, " +")))


def _leading(names: DataFrame, c: str, words: DataFrame, share: float) -> DataFrame:
    """(c, g): the words of each name that words (g) hold most rarely, as many as it takes for the others to be shorter together than this share of the name."""
    often = words.groupBy("g").agg(F.count(F.lit(1)).alias("f"))
    each = names.select(c, F.explode(_words(c)).alias("g")).join(often, "g", "left")
    ranked = each.groupBy(c).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "g"))).alias("w"))
    size = lambda xs: F.aggregate(xs, F.lit(-1), lambda n, x: n + F.length(x["g"]) + 1)
    led = F.filter("w", lambda _, i: size(F.slice("w", i + 1, F.size("w"))) >= share * size(F.col("w")) - 1e-9)
    return ranked.select(c, F.explode(F.transform(led, lambda x: x["g"])).alias("g"))


def _alike(a: DataFrame, b: DataFrame, cutoff: float) -> DataFrame:
    """(a, b, score) of names whose letters allow the cutoff and that reach it. Blocks of names meet, not names: a task holds one block of either side."""
    n, m = (max(1, -(-names.count() // AT_ONCE)) for names in (a, b))
    block = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k))
    mine = a.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda j: block("a", n) * m + j)).alias("pair"), F.lit(True).alias("left"), F.col("a").alias("name"))
    theirs = b.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i * m + block("b", m))).alias("pair"), F.lit(False).alias("left"), F.col("b").alias("name"))

    def compared(block: pa.Table) -> pa.Table:
        of = lambda side: [x for x, left in zip(block["name"].to_pylist(), block["left"].to_pylist(), strict=True) if left == side]
        return pa.Table.from_pylist([{"a": x, "b": y, "score": s} for x, y, s in fuzzy.alike(of(True), of(False), cutoff)], pa.schema({"a": pa.string(), "b": pa.string(), "score": pa.float64()}))

    return by_key(mine.unionByName(theirs), "pair", min(n * m, 2000)).groupBy("pair").applyInArrow(compared, "a string, b string, score double")


def similar_names(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """(a, b, score) of distinct normalised names of left and right (one column each) that reach the cutoff.

    Either the common words alone reach it, or all words of both sides do, the common ones first. Then, of n and m letters, the common words have
    cutoff / (200 - cutoff) of n or of m, so one of them is among the words that the name cannot miss (_leading), its rarest ones; a word of many names is none of these
    unless a name has no other. Or else cutoff * (n + m) / 200 letters are common, whatever the words' order, and with them pairs of letters: both
    are counted in bits for whole blocks of names (fuzzy.alike), and only pairs that have enough are compared. None that reaches the cutoff is lost.
    """
    at = folder(left.sparkSession, "names")

    def once(names: DataFrame, c: str) -> DataFrame:
        found = names.select(text.norm_vendor(F.col(names.columns[0])).alias(c)).filter(F.col(c) != "").distinct()
        found.write.parquet(f"{at}/{c}")
        return left.sparkSession.read.schema(found.schema).parquet(f"{at}/{c}")

    a, b = once(left, "a"), once(right, "b")
    a_words, b_words = (names.select(c, F.explode(_words(c)).alias("g")) for names, c in ((a, "a"), (b, "b")))
    share = cutoff / (200 - cutoff)
    shared = _leading(a, "a", b_words, share).join(b_words, "g").select("a", "b").union(_leading(b, "b", a_words, share).join(a_words, "g").select("a", "b")).distinct()
    shared = shared.withColumn("score", fuzzy.token_set_ratio(F.col("a"), F.col("b"))).filter(F.col("score") >= cutoff)
    return shared.union(_alike(a, b, cutoff)).distinct()


def first_vendor(invoices: DataFrame, vendors: DataFrame, cutoff: float = SAME_RECORD) -> DataFrame:
    """invoices (id, vendor) with the first vendor (by name) whose name is similar: not the most similar one."""
    known = vendors.select("name", text.norm_vendor(F.col("name")).alias("b"))
    hits = similar_names(invoices.select("vendor"), vendors.select("name"), cutoff).join(known, "b").groupBy("a").agg(F.min("name").alias("match"))
    return invoices.withColumn("a", text.norm_vendor(F.col("vendor"))).join(hits, "a", "left").drop("a")


def near_duplicates(invoices: DataFrame, cutoff: float = NEAR_NUMBER) -> DataFrame:
    """(id, match_id): the first earlier invoice of the same vendor and amount, within 0.5 % of the earlier
    one, whose number is similar but not the same. invoices: id, vendor_key, number, total.

    Amounts are dealt into bands as wide as the tolerance, 0.02 up to 4 and 0.5 % beyond, on either side of
    zero; a match lies in the same band or a next one.
    """
    size = F.abs("total")
    steps = F.when(size <= 4, size / 0.02).otherwise(200 + F.log(size / 4) / 0.005)
    band = F.floor(F.signum("total") * steps / 1.01).cast("long")  # a little wider: 0.5 % of the larger amount, too
    rows = invoices.filter("total IS NOT NULL AND number IS NOT NULL").withColumn("n", text.norm_number(F.col("number"))).withColumn("band", band)
    left = rows.select(F.col("id"), "vendor_key", F.col("n").alias("mine"), F.col("total").alias("t"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    right = rows.select(F.col("id").alias("match_id"), "vendor_key", "n", "total", "band")
    pairs = left.join(right, ["vendor_key", "band"]).filter("match_id < id AND mine != n AND abs(t - total) <= greatest(0.02, 0.005 * abs(total))")
    short = 200 * F.least(F.length("mine"), F.length("n")) / (F.length("mine") + F.length("n"))  # an upper bound of the score
    scored = pairs.filter(short >= cutoff).withColumn("score", fuzzy.ratio(F.col("mine"), F.col("n")))
    return scored.filter(F.col("score") >= cutoff).groupBy("id").agg(F.min("match_id").alias("match_id"))


def any_vendor_duplicates(invoices: DataFrame, cutoff: float = 90, tolerance: float = 0.02) -> DataFrame:
    """(id, match_id): the first earlier invoice, of whatever vendor, with the same date, an amount within the tolerance
    and a number (of six characters or more) that is the same or nearly so. invoices: id, number, total, inv_date.

    Invoices that agree in all three are compared once, by their first; each amount meets those of its band and
    the next ones.
    """
    known = invoices.filter("number IS NOT NULL AND total IS NOT NULL AND inv_date IS NOT NULL").withColumn("n", text.norm_number(F.col("number")))
    kinds = known.groupBy("n", "inv_date", "total").agg(F.min("id").alias("first")).withColumn("band", F.floor(F.col("total") / (tolerance * 1.05)).cast("long"))
    left = kinds.filter(F.length("n") >= 6).select("n", "inv_date", "total", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    right = kinds.select("inv_date", "band", F.col("n").alias("other"), F.col("total").alias("t"), "first")
    short = 200 * F.least(F.length("n"), F.length("other")) / (F.length("n") + F.length("other"))  # an upper bound of the score
    pairs = left.join(right, ["inv_date", "band"]).filter((F.abs(F.col("total") - F.col("t")) <= tolerance) & (short >= cutoff))
    scored = pairs.filter((F.col("n") == F.col("other")) | (fuzzy.ratio(F.col("n"), F.col("other")) >= cutoff))
    best = scored.groupBy("n", "inv_date", "total").agg(F.min("first").alias("match_id"))
    return known.join(best, ["n", "inv_date", "total"]).filter("match_id < id").select("id", "match_id")
