"""Sharding by extendible hashing: only shards over their byte limit split, each on one more hash bit.

The directory is indexed by the leading bits of a 48-bit hash of doc_id. One pass sums bytes into cells of
D bits (D from the total); the sums of all shorter prefixes follow from the cells, and a cell belongs to the
shortest prefix whose documents fit the limit. Cells that don't fit are refined on later bits in the same
way, reading only their rows, until all fit. Everything is aggregation and equi-joins: nothing is collected
but the total and whether cells are left, and no task sees a shard's rows together.

A document larger than the limit gets a shard of its own (it can't split). Rows of one doc_id that
exceed the limit together split on a hash of their text, and exact copies, which no hash can part, into
numbered pages. Null doc_id hashes as an empty string; null text has 0 bytes; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.store import written

BITS, LIMIT_BYTES = 48, 1 << 20


def id_hash(doc_id: Column) -> Column:
    """The first 48 bits of the MD5 of the id's digits."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("long")


def _leaves(rows: DataFrame, limit: int, depth: int, above: int) -> DataFrame:
    """For cells of depth bits of rows (parent, h, n_bytes, n): parent, cell, and the depth, above at least,
    of the shortest prefix that fits, null where none does. One row stands for n equal ones."""
    cells = rows.groupBy("parent", F.shiftright("h", BITS - depth).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.sum("n").alias("n"))
    by_depth = cells.withColumn("depth", F.explode(F.sequence(F.lit(above), F.lit(depth)))).withColumn("prefix", F.expr(f"shiftright(cell, {depth} - depth)"))
    buckets = by_depth.groupBy("parent", "depth", "prefix").agg(F.sum("bytes").alias("sum_bytes"), F.sum("n").alias("sum_n"))
    fit = buckets.filter((F.col("sum_bytes") <= limit) | (F.col("sum_n") <= 1)).select("parent", "depth", "prefix")
    found = by_depth.join(fit, ["parent", "depth", "prefix"]).groupBy("parent", "cell").agg(F.min("depth").alias("depth"))
    return cells.select("parent", "cell").join(found, ["parent", "cell"], "left")


def _split(rows: DataFrame, limit: int, total: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows with depth, and those that no bit of h parts (None if there are none)."""
    done, above, depth = None, 0, min(BITS, max(1, math.ceil(math.log2(max(1.0, total / limit))) + 4))
    while True:
        leaves = written(_leaves(rows, limit, depth, above), "leaves")
        placed = rows.withColumn("cell", F.shiftright("h", BITS - depth)).join(leaves, ["parent", "cell"]).drop("cell")
        fits = placed.filter("depth IS NOT NULL")
        done = fits if done is None else done.unionByName(fits)
        left = placed.filter("depth IS NULL").drop("depth")
        if leaves.filter("depth IS NULL").isEmpty():
            return done, None
        if depth == BITS:
            return done, left
        rows, above, depth = written(left, "oversized"), depth + 1, min(BITS, depth + 8)


def _bits(h: Column, depth: Column) -> Column:
    return F.expr("substr(lpad(bin(h), 48, '0'), 1, depth)")


def assign_shards(docs: DataFrame, limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """doc_id, n_bytes, shard (the hash bits it stands for, after an s) and shard_depth of every row."""
    slim = docs.select(
        F.col("doc_id"),
        F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
        F.lit("s").alias("parent"),
        id_hash(F.col("doc_id")).alias("h"),
        F.shiftrightunsigned(F.xxhash64("text"), 16).alias("text_h"),
        F.lit(1).cast("long").alias("n"),
    )
    slim = written(slim, "slim")
    total = slim.agg(F.sum("n_bytes")).first()[0] or 0
    shard = F.concat("parent", _bits(F.col("h"), F.col("depth")))
    done, left = _split(slim, limit_bytes, total)
    out = done.select("doc_id", "n_bytes", shard.alias("shard"), F.col("depth").cast("int").alias("shard_depth"))
    if left is None:
        return out
    # rows of one doc_id: on by the text; copies count as one row of their bytes
    copies = left.groupBy("doc_id", "h", "text_h", "n_bytes").agg(F.sum("n").alias("n"))
    copies = written(copies.withColumn("parent", F.expr(f"concat('s', lpad(bin(h), {BITS}, '0'), '-')")).withColumn("one", F.col("n_bytes")), "same_id")
    by_text = copies.select("doc_id", "parent", F.col("text_h").alias("h"), (F.col("one") * F.col("n")).alias("n_bytes"), "one", "n")
    parted, same = _split(by_text, limit_bytes, total)
    each = F.explode(F.expr("sequence(1L, n)"))
    out = out.unionByName(parted.select("doc_id", F.col("one").alias("n_bytes"), shard.alias("shard"), (F.col("depth") + BITS).cast("int").alias("shard_depth"), each.alias("k")).drop("k"))
    if same is not None:
        per_page = F.greatest(F.lit(1), F.expr(f"{limit_bytes} div greatest(one, 1)"))
        pages = same.withColumn("per_page", per_page).withColumn("page", F.explode(F.expr("sequence(0L, (n - 1) div per_page)")))
        pages = pages.withColumn("n", F.least("per_page", F.expr("n - page * per_page"))).repartition(F.xxhash64("h", "page"))
        name = F.concat("parent", F.expr(f"lpad(bin(h), {BITS}, '0')"), F.lit("-"), F.col("page").cast("string"))
        out = out.unionByName(pages.select("doc_id", F.col("one").alias("n_bytes"), name.alias("shard"), F.lit(2 * BITS).alias("shard_depth"), each.alias("k")).drop("k"))
    return out


#: The same directory by trying every depth for every document.
ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS h
  FROM documents),
p AS (
  SELECT k, h >> CAST({BITS} - k AS INTEGER) AS prefix, sum(n_bytes) AS s, count(*) AS c
  FROM d, range(0, {BITS + 1}) r(k) GROUP BY 1, 2),
leaf AS (
  SELECT d.doc_id, d.n_bytes, d.h, min(p.k) AS k
  FROM d, range(0, {BITS + 1}) r(k) JOIN p ON p.k = r.k
  WHERE p.prefix = d.h >> CAST({BITS} - r.k AS INTEGER) AND (p.s <= {LIMIT_BYTES} OR p.c = 1)
  GROUP BY 1, 2, 3)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes,
       's' || substr(lpad(bin(h), {BITS}, '0'), 1, CAST(k AS INTEGER)) AS shard, CAST(k AS INTEGER) AS shard_depth
FROM leaf
"""
