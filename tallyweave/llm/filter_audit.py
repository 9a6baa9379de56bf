"""Audit of how five document filters interact, in every order.

Each text gets a mask of the filters that it fails. Exact copies are found by routing: a task holds its texts in chains
below their xxhash (a chain keeps whole texts, so that colliding texts stay apart) with the smallest id of each. Rows that
are not the smallest of their task are decided there; one row a text is written, with the text, and goes on to the task that the hash
names, which reads them sorted by hash, chains them again and emits those that are not the smallest of all. So a text of a
third of all rows arrives once a task, and not once a row; a task holds at most HOLD_BYTES of texts before it passes
them on, and then one hash's chain.
Masks then meet their labels in a join of narrow rows, and combineByKey merges a vector of counts by mask for
each part. The 120 orders need nothing but these vectors.

Filters: A under 100 words, B 100 * distinct words < 80 * words, C 100 * [A-Z] > 10 * code points, D holds any of #$%&*|,
E equal to the text of a smaller doc_id. Words are maximal runs without space, tab, line feed, vertical tab, form feed
and carriage return. Null text: empty. Null lang: part ''. Rows of one id and text: none is smaller, so all pass E
or all fail. Null doc_id: neither smaller nor larger than any, it passes E, and it has no labels. Repeated
labels of an id: 1 if any of them is 1. No labels: neither good nor toxic. Empty table: no parts and so no rows.
Only doc_id, text, lang, quality and toxic are read: other columns may have any names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import groupby, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.store import written

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
HOLD_BYTES = 32 << 20
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"

ROUTED = pa.schema([("hash", pa.int64()), ("text", pa.binary()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64())])

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_SIGNS = re.compile(rb"[#$%&*|]")
#: Bytes of UTF-8 that don't begin a code point.
_INNER = bytes(range(0x80, 0xC0))


def own_mask(raw: bytes) -> int:
    """Bits of the filters A to D that a text in UTF-8 fails."""
    words = raw.split()  # at the six ASCII white-space characters
    fails = (
        len(words) < 100,
        100 * len(set(words)) < 80 * len(words),
        100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > 10 * len(raw.translate(None, _INNER)),
        _SIGNS.search(raw) is not None,
    )
    return sum(1 << k for k, failed in enumerate(fails) if failed)


def text_hash(raw: bytes) -> int:
    """The xxhash as a signed number."""
    return xxhash.xxh64_intdigest(raw) - (1 << 63)


class Chains:
    """Texts by hash: each with its mask and the smallest id so far, whose rows are counted by part. Rows that turn out not to be
    the smallest are counted in decided, by (doc_id, part, mask)."""

    def __init__(self) -> None:
        self.links: dict[int, list[list]] = {}
        self.decided: Counter = Counter()
        self.size = 0

    def add(self, h: int, raw: bytes, doc_id: int, parts: dict[str, int], mask: int | None) -> None:
        chain = self.links.setdefault(h, [])
        link = next((x for x in chain if x[0] == raw), None)
        if link is None:
            chain.append([raw, doc_id, dict(parts), own_mask(raw) if mask is None else mask])
            self.size += len(raw) + 200
        elif doc_id == link[1]:
            for part, n in parts.items():
                link[2][part] = link[2].get(part, 0) + n
        else:
            loser, counts = (doc_id, parts) if doc_id > link[1] else (link[1], link[2])
            if doc_id < link[1]:
                link[1:3] = doc_id, dict(parts)
            for part, n in counts.items():
                self.decided[loser, part, link[3] | COPY] += n

    def full(self, limit: int) -> bool:
        return self.size + 100 * len(self.decided) > limit


def route(rows: Iterable[tuple[int | None, str, bytes]], limit: int) -> Iterator[tuple]:
    """(hash, text, doc_id, part, mask, n) of a task's rows (doc_id, part, text): the smallest of each text with its hash and text, the
    others, which are decided, without."""
    chains = Chains()

    def leave() -> Iterator[tuple]:
        for h, chain in chains.links.items():
            for raw, doc_id, parts, mask in chain:
                yield from ((h, raw, doc_id, part, mask, n) for part, n in parts.items())
        yield from ((None, None, *key, n) for key, n in chains.decided.items())

    for doc_id, part, raw in rows:
        if doc_id is None:
            chains.decided[None, part, own_mask(raw)] += 1
        else:
            chains.add(text_hash(raw), raw, doc_id, {part: 1}, None)
        if chains.full(limit):
            yield from leave()
            chains = Chains()
    yield from leave()


def settle(records: Iterable[tuple[int, tuple]]) -> Iterator[tuple]:
    """(doc_id, part, mask, n) of all (hash, (text, doc_id, part, mask, n)) of a task, sorted by hash: only one hash's chain is held."""
    for h, same in groupby(records, key=lambda x: x[0]):
        chains = Chains()
        for _, (raw, doc_id, part, mask, n) in same:
            chains.add(h, bytes(raw), doc_id, {part: n}, mask)
            if len(chains.decided) > 10_000:
                yield from ((*key, n) for key, n in chains.decided.items())
                chains.decided.clear()
        yield from ((*key, n) for key, n in chains.decided.items())
        for _, doc_id, parts, mask in chains.links[h]:
            yield from ((doc_id, part, mask, n) for part, n in parts.items())


def masks(docs: DataFrame, hold_bytes: int = HOLD_BYTES) -> DataFrame:
    """doc_id, part, mask and how many rows (n) have these."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        block, size = [], 0
        for record in route(rows, hold_bytes):
            block.append(record)
            size += 64 + len(record[1] or b"")
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist([dict(zip(ROUTED.names, r, strict=True)) for r in block], ROUTED)
                block, size = [], 0
        yield pa.RecordBatch.from_pylist([dict(zip(ROUTED.names, r, strict=True)) for r in block], ROUTED)

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text("lang"), text("text").cast("binary"))
    routed = written(rows.mapInArrow(run, "hash long, text binary, doc_id long, part string, mask int, n long"), "routed")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    chained = routed.filter("hash IS NOT NULL").rdd.map(lambda r: (r[0], tuple(r[1:]))).repartitionAndSortWithinPartitions(tasks, lambda h: h)
    settled = spark.createDataFrame(chained.mapPartitions(settle), "doc_id long, part string, mask int, n long", verifySchema=False)
    return settled.union(routed.filter("hash IS NULL").select("doc_id", "part", "mask", "n"))


def mask_counts(masked: DataFrame, labels: DataFrame):
    """An RDD of (part, 32 x 3 counts): rows, good rows and toxic rows by mask."""
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("of")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    joined = masked.join(known, F.col("doc_id") == F.col("of"), "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0)))

    def added(counts: np.ndarray, row: tuple) -> np.ndarray:
        mask, n, good, toxic = row
        counts[mask] += (n, n * good, n * toxic)
        return counts

    return joined.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(lambda row: added(np.zeros((1 << len(FILTERS), 3), np.int64), row), added, lambda a, b: a + b)


def orders(counts: np.ndarray) -> Iterator[tuple]:
    """filter_order, step and the counts of it, for all orders, of a part's counts by mask."""
    every = np.arange(1 << len(FILTERS))
    fails = {f: (every >> k & 1).astype(bool) for k, f in enumerate(FILTERS)}
    rows, shapley = [], defaultdict(int)
    for order in map("".join, permutations(FILTERS)):
        left = np.ones(len(every), bool)
        for step, f in enumerate(order, 1):
            lost = counts[left & fails[f]].sum(0)
            redundant = counts[~left & fails[f], 0].sum()
            left &= ~fails[f]
            shapley[f] += int(lost[0])
            rows.append((f, order, step, counts[left, 0].sum(), lost[0], redundant, counts[1 << FILTERS.index(f), 0], lost[1], lost[2]))
    for f, order, step, *numbers in rows:
        yield order, step, *map(int, numbers), shapley[f]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of every part, order and step; see SCHEMA."""
    counted = mask_counts(masks(docs), labels)
    return docs.sparkSession.createDataFrame(counted.flatMap(lambda x: ((x[0], *row) for row in orders(x[1]))), SCHEMA, verifySchema=False)


#: The same counts from window functions and a join of masks with all orders.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
m AS (
  SELECT doc_id, part,
         len(ws) < 100 AS a,
         100 * len(list_distinct(ws)) < 80 * len(ws) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(first_id < doc_id, false) AS e
  FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
k AS (
  SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END
            || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails,
         count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(bad, 0)) AS bad
  FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (
  SELECT p.f || q.f || r.f || s.f || t.f AS filter_order FROM f p, f q, f r, f s, f t
  WHERE p.f NOT IN (q.f, r.f, s.f, t.f) AND q.f NOT IN (r.f, s.f, t.f) AND r.f NOT IN (s.f, t.f) AND s.f <> t.f),
x AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS f, n, good, bad, fails,
         contains(fails, substr(filter_order, step, 1)) AS hit,
         length(translate(fails, substr(filter_order, 1, step - 1), '')) < length(fails) AS gone
  FROM k, o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
c AS (
  SELECT part, filter_order, step, f,
         sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN hit AND NOT gone THEN bad ELSE 0 END) AS toxic_lost
  FROM x GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM c
"""
