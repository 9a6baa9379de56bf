"""Near-duplicate documents: BagMinHash signatures, banding, verification of multiset overlap.

A document is the multiset of its shingles of five words. Each (shingle, weight) runs independent Poisson
processes over the weight ranges [0,1), [1,2), [2,4), [4,8) ... below its weight; points of a range cut by the
weight are kept where they fall under it, which is how a process splits over its halves. A signature slot
holds the first arrival among all points dealt to it, so two documents agree in a slot with probability
equal to the weighted Jaccard similarity of their multisets. Points are drawn only up to the time by which
all slots are filled, so a document costs about as much as its shingles plus a fixed number of points.

Equal texts are one node. Nodes that agree in a band of slots are candidates. In each bucket all members are
compared with one leader (the member that shares the most buckets) and links are closed to classes. Members
of buckets that still hold several classes are dealt anew by their rare shingles (a prefix filter, which
loses nothing), so that a passage which many documents share makes no bucket. These are compared at once
where the pairs between classes are at most AT_ONCE times the members, else leader by leader until they
are. No link is given up. Pairs are verified on the full multisets, each once. Joins on buckets, classes and leaders, of
which one may hold a third of all rows, deal hot keys over several tasks.

Null text: empty. Texts without words form a class with equal texts only; texts of fewer than five words are
one shingle. class_id is the least doc_id of the class (nulls aside; null if all are null). Repeated rows are
copies. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.chunks import blocks
from tallyweave.llm.store import discard, spread_join, written

SHINGLE, SIMILARITY = 5, 0.8
#: Bands of rows: at similarity 0.8 a pair shares none with probability 0.00005.
BANDS, ROWS = 25, 5
SLOTS = BANDS * ROWS
#: Pairs for each member of a bucket that are looked at at once in the end.
AT_ONCE = 50
#: First buckets that a member carries along, so that most pairs are made once.
HEAD = 32
WORD = re.compile(r"\w+")
GOLDEN = 0x9E3779B97F4A7C15
TABLE_LIMIT = 400_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > TABLE_LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(texts: list[str], table: _WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, weight) of all distinct shingles, by text and hash."""
    words = [WORD.findall(t.lower()) for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    hashes = np.fromiter((h for w in words for h in map(table.__getitem__, w)), np.uint64, int(n.sum()))
    ends = np.cumsum(n)
    # texts of fewer words are filled up, so that they have one shingle
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        fill = SHINGLE - n[short]
        hashes = np.insert(hashes, np.repeat(ends[short], fill), np.uint64(GOLDEN))
        n[short] = SHINGLE
        ends = np.cumsum(n)
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = hashes.copy()
    for k in range(1, SHINGLE):
        value[: len(hashes) - k] = value[: len(hashes) - k] * np.uint64(0xD6E8FEB86659FD93) + hashes[k:]
    value = mix(value)
    counts = np.maximum(n - SHINGLE + 1, 0)
    text = np.repeat(np.arange(len(texts)), counts)
    parts = [np.sort(value[e - m : e - SHINGLE + 1]) for e, m in zip(ends.tolist(), n.tolist(), strict=True) if m]
    value = np.concatenate(parts)
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], value[at], np.diff(np.append(at, len(value)))


def bagminhash(text: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """float32 signatures (n, slots) of n multisets; rows without shingles stay infinite."""
    total = np.bincount(text, weights=weight, minlength=n)
    signature = np.full(n * slots, np.inf, np.float32)
    # one process for each weight range that an element reaches
    ranges = [(value, text, np.ones(len(value)), np.ones(len(value)))]
    low = 1
    while len(up := np.flatnonzero(weight > low)):
        ranges.append((mix(value[up] + np.uint64(GOLDEN * low & (2**64 - 1))), text[up], np.full(len(up), float(low)), np.minimum(weight[up], 2 * low) - low + 0.0))
        low *= 2
    seed, doc, length, covered = (np.concatenate(x) for x in zip(*ranges, strict=True))
    limit = np.where(total > 0, (np.log(slots) + 3) / np.maximum(total, 1), 0)
    todo = np.ones(len(seed), bool)
    while todo.any():
        s, d, size, part = seed[todo], doc[todo], length[todo], covered[todo]
        t, k = np.zeros(len(s)), 0
        while len(s):
            k += 1
            draw = mix(s + np.uint64(GOLDEN * (2 * k) & (2**64 - 1)))
            t = t - np.log(((draw >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53) / (slots * size)
            go = t < limit[d]
            s, d, t, size, part = s[go], d[go], t[go], size[go], part[go]
            more = mix(s + np.uint64(GOLDEN * (2 * k + 1) & (2**64 - 1)))
            slot = ((more >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)
            kept = (more & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * size < part
            np.minimum.at(signature, d[kept] * slots + slot[kept].astype(np.int64), t[kept].astype(np.float32))
        open_ = (total > 0) & np.isinf(signature.reshape(n, slots)).any(axis=1)
        limit = np.where(open_, limit * 2, 0)  # these are drawn again, further on
        todo = open_[doc]
    return signature.reshape(n, slots)


def bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each band of each signature."""
    bits = signature.view(np.uint32).astype(np.uint64).reshape(len(signature), BANDS, ROWS)
    h = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), bits.shape[:2])
    for k in range(ROWS):
        h = mix(h * np.uint64(GOLDEN) + bits[:, :, k])
    return h.view(np.int64)


def elements(text: np.ndarray, value: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) with a hash of its own for each occurrence: overlap of multisets as sets."""
    repeat = np.repeat(np.arange(len(value)), weight)
    occurrence = np.arange(len(repeat)) - np.repeat(np.cumsum(weight) - weight, weight)
    return text[repeat], mix(value[repeat] + occurrence.astype(np.uint64) * np.uint64(GOLDEN)).view(np.int64)


def _lists(text: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(text, minlength=n), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")))).alias("key")


def _signatures(rows: DataFrame) -> DataFrame:
    """key, weight and bands of rows (doc_id, key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _WordHashes()
        for batch in batches:
            at = 0
            for block in blocks(batch.column(2).to_pylist()):
                n = len(block)
                text, value, weight = shingles(block, table)
                total = np.bincount(text, weights=weight, minlength=n).astype(np.int64)
                keys = bands(bagminhash(text, value, weight, n)) if len(value) else np.zeros((n, BANDS), np.int64)
                some = total > 0
                lists = _lists(np.repeat(np.flatnonzero(some), BANDS), keys[some].ravel(), n)
                part = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(total), lists], ["doc_id", "key", "weight", "bands"])
                at += n

    return rows.mapInArrow(run, "doc_id long, key binary, weight long, bands array<long>")


def _elements(rows: DataFrame) -> DataFrame:
    """key and the set of element hashes of rows (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _WordHashes()
        for batch in batches:
            at = 0
            for block in blocks(batch.column(1).to_pylist(), 500_000):
                text, values = elements(*shingles(block, table))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(block)), _lists(text, values, len(block))], ["key", "elements"])
                at += len(block)

    return rows.mapInArrow(run, "key binary, elements array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(key, label) of all nodes of edges (a, b); label is the least key of the component.

    Alternates large and small stars: every node's neighbours are tied to the least of them. A round is two
    aggregates and two joins; the rounds grow with the logarithm of the component size.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    state = F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    before, now = None, edges.agg(*state).first()
    while now != before:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = spread_join(both, least, ["a"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
        old, edges = edges, written(small.filter("a != b").distinct(), "edges", 2 * now[0])
        discard(old)
        before, now = now, edges.agg(*state).first()
    labels = edges.select(F.col("a").alias("key"), F.col("b").alias("label"))
    return labels.union(labels.select("label", "label").distinct())


def merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (key, label) after links (a, b) that were found later: only the classes that these touch are closed anew."""
    names = labels.select(F.col("key").alias("a"), F.col("label").alias("la")), labels.select(F.col("key").alias("b"), F.col("label").alias("lb"))
    ends = spread_join(spread_join(links, names[0], ["a"], "left"), names[1], ["b"], "left")
    joined = written(components(ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))), "joined")
    known = spread_join(labels, joined.select(F.col("key").alias("label"), F.col("label").alias("to")), ["label"], "left")
    return known.select("key", F.coalesce("to", "label").alias("label")).union(joined.join(labels, "key", "left_anti"))


def _rare_buckets(rest: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """bucket, place, weight, after and head of rest (place, weight) by rare elements; after is the number of the
    place's elements that follow this one, head has its first HEAD buckets. Ordered from rare to frequent, two sets of that similarity share one of their
    first n - ceil(similarity * n) + 1 elements, so what many documents have in common makes no bucket. Elements of
    one set alone fill its first places unseen."""
    each = written(rest.join(sets, F.col("place.key") == sets["key"]).select("place", "weight", F.explode("elements").alias("bucket")), "each")
    common = written(each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "common")
    shared = written(spread_join(each, common, ["bucket"], counts=common), "shared")
    known = shared.groupBy("place").agg(F.count(F.lit(1)).alias("known"))
    first = F.col("weight") - F.ceil(F.lit(similarity) * F.col("weight") - 1e-9) + 1 - (F.col("weight") - F.col("known"))
    room = shared.join(known, "place").withColumn("first", first).filter("first > 0")
    order = Window.partitionBy("place").orderBy("n", "bucket")
    placed = room.withColumn("at", F.row_number().over(order)).filter("at <= first").withColumn("after", F.col("known") - F.col("at"))
    heads = F.transform(F.array_sort(F.collect_list(F.when(F.col("at") <= HEAD, F.struct("at", "bucket"))).over(Window.partitionBy("place"))), lambda x: x["bucket"])
    found = written(placed.select("bucket", "place", "weight", "after", heads.alias("head")), "rare")
    discard(each, common, shared)
    return found


def _links(nodes: DataFrame, docs: DataFrame, similarity: float, at_once: float = AT_ONCE) -> tuple[DataFrame, DataFrame] | None:
    """Verified links (a, b) that join all similar nodes, and their components; None if there are none.
    nodes: key, doc_id (of one row that has it), weight, bands; docs: doc_id, key, text."""
    every = nodes.select("key", "weight", F.explode("bands").alias("band"))
    shared = written(every.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "bands")
    members = written(spread_join(every, shared, ["band"], counts=shared), "members")
    discard(shared)
    if members.isEmpty():
        return None
    popular = members.groupBy("key").agg(F.sum("n").alias("popular"))
    bare, members = members, written(members.join(popular, "key").select(F.col("band").alias("bucket"), "weight", F.struct("popular", "key").alias("place"), F.col("key").alias("label")), "ranked")
    discard(bare)
    wanted = members.select("place.key").distinct().join(nodes.select("key", "doc_id"), "key")
    match = docs.join(wanted.withColumnsRenamed({"key": "k", "doc_id": "d"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left_semi")
    sets = written(_elements(match.select("key", "text")).dropDuplicates(["key"]), "elements")

    def verified(pairs: DataFrame) -> DataFrame:
        size, both = (lambda x: F.size(x)), F.size(F.array_intersect("x", "y"))
        x, y = (sets.select(F.col("key").alias(on), F.col("elements").alias(name)) for on, name in (("a", "x"), ("b", "y")))
        joined = spread_join(spread_join(pairs, y, ["b"]), x, ["a"], counts=pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")))
        return joined.filter(both >= F.lit(similarity) * (size("x") + size("y") - both)).select("a", "b")

    links = tested = labels = None

    def compare(at: DataFrame) -> None:
        """Verifies pairs (place, leader) that were not verified before, and closes the links to classes."""
        nonlocal links, tested, labels
        pairs = at.select(F.greatest("place.key", "leader.key").alias("a"), F.least("place.key", "leader.key").alias("b")).distinct()
        pairs = written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        found = written(verified(pairs), "links")
        links, tested = (found, pairs) if links is None else (links.unionByName(found), tested.unionByName(pairs))
        if labels is None or not found.isEmpty():
            old, labels = labels, written(components(found) if labels is None else merge(labels, found), "labels")
            discard(old)

    def with_label(members: DataFrame) -> DataFrame:
        kept = [c for c in members.columns if c != "label"]
        named = members.select(*kept, F.col("place.key").alias("key"))
        return named.join(labels, "key", "left").select(*kept, F.coalesce("label", "key").alias("label"))

    def beside_leaders(members: DataFrame) -> DataFrame:
        """Every member with the leader of its bucket."""
        columns = [c for c in members.columns if c not in ("bucket", "place")]
        leaders = members.groupBy("bucket").agg(F.max("place").alias("leader"), *(F.max_by(c, "place").alias(f"leader_{c}") for c in columns))
        return spread_join(members, leaders, ["bucket"]).filter("place < leader")

    alike = F.least("weight", "leader_weight") >= F.lit(similarity) * F.greatest("weight", "leader_weight")
    # if enough elements follow this bucket in both
    enough = (1 + F.least("after", "leader_after")) * (1 + similarity) >= F.lit(similarity) * (F.col("weight") + F.col("leader_weight")) - 1e-6

    # of the buckets that both have among their first, only in the first of these
    both = F.array_intersect("head", "leader_head")
    once = (F.size(both) == 0) | (F.try_element_at(both, F.lit(1)) == F.col("bucket"))

    def several(members: DataFrame) -> DataFrame:
        """The members of buckets that hold more than one class."""
        open_ = members.groupBy("bucket").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 != l1").select("bucket")
        return spread_join(members, open_, ["bucket"], "left_semi")

    # every member of a band's bucket with its leader
    at = beside_leaders(members)
    compare(at.filter(alike))
    # what is left of the buckets that hold several classes goes on by rare shingles
    rest = written(several(written(with_label(at.select("bucket", "place", "weight")), "below")).select("place", "weight").distinct(), "rest")
    discard(members)
    if rest.isEmpty():
        return links, labels
    members = _rare_buckets(rest, sets, similarity)
    n_members = members.count()
    while True:
        named = written(with_label(members), "named")
        open_ = written(several(named), "open")
        discard(members, named)
        by_class = open_.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"))
        left = by_class.groupBy("bucket").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("q")).agg(F.sum((F.col("n") * F.col("n") - F.col("q")) / 2)).first()[0]
        if not left:
            return links, labels
        if left <= at_once * n_members:
            other = open_.select("bucket", *(F.col(c).alias(n) for c, n in (("label", "leader_label"), ("place", "leader"), ("weight", "leader_weight"), ("after", "leader_after"), ("head", "leader_head"))))
            compare(open_.join(other, "bucket").filter((F.col("place") < F.col("leader")) & (F.col("label") != F.col("leader_label")) & alike & enough & once))
            return links, labels
        below = beside_leaders(open_)
        compare(below.filter((F.col("label") != F.col("leader_label")) & alike & enough))
        members = written(below.select("bucket", "place", "weight", "after", "head"), "members")
        discard(open_)


def classes(docs: DataFrame, similarity: float = SIMILARITY, at_once: float = AT_ONCE) -> DataFrame:
    """doc_id, key (of the text) and label (equal for all texts of a class) of every row."""
    rows = docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    signed = written(_signatures(rows), "signatures")
    first = signed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("weight").alias("weight"), F.first("bands").alias("bands"))
    found = _links(first, rows, similarity, at_once)
    if found is None:
        return signed.select("doc_id", "key", F.col("key").alias("label"))
    return spread_join(signed.select("key", "doc_id"), found[1], ["key"], "left").select("doc_id", "key", F.coalesce("label", "key").alias("label"))


def class_ids(docs: DataFrame, similarity: float = SIMILARITY, at_once: float = AT_ONCE) -> DataFrame:
    """doc_id and class_id, the least doc_id of its class, of every row."""
    found = written(classes(docs, similarity, at_once).select("doc_id", "label"), "classes")
    least = written(found.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n")), "least")
    return spread_join(found, least.select("label", "class_id"), ["label"], counts=least).select("doc_id", "class_id")


def representatives(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, with all their columns, of one document of each class: that of the least doc_id
    (null if all are null), and of several such rows the one whose text has the least hash."""
    found = written(classes(docs, similarity), "classes")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    kept = written(found.groupBy("label").agg(F.min(place).alias("best")), "kept").select("best.doc_id", "best.key")
    of = kept.withColumnsRenamed({"doc_id": "of", "key": "of_key"})
    same = F.col("id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key"))
    # a row as one value: its columns may have any names
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), text_key(F.col("text"))).join(of, same, "left_semi")
    again = found.withColumnRenamed("doc_id", "id").join(of, same, "left_semi")
    if again.count() != kept.count():  # rows that have both id and text in common: one of each
        packed = packed.groupBy("key", "id").agg(F.first("row").alias("row"))
    return packed.select("row.*")
