"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds H[i] = c[0] + c[1] B + ... + c[i-1] B^(i-1) modulo a prime, for two primes
below 2**31. From it follow the hash of any span, hence whether two spans are equal, and by binary search
the longest common extension of two positions. A fingerprint is the text's length, its hash under both
primes and the ``KEEP`` least scrambled hashes of its spans of ``SPAN`` code points; the likeness of two
fingerprints is the share of common spans (Dice) that these estimate, 1 for equal texts.

The query's edited text joins a document with the next one by doc_id. Documents are dealt into ranges of
doc_id of about equal bytes, each a partition of its own; each range also gets the first document of the following
one, so every text is shuffled once and no task sees more than its range. The hashes of an edited text's
spans are those of its two parts, so each text is hashed once.

Null text: empty. Empty texts: likeness 1 to each other, 0 to others. Equal doc_ids follow each other by text,
nulls first; a table of one row is its own next document; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRIMES, BASES = (2147483647, 2147483629), (1103515245, 1664525253)
SPAN, KEEP = 12, 64
SCRAMBLE = np.uint64(0x9E3779B97F4A7C15)


class _Powers:
    """Powers of a base and of its inverse modulo a prime, extended by doubling as texts need them."""

    def __init__(self, prime: int, base: int):
        self.prime = np.uint64(prime)
        self.tables = [np.array([1, x], dtype=np.uint64) for x in (base % prime, pow(base, -1, prime))]

    def upto(self, n: int) -> list[np.ndarray]:
        while len(self.tables[0]) < n:
            for k, t in enumerate(self.tables):
                step = t[-1] * t[1] % self.prime
                self.tables[k] = np.concatenate([t, t * step % self.prime])
        return self.tables


POWERS = [_Powers(p, b) for p, b in zip(PRIMES, BASES, strict=True)]


class PrefixHashes:
    """Prefix arrays of a text under both primes."""

    def __init__(self, text: str | None):
        codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        self.n = len(codes)
        self.prefix = []
        codes += np.uint64(1)  # so that code point 0 counts
        for powers in POWERS:
            terms = codes * powers.upto(self.n)[0][: self.n] % powers.prime
            self.prefix.append(np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64) % powers.prime]).astype(np.uint32))

    def span(self, start: int, end: int) -> tuple[int, ...]:
        """The hash of text[start:end] under each prime, the same wherever the span stands."""
        return tuple((int(h[end]) - int(h[start])) * int(w.upto(start + 1)[1][start]) % int(w.prime) for h, w in zip(self.prefix, POWERS, strict=True))

    def common(self, start: int, other: PrefixHashes, other_start: int) -> int:
        """Length of the longest common extension of the two positions."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(start, start + mid) == other.span(other_start, other_start + mid):
                low = mid
            else:
                high = mid - 1
        return low

    def windows(self) -> np.ndarray:
        """Scrambled 32-bit hashes of all spans of SPAN code points, by position."""
        h, w = self.prefix[0], POWERS[0]
        if self.n < SPAN:
            return np.zeros(0, np.uint32)
        diff = h[SPAN:].astype(np.uint64) + w.prime - h[:-SPAN]
        return scramble(diff * w.upto(self.n)[1][: self.n - SPAN + 1] % w.prime)


def scramble(hashes: np.ndarray) -> np.ndarray:
    return ((hashes + np.uint64(1)) * SCRAMBLE >> np.uint64(32)).astype(np.uint32)


def least(*parts: np.ndarray) -> np.ndarray:
    """The KEEP least distinct values of all parts."""
    picked = []
    for p in parts:
        for factor in (4, 64):  # a threshold leaves few to sort; repeated spans may need a wider one
            if len(p) <= factor * KEEP:
                break
            few = np.unique(p[p < np.uint32(factor * KEEP * (1 << 32) // len(p) if len(p) > factor * KEEP else 0xFFFFFFFF)])
            if len(few) >= KEEP:
                p = few
                break
        picked.append(p)
    return np.unique(np.concatenate(picked))[:KEEP]


def _form(n: int, whole: tuple[int, ...], kept: np.ndarray) -> str:
    if n and not len(kept):  # shorter than a span: its whole hash stands for its spans
        kept = scramble(np.array(whole[:1], np.uint64))
    return f"{n:x}-{whole[0]:08x}{whole[1]:08x}-" + kept.astype(">u4").tobytes().hex()


def fingerprint(text: str | None) -> str:
    p = PrefixHashes(text)
    return _form(p.n, p.span(0, p.n), least(p.windows()))


def likeness(a: str, b: str) -> float:
    """Estimated share of common spans (Dice) of the fingerprinted texts."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f.rpartition("-")[2]), ">u4") for f in (a, b))
    if not len(x) or not len(y):
        return 0.0
    union = np.unique(np.concatenate([x, y]))[:KEEP]
    both = np.intersect1d(x, y, assume_unique=True)
    j = np.isin(union, both, assume_unique=True).sum() / len(union)
    return float(2 * j / (1 + j))


class _Doc:
    def __init__(self, doc_id, text: str | None):
        self.doc_id, self.text = doc_id, text or ""
        self.hashes = PrefixHashes(self.text)
        self.windows = self.hashes.windows()
        self.fingerprint = _form(self.hashes.n, self.hashes.span(0, self.hashes.n), least(self.windows))


def _edited(doc: _Doc, after: _Doc) -> tuple[str, str]:
    """The edited text and its fingerprint, from the hashes of its two parts."""
    n = doc.hashes.n
    head, take = n - n // 2, min(n // 2, after.hashes.n)
    text = doc.text[:head] + after.text[:take]
    seam = PrefixHashes(text[max(0, head - SPAN + 1) : head + SPAN - 1])
    parts = (doc.windows[: max(0, head - SPAN + 1)], seam.windows(), after.windows[: max(0, take - SPAN + 1)])
    whole = tuple(
        (a + b * int(w.upto(head + 1)[0][head])) % int(w.prime) for a, b, w in zip(doc.hashes.span(0, head), after.hashes.span(0, take), POWERS, strict=True)
    )
    return text, _form(head + take, whole, least(*parts))


LEAST_ID = -(1 << 63)
#: Bytes of text that a range holds at most, unless one id alone has more, and ranges that are dealt at most.
RANGE_BYTES, MAX_RANGES = 32 << 20, 50_000
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix_next long"


def _bounds(docs: DataFrame, range_bytes: int) -> np.ndarray:
    """The ids at which ranges of about equal bytes begin, but for the first: fine ranges of equal counts, joined
    while they hold few bytes. As many as the bytes ask for, about MAX_RANGES at most."""
    sized = docs.select(F.coalesce("doc_id", F.lit(LEAST_ID)).alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    target = max(range_bytes, -(-total // MAX_RANGES))
    n = 4 * max(-(-total // target), docs.sparkSession.sparkContext.defaultParallelism)
    fine = np.unique(np.array(sized.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n), dtype=np.float64).astype(np.int64))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(fine) + 1, np.int64)
        for b in batches:
            np.add.at(held, np.searchsorted(fine, b.column(0).to_numpy(), side="right"), b.column(1).to_numpy())
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at], pa.int64())], ["range", "size"])

    held = np.zeros(len(fine) + 1, np.int64)
    for r in sized.mapInArrow(sizes, "range long, size long").groupBy("range").agg(F.sum("size").alias("size")).collect():  # one row a fine range
        held[r["range"]] = r["size"]
    target = min(target, max(1, 4 * total // n))  # small tables still use all cores
    bounds, now = [], held[0]
    for bound, size in zip(fine.tolist(), held[1:].tolist(), strict=True):
        if now and now + size > target:
            bounds.append(bound)
            now = 0
        now += size
    return np.array(bounds, np.int64)


def _dealt(docs: DataFrame, range_bytes: int) -> tuple[DataFrame, int]:
    """Rows (range, guest, doc_id, text): each document in its range of doc_id, and the first document of
    each range once more, as guest, in the range before (of the first: in the last). And the number of ranges."""
    ids = docs.select(F.coalesce("doc_id", F.lit(LEAST_ID)).alias("doc_id"))
    bounds = _bounds(docs, range_bytes)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.sort(b.column(0).to_numpy())
            at, first = np.unique(np.searchsorted(bounds, x, side="right"), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(x[first], pa.int64())], ["range", "first"])

    rows = sorted(ids.mapInArrow(firsts, "range long, first long").groupBy("range").agg(F.min("first").alias("first")).collect())  # one row a range
    guests = {first: rows[k - 1][0] for k, (_, first) in enumerate(rows)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts_only = np.array(sorted(guests), np.int64)
        for b in batches:
            keys = b.column(0).fill_null(LEAST_ID).to_numpy()
            home = np.searchsorted(bounds, keys, side="right")
            yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), pa.array(np.zeros(len(keys), bool)), *b.columns], ["range", "guest", "doc_id", "text"])
            hit = np.flatnonzero(np.isin(keys, firsts_only))
            if len(hit):
                extra = b.take(pa.array(hit))
                to = [guests[int(keys[i])] for i in hit]
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(np.ones(len(hit), bool)), *extra.columns], ["range", "guest", "doc_id", "text"])

    return docs.mapInArrow(deal, "range int, guest boolean, doc_id long, text string"), len(bounds) + 1


def fingerprint_documents(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with likenesses (see RESULT)."""
    dealt, n = _dealt(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), range_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
        names = [x.split()[0] for x in RESULT.split(", ")]
        at, last = None, None  # the range, and the document that waits for its next one
        for batch in batches:
            rows = []
            for range_, guest, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if range_ != at:
                    at, last = range_, None
                elif last is None:  # a further guest
                    continue
                doc = _Doc(doc_id, text)
                if last is not None:
                    edited, form = _edited(last, doc)
                    rows.append(
                        (last.doc_id, last.hashes.n, hashlib.sha256(edited.encode()).hexdigest(), last.fingerprint, form)
                        + (likeness(last.fingerprint, form), likeness(last.fingerprint, doc.fingerprint), last.hashes.common(0, doc.hashes, 0))
                    )
                last = None if guest else doc
            columns = zip(*rows, strict=True) if rows else ([] for _ in kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return dealt.repartitionById(n, "range").sortWithinPartitions("range", "guest", "doc_id", "text").mapInArrow(run, RESULT)
