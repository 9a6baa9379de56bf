"""Whitening of embeddings from an exact scatter matrix, gathered in residues.

An entry c becomes the integer x = floor(64 c) + 1000000. A first pass sums n, S and the extremes of x a partition (whole
numbers of any size). They bound every entry of the scatter of n x - S, and so the primes that a second pass needs:
each partition multiplies its centred rows modulo each prime, in blocks whose products stay below 2**53, so that
a floating-point matrix product is exact. The sums are added modulo the primes in a tree, and Chinese remaindering gives
the scatter itself, exactly. What passes the driver is d x d per prime, however many rows there are. Covariance,
eigenvectors and eigenvalues follow in double precision; a third pass measures the covariance of the whitened
rows, a last one returns them.

Vectors that are null or hold null or non-finite entries go. Vectors of another length than the commonest one (the larger of
equally common) can't be compared and go too, as do empty ones. Entries beyond 2**62 / 64 count as that. A component whose
eigenvalue is zero to double precision has whitened null, and identity_error leaves it out; if all vectors are equal,
explained is null too. A deviation beyond 2**63 is null. Null and repeated ids: each row stands for itself. An empty
table gives no rows. Only the id and the vector are read, so other columns may have any names.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

SCALE, SHIFT, SATURATED = 64.0, 1_000_000, 2.0**62
#: Residues are below 2**PRIME_BITS: sums of BLOCK products are exact in double precision.
PRIME_BITS, BLOCK = 20, 1 << 13
COMPONENTS = 32


class Moments(NamedTuple):
    n: int
    sums: np.ndarray  # Python integers
    low: int
    high: int

    def plus(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.sums + other.sums, min(self.low, other.low), max(self.high, other.high))


class Whitener(NamedTuple):
    moments: Moments
    vectors: np.ndarray  # a column for each component
    values: np.ndarray
    explained: list[float | None]
    usable: np.ndarray


def whole(column: pa.Array, d: int) -> np.ndarray:
    """The integers x of a column of lists of d entries."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    with np.errstate(over="ignore"):
        return np.floor(np.clip(SCALE * flat, -SATURATED, SATURATED)).astype(np.int64) + SHIFT


def centred(x: np.ndarray, m: Moments) -> np.ndarray:
    """n x - S, exactly: as 64-bit integers where they fit, else as Python's."""
    rest = m.sums - m.n * m.low
    if m.n * (m.high - m.low) < 2**62:
        return m.n * (x - m.low) - rest.astype(np.int64)
    return m.n * (x.astype(object) - m.low) - rest


def primes(above: int) -> list[int]:
    """The largest primes below 2**PRIME_BITS, as many as it takes for a product over `above`."""
    found, product, p = [], 1, 2**PRIME_BITS
    while product <= above:
        p -= 1
        if all(p % k for k in range(2, int(p**0.5) + 1)):
            found.append(p)
            product *= p
    return found


def residue_scatter(x: np.ndarray, m: Moments, moduli: list[int]) -> np.ndarray:
    """The scatter of n x - S modulo each prime."""
    out = np.zeros((len(moduli), x.shape[1], x.shape[1]), np.int64)
    for k, p in enumerate(moduli):
        mean = np.array([int(s) % p for s in m.sums], np.int64)
        for at in range(0, len(x), BLOCK):
            r = ((m.n % p) * (x[at : at + BLOCK] % p) - mean) % p
            block = r.astype(np.float64)
            out[k] = (out[k] + np.rint(block.T @ block).astype(np.int64)) % p
    return out


def remaindered(residues: np.ndarray, moduli: list[int]) -> np.ndarray:
    """Python integers, of either sign, with these residues (Chinese remainder theorem)."""
    product = int(np.prod(np.array(moduli, dtype=object)))
    total = sum(r.astype(object) * (product // p * pow(product // p, -1, p)) for r, p in zip(residues, moduli, strict=True)) % product
    return np.where(total > product // 2, total - product, total)


def _gathered(rows: DataFrame, part: Callable[[Iterator[pa.Array]], object], merge: Callable) -> object:
    """One small result a partition, from its vectors, merged in a tree; None if there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = part(b.column(0) for b in batches if b.num_rows)
        yield pa.RecordBatch.from_pydict({"state": [] if got is None else [pickle.dumps(got)]}, pa.schema([("state", pa.binary())]))

    def both(a, b):
        return b if a is None else a if b is None else merge(a, b)

    return rows.mapInArrow(run, "state binary").rdd.treeAggregate(None, lambda a, r: both(a, pickle.loads(bytes(r[0]))), both)


def measure(rows: DataFrame) -> tuple[int, Moments] | None:
    """The commonest length of the vectors, and the moments of those."""

    def part(columns: Iterator[pa.Array]) -> dict[int, Moments] | None:
        found: dict[int, Moments] = {}
        for column in columns:
            sizes = np.array(column.value_lengths())
            for d in map(int, np.unique(sizes)):
                x = whole(column.filter(pa.array(sizes == d)), d)
                # halves: 64-bit sums of either don't overflow within a batch
                sums = (x >> 31).sum(0).astype(object) * 2**31 + (x & (2**31 - 1)).sum(0).astype(object)
                one = Moments(len(x), sums, int(x.min()), int(x.max()))
                found[d] = found[d].plus(one) if d in found else one
        return found or None

    def merge(a: dict[int, Moments], b: dict[int, Moments]) -> dict[int, Moments]:
        return {d: a[d].plus(b[d]) if d in a and d in b else a.get(d) or b[d] for d in a.keys() | b.keys()}

    found = _gathered(rows, part, merge)
    return max(found.items(), key=lambda x: (x[1].n, x[0])) if found else None


def exact_scatter(rows: DataFrame, d: int, m: Moments) -> np.ndarray:
    """The scatter of n x - S over all rows, as Python integers."""
    moduli = primes(2 * m.n * (m.n * (m.high - m.low)) ** 2 + 1)

    def part(columns: Iterator[pa.Array]) -> np.ndarray:
        total = np.zeros((len(moduli), d, d), np.int64)
        for column in columns:
            total = (total + residue_scatter(whole(column, d), m, moduli)) % np.array(moduli)[:, None, None]
        return total

    return remaindered(_gathered(rows, part, lambda a, b: (a + b) % np.array(moduli)[:, None, None]), moduli)


def components_of(scatter: np.ndarray, m: Moments, k: int) -> Whitener:
    covariance = (scatter / m.n**3).astype(np.float64)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(0)[None], 0) < 0, -1.0, 1.0)
    trace = float(sum(scatter.diagonal()) / m.n**3)
    usable = values > trace * len(covariance) * np.finfo(float).eps
    return Whitener(m, vectors, values, [max(0.0, float(v)) / trace if trace else None for v in values], usable)


def whitened(x: np.ndarray, w: Whitener) -> np.ndarray:
    """The rows projected on the usable components, of unit variance each."""
    y = (centred(x, w.moments) / w.moments.n).astype(np.float64)
    return y @ w.vectors[:, w.usable] / np.sqrt(w.values[w.usable])


def identity_error(rows: DataFrame, d: int, w: Whitener) -> float:
    """How far the covariance of the whitened rows is from the identity."""

    def part(columns: Iterator[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
        k = int(w.usable.sum())
        total, square = np.zeros(k), np.zeros((k, k))
        for column in columns:
            z = whitened(whole(column, d), w)
            total, square = total + z.sum(0), square + z.T @ z
        return total, square

    total, square = _gathered(rows, part, lambda a, b: (a[0] + b[0], a[1] + b[1]))
    mean = total / w.moments.n
    return float(np.abs(square / w.moments.n - np.outer(mean, mean) - np.eye(len(mean))).max(initial=0.0))


def deviations(y: np.ndarray, m: Moments) -> list[int | None]:
    if y.dtype == np.int64 and y.shape[1] * (m.n * (m.high - m.low)) ** 2 < 2**63:
        return (y * y).sum(1).tolist()
    return [s if (s := sum(int(v) ** 2 for v in row)) < 2**63 else None for row in y]


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    kind = StructType(
        [StructField("vec_id", vectors.schema[vec_id].dataType), StructField("component", IntegerType())]
        + [StructField(c, LongType()) for c in ("n", "deviation")]
        + [StructField(c, DoubleType()) for c in ("whitened", "explained", "identity_error")]
    )
    # an entry that is null or NaN compares as neither; NaN is the largest double
    finite = F.forall("v", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter(F.size("v") > 0).filter(finite)
    measured = measure(rows.select("v"))
    if measured is None:
        return spark.createDataFrame([], kind)
    d, m = measured
    rows = rows.filter(F.size("v") == d)
    w = components_of(exact_scatter(rows.select("v"), d, m), m, min(components, d))
    error, k = identity_error(rows.select("v"), d, w), len(w.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = whole(batch.column(1), d)
            z = np.full((len(x), k), np.nan)
            z[:, w.usable] = whitened(x, w)
            each = pa.array(np.repeat(np.arange(len(x)), k))
            columns = [
                batch.column(0).take(each),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(x) * k, m.n, np.int64)),
                pa.array(deviations(centred(x, m), m), pa.int64()).take(each),
                pa.array(z.ravel(), from_pandas=True),
                pa.array(w.explained * len(x), pa.float64()),
                pa.array(np.full(len(x) * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, kind.names)

    return rows.mapInArrow(run, kind)
