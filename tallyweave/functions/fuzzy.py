"""Similarity of strings as Arrow UDFs, from the published definitions; scores from 0 to 100.

Used on distinct pairs of normalised strings only, see operators.matching; alike compares whole blocks of names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel(a: str, b: str) -> float:
    """Insertions and deletions only: 200 * LCS / (|a| + |b|)."""
    return 200.0 * _common(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set(a: str, b: str) -> float:
    """The best of the shared words and of each side's words beside them; 100 if one holds the other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 100.0
    # what both begin with is common; of the shared words and a side that begins with them, they are
    c, n, m = len(both), len(only_x) + bool(both), len(only_y) + bool(both)
    common = c + bool(both) + _common(only_x, only_y)
    return max(200.0 * common / (2 * c + n + m), *((200.0 * c / (2 * c + n), 200.0 * c / (2 * c + m)) if both else (0.0,)))


def partial(a: str, b: str) -> float:
    """The best indel score of the shorter string against any window of its length, or cut off, in the longer."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    n = len(short)
    spans = [(max(0, k), min(len(long), k + n)) for k in range(1 - n, len(long))]
    return max(indel(short, long[i:j]) for i, j in spans)


def _bits(sides: list[list[list[str]]], width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each side's names, given by their parts, a bit a part and occurrence, as rows of 64-bit words, and how many of a name's parts share a bit. Each
    of the commonest parts has a bit of its own."""
    numbers: dict[str, int] = {}
    parts = np.array([numbers.setdefault(p, len(numbers)) for side in sides for name in side for p in name], np.int64)
    sizes = np.array([len(name) for side in sides for name in side], np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((parts, rows))
    parts, runs = parts[order], np.ones(len(parts), bool)
    runs[1:] = (parts[1:] != parts[:-1]) | (rows[1:] != rows[:-1])
    starts = np.flatnonzero(runs)
    occurrence = np.arange(len(parts)) - np.repeat(starts, np.diff(np.append(starts, len(parts))))
    _, which, often = np.unique(parts * (sizes.max(initial=0) + 1) + occurrence, return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(-often, kind="stable")] = np.arange(len(often))
    place = rank if len(often) <= width else np.where(rank < width // 2, rank, width // 2 + rank % (width // 2))
    set_ = np.zeros((len(sizes), width), bool)
    set_[rows, place[which]] = True
    bits, doubled = np.packbits(set_, axis=1).view(np.uint64), sizes - set_.sum(1)
    cuts = np.cumsum([len(side) for side in sides])[:-1]
    return list(zip(np.split(bits, cuts), np.split(doubled, cuts), strict=True))


def _in_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bits that rows of a and b, broadcast, have in common."""
    return sum(np.bitwise_count(a[..., k] & b[..., k]).astype(np.int16) for k in range(a.shape[-1]))


def alike(left: Iterable[str], right: Iterable[str], cutoff: float) -> Iterator[tuple[str, str, float]]:
    """The pairs of names whose sorted words, all of them, may reach the cutoff by insertions and deletions, and whose token_set does. Names of n and m letters
    need cutoff * (n + m) / 200 common letters; a letter of one only parts two pairs of letters of its name at most, and one of the other's."""
    left, right = list(left), list(right)
    sides = [[" ".join(sorted(set(n.split()))) for n in names] for names in (left, right)]
    if not left or not right:
        return
    pairs_of = [[[w[k : k + 2] for w in s.split() for k in range(len(w) - 1)] for s in side] for side in sides]
    (a, a_twice), (b, b_twice) = _bits([[list(s) for s in side] for side in sides], 128)
    (p, p_twice), (q, q_twice) = _bits(pairs_of, 256)
    a_size, b_size = ([len(s) for s in side] for side in sides)
    p_size, q_size = (np.array([len(x) for x in side]) for side in pairs_of)
    for n in set(a_size):
        rows = np.flatnonzero(np.array(a_size) == n)
        for m in set(b_size):
            least = math.ceil(cutoff * (n + m) / 200 - 1e-9)
            if least > min(n, m):
                continue
            columns = np.flatnonzero(np.array(b_size) == m)
            theirs = np.ascontiguousarray(b[columns])
            for some in np.array_split(rows, -(-len(rows) // 64)):
                i, j = np.nonzero(_in_common(a[some][:, None], theirs[None]) + a_twice[some][:, None].astype(np.int16) >= least)
                i, j = some[i], columns[j]
                need = np.maximum(p_size[i] - 2 * (n - least) - (m - least), q_size[j] - 2 * (m - least) - (n - least))
                enough = _in_common(p[i], q[j]) + np.minimum(p_twice[i], q_twice[j]) >= need
                for x, y in zip(i[enough].tolist(), j[enough].tolist(), strict=True):
                    if (score := token_set(left[x], right[y])) >= cutoff:
                        yield left[x], right[y], score


def _udf(score):
    @F.pandas_udf("double")
    def scored(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else score(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return scored


def ratio(a, b):
    return _udf(indel)(a, b)


def token_set_ratio(a, b):
    return _udf(token_set)(a, b)


def partial_ratio(a, b):
    return _udf(partial)(a, b)
