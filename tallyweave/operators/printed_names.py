"""Names printed in documents, and the approved vendor of an invoice in three tiers.

A name of five letters or more is on a document if some stretch of its text, as long as the name, is similar to it: cutoff c of 100 by
insertions and deletions. Then at most (1 - c / 100) of both lengths' letters are in only one of them, and of one more segments of the name than
that, one stands whole in the text. An automaton over the segments of all names, an inverted index of them, finds these in one pass of
a text; only stretches around them are compared, bit-parallel. The names of a segment that more than FEW hold, as of a word of many names, are first
counted against the stretch together: those with too few letters in common are passed over at once. Names are the small side: they go to the tasks in
blocks of at most NAMES, so no document meets a name whose segments it doesn't hold.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import text
from tallyweave.functions.fuzzy import _common, indel, partial
from tallyweave.operators.matching import SAME_RECORD, similar_names
from tallyweave.sources.shared import once

#: The similarity of a printed name; shorter names than SHORT must be whole words, and shorter ones than LEAST are none.
PRINTED, SHORT, LEAST = 90, 5, 3
#: Names that a task looks for at once, and names of one segment that are compared without a look at their letters.
NAMES, FEW = 20_000, 16
#: Kinds of letters that are counted apart, and up to how many of each.
KINDS, MOST = 37, 3


def flat(c: Column) -> Column:
    """A text as names are looked for in it: lower-case letters, digits and spaces."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9 ]", " ")


def segments(name: str, cutoff: float) -> list[tuple[int, str]]:
    """(place, letters) of the segments of which one stands whole in every stretch that is similar enough."""
    n = math.floor(2 * len(name) * (1 - cutoff / 100) + 1e-9) + 1
    cuts = [len(name) * k // n for k in range(n + 1)]
    return [(a, name[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def letter_bits(s: str) -> tuple[int, int]:
    """A bit for each of the first MOST letters of a kind, and how many letters are beyond these."""
    counted, bits, beyond = [0] * KINDS, 0, 0
    for letter in s:
        kind = ord(letter) % KINDS
        if counted[kind] < MOST:
            bits |= 1 << MOST * kind + counted[kind]
            counted[kind] += 1
        else:
            beyond += 1
    return bits, beyond


def _words(bits: int) -> tuple[int, int]:
    return bits & (1 << 64) - 1, bits >> 64


class Index:
    """Names by their segments."""

    def __init__(self, names: list[str], cutoff: float = PRINTED, short: int = SHORT):
        """Names of fewer letters than short must be whole words."""
        import ahocorasick

        self.cutoff = cutoff
        self.words = [n for n in names if LEAST <= len(n) < short]
        self.names = [n for n in names if len(n) >= max(short, 1)]
        holders: dict[str, dict[tuple[int, int], list[int]]] = {}
        for k, name in enumerate(self.names):
            for place, letters in segments(name, cutoff):
                holders.setdefault(letters, {}).setdefault((len(name), place), []).append(k)
        self.longest = max(map(len, self.names), default=0)
        self.bits = self.beyond = None
        if len(self.names) > FEW:
            counted = [letter_bits(n) for n in self.names]
            self.bits = np.array([_words(bits) for bits, _ in counted], np.uint64)
            self.beyond = np.array([beyond for _, beyond in counted], np.int64)
        self.automaton = ahocorasick.Automaton()
        for letters, where in holders.items():
            few = [(k, place) for (_, place), ks in where.items() if len(ks) <= FEW for k in ks]
            many = [(n, place, np.array(ks), self.bits[ks], self.beyond[ks]) for (n, place), ks in where.items() if len(ks) > FEW]
            self.automaton.add_word(letters, (len(letters), few, many))
        if holders:
            self.automaton.make_automaton()

    def slack(self, n: int) -> int:
        return math.floor(2 * n * (1 - self.cutoff / 100) + 1e-9)

    def least(self, n: int, low: int, high: int, document: str) -> float:
        """What a stretch must have in common with a name of n letters if it begins from low to high; one that the text's ends cut off needs less."""
        whole = low >= 0 and high + n <= len(document)
        return n * self.cutoff / 100 if whole else n * self.cutoff / (200 - self.cutoff)

    def likely(self, n: int, start: int, document: str, names: np.ndarray, bits: np.ndarray, beyond: np.ndarray) -> list[int]:
        """Those of these names, all of n letters, that have letters enough in common with what is about a start."""
        low, high = start - self.slack(n), start + self.slack(n)

        def enough(stretch: str, least: float, bits: np.ndarray, beyond: np.ndarray) -> np.ndarray:
            here = _words(letter_bits(stretch)[0])
            return sum(np.bitwise_count(bits[:, k] & np.uint64(here[k])).astype(np.int64) for k in range(2)) + beyond >= least - 1e-9

        kept = np.flatnonzero(enough(document[max(0, low) : high + n], self.least(n, low, high, document), bits, beyond))
        if len(kept) > FEW:  # each stretch alone has less in common than all of them
            stretches = ((document[max(0, s) : s + n], self.least(n, s, s, document)) for s in range(max(low, 1 - n), min(high, len(document) - 1) + 1))
            kept = kept[np.logical_or.reduce([enough(stretch, least, bits[kept], beyond[kept]) for stretch, least in stretches])]
        return names[kept].tolist()

    def near(self, name: str, document: str, about: set[int]) -> bool:
        """Whether a stretch that begins near one of these places is similar to the name. What a range of stretches has in common
        with the name bounds what any one of them has, so most ranges are settled by one comparison."""
        n = len(name)
        slack = self.slack(n)
        ranges: list[list[int]] = []
        for s in sorted(about):
            if ranges and s - slack <= ranges[-1][1] + 1:
                ranges[-1][1] = s + slack
            else:
                ranges.append([s - slack, s + slack])
        for low, high in ranges:
            if _common(name, document[max(0, low) : high + n]) < self.least(n, low, high, document) - 1e-9:
                continue
            if any(indel(name, document[max(0, s) : s + n]) >= self.cutoff for s in range(max(low, 1 - n), min(high, len(document) - 1) + 1)):
                return True
        return False

    def printed(self, document: str) -> list[str]:
        """The names that are on a flat text, in their order."""
        padded = f" {document} "
        found = [n for n in self.words if f" {n} " in padded]
        starts: dict[int, set[int]] = {}
        if len(self.automaton):
            for end, (size, few, many) in self.automaton.iter(document):
                for k, place in few:
                    starts.setdefault(k, set()).add(end - size + 1 - place)
                for n, place, names, bits, beyond in many:
                    for k in self.likely(n, end - size + 1 - place, document, names, bits, beyond):
                        starts.setdefault(k, set()).add(end - size + 1 - place)
        for k, about in starts.items():
            name = self.names[k]
            if len(name) <= len(document) and self.near(name, document, about):
                found.append(name)
        # a text shorter than the name slides along it instead
        if len(document) < self.longest and document.strip():
            found += [n for n in self.names if len(n) > len(document) and partial(n, document) >= self.cutoff]
        return found


def names_on_documents(documents: DataFrame, names: DataFrame, cutoff: float = PRINTED, at_once: int = NAMES, dealt: bool = False) -> DataFrame:
    """(doc_id, name) for every name (column name) that is printed in a document (doc_id, text); name is the normalised one. Null texts hold
    none; repeated documents each give their rows. Documents that are dealt over all tasks already aren't shuffled again."""
    known = names.select(text.norm_vendor(F.col("name")).alias("n")).filter(F.length("n") >= LEAST).distinct()
    blocks = max(1, -(-known.count() // at_once))
    # short as they are, texts take much work: adaptive execution would put them into few tasks
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select("doc_id", flat(F.col("text")).alias("text"))
    rows = rows if dealt else rows.repartition(tasks, "doc_id", "text")
    kind = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, name string"

    def search(block: list[str]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(block, cutoff)
            for batch in batches:
                hits = [(k, n) for k, t in enumerate(batch.column(1)) for n in index.printed(t.as_py())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k for k, _ in hits], pa.int32())), pa.array([n for _, n in hits], pa.string())], ["doc_id", "name"])

        return rows.mapInArrow(run, kind)

    found = None
    for b in range(blocks):
        block = sorted(r[0] for r in known.filter(F.pmod(F.xxhash64("n"), F.lit(blocks)) == b).collect())
        found = search(block) if found is None else found.unionByName(search(block))
    return found


def approved_vendor(documents: DataFrame, texts: DataFrame | Callable[[DataFrame], DataFrame], vendors: DataFrame) -> DataFrame:
    """doc_id, the approved vendor (null if none) and the tier that told it: 1, the first by name whose name is similar to the one that was read;
    2, the first with the same tax id, white space aside; 3, the only one whose name is printed on the document. documents: doc_id, vendor,
    tax_id; texts: doc_id, text, read only where the first two tiers are silent, or
    what makes them, dealt over all tasks, of the documents (doc_id) that are still open; vendors: name, tax_id. Two vendors printed on a page are no answer."""
    known = vendors.filter(~text.missing(F.col("name"))).withColumn("n", text.norm_vendor(F.col("name")))
    bare = lambda c: F.nullif(F.upper(F.regexp_replace(c, r"(?U)\s", "")), F.lit(""))
    read = documents.select("doc_id", "vendor").withColumn("a", text.norm_vendor(F.col("vendor")))
    by_name = similar_names(documents.select("vendor"), vendors.select("name"), SAME_RECORD).join(known.select(F.col("n").alias("b"), "name"), "b").groupBy("a").agg(F.min("name").alias("name"))
    first = read.join(by_name, "a").select("doc_id", "name", F.lit(1).alias("tier"))
    ids = known.select(bare(F.col("tax_id")).alias("t"), "name").filter("t IS NOT NULL").groupBy("t").agg(F.min("name").alias("name"))
    second = documents.select("doc_id", bare(F.col("tax_id")).alias("t")).join(ids, "t").select("doc_id", "name", F.lit(2).alias("tier"))
    # only documents that are still open are searched
    told = once(first.unionByName(second), "told")
    rest, made = told.select("doc_id").distinct(), callable(texts)
    open_ = texts(documents.select("doc_id").join(rest, "doc_id", "left_anti")) if made else texts.select("doc_id", "text").join(rest, "doc_id", "left_anti")
    printed = names_on_documents(open_, vendors.select("name"), dealt=made).join(known.select(F.col("n").alias("b"), F.col("name").alias("as_known")), F.col("name") == F.col("b")).select("doc_id", "as_known")
    third = printed.groupBy("doc_id").agg(F.min("as_known").alias("name"), F.count_distinct("as_known").alias("k")).filter("k = 1").select("doc_id", "name", F.lit(3).alias("tier"))
    best = told.unionByName(third).groupBy("doc_id").agg(F.min(F.struct("tier", "name")).alias("best"))
    return documents.select("doc_id").join(best, "doc_id", "left").select("doc_id", F.col("best.name").alias("vendor"), F.col("best.tier").alias("tier"))
