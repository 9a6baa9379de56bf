"""Lines of a page from its words, and labels in them with what stands beside and below.

A word belongs to the line above as long as its centre is within the tolerance of that line's *mean* so far, so the breaks depend on
each other. Spark deals documents over tasks and sorts their words by page and height; each task then streams its words once. Gaps that are
wider than any tolerance break for sure and stretches lower than the first word's tolerance can't break, which leaves only a few
words whose mean must be followed one by one. A task holds a batch and the line that is still open, never a page.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.spans import cut, spans
from tallyweave.functions.text import let
from tallyweave.sources.shared import by_key

#: A line takes words up to this share of its height from its mean.
TOLERANCE = 0.55
WORD = "struct<x0:double,y0:double,x1:double,y1:double,text:string,begin:int>"


def breaks(centre: np.ndarray, height: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Which words begin a line; fresh are those that begin a page."""
    new = fresh.copy()
    if not len(new):
        return new
    new[0] = True
    gap = np.diff(centre, prepend=centre[0])
    # no line's first word is taller than the tallest so far
    new |= gap > TOLERANCE * np.maximum.accumulate(height) * (1 + 1e-9)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(new))
    low = centre[ends - 1] - centre[starts] < TOLERANCE * height[starts] * (1 - 1e-9)
    for start, end in zip(starts[~low].tolist(), ends[~low].tolist(), strict=True):
        total, n, first = 0.0, 0, start
        for k, (c, h) in enumerate(zip(centre[start:end].tolist(), height[start:end].tolist(), strict=True), start):
            if n and abs(c - total / n) > TOLERANCE * max(h, height[first]):
                new[k], total, n, first = True, 0.0, 0, k
            total, n = total + c, n + 1
    return new


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of words that are sorted by doc_id, page, centre and x0; the open line is carried on."""
    carried: pa.Table | None = None
    last, number = None, 0  # the document of the last line, and how many lines it has so far

    def lines(words: pa.Table, new: np.ndarray, centre: np.ndarray) -> pa.RecordBatch:
        nonlocal last, number
        at = np.cumsum(new) - 1
        order = np.lexsort((np.arange(len(at)), words.column("x0").to_numpy(), at))
        words = words.take(pa.array(order)).combine_chunks()
        starts = np.flatnonzero(new)
        length = pc.utf8_length(words.column("text")).to_numpy().astype(np.int64) + 1
        begin = np.cumsum(length) - length
        begin = begin - begin[starts][at]
        column = lambda name: words.column(name).chunk(0)
        parts = pa.StructArray.from_arrays([column("x0"), column("y0"), column("x1"), column("y1"), column("text"), pa.array(begin.astype(np.int32))], ["x0", "y0", "x1", "y1", "text", "begin"])
        offsets = pa.array(np.append(starts, len(at)).astype(np.int32))
        docs = column("doc_id").take(pa.array(starts))
        same = np.zeros(len(starts), np.int32)
        for k, doc in enumerate(docs.to_pylist()):
            last, number = doc, number + 1 if doc == last and (number or k) else 1
            same[k] = number - 1
        y = np.add.reduceat(centre, starts) / np.diff(np.append(starts, len(at)))
        texts = pc.binary_join(pa.ListArray.from_arrays(offsets, column("text")), " ")
        return pa.RecordBatch.from_arrays([docs, pa.array(same), column("page").take(pa.array(starts)), pa.array(y), texts, pa.ListArray.from_arrays(offsets, parts)], ["doc_id", "line", "page", "y", "text", "words"])

    def run(words: pa.Table, over: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
        doc, page = (pc.fill_null(pc.dictionary_encode(words.column(c)).combine_chunks().indices, -1).to_numpy(zero_copy_only=False) for c in ("doc_id", "page"))
        y0, y1 = words.column("y0").to_numpy(), words.column("y1").to_numpy()
        centre, height = (y0 + y1) / 2, np.maximum(y1 - y0, 1.0)
        fresh = np.append(True, (doc[1:] != doc[:-1]) | (page[1:] != page[:-1]))
        new = breaks(centre, height, fresh)
        keep = len(new) if over else int(np.flatnonzero(new)[-1])
        return lines(words.slice(0, keep), new[:keep], centre[:keep]) if keep else None, words.slice(keep)

    for batch in batches:
        if batch.num_rows:
            words = pa.Table.from_batches([batch])
            words = words if carried is None else pa.concat_tables([carried, words])
            done, carried = run(words.combine_chunks(), False)
            if done is not None:
                yield done
    if carried is not None and carried.num_rows:
        yield run(carried.combine_chunks(), True)[0]


def by_document(rows: DataFrame) -> DataFrame:
    return by_key(rows, "doc_id")


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in order with the words of the next two on the same page; the last two wait for theirs."""
    held: pa.Table | None = None

    def run(rows: pa.Table, over: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
        n = rows.num_rows
        keep = n if over else max(0, n - 2)
        doc, page = (pc.fill_null(pc.dictionary_encode(rows.column(c)).combine_chunks().indices, -1).to_numpy(zero_copy_only=False) for c in ("doc_id", "page"))
        words = rows.column("words").combine_chunks()
        below = []
        for k in (1, 2):
            same = np.zeros(n, bool)
            same[: max(0, n - k)] = (doc[k:] == doc[: n - k]) & (page[k:] == page[: n - k])
            at = pa.array(np.where(same, np.arange(n) + k, 0)[:keep], mask=~same[:keep])
            below.append(words.take(at))
        done = rows.slice(0, keep).combine_chunks()
        parts = [c.chunk(0) for c in done.columns] if keep else []
        return pa.RecordBatch.from_arrays([*parts, *below], [*rows.column_names, "below1", "below2"]) if keep else None, rows.slice(keep)

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        done, held = run(rows.combine_chunks(), False)
        if done is not None:
            yield done
    if held is not None and held.num_rows:
        yield run(held.combine_chunks(), True)[0]


def lines(words: DataFrame, dealt: bool = False, neighbours: bool = False) -> DataFrame:
    """Lines (doc_id, line, page, y, text, words) of words (doc_id, page, x0, y0, x1, y1, text and seq, their order in the file).
    Words that are dealt by document already, as by_document does it, aren't shuffled again; neighbours are those of with_neighbours, taken as
    the lines come, without a shuffle of lines.

    Lines are numbered from 0 through all pages of a document; words stand from left to right, begin is their place in the line's
    text. Blank words and words without a box are left out; a null doc_id is a document like any other.
    """
    kind = f"doc_id {words.schema['doc_id'].dataType.simpleString()}, line int, page int, y double, text string, words array<{WORD}>"
    box = [F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")]
    plain = words.select("doc_id", F.col("page").cast("int"), *(c.alias(n) for c, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True)), F.trim("text").alias("text"), "seq")
    plain = plain.filter((F.col("text") != "") & F.col("x0").isNotNull() & F.col("x1").isNotNull() & F.col("y0").isNotNull() & F.col("y1").isNotNull())
    in_order = (plain if dealt else by_document(plain)).sortWithinPartitions("doc_id", "page", F.col("y0") + F.col("y1"), "x0", "seq").drop("seq")
    if neighbours:
        return in_order.mapInArrow(lambda batches: _with_next(_fold(batches)), f"{kind}, below1 array<{WORD}>, below2 array<{WORD}>")
    return in_order.mapInArrow(_fold, kind)


def with_neighbours(found: DataFrame) -> DataFrame:
    """Lines with the words of the next two on the same page (below1, below2, null where there are none); lines that have them stay as they are."""
    if "below1" in found.columns:
        return found
    order = Window.partitionBy("doc_id").orderBy("line")
    same = lambda k: F.lead("page", k).over(order) == F.col("page")
    return by_document(found).withColumns({"below1": F.when(same(1), F.lead("words", 1).over(order)), "below2": F.when(same(1) & same(2), F.lead("words", 2).over(order))})


def under(words: Column, x0: Column, x1: Column, left: float, right: float) -> Column:
    """The words of a row whose middle lies below a label, joined; null if there are none."""
    middle = lambda w: (w["x0"] + w["x1"]) / 2
    inside = F.filter(words, lambda w: (middle(w) >= x0 - left) & (middle(w) <= x1 + right))
    return let(inside, lambda ws: F.when(F.size(ws) > 0, F.array_join(F.transform(ws, lambda w: w["text"]), " ")))


def lowered(line: Column) -> Column:
    """A line in lower case as holds looks at it: the letters that match s, k and i when case is ignored are these."""
    return F.lower(F.translate(line, "\u017f\u212a\u0130\u0131", "skii"))


def holds(line: Column, words: tuple[str, ...]) -> Column:
    """Whether a line holds one of some words in lower case, whatever its case: what a pattern can't match without, found far faster than it."""
    return holds_low(lowered(line), words)


def holds_low(low: Column, words: tuple[str, ...]) -> Column:
    """holds of a line that is lowered already: done once, it serves all patterns."""
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))


def label_hits(labels: list[tuple[str, int, str]], left: float = 25, right: float = 70, needs: dict[str, tuple[str, ...]] | None = None, low: Column | None = None) -> Column:
    """Every place where labels (field, tier, pattern) stand in a line of with_neighbours: array<struct<field, tier, begin, stop, x0, x1, before, after,
    below1, below2>>. needs: words of which a pattern needs one; low: the line as lowered makes it, where needs are given. A label's words are those that it touches;
    below1 and below2 are the words of the next rows under it."""
    words, line = F.col("words"), F.col("text")

    def places(field: str, tier: int, pattern: str) -> Column:
        of = lambda s: F.struct(F.lit(field).alias("field"), F.lit(tier).alias("tier"), s["begin"].alias("begin"), s["stop"].alias("stop"))
        # most lines have no label
        may = F.rlike(line, F.lit(pattern)) if needs is None else holds_low(low, needs[pattern]) & F.rlike(line, F.lit(pattern))
        return F.when(may, F.transform(spans(line, pattern), of)).otherwise(F.array().cast("array<struct<field:string,tier:int,begin:int,stop:int>>"))

    def hit(s: Column) -> Column:
        first = F.get(F.filter(words, lambda w: w["begin"] + F.length(w["text"]) > s["begin"]), F.lit(0))
        final = F.coalesce(F.get(F.filter(words, lambda w: w["begin"] + F.length(w["text"]) >= s["stop"]), F.lit(0)), F.element_at(words, -1))

        # lambdas share nothing by themselves: unbound, the label's box would be searched for once for each word below it
        def placed(box: Column) -> Column:
            return F.struct(
                s["field"].alias("field"), s["tier"].alias("tier"), s["begin"].alias("begin"), s["stop"].alias("stop"), box["x0"].alias("x0"), box["x1"].alias("x1"),
                cut(line, F.lit(0), s["begin"]).alias("before"), cut(line, s["stop"], F.length(line)).alias("after"),
                under(F.col("below1"), box["x0"], box["x1"], left, right).alias("below1"), under(F.col("below2"), box["x0"], box["x1"], left, right).alias("below2"),
            )

        return let(F.struct(first["x0"].alias("x0"), final["x1"].alias("x1")), placed)

    every = [places(*label) for label in labels]
    return F.filter(F.transform(F.flatten(F.array(*every)) if len(every) > 1 else every[0], hit), lambda h: h["x0"].isNotNull())


def iter_hits(found: DataFrame, labels: list[tuple[str, int, str]], left: float = 25, right: float = 70) -> DataFrame:
    """A row (doc_id, line, field, tier, begin, ...) for every label (field, tier, pattern) found in lines."""
    return with_neighbours(found).select("doc_id", "line", F.inline(label_hits(labels, left, right)))
