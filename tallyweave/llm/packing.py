"""Packing documents into sequences: bounded-space online best-fit.

Documents become token pieces of at most ``capacity`` ids; only longer documents are cut, into full pieces
after a first one that takes the remainder. A full piece is a sequence of its own. The others are packed
online: at most ``open_bins`` sequences are open, kept in a bitset keyed by free space, so that the fullest
one with room is found by a shift and a lowest-bit search; when one too many is open, the fullest closes.

Tokens are counted once, in the scan; only (document, piece, length) rows are dealt out for packing, so a
hot source or a very long document moves no text. Each packing task handles an even share of the pieces
and leaves at most ``open_bins`` sequences less than full.

Ids are those of tokenizers at its defaults: the name of the added token in a text is that token.

Null text: empty. An empty document is one piece, the end id alone. Repeated doc_ids: each row is packed as
a document of its own. An empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.chunks import byte_bpe
from tallyweave.llm.store import written

CAPACITY, OPEN_BINS, END_ID = 1024, 1024, 2
#: Name and id of the token added to the vocabulary.
SPECIAL = ("<|endoftext|>", 50256)
#: Tokens that a packing task is given at least.
TASK_TOKENS = 16_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class BestFit:
    """Packs a stream of lengths. place() gives (bin, offset) at once; nothing is moved later."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.free = 0  # bit f: an open bin has f ids free
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n_open = self.n_bins = 0

    def _put(self, bin_id: int, space: int) -> None:
        if not space:  # full: closed
            self.n_open -= 1
            return
        self.bins[space].append(bin_id)
        self.free |= 1 << space

    def _take(self, space: int) -> int:
        bin_id = self.bins[space].pop()
        if not self.bins[space]:
            self.free &= ~(1 << space)
        return bin_id

    def place(self, length: int) -> tuple[int, int]:
        fits = self.free >> length
        if fits:  # the least free space that holds it
            space = length + (fits & -fits).bit_length() - 1
            bin_id = self._take(space)
        else:
            space, bin_id = self.capacity, self.n_bins
            self.n_bins += 1
            self.n_open += 1
            if self.n_open > self.open_bins:  # the fullest closes
                self._take((self.free & -self.free).bit_length() - 1)
                self.n_open -= 1
        self._put(bin_id, space - length)
        return bin_id, self.capacity - space


def token_pieces(docs: DataFrame, ranks: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID, special: tuple[str, int] = SPECIAL) -> DataFrame:
    """One row a piece: doc_id, piece, start, length and CRC-32 of its ids as little-endian uint32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = byte_bpe(ranks, pattern), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            rows: list[tuple] = []
            for doc_id, text in zip(ids, texts, strict=True):
                tokens = memoryview(bpe.encode_special(text.as_py(), special) + end)
                n, start = len(tokens) // 4, 0
                step = n % capacity or capacity
                piece = 0
                while start < n:
                    rows.append((doc_id, piece, start, step, zlib.crc32(tokens[4 * start : 4 * (start + step)])))
                    start, step, piece = start + step, capacity, piece + 1
                if len(rows) > 100_000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """Adds sequence_id and offset to pieces (which need a length). Reads its input twice: pass a written table."""
    total = pieces.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // task_tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fit, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [fit.place(n) for n in batch.column("length").to_pylist()]
            bins, offsets = zip(*placed, strict=True) if placed else ((), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array((base + b for b in bins), pa.int64()), pa.array(offsets, pa.int64())],
                [*batch.schema.names, "sequence_id", "offset"],
            )

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    # a task's sequence ids hold its partition number, and rows come in a fixed order: a task run again gives the same
    dealt = pieces.repartition(tasks, F.xxhash64("doc_id", "piece")).sortWithinPartitions(F.xxhash64("doc_id", "piece"), "length", "ids_crc32")
    return dealt.mapInArrow(run, out)


def pack_documents(docs: DataFrame, ranks: str, pattern: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, end_id: int = END_ID, special: tuple[str, int] = SPECIAL) -> DataFrame:
    return pack(written(token_pieces(docs, ranks, pattern, capacity, end_id, special), "pieces"), capacity, open_bins)
