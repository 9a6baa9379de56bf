"""SentencePiece encoding and decoding by a table of distinct words.

Where no piece of a model crosses a white-space marker (checked when the model is loaded), a text is the
sequence of its marked words, and each distinct marked word is segmented once and decoded once; the texts
are then put together by position. Texts with repeated, leading or trailing spaces or a literal marker are
encoded whole by the library. There is no shuffle: each task streams its documents and keeps a bounded
table in its worker, so hot sources and copies only make the table hit more often.

Null text: empty. Empty text: no ids, decoded empty. Repeated rows give repeated results; an empty table
gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.chunks import TABLE_LIMIT, blocks, unsafe

MARK = "▁"
ENCODED = "doc_id long, ids array<int>, decoded string"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PieceCodec:
    """encode() and decode() of a sentencepiece model, through a table of distinct words."""

    def __init__(self, model: str, limit: int = TABLE_LIMIT // 2):
        import sentencepiece

        self.lib, self.limit = sentencepiece.SentencePieceProcessor(model_file=model), limit
        pieces = (self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size()))
        self.by_word = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.ids: dict[str, str | None] = {}  # word -> its ids, comma-joined; None: only in its text
        self.text: dict[str, str | None] = {}  # word -> its decoded text
        self.chars = 0  # of the words in the table

    def _load(self, words: set[str]) -> None:
        new = words.difference(self.ids)
        self.chars += sum(map(len, new))
        if len(new) + len(self.ids) > self.limit or self.chars > 20 * self.limit:
            self.chars = sum(map(len, words))
            self.ids.clear()
            self.text.clear()
            new = words
        self.ids.update(zip((odd := [w for w in new if unsafe(w)]), repeat(None)))
        self.text.update(zip(odd, repeat(None)))
        good = list(new.difference(odd))
        ids = self.lib.encode(good, num_threads=1) if good else []
        self.ids.update(zip(good, (",".join(map(str, x)) for x in ids), strict=True))
        self.text.update(zip(good, self.lib.decode(ids, num_threads=1) if good else (), strict=True))

    def _whole(self, text: str) -> tuple[str, str]:
        ids = self.lib.encode(text) if text else []
        return ",".join(map(str, ids)), self.lib.decode(ids) if ids else ""

    def __call__(self, texts) -> Iterator[tuple[str, str]]:
        """For each text its ids, comma-joined, and the text that they decode to."""
        for block in blocks(texts):
            if not self.by_word:
                yield from map(self._whole, block)
                continue
            split = [t.split(" ") for t in block]
            self._load({w for words in split for w in words})
            ids, decoded = self.ids.__getitem__, self.text.__getitem__
            for text, words in zip(block, split, strict=True):
                try:
                    yield ",".join(map(ids, words)), " ".join(map(decoded, words))
                except TypeError:  # a None among them
                    yield self._whole(text)


@cache
def codec(model: str) -> PieceCodec:
    """One table for all tasks of a worker."""
    return PieceCodec(model)


def _run(docs: DataFrame, model: str, row, schema: str, kinds: list[pa.DataType]) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(model)
        for batch in batches:
            rows = [row(*x) for x in code(batch.column(1).to_pylist())]
            columns = zip(*rows, strict=True) if rows else ([] for _ in kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids and the decoded text of each document."""
    return _run(docs, model, lambda ids, text: ([int(x) for x in ids.split(",")] if ids else [], text), ENCODED, [pa.list_(pa.int32()), pa.string()])


def encode_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the comma-joined ids and of the decoded text."""

    def row(ids: str, text: str) -> tuple[int, str, str]:
        return ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    return _run(docs, model, row, DIGEST, [pa.int64(), pa.string(), pa.string()])
