"""Tables of distinct chunks: encode each distinct chunk of a text once and join the results by position.

A chunk is a word with the one space before it. In both vocabularies used here a token can begin with
a space but never holds one after a visible character, so such chunks are encoded independently of each
other. A word that is empty, or begins or ends with white space, breaks that rule; a text that holds
one is encoded whole by the library itself. Tables live in a Python worker, hold at most ``limit``
chunks (about 200 bytes each) and start anew when full: memory stays bounded, and results do not depend
on what a table happens to hold.
"""

from __future__ import annotations

import base64
import re
from functools import cache

import numpy as np

TABLE_LIMIT = 600_000
#: Longer words are encoded when met and not kept.
KEEP_CHARS = 64
#: Runs of Unicode white space that the byte-level library's splitter must not see: it recurses once a character.
LONG_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


def unsafe(word: str) -> bool:
    return not word or word[0].isspace() or word[-1].isspace() or "▁" in word


class _Words(dict):
    """word -> ids of it with ``before`` in front, as bytes; None marks a word that is not encoded alone."""

    def __init__(self, encode, before: str):
        super().__init__()
        self.encode, self.before = encode, before

    def __missing__(self, word: str) -> bytes | None:
        ids = None if unsafe(word) else self.encode(self.before + word)
        if len(word) <= KEEP_CHARS:
            self[word] = ids
        return ids


class ByteBpe:
    """Ids of a byte-level BPE vocabulary as little-endian uint32 bytes.

    ``ranks`` names the vocabulary as base64 token and rank. To encode(), names of special tokens in a text
    are ordinary text; encode_special() gives them their ids, as tokenizers does by default.
    """

    def __init__(self, ranks: str, pattern: str, limit: int = TABLE_LIMIT):
        import tiktoken

        with open(ranks, "rb") as f:
            vocabulary = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=vocabulary, special_tokens={})._core_bpe
        self.limit, self.first, self.rest = limit, _Words(self.whole, ""), _Words(self.whole, " ")

    def whole(self, text: str) -> bytes:
        """Ids of a text of any white space. Of a run of it the splitter makes one piece, but for the last character
        before something else, which goes on with that: so long runs are cut out and encoded as pieces."""
        ids, at = [], 0
        for run in LONG_SPACE.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            ids += self.core.encode_ordinary(text[at : run.start()])
            ids += self.core.encode_single_piece(text[run.start() : end].encode())
            at = end
        return np.array(ids + self.core.encode_ordinary(text[at:]), dtype="<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Null counts as empty."""
        if not text:
            return b""
        first, *rest = text.split(" ")
        try:
            ids = b"".join((self.first[first], *map(self.rest.__getitem__, rest)))
        except TypeError:  # a None among them
            ids = self.whole(text)
        if len(self.rest) + len(self.first) > self.limit:
            self.rest.clear()
            self.first.clear()
        return ids

    def encode_special(self, text: str | None, special: tuple[str, int]) -> bytes:
        """encode() of what stands between the names of a special token, with its id for each name."""
        name, at = special
        if not text or name not in text:
            return self.encode(text)
        return np.array([at], "<u4").tobytes().join(map(self.encode, text.split(name)))


@cache
def byte_bpe(ranks: str, pattern: str) -> ByteBpe:
    """One table for all tasks of a worker."""
    return ByteBpe(ranks, pattern)


def blocks(texts, chars: int = 2_000_000):
    """Runs of texts of some million characters, nulls as empty texts: bounds what is held at once."""
    run, size = [], 0
    for t in texts:
        t = t or ""
        if run and size + len(t) > chars:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run
