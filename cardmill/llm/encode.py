"""Token ids of a whole corpus under a public byte-level BPE vocabulary.

Within a pre-token, the encoding is found by dynamic programming over its byte prefixes: each prefix has exactly one
token that can stand last, namely the one that is compatible with the last token of what comes before it. Two tokens
are compatible if merging their joint bytes gives just these two again. The table of last tokens can be extended, so
appending is exact, and after an edit only the pre-tokens around it are encoded anew.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Pre-tokens, and pairs of tokens, kept per Python worker; beyond that a store is emptied, which costs time but changes nothing.
STORE, PAIRS = 400_000, 2_000_000


def vocabulary_path(name: str) -> str:
    """A path as given, or a file of the installed public tokenizers by its name."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class PrefixTable:
    """The last token of every byte prefix of one pre-token."""

    __slots__ = ("own", "data", "last")

    def __init__(self, own: PrefixEncoder, data: bytes = b""):
        self.own, self.data, self.last = own, b"", [-1]
        self.extend(data)

    def extend(self, more: bytes) -> None:
        """Append bytes; what is there stays valid, as a prefix's last token doesn't depend on what follows."""
        done, data, last, own = len(self.data), self.data + more, self.last, self.own
        for end in range(done + 1, len(data) + 1):
            for length in range(min(own.longest, end), 0, -1):
                token = own.ranks.get(data[end - length : end])
                if token is not None and (own.whole(token) if length == end else own.compatible(last[end - length], token)):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")
        self.data = data

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.own.tokens[self.last[end]])
        return out[::-1]


class PrefixEncoder:
    """Encodes text by one vocabulary of ranks (token bytes in base64 and rank, one a line)."""

    def __init__(self, path: str, pattern: str | None = None):
        import regex

        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if b}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.split = regex.compile(pattern)
        self._pairs: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        self._store: dict[str, list[int]] = {}

    def merge(self, data: bytes) -> list[int]:
        """Plain merging of the lowest rank first; for the short byte strings of a pair of tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
            k = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[k] == 1 << 60:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ranks[p] for p in parts]

    def whole(self, token: int) -> bool:
        if (known := self._whole.get(token)) is None:
            known = self._whole[token] = self.merge(self.tokens[token]) == [token]
        return known

    def compatible(self, left: int, right: int) -> bool:
        if (known := self._pairs.get((left, right))) is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            known = self._pairs[left, right] = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def piece(self, text: str) -> list[int]:
        ids = self._store.get(text)
        if ids is None:
            if len(self._store) >= STORE:
                self._store.clear()
            ids = self._store[text] = PrefixTable(self, text.encode("utf-8", "replace")).ids()
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; null and empty texts give []. Strings of special tokens are ordinary text."""
        out: list[int] = []
        if text:
            piece, store = self.piece, self._store
            for part in self.split.findall(text):
                out += store.get(part) or piece(part)
        return out

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        piece, store = self.piece, self._store
        return sum(len(store.get(part) or piece(part)) for part in self.split.findall(text))


class EncodedText:
    """A text with its pre-tokens, for exact appends and edits."""

    def __init__(self, encoder: PrefixEncoder, text: str = ""):
        self.encoder, self.text, self.starts, self.parts = encoder, "", [], []
        self.replace(0, 0, text)

    @property
    def ids(self) -> list[int]:
        return [i for p in self.parts for i in p]

    def append(self, more: str) -> int:
        return self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> int:
        """Put ``new`` for text[start:end]; returns how many pre-tokens were encoded again.

        Where a pre-token ends depends on what follows it: on the next character, or, for white space, on the whole run
        of white space and the character after it, or, for an apostrophe, on two characters. So splitting is taken up one
        pre-token before the white space that ends at ``start``, or two if the first of them is an apostrophe, and left as soon as a new boundary falls on an old one behind ``end``.
        """
        text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        back = start
        while back and self.text[back - 1].isspace():
            back -= 1
        keep = max(0, int(np.searchsorted(self.starts, back, "left")) - 1)
        if keep and self.text[self.starts[keep] - 1] == "'":
            keep -= 1
        at = self.starts[keep] if self.starts else 0
        old = {s + shift: k for k, s in enumerate(self.starts) if s >= end}
        starts, parts, rest, done = self.starts[:keep], self.parts[:keep], None, 0
        for m in self.encoder.split.finditer(text, at):
            if m.start() >= start + len(new) and m.start() in old:
                rest = old[m.start()]
                break
            starts.append(m.start())
            parts.append(self.encoder.piece(m.group()))
            done += 1
        if rest is not None:
            starts += [s + shift for s in self.starts[rest:]]
            parts += self.parts[rest:]
        self.text, self.starts, self.parts = text, starts, parts
        return done


@lru_cache(maxsize=2)
def encoder(name: str) -> PrefixEncoder:
    """One encoder per vocabulary and Python process."""
    return PrefixEncoder(vocabulary_path(name))


def encode_texts(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``<key>, ids``: the token ids of every row's text; null and empty texts give an empty list."""
    field = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            lists = [enc.encode(t.as_py()) for t in batch.column(1)]
            offsets = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.fromiter((i for x in lists for i in x), np.int32, offsets[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"{key} {field}, ids array<int>")


def count_tokens(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``<key>, n``: the number of tokens of every row's text."""
    field = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([enc.count(t.as_py()) for t in batch.column(1)], pa.int64())], names=[key, "n"])

    return docs.select(key, text).mapInArrow(run, f"{key} {field}, n bigint")
