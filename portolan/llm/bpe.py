"""Byte-level BPE by automaton and backtracking (operator 1).

Bytes are written as Latin-1 characters, so that one Aho-Corasick automaton over the vocabulary finds the longest
token from each place. From the left, the longest token is taken that fits the one before it; where none fits, the last token is
given up for a shorter one. Two tokens fit if merging their joined bytes by rank gives back just these two, which is
remembered for each pair. A sequence whose neighbours all fit is the one that merging by rank gives, and a position
from which no continuation exists is never tried again, so the work is linear in the text. Texts are cut at single
spaces first, so that a word with its surroundings is encoded once and then remembered, in a cache of bounded size;
longer stretches without a space are encoded each time.

Cases: null text is empty; an empty text has no tokens; special tokens are not looked for; texts of any length are
encoded whole. An empty table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from portolan.llm.support import texts, with_columns

#: Bytes of a cache of encoded words, and the longest word that is remembered.
CACHED, LONGEST = 100 << 20, 64
#: What a place in a dictionary takes.
ENTRY = 100
#: White space right before a space: there a cut at the space could divide one match of the pattern.
LOOSE = re.compile(r"\s ")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Cache(dict):
    """Values of a function of short strings, forgotten all at once when they take more than `limit` bytes."""

    def __init__(self, func, limit: int = CACHED):
        super().__init__()
        self.func, self.limit, self.held = func, limit, 0

    def __missing__(self, key):
        value = self.func(key)
        if len(key) <= LONGEST:
            self.held += ENTRY + sys.getsizeof(key) + sys.getsizeof(value)
            if self.held > self.limit:
                self.clear()
                self.held = 0
            self[key] = value
        return value


class Pairs(dict):
    """Answers for pairs of tokens, written as one number: each entry is of one size."""

    def __init__(self, func, limit: int = 1_000_000):
        super().__init__()
        self.func, self.limit = func, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.func(key)
        return value


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        self.automaton = ahocorasick.Automaton()
        #: For each token the longest token that it begins with, or -1.
        self.shorter = [-1] * len(self.tokens)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        for token, rank in ranks.items():
            if self._merge(token) == [rank]:  # else merging never leaves it
                self.automaton.add_word(token.decode("latin-1"), rank)
                starts = (token[:k] for k in range(len(token) - 1, 0, -1))
                self.shorter[rank] = next((ranks[x] for x in starts if x in ranks), -1)
        self.automaton.make_automaton()
        self.sizes = [len(t) for t in self.tokens]
        self.codes = [i.to_bytes(4, "little") for i in range(len(self.tokens))]
        self.fits = Pairs(self._fits)
        self.pieces = Cache(self._piece)
        self.chunks = Cache(self._chunk)

    def _merge(self, data: bytes) -> list[int]:
        """Merging by rank, as defined; for the joined bytes of one or two tokens only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, len(self.tokens)), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == len(self.tokens):
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _fits(self, pair: int) -> bool:
        """May the second token follow the first?"""
        a, b = pair >> 32, pair & 0xFFFFFFFF
        return self._merge(self.tokens[a] + self.tokens[b]) == [a, b]

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one match of the pattern."""
        data = piece.encode().decode("latin-1")
        n, fits, sizes, shorter = len(data), self.fits, self.sizes, self.shorter
        longest = [-1] * (n + 1)
        for end, rank in self.automaton.iter(data):
            longest[end + 1 - sizes[rank]] = rank  # longer ones come later
        out: list[int] = []
        closed = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            if out:
                before = out[-1] << 32
                while token >= 0 and (closed[at + sizes[token]] or not fits[before | token]):
                    token = shorter[token]
            else:
                while token >= 0 and closed[at + sizes[token]]:
                    token = shorter[token]
            if token >= 0:
                out.append(token)
                at += sizes[token]
                token = longest[at]
            elif out:
                closed[at] = 1
                token = out.pop()
                at -= sizes[token]
            else:
                raise ValueError("the vocabulary lacks a single byte")
        return out

    def _piece(self, piece: str) -> bytes:
        return b"".join(map(self.codes.__getitem__, self.encode_piece(piece)))

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(chunk)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if LOOSE.search(text):
            return self._chunk(text)
        words = text.split(" ")
        words[1:] = [" " + w for w in words[1:]]
        return b"".join(map(self.chunks.__getitem__, words)) if text else b""

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(4)
def codec(path: str, pattern: str) -> Codec:
    """One for each worker, vocabulary and pattern."""
    return Codec(load_ranks(path), pattern)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit)."""

    def setup():
        c = codec(path, pattern)

        def func(column: pa.Array) -> dict:
            ids = [c.encode(x) for x in column.to_pylist()]
            return {"n_tokens": [len(x) // 4 for x in ids], "ids": ids}

        return func

    return with_columns(texts(df, id_col, text_col), setup, "n_tokens long, ids binary")


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Adds `decoded`, the bytes of the ids."""

    def setup():
        c = codec(path, pattern)
        return lambda column: {"decoded": [c.decode(x or b"") for x in column.to_pylist()]}

    return with_columns(df, setup, "decoded binary", ids_col, drop=False)


def digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded and decoded again in one pass, without sending the ids."""

    def setup():
        c = codec(path, pattern)

        def func(column: pa.Array) -> dict:
            ids = [c.encode(x) for x in column.to_pylist()]
            return {
                "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(c.decode(x)).hexdigest() for x in ids],
            }

        return func

    return with_columns(texts(df, id_col, text_col), setup, "n_tokens long, ids_sha256 string, decoded_sha256 string")
