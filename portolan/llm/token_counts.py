"""Token counts of a sentencepiece BPE model by rank-synchronous merging of arrays (operator 4).

A text is cut between two characters that no piece of the model holds side by side: no merge crosses such a place, so
the runs between are counted on their own, and each different run once (a cache of fixed size remembers them). The new
runs of a slice lie in one flat numpy array of symbols with ragged bounds. In each round every run merges its pair of
best rank, the leftmost of equals, all runs at once; runs without a pair leave. What survives is the count: a symbol
that is a piece counts one, an unknown character as many as its UTF-8 bytes. A run of over 200 symbols is merged
through a heap instead, by the same order, as one merge a round would take quadratic time.

Cases: null text is empty and has no tokens; special strings in texts are plain text; nothing is cut off. An empty
table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.llm.support import texts, with_columns

SPACE = "▁"
#: Words that are remembered, and the longest such word.
CACHED, LONGEST = 400_000, 64
LONG_RUN = 200
NONE = np.iinfo(np.int64).max


class Model:
    """Pieces, merges and cut places of a model file; only models with identity normalisation and byte fallback."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        usual = [i for i in range(size) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i))]
        if sp.encode("ﬁ a  b", out_type=str)[-3:] != [SPACE + "a", SPACE, SPACE + "b"]:
            raise ValueError("the model changes texts before it splits them; this operator counts models that do not")
        ids = {sp.id_to_piece(i): i for i in usual}
        score = np.array([sp.get_score(i) for i in range(size)])
        level = {s: k for k, s in enumerate(sorted({score[i] for i in usual}, reverse=True))}
        self.symbol = np.full(0x110000, -1, np.int64)
        pairs: dict[tuple[int, int], tuple[int, int]] = {}
        side_by_side: set[str] = set()
        for piece, i in ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
            side_by_side.update(piece[k : k + 2] for k in range(len(piece) - 1))
            for k in range(1, len(piece)):
                a, b = ids.get(piece[:k]), ids.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a, b] = (level[score[i]], i)
        self.pairs = pairs
        self.width = size
        keys = np.array([a * size + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.value = np.array([r * size + i for r, i in pairs.values()], np.int64)[order]
        self.joined = np.array(sorted(ord(p[0]) << 21 | ord(p[1]) for p in side_by_side), np.int64)
        self.known: dict[str, int] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank * width + merged symbol of each pair, NONE where there is no such piece."""
        key = np.where((left >= 0) & (right >= 0), left * self.width + right, -1)
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.value[at], NONE)

    def count_runs(self, runs: list[str]) -> np.ndarray:
        """Tokens of each run, by synchronous rounds."""
        sizes = np.array([len(r) for r in runs], np.int64)
        out = np.zeros(len(runs), np.int64)
        codes = np.frombuffer("".join(runs).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        symbols = self.symbol[codes]
        owner = np.repeat(np.arange(len(runs)), sizes)
        # Unknown characters are never merged: they count their bytes at once.
        extra = np.where(symbols < 0, (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF), 0)
        np.add.at(out, owner[extra > 0], extra[extra > 0])
        same = np.zeros(len(symbols), bool)
        same[:-1] = owner[1:] == owner[:-1]
        value = np.full(len(symbols), NONE)
        if len(symbols) > 1:
            value[:-1] = np.where(same[:-1], self.ranks(symbols[:-1], symbols[1:]), NONE)
        while len(symbols):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            best = np.minimum.reduceat(value // self.width, first)  # by rank; NONE // width stands for none
            live = best < NONE // self.width
            lengths = np.diff(np.append(first, len(symbols)))
            out[owner[first[~live]]] += lengths[~live]
            if not live.any():
                break
            keep = np.repeat(live, lengths)
            owner, symbols, value = owner[keep], symbols[keep], value[keep]
            best, lengths = best[live], lengths[live]
            first = np.cumsum(lengths) - lengths
            hit = np.flatnonzero(value // self.width == np.repeat(best, lengths))
            hit = hit[np.flatnonzero(np.diff(owner[hit], prepend=-1))]  # the leftmost of each run
            symbols[hit] = value[hit] % self.width
            gone = np.ones(len(symbols), bool)
            gone[hit + 1] = False
            place = np.cumsum(gone) - 1
            owner, symbols, value = owner[gone], symbols[gone], value[gone]
            at = place[hit]
            for i in (at, at[at > 0] - 1):  # the merged symbol's pairs with what follows and what precedes
                last = i + 1 >= len(symbols)
                j = np.where(last, i, i + 1)
                value[i] = np.where(last | (owner[i] != owner[j]), NONE, self.ranks(symbols[i], symbols[j]))
        return out

    def count_long(self, run: str) -> int:
        """The same for one long run, through a heap of (rank, place)."""
        codes = np.frombuffer(run.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        symbols: list[int] = self.symbol[codes].tolist()
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (found := self.pairs.get((symbols[i], symbols[j]))):
                heapq.heappush(heap, (found[0], i, symbols[i], symbols[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        merges = 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = self.pairs[a, b][1], -2
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            merges += 1
            offer(before[i], i)
            offer(i, after[i])
        alone = codes[self.symbol[codes] < 0]
        return n - merges + int(((alone > 0x7F).astype(int) + (alone > 0x7FF) + (alone > 0xFFFF)).sum())

    def cut_all(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """The runs of all words, cut where no piece joins two characters, and the number of runs of each word."""
        text = "".join(words)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        pair = codes[:-1] << 21 | codes[1:]
        at = np.searchsorted(self.joined, pair)
        at[at == len(self.joined)] = 0
        cut = np.append(self.joined[at] != pair, True)
        ends = np.cumsum([len(w) for w in words])
        cut[ends - 1] = True
        places = (np.flatnonzero(cut) + 1).tolist()
        runs = [text[a:b] for a, b in zip([0, *places], places, strict=False)]
        return runs, np.diff(np.concatenate([[0], np.cumsum(cut)[ends - 1]]))

    def count_all(self, column: list[str]) -> list[int]:
        """Tokens of each text of a slice."""
        if len(self.known) > CACHED:
            self.known.clear()
        known = self.known
        words = [WORD.findall(SPACE + x.replace(" ", SPACE)) if x else [] for x in column]
        new = list({w for ws in words for w in ws if w not in known})
        if new:
            runs, sizes = self.cut_all(new)
            number: dict[str, int] = {}
            part = [number.setdefault(r, len(number)) for r in runs]
            short = [r for r in number if len(r) <= LONG_RUN]
            count = np.zeros(len(number), np.int64)
            if short:
                count[[number[r] for r in short]] = self.count_runs(short)
            for r in number:
                if len(r) > LONG_RUN:
                    count[number[r]] = self.count_long(r)
            known.update(zip(new, np.add.reduceat(count[part], np.cumsum(sizes) - sizes).tolist(), strict=True))
        counts = [sum(map(known.__getitem__, ws)) for ws in words]
        for w in new:
            if len(w) > LONGEST:
                del known[w]
        return counts


WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@lru_cache(2)
def model(path: str) -> Model:
    return Model(path)


def token_counts(df: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more tokens than `limit`)."""

    def setup():
        m = model(path)
        return lambda column: {"n_tokens": m.count_all(column.to_pylist())}

    t = texts(df, id_col, text_col)
    counted = with_columns(t.withColumn("n_bytes", F.octet_length("text").cast("long")), setup, "n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
