"""Periodic runs of words, and texts with each run collapsed to its first period (operator 11).

A run is a stretch of consecutive words with smallest period q and at least max(12, 2 q) words that no neighbouring
word extends. All runs of a text are found by longest common extensions:

1. Ukkonen's algorithm builds the suffix tree of the words and that of their reversal. An Euler tour of each, with
   minima of blocks of the tour, answers how far two places agree forwards and backwards in constant time.
2. The longest Lyndon word at each place, under an order of the words and under its reverse, is a candidate: each run
   starts with a conjugate of some such root, so no run is missed, and a Lyndon word has no smaller period.
3. Each candidate is extended in both directions; what spans two periods is a run.

Trees are built only where a run can lie. A run of 12 words or more with two periods holds, at the distance of its period,
six equal words in a row, and sequences of this kind cover all of it. So each run lies inside a stretch whose every
word belongs to a sequence of six words that the text holds twice, and texts without such a stretch have no run.
Equal sequences always have equal hashes; an accidental equal hash only adds a stretch to search.

Cases: null text has no words and no runs; texts without words give an empty text. Rows stand alone: repeated rows give
repeated results, null ids stay. A tree holds one stretch of one text, in memory in proportion to its words.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.llm.hashing import Words, mix
from portolan.llm.support import texts, with_columns

SHORTEST = 12
WORD = r"[^\x20\x09-\x0D]+"
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
#: Entries of a tour that share one minimum in the table of minima.
BLOCK = 16


class SuffixTree:
    """Suffix tree of a sequence of numbers from 1 on, closed by a 0; leaves are numbered in the order of their suffixes."""

    def __init__(self, values: list[int]):
        s = [*values, 0]
        n = len(s)
        self.size = n
        start, stop, link = [0], [0], [0]
        kids: list[dict[int, int] | None] = [{}]
        leaves: list[int] = []
        node = edge = length = waiting = 0
        for i, c in enumerate(s):
            fresh = 0
            waiting += 1
            while waiting:
                if not length:
                    edge = i
                here = kids[node]
                k = here.get(s[edge])
                if k is None:
                    here[s[edge]] = len(start)
                    leaves.append(len(start))
                    start.append(i)
                    stop.append(n)
                    link.append(0)
                    kids.append(None)
                    if fresh:
                        link[fresh] = node
                        fresh = 0
                else:
                    span = stop[k] - start[k]
                    if length >= span:
                        edge += span
                        length -= span
                        node = k
                        continue
                    at = start[k] + length
                    if s[at] == c:
                        length += 1
                        if fresh:
                            link[fresh] = node
                        break
                    inner = len(start)
                    start.append(start[k])
                    stop.append(at)
                    link.append(0)
                    kids.append({s[at]: k, c: inner + 1})
                    here[s[edge]] = inner
                    start[k] = at
                    leaves.append(inner + 1)
                    start.append(i)
                    stop.append(n)
                    link.append(0)
                    kids.append(None)
                    if fresh:
                        link[fresh] = inner
                    fresh = inner
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        self.start, self.stop, self.kids, self.leaves = start, stop, kids, leaves

    def ranks(self, backwards: bool = False) -> np.ndarray:
        """Place of each suffix in the order of all; an end comes first under either order of the numbers."""
        kids = self.kids
        found, stack = [], [0]
        while stack:
            node = stack.pop()
            here = kids[node]
            if here is None:
                found.append(node)
                continue
            keys = sorted(here, reverse=not backwards)
            if backwards and not keys[0]:
                keys.append(keys.pop(0))
            stack += [here[c] for c in keys]
        place = np.empty(len(kids), np.int64)
        place[np.array(found)] = np.arange(len(found))
        return place[np.array(self.leaves)]

    def extensions(self) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """A function of two arrays of different suffixes: how many numbers each pair shares from its start on."""
        start, stop, kids = self.start, self.stop, self.kids
        first = [0] * len(start)
        depths: list[int] = []
        stack = [(0, 0)]
        while stack:
            node, depth = stack.pop()
            if node < 0:  # back in an inner node
                depths.append(depth)
                continue
            depth += stop[node] - start[node]
            first[node] = len(depths)
            depths.append(depth)
            here = kids[node]
            if here is not None:
                for k in here.values():
                    stack.append((-1, depth))
                    stack.append((k, depth))
        return _minima(np.array(depths, np.int32), np.array(first)[np.array(self.leaves)])


def _minima(depths: np.ndarray, first: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Least depth of a tour between the first visits of two leaves: the depth of their lowest common ancestor."""
    blocks = -(-len(depths) // BLOCK)
    grid = np.full(blocks * BLOCK, np.iinfo(np.int32).max, np.int32)
    grid[: len(depths)] = depths
    grid = grid.reshape(blocks, BLOCK)
    upto = np.minimum.accumulate(grid, axis=1).ravel()
    onwards = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    table = [grid.min(axis=1)]
    while 2 << (len(table) - 1) <= blocks:
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    flat = grid.ravel()

    def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = first[a], first[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        left, right = low // BLOCK, high // BLOCK
        out = np.minimum(onwards[low], upto[high])
        gap = right - left - 1
        level = np.frexp(np.maximum(gap, 1).astype(float))[1] - 1
        for k in np.unique(level[gap > 0]):
            m = np.flatnonzero((gap > 0) & (level == k))
            part = np.minimum(table[k][left[m] + 1], table[k][right[m] - (1 << int(k))])
            out[m] = np.minimum(out[m], part)
        same = np.flatnonzero(gap < 0)
        if len(same):
            out[same] = flat[low[same]]
            for step in range(1, BLOCK):
                at = np.minimum(low[same] + step, high[same])
                out[same] = np.minimum(out[same], flat[at])
        return out.astype(np.int64)

    return least


def _next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each suffix the next one that is smaller, or the end: up to there reaches its longest Lyndon word."""
    order = [*rank.tolist(), -1]
    n = len(rank)
    out = [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        own, j = order[i], i + 1
        while order[j] > own:
            j = out[j]
        out[i] = j
    return np.array(out[:n], np.int64)


def runs_of(values: list[int]) -> np.ndarray:
    """All runs with two periods or more as rows (start, length, period), by start, then period; values are from 1 on."""
    n = len(values)
    tree = SuffixTree(values)
    starts = np.arange(n)
    roots = np.unique(np.concatenate([starts * (n + 1) + _next_smaller(tree.ranks(b)[:n]) - starts for b in (False, True)]))
    at, period = roots // (n + 1), roots % (n + 1)
    ahead = tree.extensions()(at, at + period)
    del tree
    behind = np.zeros_like(ahead)
    inner = np.flatnonzero(at > 0)
    behind[inner] = SuffixTree(values[::-1]).extensions()(n - at[inner], n - at[inner] - period[inner])
    start, length = at - behind, behind + period + ahead
    full = length >= 2 * period
    return np.unique(np.stack([start[full], period[full], length[full]], axis=1), axis=0)[:, [0, 2, 1]]


def stretches(words: Words, width: int = SHORTEST // 2) -> list[tuple[int, int, int]]:
    """(text, first word, end) of the stretches that can hold a run: covered by sequences that their text repeats."""
    ok = words.within(width)
    places = np.flatnonzero(ok)
    keys = words.runs(width)[places] ^ mix(words.doc[places].astype(np.uint64), 11)
    order = np.argsort(keys, kind="stable")
    equal = keys[order][1:] == keys[order][:-1]
    often = np.zeros(len(keys), bool)
    often[order[1:][equal]] = True
    often[order[:-1][equal]] = True
    edges = np.zeros(len(words.doc) + 1, np.int64)
    np.add.at(edges, places[often], 1)
    np.add.at(edges, places[often] + width, -1)
    covered = np.cumsum(edges)[:-1] > 0
    # A stretch ends with its text, too.
    fresh = np.concatenate([[True], words.doc[1:] != words.doc[:-1]])[: len(covered)]
    begin = np.flatnonzero(covered & (fresh | ~np.concatenate([[False], covered[:-1]])[: len(covered)]))
    last = np.flatnonzero(covered & (np.concatenate([fresh[1:], [True]])[: len(covered)] | ~np.concatenate([covered[1:], [False]])[: len(covered)]))
    long = last + 1 - begin >= SHORTEST
    return [(int(words.doc[b]), int(b), int(e)) for b, e in zip(begin[long], last[long] + 1, strict=True)]


def _search() -> Callable[[pa.Array], dict[str, object]]:
    def search(column: pa.Array) -> dict[str, object]:
        words = Words(column)
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
        for doc, begin, end in stretches(words):
            numbers: dict[bytes, int] = {}
            values = [
                numbers.setdefault(words.joined[a:b], len(numbers) + 1)
                for a, b in zip(words.start[begin:end].tolist(), words.end[begin:end].tolist(), strict=True)
            ]
            shift = begin - int(words.first[doc])
            for start, length, period in runs_of(values).tolist():
                if length >= SHORTEST:
                    found[doc].append((start + shift, length, period))
        collapsed = []
        for runs, text in zip(found, column.cast(pa.binary()).to_pylist(), strict=True):
            own = text.split()
            if runs:
                gone = np.zeros(len(own) + 1, np.int64)
                for start, length, period in runs:
                    gone[start + period] += 1
                    gone[start + length] -= 1
                own = [own[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0)]
            collapsed.append(b" ".join(own))
        return {
            "runs": [[{"start": s, "length": n, "period": p} for s, n, p in runs] for runs in found],
            "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string()),
        }

    return search


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, runs, collapsed): all runs by start, then period, in word numbers from 0, and the words that stay."""
    return with_columns(texts(df, id_col, text_col), _search, f"runs {RUNS}, collapsed string")


def with_planted_runs(df: DataFrame) -> DataFrame:
    """(doc_id, text): texts whose id hashes to a multiple of 10 repeat a stretch of their own words up to their end."""
    key = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(key / 10)
    words = F.when(key % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    cut = texts(df).select("doc_id", "text", words.alias("words"), g.alias("g"))
    n = F.size("words")
    cut = cut.withColumn("a", (F.col("g") % F.greatest(n, F.lit(1))).cast("int"))
    rest = n - F.col("a")
    cut = cut.withColumn("p", (1 + F.floor(rest / (3 + F.col("g") % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    planted = F.concat(F.slice("words", 1, F.col("a")), F.slice(again, F.lit(1), rest))
    return cut.select("doc_id", F.when(n > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """One row per text: number of runs, the longest one, and digests of the runs and of the words that stay."""

    def line(run: Column) -> Column:
        return F.concat(F.concat_ws(",", run["start"], run["length"], run["period"]), F.lit("\n"))

    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    out = found.withColumn("best", best)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
