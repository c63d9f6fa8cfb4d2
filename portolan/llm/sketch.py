"""Two bits a cell, "seen" and "seen again", counted over all partitions: which hashes may occur more than once.

Each task counts its own hashes and sends its cells in compressed pages; pages are merged by page number, in a stream.
A cell that two tasks have seen, or one task has seen twice, is "seen again". A hash may be repeated if all its cells
are; one that is repeated always is. The size is fixed by `bits` alone (2^bits cells, 2^(bits-3) bytes of "seen
again"), so what the driver gathers and sends out does not grow with the data. Where the data outgrow it, more hashes
pass than needed and the exact step behind has more to do; nothing is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from portolan.llm.hashing import mix
from portolan.llm.support import releasing

PAGE = 1 << 16  # bytes
SCHEMA = "page int, once binary, again binary"


def cells(hashes: np.ndarray, bits: int, rows: int, own_rows: bool) -> np.ndarray:
    """Cells of each hash, rows x n. own_rows: each of the `rows` functions has its own equal part (count-min); else all share one (Bloom)."""
    part = (1 << bits) // rows if own_rows else 1 << bits
    return np.stack([(mix(hashes, 11 + r) % np.uint64(part)).astype(np.int64) + (r * part if own_rows else 0) for r in range(rows)])


def mark(plane: np.ndarray, at: np.ndarray) -> None:
    """Set bits at sorted distinct cells."""
    if len(at):
        byte, bit = at >> 3, np.left_shift(1, at & 7).astype(np.uint8)
        first = np.flatnonzero(np.diff(byte, prepend=-1))
        plane[byte[first]] |= np.bitwise_or.reduceat(bit, first)


def test(plane: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (plane[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


class Counter:
    def __init__(self, bits: int, rows: int, own_rows: bool):
        self.shape = bits, rows, own_rows
        self.once, self.again = np.zeros(1 << (bits - 3), np.uint8), np.zeros(1 << (bits - 3), np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        for row in cells(hashes, *self.shape):  # one function after the other: a hash must not meet itself
            at, n = np.unique(row, return_counts=True)
            mark(self.again, at[(n > 1) | test(self.once, at)])
            mark(self.once, at)

    def pages(self) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(self.once), PAGE):
            if (once := self.once[k : k + PAGE]).any():
                pack = [zlib.compress(x.tobytes(), 1) for x in (once, self.again[k : k + PAGE])]
                yield pa.RecordBatch.from_arrays([pa.array([k // PAGE], pa.int32()), pa.array(pack[:1]), pa.array(pack[1:])], ["page", "once", "again"])


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with equal numbers as one; expects them sorted. Keeps two planes of one page only."""

    def out() -> pa.RecordBatch:
        pack = [zlib.compress(x.tobytes(), 1) for x in (once, again)]
        return pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array(pack[:1]), pa.array(pack[1:])], ["page", "once", "again"])

    page = None
    for batch in batches:
        for number, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            one, two = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
            if number != page:
                if page is not None:
                    yield out()
                page, once, again = number, one.copy(), two.copy()
            else:
                again |= two | (once & one)
                once |= one
    if page is not None:
        yield out()


class Repeats:
    """The merged "seen again" cells. Broadcast it; `may` tells which hashes may be repeated."""

    def __init__(self, plane: bytes, bits: int, rows: int, own_rows: bool):
        self.plane, self.shape = plane, (bits, rows, own_rows)

    def may(self, hashes: np.ndarray) -> np.ndarray:
        plane = np.frombuffer(self.plane, np.uint8)
        return test(plane, cells(hashes, *self.shape)).all(axis=0)


def repeats(pages: DataFrame, bits: int, rows: int, own_rows: bool) -> Repeats:
    """Merge the tasks' pages (two merges, so that no task reads a page from every task) and gather "seen again"."""
    spread = pages.selectExpr("page", "once", "again", "pmod(xxhash64(once), 8) AS lane")
    part = spread.repartition("page", "lane").select("page", "once", "again").sortWithinPartitions("page").mapInArrow(releasing(merged), SCHEMA)
    whole = part.repartition("page").sortWithinPartitions("page").mapInArrow(releasing(merged), SCHEMA)
    plane = np.zeros(1 << (bits - 3), np.uint8)
    for row in whole.select("page", "again").collect():  # 2^(bits-3) bytes at most
        page = np.frombuffer(zlib.decompress(bytes(row["again"])), np.uint8)
        plane[row["page"] * PAGE : row["page"] * PAGE + len(page)] = page
    return Repeats(plane.tobytes(), bits, rows, own_rows)
