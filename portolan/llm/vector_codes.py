"""Vector codes of one byte a part, from codebooks fitted by Lloyd's rounds over resident members (operator 12).

Components become whole numbers (floor of 256 x) and vectors are cut into equal parts. Each position of a part has a
codebook; a part's code is the nearest entry of it.

1. Parts are dealt to owners: the rows of a table are packets of members of one (position, entry, salt), and a shuffle
   by these three brings an entry's packets together. The salt spreads an entry that holds many members.
2. In a round the owners give each resident member its nearest entry. Members that keep their entry stay where they are;
   those that change it leave in new packets, which alone pass the next shuffle, and the arrivals join the residents.
3. Owners sum their residents; the sums of an entry, combined before a shuffle of one row for each entry and task, give
   its new place. Codebooks (`PARTS` x `ENTRIES` entries) are all that the driver holds and tasks are sent.
4. After the last round every vector is encoded in one pass by the final codebooks, without a shuffle.

Sums are of whole numbers, so results do not depend on how rows were dealt. Members of a packet are 16-bit numbers
where they fit.

Cases: vectors that are null, of another length than `dim`, or hold null or non-finite components are left out. Components
saturate at +-2^27, so that every error fits 64 bits; up to there all distances are exact. Equal distances take the lower
entry. A sum of errors beyond 64 bits is null. Codebooks start from the rows first by id, equal ids by vector; with fewer rows than entries they are smaller.
Null ids come first. Repeated rows count each. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.llm.support import releasing, stored
from portolan.llm.vectors import matrix, whole

DIM, PARTS, ENTRIES, ROUNDS = 64, 16, 64, 2
SCALE, MOST = 256, 1 << 27
#: Members of an entry are spread over so many owners.
SALTS = 32
#: Vectors, and members of a position, that a task deals at once.
DEALT = 1 << 15
#: Rows whose distances to a codebook are held at once.
SLICE = 4096
PACKET = "position int, entry int, salt int, n long, wide boolean, members binary"


def whole_numbers(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x * SCALE), -MOST, MOST).astype(np.int64)


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row, the lower one of equals, and the squared distance."""
    entry, error = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
    small = max(np.abs(part).max(initial=0), np.abs(book).max(initial=0)) <= 1 << 23
    for at in range(0, len(part), SLICE):
        rows = part[at : at + SLICE]
        if small:  # whole numbers below 2^53: exact in doubles
            x, c = rows.astype(float), book.astype(float)
            squared = (x**2).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c**2).sum(axis=1)[None, :]
        else:
            squared = np.zeros((len(rows), len(book)), np.int64)
            for j in range(part.shape[1]):
                squared += (rows[:, j, None] - book[None, :, j]) ** 2
        best = squared.argmin(axis=1)
        entry[at : at + SLICE] = best
        error[at : at + SLICE] = squared[np.arange(len(rows)), best]
    return entry, error


class Packets:
    """Members gathered by (position, entry) and given out as packets, each with a salt of its own."""

    def __init__(self, seed: int):
        self.held: dict[tuple[int, int], list[np.ndarray]] = {}
        self.count, self.turn = 0, seed

    def add(self, position: int, part: np.ndarray, entry: np.ndarray) -> None:
        order = np.argsort(entry, kind="stable")
        ends = np.flatnonzero(np.diff(entry[order])) + 1
        for group in np.split(order, ends):
            if len(group):
                self.held.setdefault((position, int(entry[group[0]])), []).append(part[group])
        self.count += len(part)

    def give(self) -> pa.RecordBatch:
        rows = []
        for (position, entry), found in self.held.items():
            members = np.concatenate(found)
            wide = bool(np.abs(members).max(initial=0) > 32767)
            self.turn += 1
            rows.append((position, entry, self.turn % SALTS, len(members), wide, members.astype("<i4" if wide else "<i2").tobytes()))
        self.held, self.count = {}, 0
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary())
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in PACKET.split(", ")])


def _first_seed() -> int:
    from pyspark import TaskContext

    task = TaskContext.get()
    return task.partitionId() * 7 if task else 0


def _members(packet: dict, width: int) -> np.ndarray:
    return np.frombuffer(packet["members"], "<i4" if packet["wide"] else "<i2").reshape(-1, width).astype(np.int64)


def _deal(books: list[np.ndarray], dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Vectors to packets of the entries that their parts are nearest to."""
    width = dim // len(books)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Packets(_first_seed())
        for batch in batches:
            for at in range(0, batch.num_rows, DEALT):
                x = whole_numbers(matrix(batch.column("vector").slice(at, DEALT), dim))
                for position, book in enumerate(books):
                    part = x[:, position * width : (position + 1) * width]
                    out.add(position, part, nearest(part, book)[0])
                if out.count >= DEALT * len(books):
                    yield out.give()
        yield out.give()

    return deal


def _moves(books: list[np.ndarray], width: int, leaving: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Residents that keep their entry, or (`leaving`) those that change it, in packets of their new entry."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Packets(_first_seed())
        for batch in batches:
            for packet in batch.to_pylist():
                members = _members(packet, width)
                entry, _ = nearest(members, books[packet["position"]])
                kept = (entry != packet["entry"]) if leaving else (entry == packet["entry"])
                out.add(packet["position"], members[kept], entry[kept])
                if out.count >= DEALT * len(books):
                    yield out.give()
        yield out.give()

    return move


def _sums(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(p["position"], p["entry"], p["n"], _members(p, width).sum(axis=0).tolist()) for p in batch.to_pylist()]
            if found:
                columns = list(zip(*found, strict=True))
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["position", "entry", "n", "sums"])

    return add


def _updated(residents: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks whose entries moved to the floor of their members' means; unused entries stay."""
    width = books[0].shape[1]
    sums = residents.mapInArrow(releasing(_sums(width)), "position int, entry int, n long, sums array<bigint>")
    # Sums of many large numbers are decimals: they do not overflow.
    wide = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    new = [b.copy() for b in books]
    for row in sums.groupBy("position", "entry").agg(F.sum("n").alias("n"), *wide).collect():  # one row for each entry at most
        new[row["position"]][row["entry"]] = [int(row[f"s{i}"]) // row["n"] for i in range(width)]
    return new


def _vectors(df: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    return df.where(whole(vector_col, dim)).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))


def fit_codebooks(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dim: int = DIM,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> list[np.ndarray]:
    """One codebook (entries x components) for each position, after `rounds` rounds of Lloyd over all vectors."""
    if dim % parts or not 0 < entries <= 256:
        raise ValueError("parts must divide the vectors, and an index must fit a byte")
    width = dim // parts
    kept = _vectors(df, id_col, vector_col, dim)
    start = kept.orderBy("id", "vector").limit(entries).collect()
    first = whole_numbers(np.array([r["vector"] for r in start], float).reshape(-1, dim))
    books = [first[:, p * width : (p + 1) * width] for p in range(parts)]
    residents = None
    for turn in range(rounds if len(first) else 0):
        if residents is None:
            arrived = kept.select("vector").mapInArrow(releasing(_deal(books, dim)), PACKET)
        else:
            arrived = residents.mapInArrow(releasing(_moves(books, width, True)), PACKET)
        arrived = arrived.repartition("position", "entry", "salt")
        if residents is not None:
            arrived = residents.mapInArrow(releasing(_moves(books, width, False)), PACKET).unionByName(arrived)
        residents = stored(arrived, f"members-{turn}")
        books = _updated(residents, books)
    return books


def encode(df: DataFrame, books: list[np.ndarray], vector_col: str = "embedding", dim: int = DIM) -> DataFrame:
    """The rows whose vectors are whole, with `code` (two hex digits a part) and `error` beside one struct `row`."""
    width = dim // len(books)
    kept = df.where(whole(vector_col, dim)).select(F.struct("*").alias("row"), F.col(vector_col).cast("array<double>").alias("vector"))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole_numbers(matrix(batch.column("vector"), dim))
            code, total = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x), np.int64)
            for position, book in enumerate(books):
                entry, error = nearest(x[:, position * width : (position + 1) * width], book)
                code[:, position] = entry
                total += error
            text = [row.tobytes().hex() for row in code]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(text, pa.string()), pa.array(total)], ["row", "code", "error"])

    return kept.mapInArrow(releasing(codes), kept.drop("vector").withColumns({"code": F.lit(""), "error": F.lit(0).cast("long")}).schema)


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by position, entry and place in the part, joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for book in books for v in book.ravel()).encode()).hexdigest()


def compress(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", dim: int = DIM, **sizes: int
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every whole vector; `sizes` go to fit_codebooks()."""
    books = fit_codebooks(df, id_col, vector_col, dim, **sizes)
    one = df.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    coded = encode(one, books, "vector", dim).select("row.vec_id", "row.label", "code", "error") if len(books[0]) else None
    if coded is None:
        coded = one.where("false").select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    coded = stored(coded, "vector-codes")
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")
    )
