"""Best-fit packing planned on the histogram of lengths (operator 10).

Documents become token ids and an end token, and those over the capacity are cut into full pieces (the first one may be
shorter). Only the number of pieces of each length, at most `capacity` figures, goes to the driver. Best-fit decreasing
runs on these counts: a group of equal sequences takes as many pieces of a length as there are, and is split where
fewer are left, so the plan has rows for (length, range of ranks), whatever the number of documents. Each piece then
takes the slot of its rank within its length: row numbers in small lanes of each length, plus the counts of the lanes
before, joined with the plan.

Cases: null text is empty and becomes the end token alone; repeated rows are packed each; a text of any length is
tokenised whole. An empty table gives an empty result. `pack` reads the id and the text only.
"""

from __future__ import annotations

import bisect
import json
import zlib
from array import array
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portolan.llm.bpe import LOOSE, Cache
from portolan.llm.support import KEPT, map_slices, stored, texts

LANE_ROWS = 20_000
#: Bytes of the cache of encoded words.
CACHED = 24 << 20


class Encoder:
    """Ids as the tokenizers library gives them for a byte-level BPE file, special strings in texts included."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(map(letter.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.library = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)
        self.chunks = Cache(self._chunk, CACHED)

    def _chunk(self, chunk: str) -> bytes:
        return array("I", self.library.encode_ordinary(chunk)).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if LOOSE.search(text) or any(s in text for s in self.special):
            return np.array(self.library.encode(text, allowed_special="all"), "<u4").tobytes()
        words = text.split(" ")
        words[1:] = [" " + w for w in words[1:]]
        return b"".join(map(self.chunks.__getitem__, words)) if text else b""


@lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


KEPT.append(encoder.cache_clear)


def pieces(df: DataFrame, path: str, pattern: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece, and with `ids` the ids themselves."""
    t = texts(df, id_col, text_col)
    end = np.array([end_id], "<u4").tobytes()
    fields = T.StructType.fromDDL("piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids)

    def setup():
        e = encoder(path, pattern)

        def func(part: pa.RecordBatch):
            row, piece, start, length, crc, data = [], [], [], [], [], []
            for i, text in enumerate(part.column("text").to_pylist()):
                whole = e.encode(text) + end
                n = len(whole) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    own = whole[4 * a : 4 * b]
                    row.append(i), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(own))
                    if ids:
                        data.append(own)
            columns = [part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(data, pa.binary())] * ids, ["doc_id", *fields.names])

        return func

    return map_slices(t, setup, T.StructType([t.schema["doc_id"], *fields.fields]))


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank + 1, sequence of the first rank, offset); sequences follow the ranks by one."""
    out: list[tuple[int, int, int, int, int]] = []
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens: (first sequence, how many)
    free: list[int] = []  # the keys of groups, sorted

    def put(space: int, first: int, many: int) -> None:
        if space and many:
            if space not in groups:
                bisect.insort(free, space)
            groups[space].append((first, many))

    sequences = 0
    for length in sorted(counts, reverse=True):
        rank, count = 0, counts[length]
        while rank < count and (at := bisect.bisect_left(free, length)) < len(free):
            space = free[at]
            first, many = groups[space].pop()
            used = min(many, count - rank)
            if used < many:
                groups[space].append((first + used, many - used))
            elif not groups[space]:
                del groups[space], free[at]
            out.append((length, rank, rank + used, first, capacity - space))
            put(space - length, first, used)
            rank += used
        each = capacity // length
        full, rest = divmod(count - rank, each)
        for many, filled in ((full, each), (min(rest, 1), rest)):
            for k in range(filled if many else 0):
                out.append((length, rank, rank + many, sequences, k * length))
                rank += many
            put(capacity - filled * length, sequences, many)
            sequences += many
    return out


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to stored pieces (see `pieces`)."""
    spark = cut.sparkSession
    cut = stored(cut.withColumn("row_no", F.monotonically_increasing_id()), "pieces")  # tokenised and numbered once
    lanes = max(1, -(-cut.count() // LANE_ROWS))
    cut = cut.withColumn("lane", F.expr(f"pmod(xxhash64(row_no), {lanes})"))
    by_lane = stored(cut.groupBy("length", "lane").agg(F.count(F.lit(1)).alias("n")), "lanes")
    counts = {r["length"]: r["n"] for r in by_lane.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    before = by_lane.select("length", "lane", (F.sum("n").over(Window.partitionBy("length").orderBy("lane")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "lane").orderBy("row_no")) - 1
    ranked = cut.withColumn("in_lane", rank).join(before, ["length", "lane"]).withColumn("rank", F.col("in_lane") + F.col("before"))
    slots = spark.createDataFrame(plan(counts, capacity), "slot_length long, lo long, hi long, first long, at long")
    # The plan follows the number of different lengths, not of documents.
    joined = ranked.join(F.broadcast(slots), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    keep = [c for c in cut.columns if c not in ("row_no", "lane")]
    return joined.select(*keep, (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), F.col("at").alias("offset"))
