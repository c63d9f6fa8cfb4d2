"""Repeated passages of 35 words, with a count-min sketch in front of exact grouping (operator 7).

A window is `width` consecutive words of one text; every word covered by a window that also starts anywhere else is
removed. The first pass counts in merged partition sketches. What it counts is not each window but its anchor, the
`gram`-word sequence of smallest hash inside it: equal windows have the same anchor at the same place, so the count of
an anchor is never below that of a window, and there is one anchor for about a dozen windows. The second pass groups
exactly, by a 128-bit hash, only windows whose anchor is estimated to be repeated; none that is repeated is missed.

Windows that meet in one slice of texts are settled there, and go on as one row, so a passage that a third of all
texts hold sends one row for each slice. What is removed is collected for each text and joined with it.

The sketch has 2^bits two-bit counters whatever the data, so the broadcast is bounded (2^(bits-3) bytes); beyond
about 2^bits / 4 anchors more windows than needed are grouped, with the same result.

Cases: null text has no words; texts under 35 words have no window and stay as they are; a passage that repeats inside
one text counts. Rows that agree in id and text are copies of each other. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portolan.llm.hashing import WORD_BASE, WORD_BASE_2, Words, sliding
from portolan.llm.sketch import SCHEMA, Counter, repeats
from portolan.llm.support import map_slices, releasing, slices, texts

WIDTH, GRAM, BITS, ROWS = 35, 8, 27, 3
TOP = np.uint64(np.iinfo(np.uint64).max)


def anchors(words: Words, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of windows, the anchor hash of each window, and the hashes of all places chosen as anchors."""
    inside = words.within(width)
    if not inside.any():
        none = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), none, none
    grams = words.runs(gram)
    reach = width - gram + 1
    least = sliding(grams, reach)[: len(inside)]
    # A place is chosen if it is the smallest of some window: the largest of the window minima over it.
    minima = np.where(inside, least, np.uint64(0))
    padded = np.concatenate([np.zeros(reach - 1, np.uint64), minima, np.zeros(len(grams) - len(minima), np.uint64)])
    chosen = grams[sliding(padded, reach, smallest=False) == grams]
    starts = np.flatnonzero(inside)
    return starts, least[starts], chosen


def sketch(t: DataFrame, width: int, gram: int, bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter(bits, ROWS, True)
        for batch in batches:
            for part in slices(batch, "text"):
                seen.add(anchors(Words(part.column("text")), width, gram)[2])
        yield from seen.pages()

    return repeats(t.select("text").mapInArrow(releasing(count), SCHEMA), bits, ROWS, True)


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of n words lie in a window from one of the starts."""
    edge = np.zeros(n + width + 1, np.int64)
    edge[starts] += 1
    edge[starts + width] -= 1
    return np.cumsum(edge[:n]) > 0


def repeated_windows(t: DataFrame, width: int = WIDTH, gram: int = GRAM, bits: int = BITS) -> DataFrame:
    """doc_id, th (hash of the text), starts: the word numbers at which repeated windows start."""
    sent = t.sparkSession.sparkContext.broadcast(sketch(t, width, gram, bits))
    # A row is a window that no other in its slice equals (`at`), word of one settled in the slice (neither), or the
    # settled starts of a text there (`own`).
    schema = T.StructType([*T.StructType.fromDDL("k1 long, k2 long").fields, t.schema["doc_id"], *T.StructType.fromDDL("th long, at int, own array<int>").fields])

    def setup():
        found = sent.value

        def func(part: pa.RecordBatch):
            words = Words(part.column("text"))
            starts, anchor, _ = anchors(words, width, gram)
            starts = starts[found.may(anchor)] if len(starts) else starts
            if not len(starts):
                return
            k1, k2 = words.runs(width, WORD_BASE)[starts], words.runs(width, WORD_BASE_2)[starts]
            order = np.lexsort((k2, k1))
            k1, k2, starts = k1[order], k2[order], starts[order]
            new = np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
            group = np.cumsum(new) - 1
            settled = np.bincount(group)[group] > 1
            doc = words.doc[starts]
            at = starts - words.first[doc]
            first = np.concatenate([np.flatnonzero(~settled), np.flatnonzero(new & settled)])
            alone = np.arange(len(first)) < (~settled).sum()
            texts_of = np.sort(doc[settled])
            who, begin = np.unique(texts_of, return_index=True)
            lists = np.split(at[settled][np.argsort(doc[settled], kind="stable")], begin[1:]) if len(who) else []
            none = [None] * len(who)
            source = pa.array(np.concatenate([doc[first], who]))
            th = part.column("th").take(source)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(k1[first].view(np.int64)), th.slice(len(first))]),
                    pa.concat_arrays([pa.array(k2[first].view(np.int64)), pa.array(np.full(len(who), -1))]),
                    part.column("doc_id").take(source),
                    th,
                    pa.concat_arrays([pa.array(at[first].astype(np.int32), mask=~alone), pa.array(none, pa.int32())]),
                    pa.array([None] * len(first) + lists, pa.list_(pa.int32())),
                ],
                schema.names,
            )

        return func

    rows = map_slices(t, setup, schema)
    # One shuffle: a key has one row a slice at most, however many texts hold it.
    same = Window.partitionBy("k1", "k2")
    told = F.max(F.col("at").isNull() & F.col("own").isNull()).over(same)
    counted = rows.select("doc_id", "th", "at", "own", F.count(F.lit(1)).over(same).alias("n"), told.alias("told"))
    met = counted.where("own IS NOT NULL OR at IS NOT NULL AND (n > 1 OR told)")
    each = met.select("doc_id", "th", F.explode(F.coalesce("own", F.array("at"))).alias("at"))
    return each.groupBy("doc_id", "th").agg(F.collect_set("at").alias("starts"))


def with_starts(df: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """doc_id, text and the repeated starts of each row (null: none)."""
    t = texts(df, id_col, text_col).withColumn("th", F.xxhash64("text"))
    found = repeated_windows(t, **options)
    found = found.select(F.col("doc_id").alias("found_id"), F.col("th").alias("found_th"), "starts")
    same = t["doc_id"].eqNullSafe(F.col("found_id")) & (t["th"] == F.col("found_th"))
    return t.join(found, same, "left").select("doc_id", "text", "starts")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, bits: int = BITS, full: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row; with `full` also kept_text, the kept words joined by a space."""
    joined = with_starts(df, id_col, text_col, width=width, gram=gram, bits=bits)
    names = ["n_words", "n_removed", "kept_sha256"] + ["kept_text"] * full
    fields = T.StructType.fromDDL("n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * full)

    def setup():
        def func(part: pa.RecordBatch):
            out: list[list] = [[] for _ in names]
            for text, starts in zip(part.column("text").to_pylist(), part.column("starts"), strict=True):
                words = text.encode().split()
                kept = words
                if starts.is_valid:
                    gone = covered(len(words), starts.values.to_numpy().astype(np.int64), width)
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                data = b" ".join(kept)
                row = [len(words), len(words) - len(kept), hashlib.sha256(data).hexdigest()] + [data.decode()] * full
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=False))], ["doc_id", *names])

        return func

    return map_slices(joined, setup, T.StructType([joined.schema["doc_id"], *fields.fields]))
