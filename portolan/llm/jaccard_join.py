"""Near duplicates by Jaccard similarity of word 5-grams, with Bayesian pruning of candidates (operator 9).

1. Each text gives its set of 5-word sequences (64-bit hashes), a 128-bit name of that set, and MinHash values. Texts
   with one set are one class of copies, whatever their number; the graph below has one node for each set.
2. Sets that agree in a band of MinHash values become candidates of each other, each linked to the smallest of its
   bucket only. Components of these links are cut into blocks of about `BLOCK` sets by hash; each pair of blocks of
   a component is one unit of work, so a large group spreads over many tasks and no pair leaves a task unless needed.
3. Inside a unit, MinHash values are compared a few at a time. With m of n equal, the posterior of the similarity is
   Beta(m + 1, n - m + 1); a pair is dropped once its probability of reaching the threshold is below `TOLERANCE`.
4. Every pair that is left is verified exactly on the two sets.

A unit sends out, for each set, how many documents it is linked to, and the edges of a spanning forest: links are
counted, not listed. Components of the forests give the classes. With 48 bands of 6 values a pair at similarity 0.8
meets in no band with a probability of 5e-7, and pruning loses fewer than 1e-7.

Cases: null text has no words; a text of one to four words has one sequence, all its words; a text without words is
linked to nothing and is its own class (class_id is its id). The class id is the smallest id in the class, null if
it has none. Rows with equal texts are linked to each other. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portolan.llm.components import components
from portolan.llm.exact_dedup import may_be_among
from portolan.llm.hashing import Words, mix
from portolan.llm.support import packed, releasing, sorted_groups, stored, texts, unpacked, with_columns

SHINGLE, THRESHOLD = 5, 0.8
BANDS, BAND_ROWS = 48, 6
BLOCK = 256
STEP, TOLERANCE = 32, 1e-8
#: Columns of the shared-sequence matrix held at once while verifying.
COLUMNS = 8192
VALUES = BANDS * BAND_ROWS


@lru_cache(1)
def seeds() -> tuple[np.ndarray, np.ndarray]:
    draw = mix(np.arange(2 * VALUES, dtype=np.uint64), 3)
    return draw[:VALUES], draw[VALUES:] | np.uint64(1)


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word sequences of each text; all words of a shorter text are its only one."""
    words = Words(column)
    runs = words.runs(k)
    out = []
    for first, n in zip(words.first.tolist(), words.count.tolist(), strict=True):
        if n >= k:
            out.append(np.unique(runs[first : first + n - k + 1]))
        elif n:
            short = np.frombuffer(hashlib.blake2b(words.hash[first : first + n].tobytes(), digest_size=8).digest(), np.uint64)
            out.append(short.copy())
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The upper 32 bits of VALUES smallest values of each set, under as many multiplications of a mixed value."""
    out = np.zeros((len(sets), VALUES), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    flat = np.concatenate([sets[i] for i in full])
    first = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
    for j, (add, times) in enumerate(zip(*seeds(), strict=True)):
        out[full, j] = np.minimum.reduceat((flat ^ add) * times, first) >> np.uint64(32)
    return out


def sign(t: DataFrame, k: int) -> DataFrame:
    """doc_id, th, key (16 bytes; null without words), sig (16 bits a value), bands (64 bits each)."""

    def setup():
        def func(column: pa.Array) -> dict:
            sets = shingle_sets(column, k)
            values = signatures(sets)
            mixed = np.zeros((len(sets), BANDS), np.uint64)
            for r in range(BAND_ROWS):
                mixed = mix(mixed ^ values[:, r::BAND_ROWS].astype(np.uint64), r)
            mixed = mix(mixed + np.arange(BANDS, dtype=np.uint64), 99).view(np.int64)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            low = (values & 0xFFFF).astype("<u2")
            return {"key": keys, "sig": [x.tobytes() for x in low], "bands": list(mixed)}

        return func

    return with_columns(t, setup, "key binary, sig binary, bands array<long>")


@lru_cache(8)
def least_matches(threshold: float, tolerance: float, step: int, values: int) -> dict[int, int]:
    """For n compared values the fewest matches with which a pair stays: the smallest m with P(similarity >= threshold) >= tolerance.

    P(Beta(m + 1, n - m + 1) >= t) is the probability of at most m successes in n + 1 trials of probability t.
    """
    out = {}
    for n in range(step, values + 1, step):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def prune(left: np.ndarray, right: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (rows of left, rows of right; of left alone, i < j, without right) that survive all steps."""
    need = least_matches(threshold, TOLERANCE, STEP, left.shape[1])
    other = left if right is None else right
    same = np.zeros((len(left), len(other)), np.uint16)
    for k in range(STEP):
        same += left[:, k][:, None] == other[:, k][None, :]
    stay = same >= need[STEP]
    if right is None:
        stay &= np.triu(np.ones(stay.shape, bool), 1)
    i, j = np.nonzero(stay)
    m = same[i, j].astype(np.int64)
    for n in range(2 * STEP, left.shape[1] + 1, STEP):
        m += (left[i, n - STEP : n] == other[j, n - STEP : n]).sum(axis=1)
        stay = m >= need[n]
        i, j, m = i[stay], j[stay], m[stay]
    return i, j


def shared(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of pairs."""
    if len(i) <= 64:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    used = np.unique(np.concatenate([i, j]))
    flat = np.concatenate([sets[a] for a in used])
    owner = np.repeat(np.arange(len(used)), [len(sets[a]) for a in used])
    _, column, n = np.unique(flat, return_inverse=True, return_counts=True)
    twice = n > 1
    number = np.cumsum(twice) - 1
    stay = twice[column]
    owner, column = owner[stay], number[column[stay]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(used), len(used)), np.float64)
    for lo in range(0, int(twice.sum()), COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        part = np.zeros((len(used), COLUMNS), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        total += part @ part.T
    place = np.zeros(int(used.max()) + 1, np.int64)
    place[used] = np.arange(len(used))
    return total[place[i], place[j]].astype(np.int64)


def links(sigs: np.ndarray, sets: list[np.ndarray], split: int | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs of a unit; rows before `split` are one block, the others the second (None: one block alone)."""
    i, j = prune(sigs, None, threshold) if split is None else prune(sigs[:split], sigs[split:], threshold)
    j = j if split is None else j + split
    if not len(i):
        return i, j
    sizes = np.array([len(s) for s in sets], np.int64)
    both = shared(sets, i, j)
    t = Fraction(str(threshold))
    ok = both * t.denominator >= (sizes[i] + sizes[j] - both) * t.numerator
    return i[ok], j[ok]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that join the same rows as all of them do, fewer than n."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[rb] = ra
            out.append((a, b))
            if len(out) == n - 1:
                break
    return out


def unit_results(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (key, other, links): links of a set in one unit (other null), or an edge of a forest (links null)."""
    for (_, block, against), rows in sorted_groups(batches, ["root", "block", "against"]):
        data = rows.to_pydict()
        seen: dict[bytes, int] = {}
        for n, key in enumerate(data["key"]):
            seen.setdefault(key, n)  # rows that repeat id and text come more than once
        order = sorted(seen.values(), key=lambda n: data["side"][n])
        keys = [data["key"][n] for n in order]
        sets = [np.frombuffer(data["shingles"][n], np.uint64) for n in order]
        sigs = np.stack([np.frombuffer(data["sig"][n], "<u2") for n in order])
        copies = np.array([data["n_docs"][n] for n in order], np.int64)
        split = None if block == against else sum(data["side"][n] == 0 for n in order)
        i, j = links(sigs, sets, split, threshold)
        if len(i):
            count = np.bincount(i, copies[j], len(keys)) + np.bincount(j, copies[i], len(keys))
            own = np.flatnonzero(count).tolist()
            tree = forest(len(keys), i, j)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[x] for x in own] + [keys[a] for a, _ in tree], pa.binary()),
                    pa.array([None] * len(own) + [keys[b] for _, b in tree], pa.binary()),
                    pa.array([int(count[x]) for x in own] + [None] * len(tree), pa.int64()),
                ],
                ["key", "other", "links"],
            )


def labelled(df: DataFrame, id_col: str, text_col: str, k: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, th (hash of the text), key, root, class_id, class_size, n_links of each row; key and root null without words."""
    t = texts(df, id_col, text_col).withColumn("th", F.xxhash64("text"))
    signed = stored(sign(t, k), "signed")
    named = signed.where("key IS NOT NULL")
    nodes = named.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("least_id"), F.min_by(F.struct("doc_id", "th", "sig", "bands"), F.struct("doc_id", "th")).alias("one")
    )
    nodes = stored(nodes.select("key", "n_docs", "least_id", "one.*"), "nodes")

    banded = nodes.select("key", F.explode("bands").alias("band"))  # the band's number is mixed into its value
    buckets = banded.groupBy("band").agg(F.min("key").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "low")
    stars = banded.join(buckets, "band").where("key <> low").select(F.col("key").alias("a"), F.col("low").alias("b"))
    group = stored(components(stars), "groups")

    sizes = group.groupBy("root").agg(F.expr(f"CAST(ceil(count(1) / {BLOCK}) AS INT)").alias("blocks"))
    placed = group.join(sizes, "root").withColumn("own", F.expr("CAST(pmod(xxhash64(node), blocks) AS INT)"))
    wanted = placed.join(nodes.drop("bands", "least_id"), placed["node"] == nodes["key"]).select(
        "root", "blocks", "own", "key", "n_docs", F.col("doc_id").alias("node_id"), F.col("th").alias("node_th"), "sig"
    )
    wanted = stored(wanted, "wanted")
    # Texts of no candidate stay where they are: a filter of fixed size stands before the join.
    near = may_be_among(t, "th", wanted.select("node_th")).where("may_repeat").drop("may_repeat")
    same = (near["th"] == F.col("node_th")) & near["doc_id"].eqNullSafe(F.col("node_id"))
    held = near.join(wanted, same).select("root", "blocks", "own", "key", "n_docs", "sig", "text")

    def setup():
        return lambda column: {"shingles": [s.tobytes() for s in shingle_sets(column, k)]}

    sets = with_columns(held, setup, "shingles binary")
    unit = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("met")
    units = sets.select("root", "own", "key", "n_docs", "sig", "shingles", unit).select(
        "root",
        F.least("own", "met").alias("block"),
        F.greatest("own", "met").alias("against"),
        (F.col("own") > F.col("met")).cast("int").alias("side"),
        "key", "n_docs", "sig", "shingles",
    )
    dealt = units.repartition("root", "block", "against").sortWithinPartitions("root", "block", "against")
    found = stored(dealt.mapInArrow(releasing(lambda batches: unit_results(batches, threshold)), "key binary, other binary, links long"), "links")

    classes = stored(components(found.where("other IS NOT NULL").select(F.col("key").alias("a"), F.col("other").alias("b"))), "classes")
    counts = found.where("other IS NULL").groupBy("key").agg(F.sum("links").alias("links"))
    members = nodes.select("key", "n_docs", "least_id").join(classes.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    whole = members.groupBy("root").agg(F.min("least_id").alias("class_id"), F.sum("n_docs").alias("class_size"))
    figures = members.join(whole, "root").join(counts, "key", "left").select(
        "key", "root", "class_id", "class_size", (F.coalesce("links", F.lit(0)) + F.col("n_docs") - 1).alias("n_links")
    )
    # A large class of copies is one hot key here. The figures are a table, so that Spark can split it at run time.
    return signed.select("doc_id", "th", "key").join(stored(figures, "figures"), "key", "left")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each row: doc_id, class_id, class_size, n_links (other documents at the threshold or above)."""
    return labelled(df, id_col, text_col, **options).select(
        "doc_id",
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Of each class the row with the smallest id (nulls last, then any), with all its columns; rows without a copy stay as they are."""
    found = stored(labelled(df, id_col, text_col, **options).where("class_size > 1").select("doc_id", "th", "root").distinct(), "near")
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("best"))
    rows = packed(df, id=F.col(id_col), hash=F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    marked = may_be_among(rows, "hash", found.select("th"))
    members = marked.where("may_repeat")  # only these are shuffled

    def same(other: DataFrame):
        return members["id"].eqNullSafe(other["doc_id"]) & (members["hash"] == other["th"])

    clear = marked.where("NOT may_repeat").select("row")
    alone = members.join(found, same(found), "left_anti").select("row")
    chosen = best.select("root", "best.doc_id", "best.th")
    kept = members.join(chosen, same(chosen)).groupBy("root").agg(F.first("row").alias("row")).select("row")
    return unpacked(clear.unionByName(alone).unionByName(kept))
