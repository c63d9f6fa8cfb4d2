"""Near-duplicate vectors by a pigeonhole join over low-dimensional blocks of rotated vectors (operator 13).

Vectors of length one with cosine at least c are at a squared distance of 2 - 2 c at most, and a rotation changes no
distance. Cut into B blocks, such a pair is within 1/B of that budget in one block at least:

1. Equal vectors are one point with a number of copies. Points are scaled to length one, rotated by a fixed random rotation
   and rounded to 16-bit codes. Distances of codes are whole numbers, so every task decides alike; the budget of a
   block covers the rounding.
2. Each block has cells: a tree of cuts at medians of a bounded sample (`SAMPLE` points). A point lives in one cell of
   each block and visits the cells within the budget of it; of two cells only one visits the other.
3. A cell's points meet in units of at most `UNIT` x `UNIT`, however many they are, so a hot cell spreads over tasks.
   Pairs within the budget of the block and of no earlier block are candidates: each pair is one in one unit only.
4. Each candidate is verified. The distance of all codes decides it exactly, but for the narrow band that their rounding
   leaves open; pairs in that band leave the unit and are verified by their cosine in double precision.

A unit gives, for each point, the rows that it is linked to, and the edges of a spanning forest; no list of pairs
leaves a task but for the band. Components of the forests give the classes. The sample shapes the cells, not the results.

Cases: vectors that are null, zero, of another length than `dim`, or hold null or non-finite components link with
nothing and are their own component; n_links is then 0. component_id is the smallest id reached, null if it has none;
rows that share an id keep their own links. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.llm.components import components
from portolan.llm.support import releasing, sorted_groups, stored
from portolan.llm.vectors import from_bytes, matrix, rows_of_bytes, whole

DIM, BLOCKS, THRESHOLD = 64, 8, 0.95
#: Steps of a code for a length of one.
STEPS = 1 << 14
#: Points that the cuts are taken from (about), points of a cell aimed at, and sample points that a cell keeps at least.
SAMPLE, CELL, LEAST = 1 << 17, 1 << 13, 16
#: Points on each side of a unit, and distances held at once.
UNIT, HELD = 1 << 14, 1 << 17
MET = "block int, cell int, part int, against int, asks boolean, lives boolean, point long, copies long, codes binary"


@lru_cache(4)
def rotation(dim: int) -> np.ndarray:
    """A rotation drawn once for all runs."""
    q, r = np.linalg.qr(np.random.default_rng(20).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def unit_length(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def codes_of(x: np.ndarray) -> np.ndarray:
    return np.rint(unit_length(x) @ rotation(x.shape[1]) * STEPS).astype(np.int16)


def budget(threshold: float, blocks: int, dim: int) -> int:
    """Largest squared distance of codes in a block: the block's share of the budget and what rounding may add to it."""
    reach = math.sqrt(max(0.0, 2 - 2 * threshold) / blocks) + 1e-9
    return math.floor((reach * STEPS + math.sqrt(dim // blocks) * 1.01) ** 2)


class Cells:
    """A tree of cuts over the codes of one block; its leaves are numbered from 0 to 2^depth - 1."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.cut = np.zeros(1 << depth, np.int32), np.zeros(1 << depth, np.int32)
        held = {1: sample}
        for node in range(1, 1 << depth):
            rows = held.pop(node)
            if len(rows):
                spread = np.quantile(rows, 0.9, axis=0) - np.quantile(rows, 0.1, axis=0)
                self.axis[node] = axis = int(spread.argmax())
                self.cut[node] = int(np.median(rows[:, axis]))
            right = rows[:, self.axis[node]] > self.cut[node]
            held[2 * node], held[2 * node + 1] = rows[~right], rows[right]

    def home(self, codes: np.ndarray) -> np.ndarray:
        node = np.ones(len(codes), np.int64)
        for _ in range(self.depth):
            right = codes[np.arange(len(codes)), self.axis[node]] > self.cut[node]
            node = 2 * node + right
        return node - (1 << self.depth)

    def within(self, codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells that a squared distance of `most` reaches from each row's codes."""
        row, node = np.arange(len(codes)), np.ones(len(codes), np.int64)
        gaps = np.zeros((len(codes), codes.shape[1]), np.int64)
        for _ in range(self.depth):
            axis = self.axis[node]
            past = codes[row, axis].astype(np.int64) - self.cut[node]
            own = past > 0
            # The far side begins one step beyond the cut on the right, at the cut itself on the left.
            gap = np.where(own, past, 1 - past)
            far = gaps.copy()
            far[np.arange(len(row)), axis] = np.maximum(far[np.arange(len(row)), axis], gap)
            keep = np.flatnonzero((far**2).sum(axis=1) <= most)
            row = np.concatenate([row, row[keep]])
            node = np.concatenate([2 * node + own, 2 * node[keep] + ~own[keep]])
            gaps = np.concatenate([gaps, far[keep]])
        return row, node - (1 << self.depth)


def visits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """True where a point of cell a visits cell b; of a pair of cells one does, in turn the lower and the higher."""
    return (a < b) ^ ((a + b) % 2 == 1)


def _meetings(trees: list[Cells], codes: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each block (block, row, cell, whether the row lives there)."""
    width = codes.shape[1] // len(trees)
    for block, tree in enumerate(trees):
        part = codes[:, block * width : (block + 1) * width]
        home = tree.home(part)
        row, cell = tree.within(part, most)
        lives = home[row] == cell
        kept = lives | visits(home[row], cell)
        yield block, row[kept], cell[kept], lives[kept]


def _loads(trees: list[Cells], most: int, dim: int):
    """Points that live in each cell and that meet there, one row for each cell and task."""
    size = 1 << trees[0].depth

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(trees), size), np.int64)
        for batch in batches:
            for block, _, cell, lives in _meetings(trees, from_bytes(batch.column("codes"), "<i2", dim), most):
                total[0, block] += np.bincount(cell[lives], minlength=size)
                total[1, block] += np.bincount(cell, minlength=size)
        block, cell = np.nonzero(total[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(block, pa.int32()), pa.array(cell, pa.int32()), pa.array(total[0, block, cell]), pa.array(total[1, block, cell])],
            ["block", "cell", "lives", "asks"],
        )

    return count


def _counted(times: np.ndarray) -> np.ndarray:
    """0, 1, ... below each number in turn."""
    return np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)


def _dealt(trees: list[Cells], parts: np.ndarray, most: int, dim: int):
    """Points to the units where they meet; parts[0] and parts[1]: into how many parts the residents and all of a cell are cut."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = from_bytes(batch.column("codes"), "<i2", dim)
            draw = batch.column("point").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
            for block, row, cell, lives in _meetings(trees, codes, most):
                given, asked = parts[0, block, cell], parts[1, block, cell]
                part_asked = (draw[row] % asked.astype(np.uint64)).astype(np.int64)
                part_given = (draw[row] % given.astype(np.uint64)).astype(np.int64)
                # As one that asks to every part of the residents, as a resident to every part of those that ask;
                # a cell of one part each gets its residents once.
                alone = (given == 1) & (asked == 1)
                i = np.repeat(np.arange(len(row)), given)
                sides = [(i, part_asked[i], _counted(given), True)]
                here = np.flatnonzero(lives & ~alone)
                i = np.repeat(here, asked[here])
                sides.append((i, _counted(asked[here]), part_given[i], False))
                for i, part, against, asks in sides:
                    for at in range(0, len(i), UNIT):
                        at_row, p, g = i[at : at + UNIT], part[at : at + UNIT], against[at : at + UNIT]
                        took = pa.array(row[at_row])
                        fixed = [pa.array(np.full(len(at_row), block, np.int32)), pa.array(cell[at_row].astype(np.int32))]
                        fixed += [pa.array(p.astype(np.int32)), pa.array(g.astype(np.int32))]
                        fixed += [pa.array(np.full(len(at_row), asks)), pa.array(lives[at_row])]
                        rest = [batch.column(c).take(took) for c in ("point", "copies", "codes")]
                        yield pa.RecordBatch.from_arrays(fixed + rest, [c.split()[0] for c in MET.split(", ")])

    return deal


def close_pairs(asked: dict, given: dict, block: int, blocks: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place among asked, place among given, squared distance) of the candidates that are due in this block.

    Both sides hold `point` in rising order, `lives` and `codes` (doubles of whole numbers). Of two residents the lower
    point asks.
    """
    dim = asked["codes"].shape[1]
    width = dim // blocks
    own = slice(block * width, (block + 1) * width)
    there = given["codes"][:, own]
    # near: 2 x y >= x x + y y - most, with the norm of y as one more column of a product.
    beside = np.concatenate([there, (there**2).sum(axis=1, keepdims=True) / -2], axis=1).T
    for lives in (True, False):
        who = np.flatnonzero(asked["lives"] == lives)
        step = max(1, HELD // max(1, len(there)))
        for at in range(0, len(who), step):
            some = who[at : at + step]
            # Residents ask those above them only.
            low = int(np.searchsorted(given["point"], asked["point"][some[0]])) if lives else 0
            here = asked["codes"][some, own]
            limit = ((here**2).sum(axis=1) - most) / 2
            near = np.concatenate([here, np.ones((len(here), 1))], axis=1) @ beside[:, low:] >= limit[:, None]
            i, j = np.divmod(np.flatnonzero(near), max(1, near.shape[1]))
            i, j = some[i], j + low
            if lives:
                due = asked["point"][i] < given["point"][j]
                i, j = i[due], j[due]
            for k in range(0, len(i), HELD // dim):
                x, y = i[k : k + HELD // dim], j[k : k + HELD // dim]
                apart = ((asked["codes"][x] - given["codes"][y]) ** 2).reshape(len(x), blocks, width).sum(axis=2)
                first = (apart[:, :block] > most).all(axis=1)
                yield x[first], y[first], apart[first].sum(axis=1)


def grow(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs join two trees of a growing forest; `label` holds the tree of each node and is kept up to date."""
    picked, rest = [], np.arange(len(x))
    while len(rest := rest[label[x[rest]] != label[y[rest]]]):
        p, q = label[x[rest]], label[y[rest]]
        low, high = np.minimum(p, q), np.maximum(p, q)
        tops, first = np.unique(high, return_index=True)
        picked.append(rest[first])
        target = np.arange(len(label))
        target[tops] = low[first]
        while (further := target[target]).tobytes() != target.tobytes():
            target = further
        label[:] = target[label]
    return np.concatenate(picked) if picked else rest


KEYS = ["block", "cell", "part", "against"]
ORDER = [*KEYS, "point"]


def _meet(blocks: int, most: int, limits: tuple[float, float], dim: int):
    """Units to rows (a, links of a), edges (a, b) and open pairs (a, b, links 0)."""

    def side(t: pa.Table) -> dict:
        batch = t.combine_chunks()
        column = lambda n: batch.column(n).to_numpy()
        return {n: column(n) for n in ("point", "lives", "copies")} | {"codes": from_bytes(batch.column("codes"), "<i2", dim).astype(float)}

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a, b, links):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, links)], ["a", "b", "links"])

        for key, rows in sorted_groups(batches, KEYS):
            asking = rows.column("asks")
            # Residents come apart from those that ask, or both are one.
            residents = pc.invert(asking) if not pc.all(asking).as_py() else rows.column("lives")
            asked, given = side(rows.filter(asking)), side(rows.filter(residents))
            points, at = np.unique(np.concatenate([asked["point"], given["point"]]), return_inverse=True)
            at_asked, at_given = at[: len(asked["point"])], at[len(asked["point"]) :]
            n, label = np.zeros(len(points), np.int64), np.arange(len(points))
            for i, j, squared in close_pairs(asked, given, key[0], blocks, most):
                open_ = (squared > limits[0]) & (squared <= limits[1])
                if open_.any():
                    a, b = asked["point"][i[open_]], given["point"][j[open_]]
                    yield out(a, b, np.zeros(len(a), np.int64))
                i, j = i[squared <= limits[0]], j[squared <= limits[0]]
                np.add.at(n, at_asked[i], given["copies"][j])
                np.add.at(n, at_given[j], asked["copies"][i])
                edges = grow(label, at_asked[i], at_given[j])
                if len(edges):
                    yield out(asked["point"][i[edges]], given["point"][j[edges]], pa.nulls(len(edges), pa.int64()))
            linked = np.flatnonzero(n)
            yield out(points[linked], pa.nulls(len(linked), pa.int64()), n[linked])

    return meet


def _with_codes(dim: int):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("vector"), dim)
            yield pa.RecordBatch.from_arrays([batch.column("point"), batch.column("copies"), rows_of_bytes(codes_of(x))], ["point", "copies", "codes"])

    return code


def _verified(pairs: DataFrame, points: DataFrame, threshold: float, dim: int) -> DataFrame:
    """(a, b, copies_a, copies_b) of the pairs whose vectors reach the threshold."""
    for end in ("a", "b"):
        own = points.select(F.col("point").alias(end), F.col("copies").alias(f"copies_{end}"), F.col("vector").alias(f"vector_{end}"))
        pairs = pairs.join(own, end)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (unit_length(matrix(batch.column(f"vector_{end}"), dim)) for end in ("a", "b"))
            yield batch.filter(pa.array(np.einsum("ij,ij->i", x, y) >= threshold)).select(["a", "b", "copies_a", "copies_b"])

    return pairs.mapInArrow(releasing(verify), "a long, b long, copies_a long, copies_b long")


def links(points: DataFrame, threshold: float = THRESHOLD, blocks: int = BLOCKS, dim: int = DIM) -> tuple[DataFrame, DataFrame]:
    """((point, links), (a, b)): rows that each point is linked to, and edges of spanning forests.

    points: (point long, copies long, vector array<double>), different vectors without null, non-finite or all zero components.
    """
    if dim % blocks:
        raise ValueError("blocks must divide the vectors")
    coded = stored(points.mapInArrow(releasing(_with_codes(dim)), "point long, copies long, codes binary"), "vector-codes")
    n = coded.count()
    most = budget(threshold, blocks, dim)
    # By a hash of the point: close to SAMPLE rows whatever the table, the same ones in every run over the stored table.
    drawn = F.pmod(F.xxhash64("point", F.lit(13)), F.lit(1 << 30)) <= int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30))
    sample = from_bytes(coded.where(drawn).select("codes").toArrow().column("codes").combine_chunks(), "<i2", dim)
    depth = max(0, min(math.ceil(math.log2(max(n, 1) / CELL)), int(math.log2(max(len(sample), LEAST) / LEAST))))
    width = dim // blocks
    trees = [Cells(sample[:, b * width : (b + 1) * width], depth) for b in range(blocks)]
    counts = np.zeros((2, blocks, 1 << depth), np.int64)
    loads = coded.select("codes").mapInArrow(releasing(_loads(trees, most, dim)), "block int, cell int, lives long, asks long")
    for r in loads.groupBy("block", "cell").agg(F.sum("lives").alias("lives"), F.sum("asks").alias("asks")).collect():  # cells only
        counts[:, r["block"], r["cell"]] = r["lives"], r["asks"]
    met = coded.mapInArrow(releasing(_dealt(trees, np.maximum(1, -(-counts // UNIT)), most, dim)), MET)
    units = met.repartition(*KEYS).sortWithinPartitions(*ORDER)
    # The rounding moves a distance by at most one step for each component.
    reach, slack = math.sqrt(max(0.0, 2 - 2 * threshold)) * STEPS, math.sqrt(dim) * 1.01
    limits = (max(0.0, reach - slack) ** 2 if reach > slack else -1.0, (reach + slack) ** 2)
    found = stored(units.mapInArrow(releasing(_meet(blocks, most, limits, dim)), "a long, b long, links long"), "vector-links")
    late = stored(_verified(found.where("links = 0").select("a", "b"), points, threshold, dim), "vector-links")
    counted = found.where("b IS NULL").select(F.col("a").alias("point"), "links")
    for own, other in (("a", "b"), ("b", "a")):
        counted = counted.unionByName(late.select(F.col(own).alias("point"), F.col(f"copies_{other}").alias("links")))
    edges = found.where("b IS NOT NULL AND links IS NULL").select("a", "b").unionByName(late.select("a", "b"))
    return counted.groupBy("point").agg(F.sum("links").alias("links")), edges


def near_duplicates(
    df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, blocks: int = BLOCKS
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: other rows at a cosine of `threshold` or more, and its component."""
    value = F.col("vector")
    usable = whole(vector_col, dim) & F.exists(F.col(vector_col).cast("array<double>"), lambda x: x != 0)
    # -0.0 and 0.0 are one component.
    one = df.select(
        F.col(id_col).alias("vec_id"), F.when(usable, F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0))).alias("vector")
    )
    rows = stored(one.withColumn("key", F.when(value.isNotNull(), F.sha2(F.to_json(F.struct("vector")).cast("binary"), 256))), "vector-rows")
    same = rows.where(value.isNotNull()).groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"), F.min("vec_id").alias("least"))
    points = stored(same.withColumn("point", F.monotonically_increasing_id()), "vector-classes")
    counted, edges = links(points.select("point", "copies", "vector"), threshold, blocks, dim)
    roots = components(edges)
    placed = points.select("key", "point", "copies", "least").join(counted, "point", "left")
    placed = placed.join(roots.withColumnRenamed("node", "point"), "point", "left").withColumn("root", F.coalesce("root", "point"))
    placed = stored(placed.withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1).select("key", "root", "n_links", "least"), "vector-classes")
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    answer = placed.join(smallest, "root").select("key", "n_links", "component_id")
    out = rows.select("vec_id", "key").join(answer, "key", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )
