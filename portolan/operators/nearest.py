"""Exact distance to the nearest record of another table, over numeric columns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.operators.outliers import Regions
from portolan.session import stored

# Sizes of tasks, without influence on results: given points of a cell and of a leaf in it, points that ask a cell at once,
# distances held, points placed at once, points that the cuts are taken from (about) and those that a cell keeps of them at least.
CELL_POINTS = 4000
LEAF = 16
ASKING = 20_000
HELD = 1 << 21
PLACED = 256
SAMPLE = 1 << 17
LEAST = 4


def cells_of(given: DataFrame, names: list[str], cell_points: int = CELL_POINTS) -> tuple[Regions, np.ndarray]:
    """Cuts of the space at medians of about SAMPLE given points, and a sampled point in or near each cell."""
    n = given.count()
    share = min(1.0, SAMPLE / max(n, 1))
    drawn = F.pmod(F.xxhash64(*names), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = given.where(drawn).select(*names).toPandas().to_numpy(float).reshape(-1, len(names))
    if not len(sample):  # a table so small that the hash drew nothing of it
        sample = np.array([list(r) for r in given.select(*names).take(1)], float).reshape(-1, len(names))
    depth = int(np.ceil(np.log2(max(1.0, n / cell_points))))
    depth = min(depth, int(np.log2(max(len(sample) / LEAST, 1.0))))
    cells = Regions(sample, depth)
    if not len(sample):
        return cells, sample
    home, first = np.unique(cells.home(sample), return_index=True)
    # An empty cell takes the sampled point of the next one: any given point bounds the distance.
    after = np.minimum(np.searchsorted(home, np.arange(1 << depth)), len(home) - 1)
    return cells, sample[first[after]]


def cell_boxes(cells: Regions, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper limits of each cell, infinite where no cut bounds it."""
    low, high = np.full((2 << cells.depth, width), -np.inf), np.full((2 << cells.depth, width), np.inf)
    for level in range(cells.depth):
        node = np.arange(1 << level, 2 << level)
        low[2 * node] = low[2 * node + 1] = low[node]
        high[2 * node] = high[2 * node + 1] = high[node]
        low[2 * node + 1, cells.axis[node]] = cells.cut[node]
        high[2 * node, cells.axis[node]] = cells.cut[node]
    return low[1 << cells.depth :], high[1 << cells.depth :]


class Leaves:
    """Points halved along their widest axis until about LEAF are left, with the box of each half."""

    def __init__(self, points: np.ndarray):
        self.depth = max(0, int(np.ceil(np.log2(max(len(points), 1) / LEAF))))
        size, width = -(-len(points) >> self.depth), points.shape[1]
        # Leaves are of one size: some points are held twice, which moves no smallest distance. Columns lie apart.
        held = np.ascontiguousarray(np.resize(points, (size << self.depth, width)).T)
        self.axis, self.cut = np.zeros(1 << self.depth, np.int64), np.zeros(1 << self.depth)
        self.low, self.high = np.zeros((width, 2 << self.depth)), np.zeros((width, 2 << self.depth))
        for level in range(self.depth + 1):
            node = np.arange(1 << level, 2 << level)
            held = held.reshape(width, len(node), -1)
            self.low[:, node], self.high[:, node] = held.min(axis=2), held.max(axis=2)
            if level < self.depth:
                axis = (self.high[:, node] - self.low[:, node]).argmax(axis=0)
                values = held[axis, np.arange(len(node))]
                middle = values.shape[1] // 2 - 1
                order = np.argpartition(values, middle, axis=1)
                self.axis[node], self.cut[node] = axis, values[np.arange(len(node)), order[:, middle]]
                held = np.take_along_axis(held, order[None], 2)
        self.held = held

    def _least(self, x: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        squared = np.zeros((len(leaf), self.held.shape[2]))
        for j in range(len(x)):
            squared += (x[j][:, None] - self.held[j][leaf]) ** 2
        return squared.min(axis=1)

    def least(self, x: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The bounds, lowered to the smallest squared distance of each row to a point."""
        x = np.ascontiguousarray(x.T)
        node, at = np.ones(len(bound), np.int64), np.arange(len(bound))
        for _ in range(self.depth):
            node = 2 * node + (x[self.axis[node], at] > self.cut[node])
        own = node - (1 << self.depth)
        bound = np.minimum(bound, self._least(x, own))
        row, node = at, np.ones(len(bound), np.int64)
        for _ in range(self.depth):
            row, node = np.concatenate([row, row]), np.concatenate([2 * node, 2 * node + 1])
            gap = np.zeros(len(row))
            for j in range(len(x)):
                value = x[j][row]
                gap += np.maximum(np.maximum(self.low[j][node] - value, value - self.high[j][node]), 0.0) ** 2
            keep = np.flatnonzero(gap < bound[row])  # limits are points: no distance is below its gap, rounded or not
            row, node = row[keep], node[keep]
        leaf = node - (1 << self.depth)
        row, leaf = row[leaf != own[row]], leaf[leaf != own[row]]
        step = max(1, HELD // self.held.shape[2])
        for start in range(0, len(row), step):
            part = slice(start, start + step)
            np.minimum.at(bound, row[part], self._least(x[:, row[part]], leaf[part]))
        return bound


def closest(asked: pd.DataFrame, given: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    """The points that ask, with their bound lowered to the smallest squared distance to a given point."""
    bound, here = asked["bound"].to_numpy(float).copy(), asked[names].to_numpy(float)
    if len(given):
        leaves = Leaves(given[names].to_numpy(float))
        step = max(1, HELD // (LEAF * 8))
        for at in range(0, len(here), step):
            bound[at : at + step] = leaves.least(here[at : at + step], bound[at : at + step])
    return asked[[*names, "copies", "cell"]].assign(bound=bound)


def _met(asked: DataFrame, given: DataFrame, names: list[str], schema: str) -> DataFrame:
    """closest() in every cell that is asked. A cell with many askers is dealt to several tasks."""
    loads = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(ASKING))).alias("shares"))
    loads = stored(loads, "nearest_loads")
    dealt = asked.join(loads, "cell").withColumn("share", F.pmod(F.xxhash64(*names), F.col("shares"))).drop("shares")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))
    held = given.join(loads, "cell").withColumn("share", copies).drop("shares")
    keys = ["cell", "share"]
    return dealt.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(lambda a, g: closest(a, g, names), schema)


def nearest_distances(
    asking: DataFrame, given: DataFrame, columns: list[str], cell_points: int = CELL_POINTS
) -> DataFrame:
    """(columns..., copies, distance): Euclidean distance of each distinct row of `asking` to its nearest row of `given`.

    Every row of both tables counts; equal rows are one point, with its `copies`. Rows with a NULL or non-finite column are
    left out; with no given row the distance is NULL. Given points are cut into cells at medians of a bounded sample. A point
    asks its own cell; only one whose distance so far leaves the cell asks the others that it reaches. Inside a cell it
    meets the leaves in reach, so that its work does not follow the size of cells, which changes no result either.
    """
    names = [f"near_{i}" for i in range(len(columns))]

    def points(df: DataFrame) -> DataFrame:
        numbers = [(F.col(c).cast("double") + F.lit(0.0)).alias(n) for n, c in zip(names, columns)]
        whole = reduce(and_, [F.abs(F.col(n)) < F.lit(float("inf")) for n in names])  # NaN is above all numbers
        return df.select(*numbers).where(whole).groupBy(*names).agg(F.count(F.lit(1)).alias("copies"))

    held = stored(points(given).select(*names), "nearest_given")
    cells, known = cells_of(held, names, cell_points)
    if not len(known):
        none = points(asking).withColumn("distance", F.lit(None).cast("double"))
        return none.select(*[F.col(n).alias(c) for n, c in zip(names, columns)], "copies", "distance")
    low, high = cell_boxes(cells, len(names))
    numbers = ", ".join(f"{n} double" for n in names)
    schema = f"{numbers}, copies long, cell int, bound double"

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(cell=cells.home(batch[names].to_numpy(float)).astype(np.int32))

    def place_asking(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in place(batches):
            squared = np.zeros(len(batch))
            for j, n in enumerate(names):
                squared += (batch[n].to_numpy(float) - known[batch["cell"], j]) ** 2
            yield batch.assign(bound=squared)

    def leaving(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, cell = batch[names].to_numpy(float), batch["cell"].to_numpy()
            bound = batch["bound"].to_numpy(float)
            edge = np.minimum(x - low[cell], high[cell] - x).min(axis=1) ** 2
            yield batch[(bound > 0) & (edge <= bound * (1 + 1e-9))]

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in leaving(batches):
            for at in range(0, len(batch), PLACED):
                part = batch.iloc[at : at + PLACED]
                row, cell = cells.within(part[names].to_numpy(float), part["bound"].to_numpy(float))
                abroad = cell != part["cell"].to_numpy()[row]
                yield part.iloc[row[abroad]].assign(cell=cell[abroad].astype(np.int32))

    held = stored(held.mapInPandas(place, f"{numbers}, cell int"), "nearest_cells")
    asked = stored(points(asking).mapInPandas(place_asking, schema), "nearest_asked")
    inside = stored(_met(asked, held, names, schema), "nearest_inside")
    visits = stored(inside.mapInPandas(visit, schema), "nearest_visits")
    bounds = inside.unionByName(_met(visits, held, names, schema))
    found = bounds.groupBy(*names, "copies").agg(F.sqrt(F.min("bound")).alias("distance"))
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, columns)], "copies", "distance")
