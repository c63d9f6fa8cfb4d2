"""Outliers: interquartile range and local outlier factor."""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portolan.functions.numeric import half_even, lenient_double
from portolan.operators.quantiles import exact_quantiles, quantiles
from portolan.session import stored

IQR_FACTOR = 1.5


def beyond_iqr(value: Column, q1: Column, q3: Column) -> Column:
    """Strictly outside the quartiles by 1.5 ranges."""
    return (value > q3 + IQR_FACTOR * (q3 - q1)) | (value < q1 - IQR_FACTOR * (q3 - q1))


def outliers_iqr(df: DataFrame, column: str, by: str | None = None, method: str = "exact") -> DataFrame:
    """Rows strictly outside the quartiles by 1.5 ranges, with `iqr` and `limite_superior`.

    Global limits are one scalar subquery; with `by`, limits are joined per group.
    """
    value = lenient_double(column)
    wanted = {"q1": 0.25, "q3": 0.75}
    if by is None:
        limits = quantiles(df, value, wanted, method=method).select(F.struct("q1", "q3").alias("q")).scalar()
        out = df.withColumn("q", limits).withColumns({"q1": F.col("q.q1"), "q3": F.col("q.q3")}).drop("q")
    else:
        out = df.join(quantiles(df, value, wanted, [by], method), by)
    iqr = F.col("q3") - F.col("q1")
    return (
        out.withColumns({"iqr": iqr, "limite_superior": F.col("q3") + IQR_FACTOR * iqr})
        .where((value > F.col("limite_superior")) | (value < F.col("q1") - IQR_FACTOR * F.col("iqr")))
        .drop("q1", "q3")
    )


# Fixed values of the outlier score: neighbours, share flagged, damping of the rest, smallest table.
NEIGHBOURS = 20
CONTAMINATION = 0.1
DAMPING = 0.3
# Factors meet the limit to this many decimals, so that equal ones stay equal in whatever order their parts were summed.
FACTOR_DIGITS = 9
MIN_ROWS = 10
# Sizes of tasks, without influence on results: rows of a scope that are one task and points of a cell of a larger scope at most, cells of
# a larger scope for each core, points of such a cell at least, points of a leaf in a cell, points up to which all pairs are met, points
# that visit a cell at once, distances held, points that the cuts are taken from (about) and those that a cell keeps of them at least.
BLOCK_POINTS = 1 << 17
CELLS_PER_CORE = 4
LEAST_CELL = 4000
LEAF = 64
ALL_PAIRS = 256
VISITS = 4000
TILE = 1 << 14
SAMPLE = 1 << 17
LEAST = 16


def lof_of_points(points: np.ndarray, copies: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """Local outlier factor of distinct points, each standing for a number of equal rows.

    A row's own copies are neighbours at distance 0. Equal distances are taken in coordinate order. All pairs are met up to ALL_PAIRS
    points, the leaves of a tree that a search can reach beyond.
    """
    order = np.lexsort(points.T[::-1])
    pts, weight = points[order], copies[order].astype(float)
    k = int(min(k, weight.sum() - 1))
    out = np.empty(len(pts))
    if len(pts) > ALL_PAIRS:
        out[order] = _factor_by_leaves(pts, copies[order], k)
        return out
    squared = np.zeros((len(pts), len(pts)))
    for j in range(pts.shape[1]):
        squared += (pts[:, j][:, None] - pts[:, j][None, :]) ** 2
    near = np.argsort(squared, axis=1, kind="stable")[:, : k + 1]
    dist = np.sqrt(np.take_along_axis(squared, near, axis=1))
    available = weight[near]
    available[near == np.arange(len(pts))[:, None]] -= 1.0
    reached = np.cumsum(available, axis=1)
    used = np.clip(k - (reached - available), 0.0, available)
    k_distance = dist[np.arange(len(pts)), np.argmax(reached >= k, axis=1)]
    reach = np.maximum(dist, k_distance[near])
    density = 1.0 / ((used * reach).sum(axis=1) / k + 1e-10)
    factor = (used * density[near]).sum(axis=1) / k / density
    out[order] = factor
    return out


def _factor_by_leaves(points: np.ndarray, copies: np.ndarray, k: int) -> np.ndarray:
    """lof_of_points() of points in coordinate order; what is held grows with the points, not with their square."""
    n = len(points)
    cell = Cell(np.arange(n), copies, points)
    asked = cell.ids  # in the order of the leaves: searches of one part stay near each other
    parts = []
    for start in range(0, n, VISITS):
        some = asked[start : start + VISITS]
        row, near, squared, rows, _ = cell.search(points[some], some, np.full(len(some), k), np.full(len(some), np.inf))
        parts.append((some[row], near, np.sqrt(squared), rows_used(row, rows, np.full(len(row), k))))
    owner, near, distance, used = (np.concatenate(c) for c in zip(*parts))
    reach = np.zeros(n)
    np.maximum.at(reach, owner, distance)
    density = 1.0 / (np.bincount(owner, used * np.maximum(distance, reach[near]), n) / k + 1e-10)
    return np.bincount(owner, used * density[near], n) / k / density


def lof_scores_of_block(points: np.ndarray, copies: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """The factor scaled to [0, 1] over the block's rows; scores of rows outside the top tenth are damped."""
    if copies.sum() < MIN_ROWS:
        return np.zeros(len(points))
    factor = lof_of_points(points, copies, k)
    compared = -np.rint(factor * 10.0**FACTOR_DIGITS) / 10.0**FACTOR_DIGITS
    scaled = (factor - factor.min()) / (factor.max() - factor.min() + 1e-9)
    ranked = np.sort(np.repeat(compared, copies))
    # A tenth of 70 is 7, not 7 and an ulp: the row that lies on the limit itself is not flagged.
    place = round(CONTAMINATION * (len(ranked) - 1), 9)
    low = int(place)
    limit = ranked[low] + (ranked[min(low + 1, len(ranked) - 1)] - ranked[low]) * (place - low)
    return np.where(compared < limit, scaled, scaled * DAMPING)


def nearest(owner: np.ndarray, squared: np.ndarray, near: np.ndarray, rows: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the candidates among each owner's k nearest rows, equal distances by `near`, and how many rows each gives."""
    order = np.lexsort((near, squared, owner))
    used = rows_used(owner[order], rows[order], k[order])
    return order[used > 0], used[used > 0]


def rows_used(owner: np.ndarray, rows: np.ndarray, k: np.ndarray) -> np.ndarray:
    """How many rows each candidate gives until its owner has k; candidates of an owner follow each other, nearest first."""
    first = np.r_[True, owner[1:] != owner[:-1]][: len(owner)]
    before = np.cumsum(rows) - rows
    before = before - before[np.maximum.accumulate(np.where(first, np.arange(len(owner)), 0))]
    return np.clip(k - before, 0, rows)


class Regions:
    """Cuts of a space at medians of a sample; the regions that remain are numbered from 0 to 2^depth - 1."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.cut = np.zeros(1 << depth, np.int32), np.zeros(1 << depth)
        held = {1: sample}
        for node in range(1, 1 << depth):
            rows = held.pop(node)
            if len(rows):
                spread = np.quantile(rows, 0.95, axis=0) - np.quantile(rows, 0.05, axis=0)
                spread = spread if spread.max() > 0 else rows.max(axis=0) - rows.min(axis=0)
                self.axis[node] = axis = int(spread.argmax())
                values = np.sort(rows[:, axis])
                middle = values[(len(values) - 1) // 2]
                smaller = values[values < values[-1]]
                cut = min(middle, smaller[-1]) if len(smaller) else middle
                # Between two values rather than on one: rows that share a value do not lie on the border.
                larger = values[values > cut]
                between = cut / 2 + larger[0] / 2 if len(larger) else cut
                self.cut[node] = between if cut < between < larger[:1].sum() else cut
            right = rows[:, self.axis[node]] > self.cut[node]
            held[2 * node], held[2 * node + 1] = rows[~right], rows[right]

    def home(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (x[np.arange(len(x)), self.axis[node]] > self.cut[node])
        return node - (1 << self.depth)

    def within(self, x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, region) of the regions that a ball of squared radius `bound` around each row can reach."""
        bound = bound * (1 + 1e-9)  # the squares of a gap and of a distance are summed alike; this covers their rounding
        row, node, gaps = np.arange(len(x)), np.ones(len(x), np.int64), np.zeros_like(x)
        for _ in range(self.depth):
            axis = self.axis[node]
            past = x[row, axis] - self.cut[node]
            right = past > 0
            far = gaps.copy()
            at = np.arange(len(row))
            far[at, axis] = np.maximum(far[at, axis], np.abs(past))
            keep = np.flatnonzero((far**2).sum(axis=1) <= bound[row])
            row = np.concatenate([row, row[keep]])
            node = np.concatenate([2 * node + right, 2 * node[keep] + ~right[keep]])
            gaps = np.concatenate([gaps, far[keep]])
        return row, node - (1 << self.depth)


def _regions(points: DataFrame, names: list[str], cell_points: int) -> dict[str, Regions]:
    """Cuts of each scope that has more points than a cell, from about SAMPLE points of all scopes together."""
    n = points.count()
    cores = points.sparkSession.sparkContext.defaultParallelism
    cell_points = min(cell_points, max(LEAST_CELL, n // (CELLS_PER_CORE * cores)))
    drawn = F.pmod(F.xxhash64("lof_id", F.lit(7)), F.lit(1 << 30)) <= int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30))
    sample = points.where(drawn).select("lof_scope", *names).toPandas()
    grown = n / max(len(sample), 1)
    out = {}
    for scope, part in sample.groupby("lof_scope", sort=False):
        depth = min(int(np.ceil(np.log2(max(1.0, len(part) * grown / cell_points)))), int(np.log2(max(len(part) / LEAST, 1.0))))
        if depth:
            out[scope] = Regions(part[names].to_numpy(float), depth)
    return out


def _bytes(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary value for each stretch of an array of 8-byte numbers."""
    offsets = (np.concatenate([[0], ends]) * 8).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _numbers(column: pa.ChunkedArray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a binary column one after another, and how many each value holds."""
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), dtype), np.fromiter((len(x) // 8 for x in data), np.int64, len(data))


LIST = "lof_scope string, home int, lof_id long, k long, near binary, squared binary, rows binary"
FOUND = LIST + ", coordinates binary, bound double"
SETTLED = "lof_scope string, home int, lof_id long, own boolean, k long, reach double, near binary, distance binary, used binary"


CLOSED = "lof_scope string, home int, lof_id long, h1 long, h2 long, copies long, k long, crosses boolean, reach double, density double, factor double"
CLOSED += ", near binary, squared binary, rows binary, coordinates binary, bound double"


KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, KINDS[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _table(ddl: str, *columns) -> pa.Table:
    return pa.table(list(columns), schema=_schema(ddl))


def squared_distances(here: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Squares of the columns' differences, summed in the order of the columns. What all points share adds nothing and is left out."""
    out = np.zeros((len(here), len(there)))
    gap = np.empty_like(out)
    low, high = np.minimum(here.min(axis=0), there.min(axis=0)), np.maximum(here.max(axis=0), there.max(axis=0))
    for n in np.flatnonzero(low < high):
        np.subtract(here[:, n, None], there[None, :, n], out=gap)
        gap *= gap
        out += gap
    return out


class Cell:
    """The points of a cell, cut into leaves of about LEAF points: a search meets leaves, not the whole cell."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, points: np.ndarray):
        self.tree = Regions(points, max(0, int(np.ceil(np.log2(max(len(ids), 1) / LEAF)))))
        leaf = self.tree.home(points)
        order = np.argsort(leaf, kind="stable")
        self.ids, self.copies, self.points = ids[order], copies[order], points[order]
        self.starts = np.searchsorted(leaf[order], np.arange((1 << self.tree.depth) + 1))

    def _meet(self, rows, leaves, here, own, most, bound, first):
        """(row, place, squared) within each row's bound, over pairs of a row and a leaf; in the first leaf the nearest `most` + 1."""
        out = []
        order = np.argsort(leaves, kind="stable")
        rows, leaves = rows[order], leaves[order]
        ends = np.flatnonzero(np.r_[leaves[1:] != leaves[:-1], True][: len(leaves)]) + 1
        for begin, end in zip(np.r_[0, ends[:-1]][: len(ends)], ends, strict=True):
            low, high = self.starts[leaves[begin]], self.starts[leaves[begin] + 1]
            step = max(1, TILE // max(high - low, 1))
            for start in range(begin, end if high > low else begin, step):
                some = rows[start : min(start + step, end)]
                squared = squared_distances(here[some], self.points[low:high])
                limit = bound[some]
                if first and most < high - low:
                    limit = np.minimum(limit, np.partition(squared, most, axis=1)[:, most])
                i, j = np.nonzero(squared <= limit[:, None])
                kept = self.copies[low + j] > (own[some[i]] == self.ids[low + j])
                i, j = i[kept], j[kept]
                out.append((some[i], low + j, squared[i, j]))
        return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]

    def _cut(self, row, place, squared, own, k):
        """The nearest k rows of each owner, and the rows that each point gives."""
        rows = self.copies[place] - (own[row] == self.ids[place])
        at, used = nearest(row, squared, self.ids[place], rows, k[row])
        return row[at], place[at], squared[at], rows[at], used

    def search(self, here, own, k, bound):
        """(owner, id, squared, rows) of the k nearest rows within each bound, and the bounds that they give."""
        n, most = len(own), int(k.max())
        home = self.tree.home(here)
        near = self._meet(np.arange(n), home, here, own, most, bound, True)
        row, place, squared, rows, used = self._cut(*near, own, k)
        bound = self._shrunk(row, squared, used, k, bound)
        if self.tree.depth:
            at, leaves = self.tree.within(here, bound)
            other = leaves != home[at]
            far = self._meet(at[other], leaves[other], here, own, most, bound, False)
            row, place, squared = (np.concatenate(c) for c in zip((row, place, squared), far))
            row, place, squared, rows, used = self._cut(row, place, squared, own, k)
            bound = self._shrunk(row, squared, used, k, bound)
        return row, self.ids[place], squared, rows, bound

    @staticmethod
    def _shrunk(row, squared, used, k, bound):
        enough = np.bincount(row, used, len(k)) >= k
        reached = np.zeros(len(k))
        np.maximum.at(reached, row, squared)
        return np.where(enough, np.minimum(bound, reached), bound)


def _found(asked: pa.Table, given: pa.Table, home: str, width: int) -> pa.Table:
    """The nearest points of a cell for each one that asks, within its bound so far, and the bound that they give."""
    given = given.sort_by("lof_id")
    cell = Cell(given["lof_id"].to_numpy(), given["copies"].to_numpy(), _numbers(given["coordinates"], "<f8")[0].reshape(-1, width))
    parts = []
    for start in range(0, asked.num_rows, VISITS):
        part = asked.slice(start, VISITS).combine_chunks()
        own, k, bound = (part[c].to_numpy() for c in ("lof_id", "k", "bound"))
        here = _numbers(part["coordinates"], "<f8")[0].reshape(-1, width)
        row, near, squared, rows, bound = cell.search(here, own, k, bound)
        ends = np.cumsum(np.bincount(row, minlength=len(own)))
        lists = (_bytes(near, ends), _bytes(squared, ends), _bytes(rows, ends))
        parts.append(_table(FOUND, part["lof_scope"], part[home], own, k, *lists, part["coordinates"], bound))
    return pa.concat_tables(parts) if parts else _schema(FOUND).empty_table()


def _inside(given: pa.Table, tree: Regions | None, width: int) -> pa.Table:
    """What a cell alone can say of its points: `crosses` where a point's k-distance reaches another cell, the reach where it does not, the
    density where no neighbour crosses either, the factor where those of all neighbours are known. The rest, and only the rest, keep their lists.
    """
    found = _found(given, given, "cell", width)
    ids, k, bound = found["lof_id"].to_numpy(), found["k"].to_numpy(), found["bound"].to_numpy()
    here = _numbers(given["coordinates"], "<f8")[0].reshape(-1, width)  # found is in the order of given
    n = len(ids)
    crosses = np.zeros(n, bool)
    for start in range(0, n if tree else 0, VISITS):
        row, cell = tree.within(here[start : start + VISITS], bound[start : start + VISITS])
        crosses[start + np.unique(row[cell != found["home"][0].as_py()])] = True
    near, many = _numbers(found["near"], "<i8")
    squared, rows = _numbers(found["squared"], "<f8")[0], _numbers(found["rows"], "<i8")[0]
    owner, order = np.repeat(np.arange(n), many), np.argsort(ids)
    near = order[np.searchsorted(ids[order], near)]
    used, distance = rows_used(owner, rows, k[owner]), np.sqrt(squared)
    reach = np.zeros(n)
    np.maximum.at(reach, owner, distance)
    some_near = lambda flags: np.bincount(owner, flags[near], n) > 0
    density = 1.0 / (np.bincount(owner, used * np.maximum(distance, reach[near]), n) / k + 1e-10)
    loose = crosses | some_near(crosses)
    factor = np.bincount(owner, used * density[near], n) / k / density
    opened = loose | some_near(loose)
    kept = lambda column, flags: column.take(pa.array(np.arange(n), mask=~flags))  # NULL elsewhere
    lists = [kept(found[c], opened) for c in ("near", "squared", "rows")]
    values = [pa.array(v, mask=flags) for v, flags in ((reach, opened), (density, opened), (factor, opened))]
    columns = [found[c] for c in ("lof_scope", "home", "lof_id")] + [given[c] for c in ("h1", "h2", "copies")]
    return _table(CLOSED, *columns, found["k"], pa.array(crosses), *values, *lists, kept(found["coordinates"], crosses), kept(found["bound"], crosses))


def _settled(lists: pa.Table) -> pa.Table:
    """Final neighbours of the points of a cell; with `own` false, the points of other cells among them."""
    near, many = _numbers(lists["near"], "<i8")
    squared, rows = _numbers(lists["squared"], "<f8")[0], _numbers(lists["rows"], "<i8")[0]
    ids, place = np.unique(lists["lof_id"].to_numpy(), return_inverse=True)
    k = np.zeros(len(ids), np.int64)
    k[place] = lists["k"].to_numpy()
    owner = np.repeat(place, many)
    at, used = nearest(owner, squared, near, rows, k[owner])
    owner, near, distance = owner[at], near[at], np.sqrt(squared[at])
    reach = np.zeros(len(ids))
    np.maximum.at(reach, owner, distance)
    ends = np.cumsum(np.bincount(owner, minlength=len(ids)))
    scope, home = lists["lof_scope"][0].as_py(), lists["home"][0].as_py()
    same = lambda n: (pa.array([scope] * n, pa.string()), pa.array([home] * n, pa.int32()))
    own = _table(SETTLED, *same(len(ids)), ids, pa.array([True] * len(ids)), k, reach, _bytes(near, ends), _bytes(distance, ends), _bytes(used, ends))
    others = np.setdiff1d(near, ids)
    none = [pa.nulls(len(others), t) for t in (pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.binary())]
    return pa.concat_tables([own, _table(SETTLED, *same(len(others)), others, pa.array([False] * len(others), pa.bool_()), *none)])


def _around(settled: DataFrame, own: DataFrame, values: DataFrame, combine, out: str) -> DataFrame:
    """A value of each settled point from the values of its neighbours: `own` has those of the settled points, `values` all others that
    are known by now. combine: (numbers of a list's neighbours, distance, used, k of each point, sum over lists).
    """
    keys = ["lof_scope", "home"]
    ours = own.select(*keys, "lof_id", "value")
    everyone = ours.select("lof_id", "value").unionByName(values.select("lof_id", "value"))
    abroad = settled.where("NOT own").select(*keys, "lof_id").join(everyone, "lof_id").select(*keys, "lof_id", "value")
    known = ours.unionByName(abroad)
    known = known.select(*[F.col(c).alias(c) for c in known.columns])  # new columns: both sides come from one table
    ddl = f"lof_scope string, home int, lof_id long, {out} double"

    def gather(lists: pa.Table, numbers: pa.Table) -> pa.Table:
        if not lists.num_rows:
            return _schema(ddl).empty_table()
        near, many = _numbers(lists["near"], "<i8")
        distance, used = _numbers(lists["distance"], "<f8")[0], _numbers(lists["used"], "<i8")[0]
        ids = numbers["lof_id"].to_numpy()
        order = np.argsort(ids)
        found = numbers["value"].to_numpy()[order][np.searchsorted(ids[order], near)]
        owner = np.repeat(np.arange(len(many)), many)
        total = lambda x: np.bincount(owner, x, len(many))  # in the order of the lists: no result depends on the dealing
        return _table(ddl, lists["lof_scope"], lists["home"], lists["lof_id"], combine(found, distance, used, lists["k"].to_numpy(), total))

    lists = settled.where("own").select(*keys, "lof_id", "k", "near", "distance", "used")
    return lists.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInArrow(gather, ddl)


def _lof_factors(points: DataFrame, names: list[str], cell_points: int) -> DataFrame:
    """(lof_scope, h1, h2, copies, factor), the factor as lof_of_points() gives it over each whole scope.

    Cells are as large as a task can hold, and a cell alone settles all points but those near its border. Only these visit the cells that their
    k-distance so far reaches, and only their lists are stored and moved; what they need of other points is one number for each.
    `lof_id` rises with the coordinates, which settles equal distances.
    """
    trees, width = _regions(points, names, cell_points), len(names)

    def by_scope(batch: pa.RecordBatch):
        scopes = batch.column("lof_scope").dictionary_encode()
        for code, scope in enumerate(scopes.dictionary.to_pylist()):
            yield trees.get(scope), np.flatnonzero(scopes.indices.to_numpy() == code)

    own = ["lof_id", "h1", "h2", "k", "copies"]

    def place(batches):
        for batch in batches:
            x = np.column_stack([batch.column(n).to_numpy() for n in names])
            cell = np.zeros(len(x), np.int32)
            for tree, rows in by_scope(batch):
                if tree:
                    cell[rows] = tree.home(x[rows])
            data = _bytes(x.ravel(), np.arange(1, len(x) + 1) * width)
            yield pa.RecordBatch.from_arrays(
                [batch.column("lof_scope"), pa.array(cell), *[batch.column(c) for c in own], data], ["lof_scope", "cell", *own, "coordinates"]
            )

    placed = points.mapInArrow(place, "lof_scope string, cell int, lof_id long, h1 long, h2 long, k long, copies long, coordinates binary")

    def inside(given: pa.Table) -> pa.Table:
        given = given.append_column("bound", pa.array(np.full(given.num_rows, np.inf)))
        return _inside(given, trees.get(given["lof_scope"][0].as_py()), width)

    closed = stored(placed.groupBy("lof_scope", "cell").applyInArrow(inside, CLOSED), "lof_inside")
    keys = ["lof_scope", "h1", "h2", "copies"]
    done = closed.where("factor IS NOT NULL")
    opened = closed.where("factor IS NULL")
    factors = done.select(*keys, "factor")
    if opened.isEmpty():
        return factors

    def visit(batches):
        for batch in batches:
            x = _numbers(pa.chunked_array([batch.column("coordinates")]), "<f8")[0].reshape(-1, width)
            bound, home = batch.column("bound").to_numpy(), batch.column("home").to_numpy()
            for tree, rows in by_scope(batch):
                for at in range(0, len(rows) if tree else 0, VISITS):
                    some = rows[at : at + VISITS]
                    row, cell = tree.within(x[some], bound[some])
                    row = some[row]
                    row, cell = row[cell != home[row]], cell[cell != home[row]]
                    part = batch.select(["lof_scope", "home", "lof_id", "k", "coordinates", "bound"]).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32))], [*part.schema.names, "cell"])

    seen = "lof_scope string, home int, lof_id long, k long, coordinates binary, bound double, cell int"
    crossing = opened.where("crosses").select("lof_scope", "home", "lof_id", "k", "coordinates", "bound")
    visits = stored(crossing.mapInArrow(visit, seen), "lof_visits")
    # A share brings its cell's points along once more: it is as many visits as a cell has points.
    loads = visits.groupBy("lof_scope", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(BLOCK_POINTS))).alias("shares"))
    loads = stored(loads, "lof_loads")
    asked = visits.join(loads, ["lof_scope", "cell"]).withColumn("share", F.pmod(F.xxhash64("lof_id"), F.col("shares")))
    given = placed.join(loads, ["lof_scope", "cell"]).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
    shares = ["lof_scope", "cell", "share"]
    asked = asked.select(*shares, "home", "lof_id", "k", "coordinates", "bound")
    given = given.select(*shares, "lof_id", "copies", "coordinates")
    outside = asked.groupBy(*shares).cogroup(given.groupBy(*shares)).applyInArrow(lambda a, g: _found(a, g, "home", width), FOUND)
    columns = [c.split()[0] for c in LIST.split(", ")]
    lists = opened.select(*columns).unionByName(outside.select(*columns))
    settled = stored(lists.groupBy("lof_scope", "home").applyInArrow(_settled, SETTLED), "lof_lists")
    reach = settled.where("own").select("lof_scope", "home", "lof_id", F.col("reach").alias("value"))

    def density(reached, distance, used, k, total):
        return 1.0 / (total(used * np.maximum(distance, reached)) / k + 1e-10)

    dense = stored(_around(settled, reach, done.select("lof_id", F.col("reach").alias("value")), density, "value"), "lof_density")
    known = done.select("lof_id", F.col("density").alias("value"))
    mean = _around(settled, dense, known, lambda dense, _, used, k, total: total(used * dense) / k, "mean")
    late = dense.join(mean.select("lof_id", "mean"), "lof_id").select("lof_id", (F.col("mean") / F.col("value")).alias("factor"))
    return stored(factors.unionByName(opened.select("lof_id", *keys).join(late, "lof_id").select(*keys, "factor")), "lof_factors")


def _lof_of_large(points: DataFrame, names: list[str], cell_points: int) -> DataFrame:
    """lof_scores_of_block() over scopes of any size: (lof_scope, h1, h2, lof_score)."""
    factors = _lof_factors(points, names, cell_points)
    compared = -half_even(F.col("factor"), FACTOR_DIGITS)
    limit = exact_quantiles(factors, compared, {"limit": CONTAMINATION}, ["lof_scope"], F.col("copies"))
    ends = factors.groupBy("lof_scope").agg(F.min("factor").alias("least"), F.max("factor").alias("most"))
    scaled = (F.col("factor") - F.col("least")) / (F.col("most") - F.col("least") + 1e-9)
    score = F.when(compared < F.col("limit"), scaled).otherwise(scaled * DAMPING)
    ends = F.broadcast(stored(limit.join(ends, "lof_scope"), "lof_limits"))  # one row for each scope of more than block_points points
    return factors.join(ends, "lof_scope").select("lof_scope", "h1", "h2", score.alias("lof_score"))


def _scope_key(columns: list[str]) -> Column:
    return F.concat_ws("\x1f", F.lit(""), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def _number(column: str, digits: int | None) -> Column:
    """The column as a double, rounded half-even where digits are given; what is NULL or no number counts as 0."""
    value = F.col(column).cast("double")
    value = value if digits is None else half_even(value, digits)
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0)) + F.lit(0.0)


def _scores_of_rows(rows: pa.Table, inputs: list[tuple[str, int | None]], k: int) -> np.ndarray:
    """The score of each row of a scope; numbers as _number() gives them."""
    columns = []
    for name, digits in inputs:
        x = rows[name].to_numpy().astype(float)
        x = x if digits is None else np.rint(x * 10.0**digits) / 10.0**digits
        columns.append(np.where(np.isnan(x), 0.0, x) + 0.0)
    points = np.column_stack(columns)
    order = np.lexsort(points.T[::-1])
    new = np.r_[True, (points[order][1:] != points[order][:-1]).any(axis=1)]
    place = np.empty(len(points), np.int64)
    place[order] = np.cumsum(new) - 1
    return lof_scores_of_block(points[order][new], np.bincount(place), k)[place]


def lof_scores(
    df: DataFrame,
    columns: list[str],
    out: str = "KPI_Outlier",
    scope: str | list[str] | None = None,
    k: int = NEIGHBOURS,
    block_points: int = BLOCK_POINTS,
    digits: dict[str, int] | None = None,
    keep: list[str] | None = None,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Adds the outlier score over numeric columns; NULLs count as 0.

    Neighbours, scale and share flagged are those of the whole table (or of each value of the `scope` columns). Equal rows are one point with
    a number of copies. A scope of at most `block_points` rows is one task, which its rows pass once; a larger one is cut into cells, and a
    point meets the cells within its k-distance: the size changes no result. `digits` rounds columns half-even before they are compared.
    The result has the columns `keep` (default: all). `sizes` is a table with the scope columns of the same rows, where these can be
    had for less than `df`: scopes are then counted in it, and `df` need not be stored.
    """
    digits, keep = digits or {}, df.columns if keep is None else keep
    names = [f"lof_{i}" for i in range(len(columns))]
    key = _scope_key([] if scope is None else [scope] if isinstance(scope, str) else scope).alias("lof_scope")
    doubles = {c for c, kind in df.dtypes if kind == "double" and c in keep}
    own = {n: c for n, c in zip(names, columns) if c not in doubles}  # what the result carries anyway is not carried twice
    rows = df.select(*keep, key, *[F.col(c).cast("double").alias(n) for n, c in own.items()])
    inputs = [(n if n in own else c, digits.get(c)) for n, c in zip(names, columns)]
    if sizes is None:
        rows = stored(rows, "lof_rows")  # what comes before is computed once, not for counting and again for the result
    counts = (rows if sizes is None else sizes.select(key)).groupBy("lof_scope").agg(F.count(F.lit(1)).alias("n"))
    wide = stored(counts.where(F.col("n") > block_points).select("lof_scope"), "lof_wide")

    def score(group: pa.Table) -> pa.Table:
        return group.select(keep).append_column(out, pa.array(_scores_of_rows(group, inputs, k)))

    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField(out, T.DoubleType())])
    if wide.isEmpty():
        return rows.groupBy("lof_scope").applyInArrow(score, schema)
    rows = rows if sizes is None else stored(rows, "lof_rows")
    narrow = rows.join(wide, "lof_scope", "left_anti").groupBy("lof_scope").applyInArrow(score, schema)
    keyed = rows.join(wide, "lof_scope", "left_semi").withColumns({n: _number(*x) for n, x in zip(names, inputs)})
    return narrow.unionByName(_scores_of_wide(keyed, names, k, block_points, out).select(*keep, out))


def _scores_of_wide(keyed: DataFrame, names: list[str], k: int, block_points: int, out: str) -> DataFrame:
    """Rows of scopes with many rows, with their score: equal rows are counted, and scopes with many points cut into cells.

    Points are counted, ordered and numbered where one shuffle by ranges brought them. Scores return to rows by 128 bits of hash of the point,
    not by its coordinates: that two of 10^9 points share them has a probability below 10^-20.
    """
    key = {"h1": F.xxhash64(*names), "h2": F.xxhash64(F.lit(1), *names)}
    points = keyed.select("lof_scope", *names).repartitionByRange("lof_scope", *names)
    points = points.groupBy("lof_scope", *names).agg(F.count(F.lit(1)).alias("copies")).sortWithinPartitions("lof_scope", *names)
    points = stored(points.withColumns({"lof_id": F.monotonically_increasing_id(), **key}), "lof_points")
    sizes = points.groupBy("lof_scope").agg(F.count(F.lit(1)).alias("size"), F.sum("copies").alias("rows"))
    sized = points.join(F.broadcast(stored(sizes, "lof_sizes")), "lof_scope")  # one row for each scope of more than block_points rows

    def score_block(pdf: pd.DataFrame) -> pd.DataFrame:
        scores = lof_scores_of_block(pdf[names].to_numpy(float), pdf["copies"].to_numpy(), k)
        return pdf[["lof_scope", "h1", "h2"]].assign(lof_score=scores)

    few = sized.where(F.col("size") <= block_points)
    scored = few.groupBy("lof_scope").applyInPandas(score_block, "lof_scope string, h1 long, h2 long, lof_score double")
    large = sized.where(F.col("size") > block_points)
    if not large.isEmpty():
        large = large.withColumn("k", F.least(F.lit(k).cast("long"), F.col("rows") - 1)).drop("size", "rows")
        scored = scored.unionByName(_lof_of_large(large, names, block_points))
    keyed = keyed.withColumns(key).drop(*names)
    return keyed.join(scored, ["lof_scope", "h1", "h2"]).withColumnRenamed("lof_score", out)
