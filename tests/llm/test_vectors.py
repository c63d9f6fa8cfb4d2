"""Vector codes and embedding links against plain numpy over all pairs and all rows."""

import hashlib
import math

import numpy as np
import pytest

from portolan.llm import embedding_links, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, row string, point long, code string, copies string, key string, cell int"


@pytest.fixture
def table(spark):
    def make(rows):
        return spark.createDataFrame([(i, v, lab, "r", 5, "c", "x", "k", 1) for i, v, lab in rows], SCHEMA)

    return make


def bad(v, dim=64):
    return v is None or len(v) != dim or any(x is None or not math.isfinite(x) for x in v)


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = sorted((r for r in rows if not bad(r[1])), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    x = np.array([[math.floor(256 * float(c)) for c in r[1]] for r in kept], np.int64).reshape(len(kept), parts, -1)
    books = x[:entries].copy()

    def assign():
        d = ((x[:, None] - books[None]) ** 2).sum(axis=3)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        own, _ = assign()
        for p in range(parts):
            for e in range(len(books)):
                members = x[own[:, p] == e, p]
                if len(members):
                    books[e, p] = members.sum(axis=0) // len(members)
    own, error = assign()
    sha = hashlib.sha256(",".join(str(v) for v in books.transpose(1, 0, 2).ravel()).encode()).hexdigest()
    labels = {}
    for r, e in zip(kept, error.sum(axis=1), strict=True):
        labels[r[2]] = labels.get(r[2], 0) + int(e)
    return sorted(
        ((r[0], bytes(o.astype(np.uint8)).hex(), int(e), labels[r[2]], sha) for r, o, e in zip(kept, own, error.sum(axis=1), strict=True)), key=str
    )


def brute_links(rows, threshold=0.95):
    ok = [i for i, r in enumerate(rows) if not bad(r[1]) and any(r[1])]
    x = np.array([rows[i][1] for i in ok], float).reshape(len(ok), 64)
    u = x / np.abs(x).max(axis=1, initial=1e-300)[:, None]
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = {i: {ok[k] for k in np.flatnonzero(u @ u[j] >= threshold)} - {i} for j, i in enumerate(ok)}
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for k in near.get(todo.pop(), ()):
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        component = min(ids, default=None)
        out.append((r[0], len(near.get(i, ())), component, r[0] == component))
    return sorted(out, key=str)


def drawn(n, seed, near=0.0):
    """Vectors of which some are close to an earlier one, at cosines on both sides of 0.95."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        v = rng.normal(size=64)
        if out and rng.random() < near:
            v = np.array(out[rng.integers(len(out))]) + rng.normal(size=64) * rng.choice([0.05, 0.3, 0.33, 0.36])
        out.append([float(np.float32(c)) for c in v])
    return [(i * 3 % 1009 if i % 50 else None, v, i % 4 or None) for i, v in enumerate(out)]


ODD = [
    (1, None, 1), (2, [], 1), (3, [0.0] * 64, 2), (4, [1.0] * 63, 2), (5, [1.0] * 63 + [None], None), (6, [1.0] * 63 + [float("nan")], None),
    (7, [1.0] * 63 + [float("-inf")], 3), (8, [1.0] * 64, 3), (8, [1.0] * 64, 3), (9, [2.0] * 64, None), (10, [-0.0] * 63 + [1.0], None),
    (11, [0.0] * 63 + [3.0], None), (None, [1.0] * 64, 7), (None, None, 7), (12, [1e-30] * 64, 1), (13, [3e5] * 64, 1), (14, [-1.0] * 64, 1),
]


@pytest.mark.parametrize("rows", [drawn(300, 1), drawn(20, 2), ODD, ODD + drawn(200, 4, 0.5)], ids=["plain", "few", "odd", "mixed"])
def test_codes(table, rows):
    got = vector_codes.compress(table(rows))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_codes(rows)


def test_more_rounds_and_other_sizes(table):
    rows = drawn(150, 6)
    books = vector_codes.fit_codebooks(table(rows), parts=8, entries=5, rounds=4)
    assert [b.shape for b in books] == [(5, 8)] * 8
    sha = brute_codes(rows, 8, 5, 4)[0][-1]
    assert vector_codes.books_digest(books) == sha


def test_members_that_keep_their_entry_do_not_move(spark, table, monkeypatch):
    """After the first round a packet passes the shuffle only with members that changed their entry."""
    moved = []
    plain = vector_codes.stored

    def watch(df, name):
        out = plain(df, name)
        if name.startswith("members"):
            text = df._jdf.queryExecution().simpleString()
            moved.append((text.count("hashpartitioning"), "Union" in text, sum(r["n"] for r in out.collect())))
        return out

    monkeypatch.setattr(vector_codes, "stored", watch)
    vector_codes.fit_codebooks(table(drawn(200, 7)), rounds=2)
    assert [m[2] for m in moved] == [200 * 16, 200 * 16]
    assert not moved[0][1] and moved[1][1]


def test_saturated_components(table):
    rows = [(i, [s * 1e30] * 64, None) for i, s in enumerate((1.0, -1.0, 2.0))]
    got = vector_codes.compress(table(rows)).collect()
    assert len(got) == 3 and all(r["error"] == 0 for r in got)


def test_empty_tables(table):
    assert vector_codes.compress(table([])).count() == 0
    assert vector_codes.compress(table([(1, None, 1)])).count() == 0
    assert embedding_links.near_duplicates(table([])).count() == 0
    assert [tuple(r) for r in embedding_links.near_duplicates(table([(1, None, 1)])).collect()] == [(1, 0, 1, True)]


@pytest.mark.parametrize("rows", [drawn(600, 11, 0.6), ODD + drawn(150, 12, 0.5), [(i, [1.0, *[0.1] * 63], 1) for i in range(40)]], ids=["near", "odd", "copies"])
@pytest.mark.parametrize("cell, unit", [(1 << 13, 1 << 14), (32, 16)], ids=["one cell", "many cells and units"])
def test_links(table, monkeypatch, rows, cell, unit):
    monkeypatch.setattr(embedding_links, "CELL", cell)
    monkeypatch.setattr(embedding_links, "UNIT", unit)
    monkeypatch.setattr(embedding_links, "LEAST", 1)
    got = embedding_links.near_duplicates(table(rows))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_links(rows)


@pytest.mark.parametrize("threshold", [0.5, 0.999, 1.0])
def test_other_thresholds(table, threshold):
    rows = drawn(150, 15, 0.7) + [(2000, [0.5] * 64, 1), (2001, [0.5] * 64, 1)]
    got = {r["vec_id"]: r["n_links"] for r in embedding_links.near_duplicates(table(rows), threshold).collect() if r["vec_id"] is not None}
    want = {r[0]: r[1] for r in brute_links(rows, threshold) if r[0] is not None}
    if threshold < 1.0:
        assert got == want
    else:  # a cosine of two copies may round to just below 1; copies are linked as equal
        assert got[2000] == got[2001] == 1


def test_forest_joins_all_that_pairs_join():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 50, 80), rng.integers(0, 50, 80)
    label = np.arange(50)
    picked = embedding_links.grow(label, x, y)
    assert (label[x] == label[y]).all()
    assert len(picked) == 50 - len(np.unique(label))


def test_cells_in_reach_are_all_found():
    rng = np.random.default_rng(3)
    codes = rng.integers(-300, 300, (400, 4)).astype(np.int16)
    tree = embedding_links.Cells(codes, 5)
    home = tree.home(codes)
    row, cell = tree.within(codes, 120**2)
    reached = set(zip(row.tolist(), cell.tolist(), strict=True))
    assert len(reached) == len(row)
    apart = ((codes[:, None].astype(int) - codes[None].astype(int)) ** 2).sum(axis=2)
    for i, j in zip(*np.nonzero(apart <= 120**2), strict=True):
        assert (i, home[j]) in reached
    assert all(embedding_links.visits(np.array([a]), np.array([b]))[0] != embedding_links.visits(np.array([b]), np.array([a]))[0] for a in range(8) for b in range(a))
