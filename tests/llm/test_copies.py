"""Exact copies, passages and near copies against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from portolan.llm import exact_dedup, jaccard_join, substring_dedup
from portolan.llm.components import components
from portolan.llm.hashing import Words, sliding
from portolan.llm.sketch import Counter as Cells
from portolan.llm.sketch import Repeats

GAPS = str.maketrans("", "", " \t\n\x0b\x0c\r")


def as_text(rows):
    return sorted(str(tuple(r)) for r in rows)


def test_exact_copies(docs, odd, rows):
    pairs = [*odd, *rows, (900, "o n e "), (901, "one "), (-3, "o n e ")]
    groups = defaultdict(list)
    for n, (i, t) in enumerate(pairs):
        groups[hashlib.sha256((t or "").translate(GAPS).encode()).hexdigest()].append((-len(t or ""), i is None, i or 0, n))
    want = []
    for sha, own in groups.items():
        best = min(own)
        want += [(pairs[o[3]][0], pairs[best[3]][0], len(own), o == best, sha) for o in own]
    df = docs(pairs)
    assert as_text(exact_dedup.group_copies(df).collect()) == as_text(want)
    # A filter that is full sends every row through the shuffle, with the same result.
    assert as_text(exact_dedup.group_copies(df, bits=19).collect()) == as_text(want)
    stay = exact_dedup.dedup_rows(df)
    assert stay.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in stay.collect()) == sorted(str(w[0]) for w in want if w[3])
    assert exact_dedup.group_copies(docs([])).count() == 0 and exact_dedup.dedup_rows(docs([])).count() == 0


def test_sketch_misses_no_repeat():
    draw = np.random.default_rng(1)
    values = draw.integers(0, 1 << 63, 5000, dtype=np.uint64)
    values[100:200] = values[300:400]
    for own_rows in (True, False):
        cells = Cells(19, 3, own_rows)
        cells.add(values[:250])
        cells.add(values[250:])
        may = Repeats(cells.again.tobytes(), 19, 3, own_rows).may(values)
        assert may[100:200].all() and may[300:400].all()
        assert may.mean() < 0.2


def test_words_and_runs():
    texts = ["a b\x0bc", "", "  ", "b c a b", "x" * 1000 + " b", "a\x1cb \xa0"]
    words = Words(pa.array(texts))
    flat = [w for t in texts for w in t.encode().split()]
    assert words.count.tolist() == [len(t.encode().split()) for t in texts]
    by = defaultdict(set)
    for w, h in zip(flat, words.hash.tolist(), strict=True):
        by[w].add(h)
    assert all(len(s) == 1 for s in by.values()) and len(set.union(*by.values())) == len(by)
    runs = words.runs(2)
    assert runs[1] == runs[3]  # "b c" in both texts
    assert sliding(np.arange(10), 4).tolist() == list(range(7))


def repeated(pairs, width):
    texts = [(t or "").encode().split() for _, t in pairs]
    seen = Counter(tuple(w[k : k + width]) for w in texts for k in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(pairs, texts, strict=True):
        gone = set()
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone.update(range(k, k + width))
        kept = b" ".join(x for n, x in enumerate(w) if n not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_passages(docs, odd, rows):
    draw = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    passage = " ".join(draw.choice(words) for _ in range(60))
    made = [(1000 + k, " ".join(draw.choice(words) for _ in range(draw.randint(0, 80))) + " " + passage + " tail") for k in range(40)]
    made += [(2000, " ".join(["again and"] * 40)), (2001, passage + " " + passage), (2002, " ".join(passage.split()[:35])), (2003, " ".join(passage.split()[:34]))]
    pairs = [*odd, *rows, *made]
    assert as_text(substring_dedup.remove_repeats(docs(pairs)).collect()) == as_text(repeated(pairs, 35))
    small = substring_dedup.remove_repeats(docs(pairs), width=9, gram=4, bits=19, full=True)
    assert as_text(small.drop("kept_text").collect()) == as_text(repeated(pairs, 9))
    assert substring_dedup.remove_repeats(docs([])).count() == 0


def shingles(text):
    w = (text or "").encode().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(pairs):
    sets = [shingles(t) for _, t in pairs]
    n = len(pairs)
    near = [[] for _ in range(n)]
    for a in range(n):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                near[a].append(b), near[b].append(a)
    root = list(range(n))
    for a in range(n):  # depth first
        if root[a] == a:
            todo, seen = [a], {a}
            while todo:
                for y in near[todo.pop()]:
                    if y not in seen:
                        seen.add(y), todo.append(y)
            for y in seen:
                root[y] = a
    members = defaultdict(list)
    for a in range(n):
        members[root[a]].append(a)
    out = []
    for a, (i, _) in enumerate(pairs):
        ids = [pairs[x][0] for x in members[root[a]] if pairs[x][0] is not None]
        out.append((i, (min(ids) if ids else None) if sets[a] else i, len(members[root[a]]), len(near[a])))
    return out


def variants(n, edits):
    draw = random.Random(n)
    words = [f"v{k}" for k in range(2000)]
    base = [draw.choice(words) for _ in range(150)]
    out = []
    for k in range(n):
        own = list(base)
        for _ in range(draw.randint(0, edits)):
            own[draw.randrange(len(own))] = draw.choice(words)
        out.append((5000 + k, " ".join(own)))
    return out


def test_near_copies(docs, odd, rows):
    pairs = [*odd, *rows[:150], *variants(120, 6), (7000, variants(1, 0)[0][1])]
    df = docs(pairs)
    assert as_text(jaccard_join.near_duplicates(df).collect()) == as_text(brute(pairs))
    assert jaccard_join.near_duplicates(docs([])).count() == 0


def test_blocks_of_a_large_group_change_nothing(docs, monkeypatch):
    pairs = variants(90, 8)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    assert as_text(jaccard_join.near_duplicates(docs(pairs)).collect()) == as_text(brute(pairs))


def test_one_of_each_class_stays(docs, odd):
    pairs = [*odd, *variants(40, 5)]
    df = docs(pairs)
    stay = jaccard_join.keep_one(df)
    assert stay.columns == df.columns
    want = defaultdict(set)
    for (i, t), row in zip(pairs, brute(pairs), strict=True):
        if shingles(t):
            want[row[1] if row[1] is not None else t].add(i)
    empty = sum(not shingles(t) for _, t in pairs)
    assert stay.count() == len(want) + empty
    assert sorted(str(min(x for x in ids)) for k, ids in want.items() if None not in ids) == sorted(str(r[0]) for r in stay.collect() if r[0] is not None and shingles(r[1]))
    assert jaccard_join.keep_one(docs([])).count() == 0


def test_pruning_keeps_likely_pairs():
    need = jaccard_join.least_matches(0.8, 1e-8, 32, 288)
    assert need[32] < 32 * 0.8 and all(need[n] < 0.8 * n for n in need)
    assert need[288] > 0.6 * 288


@pytest.mark.parametrize("kind", ["path", "star", "sparse", "loops", "none"])
def test_components(spark, kind):
    draw = random.Random(5)
    edges = {
        "path": [(i, i + 1) for i in range(60)],
        "star": [(0, i) for i in range(1, 90)] + [(5, 0)],
        "sparse": [(draw.randrange(150), draw.randrange(150)) for _ in range(90)],
        "loops": [(1, 1), (2, 3), (3, 2), (2, 3)],
        "none": [],
    }[kind]
    parent = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in parent:
        for a, b in edges:
            if a in parent and b in parent:
                parent[a] = parent[b] = min(parent[a], parent[b])
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(r["node"] for r in found) == sorted(parent)
    roots = {r["node"]: r["root"] for r in found}
    groups = {}
    for node, least in parent.items():
        groups.setdefault(least, set()).add(roots[node])
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)
