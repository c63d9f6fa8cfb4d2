"""Periodic runs against every period of every text, and the planted runs against their rule."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from portolan.llm import periodic_runs
from portolan.llm.hashing import Words


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def all_runs(v, shortest=1):
    found = {}
    for q in range(1, len(v) // 2 + 1):
        i = 0
        while i < len(v) - q:
            j = i
            while j < len(v) - q and v[j] == v[j + q]:
                j += 1
            if j - i >= q and j - i + q >= shortest:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    w = words_of(text)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    w = planted(doc_id, text)
    runs = all_runs(w, 12)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2],
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def test_runs_of_short_sequences():
    draw = random.Random(3)
    for _ in range(600):
        n, k = draw.randint(1, 50), draw.randint(1, 4)
        v = [draw.randint(1, k) for _ in range(n)]
        if draw.random() < 0.4:
            p = draw.randint(1, n)
            v = [v[i % p] for i in range(n)]
        assert [tuple(r) for r in periodic_runs.runs_of(v).tolist()] == all_runs(v)


def test_extensions_are_longest_common_prefixes():
    v = [1, 2, 1, 2, 3, 1, 2, 1, 2, 1]
    tree = periodic_runs.SuffixTree(v)
    a, b = np.array([(i, j) for i in range(10) for j in range(10) if i != j]).T
    want = [next((k for k in range(11) if max(i, j) + k >= 10 or v[i + k] != v[j + k])) for i, j in zip(a, b, strict=True)]
    assert tree.extensions()(a, b).tolist() == want
    assert tree.ranks()[:10].tolist() == [1 + sorted(v[i:] for i in range(10)).index(v[i:]) for i in range(10)]


def test_every_run_lies_in_a_stretch():
    draw = random.Random(5)
    texts = []
    for _ in range(300):
        w = [draw.choice("abcdefgh") for _ in range(draw.randint(0, 90))]
        p = draw.randint(1, 20)
        texts.append(" ".join(w + [w[i % p] for i in range(60)] if len(w) > p else w))
    found = periodic_runs.stretches(Words(pa.array(texts, pa.binary())))
    first = Words(pa.array(texts, pa.binary())).first
    for doc, text in enumerate(texts):
        for s, n, _ in all_runs(text.split(), 12):
            assert any(d == doc and b - first[d] <= s and s + n <= e - first[d] for d, b, e in found)


def test_long_period_and_one_word_end_in_time():
    started = time.time()
    assert periodic_runs.runs_of([1] * 60000).tolist() == [[0, 60000, 1]]
    v = [i % 20000 + 1 for i in range(60000)]
    assert periodic_runs.runs_of(v).tolist() == [[0, 60000, 20000]]
    assert time.time() - started < 60


def test_query_against_brute_force(spark, small, rows):
    from portolan.llm import queries

    got = sorted(tuple(r) for r in queries.op11_periodic_runs(spark, small).collect())
    # Every period of a text is tried here, so texts of the fixture over 4,000 words are left to the SQL twin.
    short = {i for i, t in rows if len(words_of(t)) <= 4000}
    assert len(short) >= 190
    assert [r for r in got if r[0] in short] == sorted(expected(i, t) for i, t in rows if i in short)
    assert sum(r[1] for r in got) > 20


def test_cases(spark, docs, odd):
    # The text of the same word 20,000 times long, equal texts, null ids and null texts.
    given = [*odd, (9, "a b c " * 5), (10, "x y"), (11, "p q r s t u v w x y z a b"), (12, " ".join(["é", "ö"] * 8))]
    out = periodic_runs.digests(periodic_runs.find_runs(periodic_runs.with_planted_runs(docs(given))))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted((expected(i, t) for i, t in given), key=key)
    assert periodic_runs.digests(periodic_runs.find_runs(docs([]))).count() == 0


@pytest.mark.parametrize("text, left", [("a b c a b c a b c a b c", "a b c"), ("a b a b a b a b a b", "a b a b a b a b a b"), ("z " + "q " * 12 + "r", "z q r")])
def test_collapsed(spark, docs, text, left):
    assert periodic_runs.find_runs(docs([(1, text)])).first()["collapsed"] == left
