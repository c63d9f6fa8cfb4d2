"""Encoding, counting and packing against the libraries."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from portolan.llm import bpe, packing, token_counts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
PATTERN = public_tokenizers.PATTERN


def strange(n):
    draw = random.Random(4)
    pool = ["the", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "日本", "!", "$$$", "123", "'s", "'", "A", "aaaa", "😀", "²", "x" * 50, "▁", "<s>", "<|endoftext|>", "tion"]
    return ["".join(draw.choice(pool) for _ in range(draw.randint(0, 25))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("multi", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_bpe_gives_the_librarys_ids(library):
    c = bpe.codec(RANKS, PATTERN)
    for text in [*strange(3000), "a" * 5000, " " * 3000, "ab" * 3000]:
        assert np.frombuffer(c.encode(text), "<u4").tolist() == library.encode_ordinary(text), text[:80]


def test_bpe_cache_overflow_changes_nothing(library):
    c = bpe.Codec(bpe.load_ranks(RANKS), PATTERN)
    for cache in (c.pieces, c.chunks, c.fits):
        cache.limit = 3
    text = "many different words overflow all caches here, again and again: many words"
    assert np.frombuffer(c.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_bpe_query_and_round_trip(spark, docs, odd, library):
    df = docs(odd)
    got = sorted(bpe.digests(df, RANKS, PATTERN).collect(), key=str)
    want = []
    for i, t in odd:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    back = bpe.decode(bpe.encode(df, RANKS, PATTERN), RANKS, PATTERN).select("decoded").collect()
    assert sorted(bytes(r[0]) for r in back) == sorted((t or "").encode() for _, t in odd)
    assert bpe.digests(docs([]), RANKS, PATTERN).count() == 0


def test_counts_equal_the_librarys():
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    m = token_counts.model(PIECES)
    texts = [*strange(3000), "a" * 3000, " " * 500, "".join(random.Random(1).choice("abcdehinorst") for _ in range(3000))]
    assert m.count_all(texts) == [len(x) for x in sp.encode(texts)]
    assert m.count_all([]) == []


def test_counts_query(docs, odd):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = token_counts.token_counts(docs(odd), PIECES, limit=100).collect()
    want = [(i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 100) for i, t in odd]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert token_counts.token_counts(docs([]), PIECES).count() == 0


def test_packing_encoder_equals_the_library():
    library, own = Tokenizer.from_file(JSON), packing.encoder(JSON, PATTERN)
    for text in strange(2000):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def check_packing(rows, pairs, capacity):
    library = Tokenizer.from_file(JSON)
    want = []
    for i, t in pairs:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted(map(str, (tuple(r)[:5] for r in rows))) == sorted(map(str, want))
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(w[3] for w in want)
    return len(places), -(-total // capacity)


def test_packing(docs, odd, rows):
    for pairs, capacity in ((odd, 2048), (rows, 2048), (odd * 5, 7)):
        got = packing.pack(packing.pieces(docs(pairs), JSON, PATTERN, capacity), capacity).collect()
        used, least = check_packing(got, pairs, capacity)
        assert used <= least * 1.1 + 2
    assert packing.pack(packing.pieces(docs([]), JSON, PATTERN)).count() == 0


def test_plan_is_best_fit_over_documents():
    """The plan uses as many sequences as best-fit decreasing on single pieces."""
    draw = random.Random(3)
    for _ in range(60):
        lengths = [draw.randint(1, 40) for _ in range(draw.randint(1, 200))]
        bins: list[int] = []
        for n in sorted(lengths, reverse=True):
            fit = min((b for b in range(len(bins)) if bins[b] >= n), key=lambda b: bins[b], default=None)
            if fit is None:
                bins.append(40 - n)
            else:
                bins[fit] -= n
        counts = {n: lengths.count(n) for n in lengths}
        plan = packing.plan(counts, 40)
        used = {first + k for _, lo, hi, first, _ in plan for k in range(hi - lo)}
        assert len(used) == len(bins)
        for n, c in counts.items():
            assert sorted(r for length, lo, hi, _, _ in plan if length == n for r in range(lo, hi)) == list(range(c))


def test_caches_are_bounded_by_bytes():
    import sys

    from portolan.llm.bpe import Cache

    made = Cache(lambda key: key.encode() * 4, limit=1 << 16)
    for i in range(20000):
        made[f"word{i % 3000}" if i % 3 else "長" * (i % 200)]
        assert sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in made.items()) <= 1 << 16
    assert made["長" * 3000] == ("長" * 3000).encode() * 4
    assert all(len(k) <= 64 for k in made)


def test_long_texts_without_spaces_leave_nothing_behind(spark, docs):
    import public_tokenizers
    import tiktoken

    from portolan.llm import bpe, token_counts

    texts = ["長い文" * n for n in (10, 400, 3000)] + ["a1b2" * 5000]
    codec = bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    for t in texts:
        assert list(__import__("numpy").frombuffer(codec.encode(t), "<u4")) == library.encode_ordinary(t)
    assert max(map(len, codec.chunks)) <= 64
    model = token_counts.model(public_tokenizers.path("piece_bpe_32k.model"))
    model.count_all(texts)
    assert max(map(len, model.known)) <= token_counts.LONGEST
