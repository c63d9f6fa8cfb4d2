"""Personal data, secrets, quality rules and chat against plain definitions."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from portolan.llm import chat, pii, quality_rules, secret_scan

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0


def base_pii(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m.group())) <= 15]


def strange_texts(n, pool):
    draw = random.Random(6)
    return ["".join(draw.choice(pool) for _ in range(draw.randint(0, 30))) for _ in range(n)]


def test_pii_rules():
    pool = ["a", "b.c", "@", "x.com", ".", "-", " ", "+1", "(555)", "4111111111111111", "41 11-", "1", "255", "256", "10.0.0.1", "\n", "é", "%", "12345678", ".."]
    for text in strange_texts(5000, pool):
        assert pii.base_spans(text) == base_pii(text), text


def test_pii_rules_are_linear():
    for text in ("a" * 200000 + "@", "1" * 200000, "a@" * 50000, "1." * 50000, "+1" * 50000, "@" * 100000):
        pii.mentions(text, pii.base_spans(text))


def test_pii_query(docs, odd, rows):
    pairs = [*odd, *rows, (50, "write to a.b@c.de or +49 (30) 555-0199 now")]
    got = {str(r["doc_id"]) + r["base"]: r for r in pii.find_pii(docs(pairs)).collect()}
    for i, t in pairs:
        spans = base_pii(t or "")
        row = got[str(i) + ",".join(f"{k}:{a}:{b}" for k, a, b in spans)]
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
        assert set(row["base"].split(",")) <= set(row["spans"].split(","))
    assert pii.find_pii(docs([])).count() == 0


def test_pii_context_reveals_unseen_identifiers(docs):
    draw = random.Random(1)
    number = lambda: "+1 555 " + "".join(draw.choice("0123456789") for _ in range(7))
    pairs = [(k, f"words here. call me at {number()} today please") for k in range(30)]
    pairs += [(100, "some text. call me at 0155-5012-99 today please"), (101, "pages 0155-5012-98 of it")]
    rows = {r["doc_id"]: r for r in pii.find_pii(docs(pairs)).collect()}
    at = pairs[30][1].index("0155")
    assert rows[100]["spans"] == f"phone:{at}:{at + 12}" and rows[100]["n_added"] == 1
    assert rows[101]["spans"] == ""


def test_pii_grouped_numbers_and_long_chains(docs):
    seed = lambda k: f"+1 555 {1000000 + k}"
    pairs = [(k, f"words here. call me at {seed(k)} today please") for k in range(60)]
    unseen = ["030 1234 5678", "(030) 12-34-56", "1234 5678 9012 3456", "0" * 70]
    pairs += [(100 + k, f"so then. call me at {x} today please") for k, x in enumerate(unseen)]
    got = {r["doc_id"]: r for r in pii.find_pii(docs(pairs)).collect()}
    for k, x in enumerate(unseen):
        at = pairs[60 + k][1].index(x)
        assert f"phone:{at}:{at + len(x)}" in got[100 + k]["spans"].split(","), x
    for text in ("1 " * 100000 + "1x", "AB12 " * 40000 + "x", "AB12 CDEF" * 20000, "(1)" * 70000, "1" * 200000 + "x"):
        pii.mentions(text, [])
    iban = "send to DE89 3704 0044 0532 0130 00 now"
    assert "de89 3704 0044 0532 0130 00" in [m["name"] for m in pii.mentions(iban, [])]
    # Each context teaches the numbers of the next: the last takes four rounds of patterns.
    sizes = [5300, 800, 120, 16, 1]
    name = lambda level, k: seed(k) if level == 0 else f"{level}{k:07d}"
    texts = [f"we l{c}a l{c}b {name(level, k)} l{c}c end" for level, n in enumerate(sizes) for k in range(n) for c in (level - 1, level) if c >= 0]
    last = {r["doc_id"]: r for r in pii.find_pii(docs(list(enumerate(texts)))).where("n_added > 0").collect()}
    assert texts.index(f"we l3a l3b {name(4, 0)} l3c end") in last


ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_secrets(text):
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(1)) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    return out + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]


def test_secret_rules():
    pool = ["token", "Password", "API_KEY", "apikey", "=", ":", " ", '"', "'", "abc", "AKIA", "ABCDEF0123456789", "deadbeef", "0123456789abcdef", "\n", "é", "secretſ", "toKen", "x/y+z="]
    for text in strange_texts(5000, pool):
        assert secret_scan.base_spans(text) == base_secrets(text), text


def test_randomness_tells_keys_from_words():
    draw = random.Random(2)
    keys = ["".join(draw.choice(a) for _ in range(48)) for a in secret_scan.ALPHABETS for _ in range(50)]
    words = ["thisisaperfectlyordinarysentencewithoutspacesinside"[:48], "a" * 48, "ab" * 24, "0123456789abcdef" * 3]
    assert (secret_scan.randomness(keys) > 0.001).mean() > 0.95
    assert (secret_scan.randomness(words) < 0.001).all()


def test_secrets_query_and_redaction(docs, odd, rows):
    draw = random.Random(5)
    key = "".join(draw.choice(secret_scan.ALPHABETS[6]) for _ in range(90))
    pairs = [*odd, *rows, (60, f"use {key} for it"), (61, 'token = "0123456789abcdefABCD" and more')]
    got = secret_scan.find_secrets(docs(pairs)).collect()
    by = {str(r["doc_id"]) + r["base"]: r for r in got}
    for i, t in pairs:
        spans = sorted(base_secrets(t or ""), key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))
        row = by[str(i) + ",".join(f"{k}:{a}:{b}" for k, a, b in spans)]
        assert (row["n_assign"], row["n_access"], row["n_hex"]) == tuple(sum(s[0] == k for s in spans) for k in secret_scan.KINDS)
        assert set(row["base"].split(",")) <= set(row["spans"].split(","))
    assert next(r for r in got if r["doc_id"] == 60)["spans"] == f"random:4:{4 + len(key)}"
    df = docs(pairs)
    clean = secret_scan.redact(df, length_col="n_chars")
    assert clean.columns == df.columns and clean.count() == len(pairs)
    texts = {r["doc_id"]: r for r in clean.where("doc_id >= 60").collect()}
    assert texts[60]["text"] == "use [secret] for it" and texts[60]["n_chars"] == len("use [secret] for it")
    assert texts[61]["text"] == '[secret]" and more'
    assert clean.where("doc_id = 1").first()["text"] is None
    assert secret_scan.find_secrets(docs([])).count() == 0 and secret_scan.redact(docs([])).count() == 0


def test_decoys_of_short_texts_and_templates(docs):
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("aeiounrst") for _ in range(draw.randint(3, 8)))
    key = lambda n: "".join(draw.choice(secret_scan.ALPHABETS[6]) for _ in range(n))
    # Texts of some 30 letters: none fills a band of 96 by itself.
    long = key(110)
    pairs = [(k, " ".join(word() for _ in range(6))) for k in range(1500)] + [(9000, f"so {long} it is")]
    got = {r["doc_id"]: r for r in secret_scan.find_secrets(docs(pairs)).collect()}
    assert got[9000]["spans"] == f"random:3:{3 + len(long)}"
    # A tenth of the texts share an opening of letters that look drawn at random.
    hot = " ".join(key(15).translate({43: "x", 47: "y"} | {48 + d: "qwertzuiop"[d] for d in range(10)}) for _ in range(40))
    many = [(k, " ".join(word() for _ in range(120))) for k in range(900)] + [(2000 + k, f"{hot} " + " ".join(word() for _ in range(900))) for k in range(100)]
    many += [(9000 + k, f"so {key(100)} it is") for k in range(20)]
    got = {r["doc_id"]: r for r in secret_scan.find_secrets(docs(many)).collect()}
    assert sum(got[9000 + k]["n_added"] for k in range(20)) >= 18
    found = secret_scan.decoys(" ".join(word() for _ in range(40)))
    assert [len(x) for x in found] == list(secret_scan.BANDS)


def plain_counts(text):
    w = re.findall("[^\x20\x09-\x0d]+", text)
    triples = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    covered = {k + j for k, t in enumerate(triples) if triples.count(t) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:k] for k, x in enumerate(lines)), len(covered))


def test_quality_counts(rows):
    texts = [t for _, t in rows if len(t) < 3000] + ["", " \n ", "a b c a b c a", "x\n\nx\n x\nx", "# a | b\x1c"]
    for text in texts:
        assert quality_rules.counts_of(text)[:5] == plain_counts(text)


def test_quality_learns_and_keeps(spark, docs, odd):
    draw = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    good = [(200 + k, " ".join(draw.choice(words) for _ in range(80))) for k in range(200)]
    bad = [(1000 + k, " ".join(draw.choice(words) + "###" for _ in range(80))) for k in range(100)]
    df = docs([*odd, *good, *bad])
    labels = spark.createDataFrame([(i, 1) for i, _ in good[:120]] + [(i, 0) for i, _ in bad[:60]] + [(3, None), (None, 0), (99999, 0)], "doc_id long, quality int")
    judged = {r["doc_id"]: r["kept"] for r in quality_rules.judge(df, labels).collect()}
    assert all(judged[i] for i, _ in good) and not any(judged[i] for i, _ in bad) and not judged[1]
    kept = quality_rules.keep_rows(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(judged.values())
    assert quality_rules.judge(df, labels.limit(0)).where("kept").count() == 300
    assert quality_rules.judge(docs([]), labels).count() == 0


def test_quality_on_held_out_labels(spark, given, small):
    folder = small.replace("0.001", "0.1")
    df, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = quality_rules.judge(df, train).join(test, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.avg(F.col("base_failed").cast("int")).alias("base")).collect()
    kept = {r["quality"]: r for r in got}
    assert kept[1]["kept"] + kept[1]["base"] > 0.97 and kept[0]["kept"] < 0.35


TURNS = [
    (1, 0, "system", "be <kind> [INST] </s>"), (1, 1, "user", "hi \\b \\l"), (1, 2, "assistant", "yes\\"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "bye"),
    (2, 0, "user", "only"), (3, 0, "assistant", "<s>[user]x</s>"), (None, 0, "we]ird[", "r"), (4, None, None, None), (5, 1, "assistant", "b"), (5, 1, "assistant", "a"),
]


def test_chat(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS parts", "1 AS t")
    made = chat.examples(df)
    got = {r["conv_id"]: r for r in chat.digests(made).collect()}
    groups = {}
    for c, n, role, text in TURNS:
        groups.setdefault(c, []).append((n is not None, n or 0, role or "", text or ""))
    assert set(got) == set(groups)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        row = got[c]
        assert (row["n_turns"], row["turns_sha256"]) == (len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)))
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), sha(loss))
    assert made.where("conv_id = 1").count() == 3 and made.where("conv_id = 1 AND loss_start IS NOT NULL").count() == 2
    for r in made.where("loss_start IS NOT NULL").collect():
        body = r["formatted"][r["loss_start"] : r["loss_start"] + r["loss_length"]]
        assert r["formatted"].endswith(body + "</s>")
    assert chat.digests(chat.examples(df.limit(0))).count() == 0


def test_chat_plan_has_no_python(spark, small):
    df = spark.read.parquet(f"{small}/conversations.parquet")
    plan = chat.digests(chat.examples(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("texts", [[], [""], ["abc"]])
def test_randomness_of_short_lists(texts):
    assert len(secret_scan.randomness([t for t in texts if len(t) > 1])) == sum(len(t) > 1 for t in texts)
    assert np.all(np.array(secret_scan.decoys("")) == np.array([]))


def test_many_spans_in_one_text_take_linear_time():
    import time

    line = "0123456789abcdef0123456789abcdef01234567 Zm9vYmFyYmF6cXV4Zm9vYmFyYmF6cXV4\n"
    spans = secret_scan.base_spans(line * 40000)
    started = time.time()
    free = secret_scan.free_candidates(line * 40000, spans)
    assert len(spans) == len(free) == 40000
    assert time.time() - started < 5


def test_free_candidates_touch_no_span():
    text = "x" * 25 + " " + "y" * 30 + " " + "z" * 20
    for spans in ([], [("hex", 0, 3)], [("hex", 20, 26), ("assign", 2, 60)], [("hex", 25, 26)], [("hex", 0, 90), ("hex", 3, 4)]):
        want = [m.span() for m in secret_scan.CANDIDATE.finditer(text) if not any(a < m.end() and b > m.start() for _, a, b in spans)]
        assert [m.span() for m in secret_scan.free_candidates(text, spans)] == want
