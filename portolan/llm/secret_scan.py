"""Secrets by fixed rules and a battery of randomness tests (operator 8).

The rules find assignments to password-like names, access keys and long hexadecimal strings; their spans always stay.
Every other run of 20 or more characters of the alphabets of encodings is a candidate. Its encoding is inferred (the
smallest of hex, base 32, base 36, base 62, base 64 that holds it), its characters become digits of that alphabet, and three
tests ask if they look drawn at random: chi-squared uniformity, the number of runs above and below the middle, and
the correlation of neighbours. Fisher's method makes one figure of the three, near 0 for what is not random.

Short strings can pass by luck. So the same figure is taken of decoys: ordinary words from all over each document, strung
together to the lengths of the candidates, each length by itself. Documents with too few words for a length lend theirs to
decoys strung together from several documents. Equal decoys count once, so that copies and templates weigh as one text. Within each band of length a candidate's p-value is the share of decoys that look
as random as it does. Benjamini and Hochberg's procedure per band keeps the expected share of false finds below `RATE`.
Counts of figures on a fixed grid for each band are all that is gathered.

Cases: null text is empty; texts of any length are read whole and in linear time; equal rows give equal results;
without decoys in a band (fewer Latin letters in all texts than one decoy has) nothing is added there. An empty table gives an empty result. Only the id and the text are read
by `find_secrets`; `redact` returns all columns.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portolan.llm.support import arrow_type, map_slices, packed, stored, texts

KINDS = ("assign", "access", "hex")
ADDED = "random"
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
NAMES = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")
LEAST = 20
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+")
WORD = re.compile(r"[A-Za-z]+")
#: Lengths of the bands: from each figure up to the next.
BANDS = (20, 24, 28, 32, 40, 48, 64, 96)
#: Texts with too few words are joined to about so many times the letters of the longest band.
JOINT = 4
RATE, GRID, LOWEST = 0.05, 60, 12.0
ALPHABETS = (
    "0123456789abcdef",
    "0123456789ABCDEF",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "0123456789abcdefghijklmnopqrstuvwxyz",
    "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
)


def _tables() -> np.ndarray:
    out = np.full((len(ALPHABETS), 128), -1, np.int64)
    for i, alphabet in enumerate(ALPHABETS):
        out[i, [ord(c) for c in alphabet]] = np.arange(len(alphabet))
    return out


TABLES, SIZES = _tables(), np.array([len(a) for a in ALPHABETS])
_erfc = np.frompyfunc(math.erfc, 1, 1)


def upper(z: np.ndarray) -> np.ndarray:
    """Probability of a normal value above z."""
    return 0.5 * _erfc(z / math.sqrt(2)).astype(float)


def randomness(strings: list[str]) -> np.ndarray:
    """One p-value for each string (of at least two characters): how well it agrees with random digits of its alphabet."""
    if not strings:
        return np.zeros(0)
    n = np.array([len(s) for s in strings], np.int64)
    first = np.cumsum(n) - n
    codes = np.frombuffer("".join(strings).encode("ascii"), np.uint8)
    fits = np.minimum.reduceat(TABLES[:, codes], first, axis=1) >= 0
    which = np.argmax(fits, axis=0)  # alphabets come by size; the first that fits is the smallest
    k = SIZES[which].astype(float)
    owner = np.repeat(np.arange(len(n)), n)
    digit = TABLES[which[owner], codes]
    counts = np.bincount(owner * 66 + digit, minlength=66 * len(n)).reshape(len(n), 66)
    # Uniformity: chi-squared by the normal approximation of its cube root.
    chi = (counts.astype(float) ** 2).sum(axis=1) * k / n - n
    free = k - 1
    uniform = upper((np.cbrt(chi / free) - (1 - 2 / (9 * free))) / np.sqrt(2 / (9 * free)))
    # Runs above and below the middle of the alphabet.
    high = digit >= (k / 2)[owner]
    change = np.zeros(len(codes), np.int64)
    change[1:] = (high[1:] != high[:-1]) & (owner[1:] == owner[:-1])
    runs = np.add.reduceat(change, first) + 1
    a = np.add.reduceat(high.astype(float), first)
    b = n - a
    mean = 2 * a * b / n + 1
    var = np.maximum((mean - 1) * (mean - 2) / np.maximum(n - 1, 1), 1e-9)
    by_runs = np.where((a == 0) | (b == 0), 1e-12, 2 * upper(np.abs(runs - mean) / np.sqrt(var)))
    # Correlation of each digit with the next one.
    centred = digit - (np.add.reduceat(digit.astype(float), first) / n)[owner]
    product = np.zeros(len(codes))
    product[1:] = np.where(owner[1:] == owner[:-1], centred[1:] * centred[:-1], 0)
    square = np.add.reduceat(centred**2, first)
    r = np.add.reduceat(product, first) / np.maximum(square, 1e-9)
    serial = np.where(square < 1e-9, 1e-12, 2 * upper(np.abs(r + 1 / n) * np.sqrt(n)))
    # Fisher: -2 sum(log p) is chi-squared with six degrees of freedom.
    half = -np.log(np.clip(np.stack([uniform, by_runs, serial]), 1e-12, 1)).sum(axis=0)
    return np.exp(-half) * (1 + half + half**2 / 2)


def level(p: np.ndarray) -> np.ndarray:
    """Place of p on the grid of its logarithm: 0 is least random, GRID looks like chance."""
    return np.round(np.clip(1 + np.log10(np.maximum(p, 1e-300)) / LOWEST, 0, 1) * GRID).astype(np.int64)


def band(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(BANDS, n, side="right") - 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    low = text.lower()
    if any(k in low for k in NAMES):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def free_candidates(text: str, spans: list[tuple[str, int, int]]) -> list[re.Match]:
    """Candidates that no span touches: one sweep over both."""
    out, upto, at = [], 0, 0
    taken = sorted((a, b) for _, a, b in spans)
    for m in CANDIDATE.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            upto = max(upto, taken[at][1])
            at += 1
        if upto <= m.start():
            out.append(m)
    return out


def ordinary(text: str) -> list[str]:
    return [w for w in WORD.findall(text) if len(w) < LEAST]


def decoys(text: str) -> list[str]:
    """One string for each band, of ordinary words from all over a text; texts with too few words give fewer.

    Each band starts at a word that depends on the text and goes on by steps that visit every word once.
    """
    words = ordinary(text)
    n, out = len(words), []
    seed = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    step = max(1, int(n * 0.618))
    while math.gcd(step, n) > 1:
        step += 1
    for size in BANDS:
        got, length = [], 0
        at = (seed * size >> 7) % n if n else 0
        while length < size and len(got) < n:
            got.append(words[at])
            length += len(words[at])
            at = (at + step) % n
        if length < size:
            return out
        out.append("".join(got)[:size])
    return out


CANDIDATES = "array<struct<start:int,end:int,band:int,level:int>>"
DECOYS = "array<struct<place:int,id:long>>"
FIELDS = f"base array<struct<kind:string,start:int,end:int>>, candidates {CANDIDATES}, decoys {DECOYS}, words string"


def placed(fakes: list[str]) -> list[dict]:
    """Place and id of each decoy; equal decoys have equal ids."""
    places = band(np.array([len(s) for s in fakes], np.int64)) * (GRID + 1) + level(randomness(fakes))
    ids = [int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "little", signed=True) for s in fakes]
    return [{"place": p, "id": i} for p, i in zip(places.tolist(), ids, strict=True)]


def read(t: DataFrame) -> DataFrame:
    """Base spans, candidates, decoys (place: band * (GRID + 1) + level) and words too few for decoys of each text, in place of it."""
    fields = T.StructType.fromDDL(FIELDS)
    schema = T.StructType([f for f in t.schema.fields if f.name != "text"] + fields.fields)
    kinds = [arrow_type(f.dataType) for f in fields]

    def setup():
        def func(part: pa.RecordBatch):
            base, spans, strings, sizes, fakes, few = [], [], [], [], [], []
            for text in part.column("text").to_pylist():
                own = base_spans(text)
                base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in own])
                free = free_candidates(text, own)
                spans.append([m.span() for m in free])
                strings += [m.group() for m in free]
                made = decoys(text)
                few.append(" ".join(ordinary(text)) or None if len(made) < len(BANDS) else None)
                sizes.append(len(made))
                fakes += made
            p = randomness(strings)
            place = list(zip(band(np.array([len(s) for s in strings], np.int64)).tolist(), level(p).tolist(), strict=True))
            lie = placed(fakes)
            at, to, candidates, lies = 0, 0, [], []
            for own, many in zip(spans, sizes, strict=True):
                candidates.append([{"start": a, "end": b, "band": w, "level": v} for (a, b), (w, v) in zip(own, place[at : at + len(own)], strict=True)])
                lies.append(lie[to : to + many])
                at, to = at + len(own), to + many
            kept = [part.column(n) for n in schema.names[: -len(kinds)]]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(x, k) for x, k in zip((base, candidates, lies, few), kinds, strict=True)], schema.names)

        return func

    return map_slices(t, setup, schema)


def joint_decoys(found: DataFrame) -> DataFrame:
    """Decoys of the texts with too few words, several texts as one; by the hash of the words, whatever the partitions."""
    few = found.where("words IS NOT NULL").select("words").distinct()
    letters = few.agg(F.sum(F.length("words"))).first()[0] or 0
    groups = F.pmod(F.xxhash64("words"), F.lit(max(1, letters // (JOINT * BANDS[-1]))))
    joint = few.groupBy(groups.alias("g")).agg(F.array_join(F.array_sort(F.collect_list("words")), " ").alias("text")).select("text")
    schema = T.StructType.fromDDL(f"decoys {DECOYS}")

    def setup():
        def func(part: pa.RecordBatch):
            made = [placed(decoys(t)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, arrow_type(schema[0].dataType))], schema.names)

        return func

    return map_slices(joint, setup, schema)


def thresholds(found: DataFrame, rate: float = RATE) -> dict[int, int]:
    """For each band the least level that counts as a find. Gathers a count for each band and level, whatever the input."""
    real = found.select(F.explode("candidates").alias("c")).groupBy("c.band", "c.level").count().collect()
    lies = found.select("decoys").unionByName(joint_decoys(found)).select(F.explode("decoys").alias("d")).select("d.place", "d.id").distinct()
    fake = lies.groupBy("place").count().collect()
    seen, null = np.zeros((len(BANDS), GRID + 1)), np.zeros((len(BANDS), GRID + 1))
    for row in real:
        seen[row["band"], row["level"]] = row["count"]
    for row in fake:
        null[divmod(row["place"], GRID + 1)] = row["count"]
    out = {}
    for b in range(len(BANDS)):
        if not seen[b].sum() or not null[b].sum():
            continue
        above = np.cumsum(seen[b][::-1])[::-1]
        p = (1 + np.cumsum(null[b][::-1])[::-1]) / (1 + null[b].sum())
        good = np.flatnonzero(p * seen[b].sum() <= rate * above)  # p of the k-th best <= rate * k / m
        if len(good):
            out[b] = int(good[0])
    return out


def all_spans(found: DataFrame, limits: dict[int, int]) -> DataFrame:
    """Adds `more`: candidates at or above the limit of their band."""
    test = " OR ".join(f"(c.band = {b} AND c.level >= {v})" for b, v in sorted(limits.items())) or "false"
    return found.withColumn("more", F.expr(f"transform(filter(candidates, c -> {test}), c -> struct('{ADDED}' AS kind, c.start AS start, c.end AS end))"))


def written(spans: str) -> str:
    """SQL text of an array of spans as kind:start:end, by start, then kind as listed."""
    rank = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate((*KINDS, ADDED)))
    keyed = f"transform({spans}, s -> struct(s.start AS a, CASE s.kind {rank} END AS r, s.end AS b, s.kind AS k))"
    return f"array_join(transform(array_sort({keyed}), s -> concat_ws(':', s.k, s.a, s.b)), ',')"


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base (text of the rules' spans), spans (text of all), n_added."""
    found = stored(read(texts(df, id_col, text_col)), "candidates")
    both = all_spans(found, thresholds(found, rate)).withColumn("everything", F.concat("base", "more"))
    counts = [F.expr(f"CAST(size(filter(base, s -> s.kind = '{k}')) AS LONG)").alias(f"n_{k}") for k in KINDS]
    return both.select(
        "doc_id", *counts, F.expr(written("base")).alias("base"), F.expr(written("everything")).alias("spans"), F.size("more").cast("long").alias("n_added")
    )


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = None, sign: str = "[secret]", rate: float = RATE) -> DataFrame:
    """All rows and columns, with each secret in the text replaced; `length_col` gets the new length where the text changed. Null texts stay null."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    limits = thresholds(stored(read(df.select(text.alias("text"))).select("candidates", "decoys", "words"), "candidates"), rate)
    rows = packed(df, text=text)
    schema = T.StructType([*rows.schema.fields, T.StructField("clean", T.StringType())])

    def setup():
        def func(part: pa.RecordBatch):
            data = part.column("text").to_pylist()
            base = [base_spans(t) for t in data]
            spans = [[(a, b) for _, a, b in own] for own in base]
            free = [(i, m) for i, t in enumerate(data) for m in free_candidates(t, base[i])]
            if free:
                bands = band(np.array([len(m.group()) for _, m in free], np.int64))
                levels = level(randomness([m.group() for _, m in free]))
                for (i, m), w, v in zip(free, bands.tolist(), levels.tolist(), strict=True):
                    if v >= limits.get(w, GRID + 1):
                        spans[i].append(m.span())
            clean = [replaced(t, s, sign) if s else None for t, s in zip(data, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(clean, pa.string())], schema.names)

        return func

    done = map_slices(rows, setup, schema)
    new = F.col("row").withField(f"`{text_col}`", F.col("clean"))
    if length_col:
        kind = df.schema[length_col].dataType
        new = new.withField(f"`{length_col}`", F.length("clean").cast(kind))
    return done.select(F.when(F.col("clean").isNull(), F.col("row")).otherwise(new).alias("row")).select("row.*")


def replaced(text: str, spans: list[tuple[int, int]], sign: str) -> str:
    """The text with every span, overlapping ones as one, replaced."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], sign]
        at = max(at, b)
    return "".join(out) + text[at:]
