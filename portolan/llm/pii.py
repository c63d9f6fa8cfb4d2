"""Personal data by bootstrapped contextual extraction (operator 6).

Fixed rules find the seeds: e-mail and IP addresses, card and telephone numbers. The words around every identifier
(a token with a digit or an @, or groups of digits joined by single spaces, dots, brackets or hyphens) are its lexical patterns: the two words before it, and the word before with the word
after, each with the make of the identifier (with an @, digits alone, mixed). Patterns and identifiers form a graph that Spark scores in rounds: a pattern is as
sure as the lower bound of the share of its identifiers that are known to be of a kind, an identifier as sure as its
patterns together make it, and what is sure enough counts as known in the next round, until a round finds no new identifier. Identifiers that no rule found, but that
sure patterns did, are added as spans of that kind. Spans of the rules always stay.

The graph holds identifiers and patterns with counts, not texts; all documents take part in it.

Cases: null text is empty; a text of any length is read whole and in linear time; equal rows give equal results. An empty
table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

import re
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portolan.llm.support import arrow_type, map_slices, stored, texts

KINDS = ("email", "ip", "card", "phone")
LEAST_SEEDS, SURE, TOGETHER = 4, 0.75, 0.9
#: No identifier of any kind that the rules do not find is shorter.
SHORTEST = 6
#: z of the lower (Wilson) bound of a pattern's share.
Z = 1.645

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
MARK = re.compile(r"[0-9@]")
LETTER = re.compile(r"[A-Za-z]")
#: A token with a mark, from its first character on; possessive, so that no token is read twice.
IDENTIFIER = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
#: Groups of digits, or an account number in groups after its country and check digits.
GROUPS = re.compile(
    r"(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}(?:[\x20-][A-Z0-9]{4})++(?:[\x20-][A-Z0-9]{1,3}+)?+|[+(]{0,2}[0-9]++(?:(?:\x20?[()]\x20?|\)-|[\x20.-])[0-9]++)++)"
)
EDGE = "\"'`.,;:!?()[]{}<>|*#$%&"
BEFORE = re.compile(r"([^\x20\x09-\x0D]*)[\x20\x09-\x0D]+([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*\Z")
AFTER = re.compile(r"[^\x20\x09-\x0D]*[\x20\x09-\x0D]+([^\x20\x09-\x0D]{1,40})")
WINDOW = 120


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address rule, found from each @: what stands before it up to the last match, then the domain."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at) if start < at else None
        if match:
            out.append((start, match.end()))
            done = match.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed rules by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = NOT_DIGIT.sub("", m.group()) if m.end() - m.start() >= 16 else ""
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                    out.append(("phone", *m.span()))
    return out


def make(token: str) -> str:
    return "at" if "@" in token else "mixed" if LETTER.search(token) else "digits"


def whole(text: str, a: int, b: int) -> int:
    """End of a run without a last group that goes on as a word."""
    if b < len(text) and text[b].isalnum():
        while b > a and text[b - 1].isalnum():
            b -= 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
    return b


def mentions(text: str, base: list[tuple[str, int, int]]) -> list[dict]:
    """Identifiers of a text with their surroundings: base spans and all other tokens with a digit or an @ and runs of digit groups."""
    spans = [(a, b, k) for k, a, b in base]
    taken = sorted((a, b) for a, b, _ in spans)
    some = MARK.search(text) is not None
    runs = {(m.start(), whole(text, *m.span())) for m in GROUPS.finditer(text)} if some else set()
    tokens = set()
    for m in IDENTIFIER.finditer(text) if some else ():
        part = m.group()
        a = m.start() + len(part) - len(part.lstrip(EDGE))
        b = m.end() - (len(part) - len(part.rstrip(EDGE)))
        tokens.add((a, b))
    k = 0
    for a, b in sorted(tokens | runs):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if b - a >= SHORTEST and not any(x < b and y > a for x, y in taken[k : k + 8]):
            spans.append((a, b, None))
    out = []
    for a, b, kind in spans:
        left, right = BEFORE.search(text, max(0, a - WINDOW), a), AFTER.match(text, b, b + WINDOW)
        two, one = left.groups() if left else ("", "")
        token = text[a:b].lower()
        ways = [f"{make(token)} 2 {two.lower()} {one.lower()}"] if two and one else []
        ways += [f"{make(token)} 1 {one.lower()} _ {right.group(1).lower()}"] if one and right else []
        out.append({"start": a, "end": b, "kind": kind, "name": token, "ways": ways})
    return out


MENTION = "struct<start:int,end:int,kind:string,name:string,ways:array<string>>"
FIELDS = f"n_email long, n_ip long, n_card long, n_phone long, base array<struct<kind:string,start:int,end:int>>, mentions array<{MENTION}>"


def read(t: DataFrame) -> DataFrame:
    """Base spans and identifiers of each text, in place of it."""
    fields = T.StructType.fromDDL(FIELDS)
    schema = T.StructType([f for f in t.schema.fields if f.name != "text"] + fields.fields)
    kinds = [arrow_type(f.dataType) for f in fields]

    def setup():
        def func(part: pa.RecordBatch):
            found = [base_spans(x) for x in part.column("text").to_pylist()]
            more = [mentions(x, b) for x, b in zip(part.column("text").to_pylist(), found, strict=True)]
            made = [[sum(s[0] == k for s in b) for b in found] for k in KINDS]
            made.append([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in b] for b in found])
            made.append(more)
            kept = [part.column(n) for n in schema.names[: -len(kinds)]]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(x, k) for x, k in zip(made, kinds, strict=True)], schema.names)

        return func

    return map_slices(t, setup, schema)


def graph(found: DataFrame) -> DataFrame:
    """Edges (pattern, name, kind): each identifier once with each of its patterns; kind null where no rule knows it."""
    m = found.select(F.explode("mentions").alias("m")).select("m.name", "m.kind", F.explode("m.ways").alias("pattern"))
    return m.groupBy("pattern", "name").agg(F.max("kind").alias("kind"))


def score(edges: DataFrame, rounds: int | None = None, least: int = LEAST_SEEDS, sure: float = SURE) -> DataFrame:
    """(pattern, kind, sure): patterns that are sure of a kind after all rounds; without `rounds`, when no new identifier appears."""
    known = edges.where("kind IS NOT NULL").select("name", "kind").distinct()
    total = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    for _ in count() if rounds is None else range(rounds):
        own = edges.select("pattern", "name").join(known, "name").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("p")).where(F.col("p") >= least)
        share, n = F.col("p") / F.col("n"), F.col("n")
        low = (share + Z * Z / (2 * n) - Z * F.sqrt((share * (1 - share) + Z * Z / (4 * n)) / n)) / (1 + Z * Z / n)
        patterns = stored(own.join(total, "pattern").select("pattern", "kind", low.alias("sure")).where(F.col("sure") >= sure), "patterns")
        reached = edges.where("kind IS NULL").select("pattern", "name").join(patterns, "pattern")
        fresh = stored(reached.groupBy("name", "kind").agg(together().alias("weight")).where(F.col("weight") >= TOGETHER).select("name", "kind"), "fresh")
        grown = known.unionByName(fresh).distinct()
        if fresh.join(known, ["name", "kind"], "left_anti").isEmpty():
            break
        known = stored(grown, "known")
    return patterns


def together():
    """How sure the patterns of a group are together: 1 - product of (1 - sure)."""
    return 1 - F.exp(F.sum(F.log(1 - F.least(F.col("sure"), F.lit(0.999)))))


def added_spans(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """doc_id, th, more: spans of identifiers that sure patterns reveal and no rule found."""
    m = found.select("doc_id", "th", F.explode("mentions").alias("m")).where("m.kind IS NULL")
    m = m.select("doc_id", "th", "m.start", "m.end", F.explode("m.ways").alias("pattern"))
    spans = m.join(patterns, "pattern").groupBy("doc_id", "th", "start", "end", "kind").agg(together().alias("weight")).where(F.col("weight") >= TOGETHER)
    return spans.groupBy("doc_id", "th").agg(F.collect_set(F.struct("kind", "start", "end")).alias("more"))


def written(spans: str) -> str:
    """SQL text of an array of spans as kind:start:end, by kind as listed, then start."""
    rank = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS))
    keyed = f"transform({spans}, s -> struct(CASE s.kind {rank} END AS r, s.start AS a, s.end AS b, s.kind AS k))"
    return f"array_join(transform(array_sort({keyed}), s -> concat_ws(':', s.k, s.a, s.b)), ',')"


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base (text of the rules' spans), spans (text of all), n_added."""
    found = stored(read(texts(df, id_col, text_col).withColumn("th", F.xxhash64("text"))), "mentions")
    more = added_spans(found, score(stored(graph(found), "graph")))
    # Equal rows were gathered together: each span once.
    more = more.select(F.col("doc_id").alias("more_id"), F.col("th").alias("more_th"), "more")
    both = found.drop("mentions").join(more, found["doc_id"].eqNullSafe(F.col("more_id")) & (found["th"] == F.col("more_th")), "left")
    none = F.expr("CAST(array() AS array<struct<kind:string,start:int,end:int>>)")
    both = both.withColumn("everything", F.concat("base", F.coalesce("more", none)))
    return both.select(
        "doc_id", *(f"n_{k}" for k in KINDS), F.expr(written("base")).alias("base"), F.expr(written("everything")).alias("spans"),
        F.size(F.coalesce("more", none)).cast("long").alias("n_added"),
    )
