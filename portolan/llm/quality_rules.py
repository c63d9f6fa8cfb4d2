"""Quality rules as a learned decision list (operator 3).

Per document a fixed set of counts is taken over the whole text. From labelled documents, sequential covering learns
rules for the class "bad": a rule is grown as a conjunction of thresholds by information gain on two thirds of the
labelled rows, pruned from its end on the other third, kept if it is precise enough there, and the rows that it covers
are taken away before the next one. The list is short, can be read, and becomes one ordered Spark conditional
expression: the first rule that holds decides, and a document that meets none is kept.

The labelled sample is bounded (`sample_rows`, by the hash of the id); every document is measured and judged.

Cases: null text has no words (and so fails the base rule); null or missing labels are left out of training; an id
that is labelled more than once counts as often as it is; without labels, or with one class only, the list is empty
and the base rule alone decides. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.llm.support import packed, stored, texts, with_columns

SAMPLE_ROWS = 20_000
GAPS = b" \t\n\x0b\x0c\r"
SYMBOLS, CAPITALS, DIGITS, MARKS = b"#*$%&|<>", bytes(range(65, 91)), bytes(range(48, 58)), b"!?"
COUNTS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_distinct_words long, n_capitals long, n_digits long, n_marks long"
)
#: What rules may test: name and expression over the counts.
FEATURES = {
    "words": "CAST(n_words AS DOUBLE)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "capital_share": "n_capitals / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
}
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def counts_of(text: str) -> tuple[int, ...]:
    """The figures of one text, in the order of COUNTS."""
    data = text.encode()
    words = data.split()  # bytes split at [\x20\x09-\x0D] only
    n = len(words)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen = Counter(windows)
    repeated = 0
    if len(seen) < len(windows):
        upto = 0
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    lines = [x for x in data.split(b"\n") if x.strip(GAPS)]

    def of(chars: bytes) -> int:
        return len(data) - len(data.translate(None, chars))

    return (n, len(text) - of(GAPS), of(SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines), len(set(words)), of(CAPITALS), of(DIGITS), of(MARKS))


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The counts in place of the text column."""

    def setup():
        names = [x.split()[0] for x in COUNTS.split(", ")]

        def func(column: pa.Array) -> dict:
            rows = np.array([counts_of(x) for x in column.to_pylist()], np.int64).reshape(len(column), len(names))
            return dict(zip(names, rows.T, strict=True))

        return func

    return with_columns(df, setup, COUNTS, text_col)


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} CAST({self.threshold!r} AS DOUBLE)"


Rule = tuple[Test, ...]


def _holds(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for t in rule:
        out &= x[t.feature] > t.threshold if t.above else x[t.feature] <= t.threshold
    return out


def _best_test(x: dict[str, np.ndarray], bad: np.ndarray) -> Test | None:
    """The threshold with the largest gain: bad rows kept times the growth of the logarithm of their share."""
    all_bad, n = bad.sum(), len(bad)
    before = np.log2(all_bad / n)
    best, found = 1e-9, None
    for name, values in x.items():
        order = np.argsort(values, kind="stable")
        v, b = values[order], bad[order]
        edge = np.flatnonzero(v[1:] > v[:-1])
        if not len(edge):
            continue
        low = np.cumsum(b)[edge]
        for above, p, t in ((False, low, edge + 1), (True, all_bad - low, n - edge - 1)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / t) - before), 0)
            i = int(np.argmax(gain))
            if gain[i] > best:
                best, found = gain[i], Test(name, above, float((v[edge[i]] + v[edge[i] + 1]) / 2))
    return found


def learn(x: dict[str, np.ndarray], bad: np.ndarray, min_precision: float = 0.9, min_rows: int = 10, most_rules: int = 12, most_tests: int = 4) -> list[Rule]:
    """Ordered rules for bad rows. Every third row prunes, the others grow."""
    rules: list[Rule] = []
    part = np.arange(len(bad)) % 3 == 2
    left = np.ones(len(bad), bool)
    while len(rules) < most_rules:
        grow, prune = left & ~part, left & part
        rule: Rule = ()
        covered = grow.copy()
        while len(rule) < most_tests and bad[covered].any() and not bad[covered].all():
            test = _best_test({k: v[covered] for k, v in x.items()}, bad[covered])
            if test is None:
                break
            rule += (test,)
            covered &= _holds((test,), x)
        options = []
        for k in range(len(rule), 0, -1):
            hit = prune & _holds(rule[:k], x)
            p = int(bad[hit].sum())
            n = int(hit.sum()) - p
            options.append(((p - n) / max(p + n, 1), p, k))
        if not options:
            break
        _, p, k = max(options)
        rule = rule[:k]
        hit = left & _holds(rule, x)
        total, good = int(hit.sum()), int((hit & ~bad).sum())
        checked = prune & hit
        if total < min_rows or total - good < min_precision * total or bad[checked].sum() < min_precision * max(checked.sum(), 1):
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True for a document that the list keeps: ordered conditions, the first that holds decides."""
    if not rules:
        return F.lit(True)
    out = None
    for rule in rules:
        condition = F.expr(" AND ".join(f"({t.sql()})" for t in rule))
        out = F.when(condition, False) if out is None else out.when(condition, False)
    return out.otherwise(True)


def sampled(known: DataFrame, rows: int) -> DataFrame:
    """About the first rows by the hash of the id: a cut of the hash in the ratio of `rows` to all, 5 % above it.

    Every id is in or out as a whole, and no task orders more than its own rows.
    """
    share = 1.05 * rows / max(known.count(), 1)
    return known if share >= 1 else known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))


def fit(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Learn from the counts of labelled documents (label 0: bad). At most `sample_rows` rows come to the driver."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).where("label IS NOT NULL AND doc_id IS NOT NULL")
    known = sampled(known, sample_rows)
    features = [F.expr(e).alias(k) for k, e in FEATURES.items()]
    rows = measured.join(known, "doc_id").select("label", F.xxhash64("doc_id").alias("h"), *features)
    rows = rows.orderBy("h", "label", *FEATURES).limit(sample_rows).toPandas()  # an id may repeat among the documents
    if rows["label"].nunique() < 2:
        return []
    return learn({k: rows[k].to_numpy(float) for k in FEATURES}, (rows["label"] == 0).to_numpy())


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fit_options) -> DataFrame:
    """doc_id, counts, base_failed, kept, for every document."""
    measured = stored(measure(texts(df, id_col, text_col)), "counts")
    rules = fit(measured, labels, id_col, **fit_options)
    base = F.expr(BASE_FAILED)
    return measured.select("*", base.alias("base_failed"), (~base & verdict(rules)).alias("kept"))


def keep_rows(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fit_options) -> DataFrame:
    """The rows that the base rule and the list keep, with all their columns."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # Rules are learned from the labelled sample alone, whose ids are few enough to send to every task; the other rows
    # are measured once, where they are judged.
    known = sampled(labels.select(F.col(id_col).alias("doc_id")).where("doc_id IS NOT NULL"), fit_options.get("sample_rows", SAMPLE_ROWS)).distinct()
    labelled = df.select(F.col(id_col).alias("doc_id"), text.alias("text")).join(F.broadcast(known), "doc_id", "left_semi")
    rules = fit(stored(measure(labelled), "labelled-counts"), labels, id_col, **fit_options)
    measured = measure(packed(df, doc_id=F.col(id_col), text=text))
    return measured.where(~F.expr(BASE_FAILED) & verdict(rules)).select("row.*")
