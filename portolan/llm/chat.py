"""Chat formatting by prefix-target expansion (operator 5), in DataFrame functions only.

Every assistant turn becomes an example: all turns before it as context, and its text alone under the loss mask. A
conversation whose last turn is no reply gives one more example without a target, so that no turn is lost. A turn is

    <s>[ROLE]text</s>

with `\\`, `<` and `[` of role and text written as `\\b`, `\\l` and `\\k`, so that a control string can't arise inside a
text, and reading back is three replacements. `loss_start` and `loss_length` are the mask, in code points of `formatted`.

An example repeats its context: a conversation of n turns gives up to n/2 prefixes of it, which is what this format
is; the rows of one conversation are the unit of work.

Cases: null role or text counts as empty; turns with equal numbers are ordered by role, then text; a null turn comes
first; a null conversation id is one conversation. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, HEAD, BODY, CLOSE = "<s>", "[", "]", "</s>"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("[", "\\k"))
TARGET = "assistant"


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def escape_role(role: Column) -> Column:
    """As a text, and without the sign that ends the role."""
    return F.replace(escape(role), F.lit("]"), F.lit("\\e"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\e"), F.lit("]")))


def examples(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, n_turns, formatted, loss_start, loss_length: one row for each assistant turn, and for a rest without one (null mask)."""
    turns = df.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(OPEN + HEAD), escape_role(t["role"]), F.lit(BODY))
    parts = F.transform("turns", lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == TARGET).alias("target")))
    ends = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.struct(i.alias("n_turns"), F.element_at("parts", i)["target"].alias("target")))
    wanted = F.filter(ends, lambda e: e["target"] | (e["n_turns"] == F.size("parts")))
    each = grouped.select("conv_id", parts.alias("parts")).select("conv_id", "parts", F.explode(wanted).alias("end"))
    whole = lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))
    last = F.element_at("parts", F.col("end.n_turns"))
    context = F.array_join(F.transform(F.slice("parts", 1, F.col("end.n_turns") - 1), whole), "")
    built = each.select("conv_id", "end", context.alias("context"), last.alias("last"))
    return built.select(
        "conv_id",
        F.col("end.n_turns").alias("n_turns"),
        F.concat("context", whole(F.col("last"))).alias("formatted"),
        F.when(F.col("end.target"), F.length("context") + F.length("last.head")).alias("loss_start"),
        F.when(F.col("end.target"), F.length("last.body")).alias("loss_length"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    pieces = F.filter(F.split(formatted, "</s>"), lambda p: p != "")

    def turn(p: Column) -> Column:
        inner = F.substr(p, F.lit(len(OPEN + HEAD) + 1))
        at = F.instr(inner, BODY)
        return F.struct(
            unescape_role(F.substr(inner, F.lit(1), at - 1)).alias("role"), unescape(F.substr(inner, at + F.lit(len(BODY)))).alias("text")
        )

    return F.transform(pieces, turn)


def read_target(formatted: Column, loss_start: Column, loss_length: Column) -> Column:
    """The text under the mask; null without one."""
    return unescape(F.substr(formatted, loss_start + 1, loss_length))


def digests(made: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns, the text under all masks in order, and the size of the output."""
    seen = made.select(
        "conv_id",
        "n_turns",
        F.length("formatted").cast("long").alias("chars"),
        read_target(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("target"),
        "formatted",
    )
    gathered = seen.groupBy("conv_id").agg(
        F.max(F.struct("n_turns", "formatted")).alias("longest"),
        F.sort_array(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("n_turns", "target")))).alias("targets"),
        F.sum("chars").alias("formatted_chars"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(F.transform("targets", lambda t: t["target"]), "")
    ready = gathered.select("conv_id", read_turns(F.col("longest.formatted")).alias("turns"), loss.alias("loss"), "formatted_chars")
    return ready.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
