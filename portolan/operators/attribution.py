"""Attribution of rows to companies: complement naive Bayes as joins, soft votes, result columns.

Rows are reduced to distinct token bags, and token weights are one table of (token, class) pairs seen in training. Classes
are dealt to blocks, each with an inverted list of classes for each token; a bag visits the blocks that hold one of
its tokens and takes away the best classes and sums of each (see `block_scores`). No table of bags x classes is shuffled.
Classes that share no token with a bag depend on its length only, and are summed once for each length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from portolan.functions.numeric import half_even
from portolan.operators.topk import top_classes
from portolan.session import stored

ALPHA = 0.3
TOP = 5
# Sizes of tasks, without influence on results: classes and pairs of a block, bags that meet a block, scores held at once.
CLASS_BLOCK = 1024
PAIRS = 1 << 18
BAG_PART = 4096
CELLS = 1 << 20
# Memory of a streaming vote weight and lower limit of a batch one.
MEMORY = 0.7
LOWEST_WEIGHT = 0.1


def with_bag(df: DataFrame, tokens: Column) -> DataFrame:
    """Adds `tokens` (sorted) and `bag`, the md5 of the joined tokens: equal token lists share a bag."""
    return df.withColumn("tokens", F.sort_array(tokens)).withColumn("bag", F.md5(F.array_join("tokens", " ")))


def bag_tokens(df: DataFrame) -> DataFrame:
    """(bag, token, x) of the distinct bags of a frame from `with_bag`."""
    # Distinct first, by hashing: the first array of a group alone would sort all rows by bag.
    bags = df.select("bag", "tokens").distinct().groupBy("bag").agg(F.first("tokens").alias("tokens"))
    # A row without tokens keeps its bag, with one NULL token that no model knows.
    return bags.select("bag", F.explode_outer("tokens").alias("token")).groupBy("bag", "token").agg(
        F.count(F.lit(1)).alias("x")
    )


def complement_counts(df: DataFrame, label: str) -> DataFrame:
    """(token, class, n): the sufficient statistic. Counts of batches add up, in any order.

    One scan and one shuffle: tokens are counted per class where the rows lie, so that a frequent class or token leaves a
    task as few rows.
    """
    pairs = df.select(F.col(label).alias("class"), F.explode("tokens").alias("token")).where("token IS NOT NULL")
    return pairs.groupBy("token", "class").agg(F.count(F.lit(1)).alias("n"))


def add_counts(*parts: DataFrame) -> DataFrame:
    """Counts of several batches as one."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("token", "class").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class ComplementModel:
    """pairs (token, class, gain), tokens (token, ln_all), classes (class, base)."""

    pairs: DataFrame
    tokens: DataFrame
    classes: DataFrame

    def save(self, path: str) -> None:
        for name in ("pairs", "tokens", "classes"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    def kept(self) -> "ComplementModel":
        """The same model as tables of the shared folder: what reads it several times does not train again."""
        return ComplementModel(*[stored(getattr(self, name), f"model-{name}") for name in ("pairs", "tokens", "classes")])

    @classmethod
    def load(cls, spark, path: str) -> "ComplementModel":
        return cls(*[spark.read.parquet(f"{path}/{name}") for name in ("pairs", "tokens", "classes")])


def complement_model(counts: DataFrame, alpha: float = ALPHA) -> ComplementModel:
    """Weights of the complement class: score(row, c) = len * base_c - sum x ln_all + sum x gain_tc,
    where base_c = ln of the complement's total and gain_tc >= 0 is non-zero only for seen pairs."""
    per_token = counts.groupBy("token").agg(F.sum("n").alias("all_t"))
    whole = per_token.agg(F.struct(F.sum("all_t").alias("total"), F.count(F.lit(1)).alias("vocabulary")).alias("w"))
    ln_all = F.ln(F.col("all_t") + F.lit(alpha))
    classes = (
        counts.groupBy("class")
        .agg(F.sum("n").alias("n_c"))
        .withColumn("w", whole.scalar())
        .select("class", F.ln(F.col("w.total") + F.lit(alpha) * F.col("w.vocabulary") - F.col("n_c")).alias("base"))
    )
    pairs = counts.join(per_token, "token").select(
        "token", "class", (ln_all - F.ln(F.col("all_t") + F.lit(alpha) - F.col("n"))).alias("gain")
    )
    return ComplementModel(pairs, per_token.select("token", ln_all.alias("ln_all")), classes)


def _fallback(model: ComplementModel, k: int) -> Column:
    """Scalar array of the k classes with the largest base and the k smallest names.

    A class sharing no token with a bag scores len * base; any outside these 2k is beaten by k of them.
    A bag without known tokens scores 0 everywhere and takes the smallest names.
    """
    best = model.classes.orderBy(F.desc("base"), "class").limit(k)
    first = model.classes.orderBy("class").limit(k)
    return best.union(first).agg(F.collect_set("class").alias("c")).scalar()


def bag_lengths(tokens: DataFrame, model: ComplementModel) -> DataFrame:
    """(bag, len, constant): known tokens of a bag, and the part of its scores that is equal for all classes."""
    known = F.col("ln_all").isNotNull()
    return (
        tokens.join(model.tokens, "token", "left")
        .groupBy("bag")
        .agg(
            F.sum(F.when(known, F.col("x")).otherwise(0)).alias("len"),
            F.coalesce(F.sum(F.col("x") * F.col("ln_all")), F.lit(0.0)).alias("constant"),
        )
    )


def class_block(label: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(label), F.lit(blocks)).cast("int")


def fallback_scores(lengths: DataFrame, model: ComplementModel, k: int = TOP) -> DataFrame:
    """(bag, class, p) of the classes that can be among a bag's top k without sharing a token with it."""
    others = lengths.select("bag", "len", "constant", F.explode(_fallback(model, k)).alias("class"))
    return others.join(model.classes, "class").select("bag", "class", (F.col("len") * F.col("base") - F.col("constant")).alias("p"))


def length_sums(lengths: DataFrame, model: ComplementModel, blocks: int) -> DataFrame:
    """(len, top, flat, flat_s) per distinct bag length: sums over all classes as if no token were shared.

    Classes without gain depend on a bag through its length only. Lengths meet the classes block by block, and what
    leaves a task is one row for each length.
    """
    top = model.classes.agg(F.max("base")).scalar()
    classes = model.classes.select(class_block("class", blocks).alias("block"), (F.col("base") - top).alias("base"))
    asked = lengths.select("len").distinct().withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    s = F.col("len") * F.col("base")
    sums = asked.join(classes, "block").groupBy("len").agg(F.sum(F.exp(s)).alias("flat"), F.sum(F.exp(s) * s).alias("flat_s"))
    return sums.withColumn("top", F.col("len") * top)


UNIT_SUMS = "shift double, mass double, mass_s double, flat double, flat_s double"


def _score_unit(asked: pa.Table, given: pa.Table, k: int, schema: pa.Schema) -> pa.Table:
    """Scores of some bags against one block of classes, from the block's inverted lists.

    asked: (bag, token, x, len, constant); given: (token, class, gain, base, rel), each sorted list of a token being the
    classes of the block that hold it. For each bag: its k best classes of those that share a token with it, and one row
    of sums over all of these, with their gains and without.
    """
    if not asked.num_rows or not given.num_rows:
        return schema.empty_table()
    tokens, classes, bags = pc.unique(given["token"]), pc.unique(given["class"]), pc.unique(asked["bag"])
    classes = classes.take(pc.array_sort_indices(classes))  # equal scores go by class
    place = lambda t, c, among: pc.index_in(t[c], value_set=among).combine_chunks().to_numpy(zero_copy_only=False)
    column = place(given, "class", classes)
    base, rel = np.empty(len(classes)), np.empty(len(classes))
    base[column], rel[column] = given["base"].to_numpy(), given["rel"].to_numpy()
    list_of = place(given, "token", tokens)
    order = np.lexsort((column, list_of))
    column, gain = column[order], given["gain"].to_numpy()[order]
    ends = np.concatenate([[0], np.cumsum(np.bincount(list_of, minlength=len(tokens)))])
    bag, token = place(asked, "bag", bags), place(asked, "token", tokens)
    x = asked["x"].to_numpy().astype(float)
    length, constant = np.empty(len(bags)), np.empty(len(bags))
    length[bag], constant[bag] = asked["len"].to_numpy(), asked["constant"].to_numpy()
    found: dict[str, list] = {n: [] for n in schema.names}
    step = max(1, CELLS // len(classes))
    for at in range(0, len(bags), step):
        here = np.flatnonzero((bag >= at) & (bag < at + step))
        here = here[np.argsort(token[here], kind="stable")]
        gains = np.zeros((min(step, len(bags) - at), len(classes)))
        for own in np.split(here, np.flatnonzero(np.diff(token[here])) + 1):
            t = token[own[0]]
            row, holds = bag[own] - at, slice(ends[t], ends[t + 1])
            gains[np.ix_(row, column[holds])] += np.outer(x[own], gain[holds])
        some = slice(at, at + len(gains))
        shared = gains > 0
        flat = length[some, None] * rel[None, :]
        score = np.where(shared, flat + gains, -np.inf)
        shift = np.maximum(score.max(axis=1), 0.0)
        raised = np.exp(score - shift[:, None])
        plain = np.where(shared, np.exp(flat), 0.0)
        p = np.where(shared, length[some, None] * base[None, :] - constant[some, None] + gains, -np.inf)
        sums = (shift, raised.sum(axis=1), (raised * np.where(shared, score, 0.0)).sum(axis=1), plain.sum(axis=1), (plain * flat).sum(axis=1))
        for name, values in zip(("shift", "mass", "mass_s", "flat", "flat_s"), sums, strict=True):
            found[name].append(pa.array(values))
        key = np.round(p, 9)
        limit = -np.partition(-key, min(k, len(classes)) - 1, axis=1)[:, min(k, len(classes)) - 1]
        for i in range(len(gains)):
            best = np.flatnonzero((key[i] >= limit[i]) & shared[i])
            best = best[np.argsort(-key[i, best], kind="stable")[:k]]
            found["bag"].append((at + i, best, p[i, best]))
    own, best, p = (np.concatenate(c) for c in zip(*((np.full(len(b), i), b, v) for i, b, v in found["bag"]), strict=True))
    none = pa.nulls(len(own), pa.float64())
    top = pa.table([bags.take(pa.array(own)), classes.take(pa.array(best)), pa.array(p), *[none] * 5], schema=schema)
    names = schema.names[3:]
    rows = [bags, pa.nulls(len(bags), schema.field("class").type), pa.nulls(len(bags), pa.float64()), *(pa.concat_arrays(found[n]) for n in names)]
    return pa.concat_tables([top, pa.table(rows, schema=schema)])


def block_scores(tokens: DataFrame, lengths: DataFrame, model: ComplementModel, blocks: int, parts: int, k: int = TOP) -> DataFrame:
    """(bag, class, p) of the best classes of each visited block, and (bag, sums) of the block, in one table.

    Bags visit the blocks of classes that hold one of their tokens. No score leaves its task but for k of a bag and
    block: what is shuffled are tokens of bags, once for each block they visit, and at most k + 1 rows for each bag and
    block. A token that all classes share is one list in each block.
    """
    top = model.classes.agg(F.max("base")).scalar()
    weights = model.pairs.join(model.classes, "class").select(
        class_block("class", blocks).alias("block"), "token", "class", "gain", "base", (F.col("base") - top).alias("rel")
    )
    places = model.pairs.select("token", class_block("class", blocks).alias("block")).distinct()
    part = F.pmod(F.xxhash64("bag"), F.lit(parts)).cast("int").alias("part")
    asked = tokens.join(lengths, "bag").join(places, "token").select("block", part, "bag", "token", "x", "len", "constant")
    given = weights.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    kind = model.classes.schema["class"].dataType.simpleString()
    ddl = f"bag string, class {kind}, p double, {UNIT_SUMS}"
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))
    keys = ["block", "part"]
    return asked.groupBy(*keys).cogroup(given.groupBy(*keys)).applyInArrow(lambda a, g: _score_unit(a, g, k, schema), ddl)


def bag_totals(units: DataFrame) -> DataFrame:
    """(bag, shift, mass, mass_s, flat, flat_s) of all visited blocks of a bag, on one scale."""
    sums = units.where("class IS NULL").withColumn("most", F.max("shift").over(Window.partitionBy("bag")))
    scale = F.exp(F.col("shift") - F.col("most"))
    return sums.groupBy("bag").agg(
        F.max("most").alias("shift"),
        F.sum(F.col("mass") * scale).alias("mass"),
        F.sum(F.col("mass_s") * scale).alias("mass_s"),
        F.sum("flat").alias("seen"),
        F.sum("flat_s").alias("seen_s"),
    )


def attribute(
    df: DataFrame, model: ComplementModel, k: int = TOP, block_classes: int = CLASS_BLOCK, bag_part: int = BAG_PART
) -> DataFrame:
    """Result columns for the rows of a frame from `with_bag`: RES_Previsto, RES_Confianca,
    RES_Top1..k with probabilities, RES_Entropia, RES_Margem.

    Scores are exact over all classes, whatever their number: `block_classes` (classes that meet a bag at once, about) and
    `bag_part` change no result beyond the last bits of sums.
    """
    model = model.kept()
    tokens = stored(bag_tokens(df), "bags")
    lengths = stored(bag_lengths(tokens, model), "bag-lengths")
    blocks = max(1, -(-model.classes.count() // block_classes), -(-model.pairs.count() // PAIRS))
    parts = max(1, -(-lengths.count() // bag_part))
    units = stored(block_scores(tokens, lengths, model, blocks, parts, k), "bag-scores")
    candidates = units.where("class IS NOT NULL").select("bag", "class", "p").unionByName(fallback_scores(lengths, model, k))
    best = top_classes(candidates.groupBy("bag", "class").agg(F.max("p").alias("p")), ["bag"], k)
    # All classes as if nothing were shared, less those that share a token, plus these with their gains.
    placed = lengths.join(length_sums(lengths, model, blocks), "len").join(bag_totals(units), "bag", "left")
    shift = F.coalesce("shift", F.lit(0.0))
    rest = lambda flat, seen: (F.col(flat) - F.coalesce(seen, F.lit(0.0))) * F.exp(-shift)
    mass = rest("flat", "seen") + F.coalesce("mass", F.lit(0.0))
    mass_s = rest("flat_s", "seen_s") + F.coalesce("mass_s", F.lit(0.0))
    logarithm = F.ln(mass) + shift
    totals = placed.select("bag", (F.col("constant") - F.col("top") - logarithm).alias("shift"), (logarithm - mass_s / mass).alias("spread"))
    probability = {r: F.exp(F.col(f"Top{r}_p") + F.col("shift")) for r in range(1, k + 1)}
    per_bag = best.join(totals, "bag").select(
        "bag",
        F.col("Top1").alias("RES_Previsto"),
        half_even(probability[1], 4).alias("RES_Confianca"),
        *[
            c
            for r in range(1, k + 1)
            for c in (F.col(f"Top{r}").alias(f"RES_Top{r}"), half_even(probability[r], 4).alias(f"RES_Top{r}_p"))
        ],
        half_even(F.col("spread"), 4).alias("RES_Entropia"),
        half_even(probability[1] - F.coalesce(probability[2], probability[1]) if k > 1 else F.lit(0.0), 4).alias("RES_Margem"),
    )
    # Stored, so that its size is known before the join: where texts repeat it is broadcast and no row moves.
    return df.join(stored(per_bag, "bag-results"), "bag", "left").drop("bag", "tokens")


def soft_vote(models: list[tuple[DataFrame, float]], row: str = "row", label: str = "class") -> DataFrame:
    """(row, class, p): weighted sum of class probabilities, each row normalised."""
    votes = None
    for scores, weight in models:
        part = scores.select(row, label, (F.col("p") * F.lit(float(weight))).alias("p"))
        votes = part if votes is None else votes.unionByName(part)
    # A row's window holds one entry per class, at most the class cap.
    total = F.sum("p").over(Window.partitionBy(row))
    summed = votes.groupBy(row, label).agg(F.sum("p").alias("p"))
    return summed.select(row, label, (F.col("p") / (total + F.lit(1e-12))).alias("p"))


def result_columns(scores: DataFrame, row: str = "row", label: str = "class", k: int = TOP) -> DataFrame:
    """Result columns from complete class probabilities in long form; entropy and margin are plain aggregates of a row."""
    best = top_classes(scores, [row], max(k, 2), label, digits=12)
    spread = scores.groupBy(row).agg(half_even(-F.sum(F.col("p") * F.ln(F.col("p") + F.lit(1e-12))), 4).alias("RES_Entropia"))
    return best.join(spread, row).select(
        row,
        F.col("Top1").alias("RES_Previsto"),
        half_even(F.col("Top1_p"), 4).alias("RES_Confianca"),
        *[
            c
            for r in range(1, k + 1)
            for c in (F.col(f"Top{r}").alias(f"RES_Top{r}"), half_even(F.col(f"Top{r}_p"), 4).alias(f"RES_Top{r}_p"))
        ],
        "RES_Entropia",
        half_even(F.coalesce(F.col("Top1_p") - F.col("Top2_p"), F.lit(0.0)), 4).alias("RES_Margem"),
    )


def batch_weights(fold_accuracy: DataFrame) -> DataFrame:
    """(model, weight) from fold accuracies (model, fold, accuracy): mean, clipped to [0.1, 1], normalised."""
    raw = fold_accuracy.groupBy("model").agg(
        F.greatest(F.lit(LOWEST_WEIGHT), F.least(F.lit(1.0), F.avg("accuracy"))).alias("raw")
    )
    return _normalised(raw)


def updated_weights(weights: DataFrame, accuracies: DataFrame) -> DataFrame:
    """One batch's update: 0.7 of the old weight plus 0.3 of the batch accuracy, normalised. A model
    without an accuracy this time keeps its weight before normalising."""
    raw = weights.join(accuracies, "model", "left").select(
        "model",
        F.coalesce(F.lit(MEMORY) * F.col("weight") + F.lit(1 - MEMORY) * F.col("accuracy"), F.col("weight")).alias("raw"),
    )
    return _normalised(raw)


def _normalised(raw: DataFrame) -> DataFrame:
    total = raw.agg(F.sum("raw").alias("t")).scalar()
    return raw.withColumn("total", total).select(
        "model", (F.col("raw") / F.when(F.col("total") != 0, F.col("total")).otherwise(1.0)).alias("weight")
    )
