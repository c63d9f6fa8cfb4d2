"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.llm.support import stored

#: Maps joined in one plan before the result is written.
JOINED = 8


def components(edges: DataFrame, most_rounds: int = 120) -> DataFrame:
    """(node, root) of every node that an edge (a, b) touches; root is one node of its component, the same for all.

    Randomised contraction: each round draws an order of the nodes by hash, every node moves to the first of itself and
    its neighbours, and edges are rewritten to where their ends moved. Edges inside one place vanish, so each round is
    expected to leave a fixed share of the nodes at most; it ends when no edge is left. The moves of all rounds, joined
    from the last to the first, give the roots. Edges and moves are tables in the shared folder. A node with many
    neighbours is a hot key of a join between tables, which Spark can split; its minimum is combined before the shuffle.
    """
    now = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    moves: list[DataFrame] = []
    while not now.isEmpty():
        if len(moves) == most_rounds:
            raise RuntimeError("components did not settle")
        moves.append(stored(_move(now, len(moves)), "moves"))
        now = stored(_contract(now, moves[-1]), "edges")
    if not moves:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    whole = moves.pop()
    for n, move in enumerate(reversed(moves), 1):
        later = whole.select(F.col("node").alias("root"), F.col("root").alias("end"))
        whole = move.join(later, "root", "left").select("node", F.coalesce("end", "root").alias("root"))
        whole = whole if n % JOINED else stored(whole, "moves")
    return whole


def _move(edges: DataFrame, turn: int) -> DataFrame:
    """(node, root): the first of a node and its neighbours in the order of this turn."""

    def place(column: str):
        return F.struct(F.xxhash64(F.lit(turn), column).alias("at"), F.col(column).alias("root"))

    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = both.groupBy("a").agg(F.min(place("b")).alias("first"))
    return first.select(F.col("a").alias("node"), F.least("first", place("a"))["root"].alias("root"))


def _contract(edges: DataFrame, moves: DataFrame) -> DataFrame:
    left = moves.select(F.col("node").alias("a"), F.col("root").alias("x"))
    right = moves.select(F.col("node").alias("b"), F.col("root").alias("y"))
    met = edges.join(left, "a").join(right, "b").where("x <> y")
    return met.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
