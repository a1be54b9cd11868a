"""Connected components of a list of links, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(links: DataFrame, rounds: int = 60, settle: bool = True) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node reachable.

    In each round a node takes the smallest root among its neighbours' and its own, then the root of that root, so chains
    shorten by more than half. It ends when a round changes nothing. Null ends and loops are ignored; repeats do no harm.
    settle=False ends after the given rounds: nodes of one root are then connected, but not all that are need have one.
    """
    both = links.select("a", "b").filter("a is not null and b is not null and a <> b")
    both = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    for _ in range(rounds):
        told = both.join(state.select(F.col("node").alias("a"), "root"), "a").groupBy(F.col("b").alias("node")).agg(F.min("root").alias("told"))
        nearer = state.join(told, "node").select("node", F.col("root").alias("old"), F.least("root", "told").alias("root"))
        above = state.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = materialize(nearer.join(above, "root", "left").select("node", "old", F.least("root", F.coalesce("above", "root")).alias("root")))
        state = jumped.select("node", "root")
        if settle and jumped.filter("root <> old").isEmpty():
            return state
    if settle:
        raise RuntimeError("components did not settle")
    return state
