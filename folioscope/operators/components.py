"""Connected components by spreading minima and jumping pointers, over edges of any number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.durable import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of ``edges`` (a, b); the component is its smallest node.

    Each round takes the smallest component among the neighbours, then the component of the component,
    so the number of rounds is about the logarithm of the longest path. State is checkpointed per round.
    """
    pairs = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    both = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(state.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        spread = state.join(near, F.col("node") == F.col("a"), "left").select("node", "component", F.least("component", F.coalesce("near", "component")).alias("new"))
        jump = state.select(F.col("node").alias("new"), F.col("component").alias("further"))
        after = cut(spread.join(jump, "new", "left").select("node", "component", F.least("new", F.coalesce("further", "new")).alias("next")))
        changed = after.where("next != component").limit(1).count()
        state = after.select("node", F.col("next").alias("component"))
        if not changed:
            return state


def label_propagation(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """(node, community): each node takes the heaviest community among its neighbours, ties to the smallest; fixed rounds.

    A node keeps its community unless another one is strictly heavier, which damps oscillation.
    """
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("w"))
    both = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    state = cut(both.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node")))
    for number in range(rounds):
        heard = both.join(state.select(F.col("node").alias("b"), "community"), "b").groupBy("a", "community").agg(F.sum("w").alias("w"))
        best = heard.groupBy("a").agg(F.max("w").alias("w"), F.min_by("community", F.struct((-F.col("w")).alias("w"), F.col("community"))).alias("best"))
        kept = heard.select(F.col("a").alias("node"), "community", F.col("w").alias("own"))
        half = F.pmod(F.xxhash64("node", F.lit(number)), F.lit(2)) == 0  # half of the nodes move at a time
        state = cut(
            state.join(best, F.col("node") == F.col("a"), "left").join(kept, ["node", "community"], "left")
            .select("node", F.when(half & (F.coalesce("w", F.lit(0)) > F.coalesce("own", F.lit(0))), F.col("best")).otherwise(F.col("community")).alias("community"))
        )
    return state
