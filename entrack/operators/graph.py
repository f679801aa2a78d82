"""Similarity groups: connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entrack.operators.lineage import cut


def groups(nodes: DataFrame, links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, group_id): every node with the smallest node it is linked to through any number of links.

    ``nodes``: node; ``links``: a, b. Each round hooks every group that has a smaller neighbour onto the smallest one,
    jumps one hook further, and carries the links over to what is left. In a connected part only groups smaller than
    all their neighbours stay, so links shrink by a share each round and long chains settle in few; each round's labels and links are
    written to the shared folder and read again.
    """
    linked = links.where("a <> b")
    edges = cut(linked.unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = nodes.select("node", F.col("node").alias("group_id")).distinct()
    for _ in range(most_rounds):
        if edges.isEmpty():
            return labels
        hooks = edges.groupBy("a").agg(F.min("b").alias("near")).select("a", F.least("a", "near").alias("to"))
        onward = hooks.select(F.col("a").alias("to"), F.col("to").alias("next"))
        moves = cut(hooks.join(onward, "to").select("a", F.col("next").alias("to")))  # what is hooked onto has links itself
        labels = cut(labels.join(moves, labels["group_id"] == moves["a"], "left").select("node", F.coalesce("to", "group_id").alias("group_id")))
        ends = moves.select(F.col("a").alias("b"), F.col("to").alias("b_to"))
        carried = edges.join(moves, "a").join(ends, "b").where("to <> b_to")
        edges = cut(carried.select(F.col("to").alias("a"), F.col("b_to").alias("b")).distinct())
    raise RuntimeError("groups did not settle")
