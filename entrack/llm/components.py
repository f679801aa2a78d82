"""Connected components of a link table, by alternating large and small stars.

Every round works on distinct edges only, contracts what meets inside a partition first, and writes its
edges to the shared folder, so the lineage stays short and nothing is gathered in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entrack.llm.common import Scratch, salted_join

_EDGE = "u long, v long"
MOST_ROUNDS = 60


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of a partition as stars: (node, smallest node reached inside the partition)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        at = parent.setdefault(x, x)
        while at != parent[at]:
            parent[at] = parent[parent[at]]
            at = parent[at]
        parent[x] = at
        return at

    for batch in batches:
        for u, v in zip(batch["u"].tolist(), batch["v"].tolist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    rows = [(x, r) for x in parent if (r := root(x)) != x]
    for lo in range(0, len(rows), 50_000):
        yield pd.DataFrame(np.array(rows[lo : lo + 50_000], dtype=np.int64), columns=["u", "v"])


def components(links: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, component) of every node with a link; the component is its smallest node.

    ``links`` has the long columns u and v; loops and repeated links change nothing, and no links give an
    empty result. Rounds grow with the logarithm of the longest path; beyond MOST_ROUNDS it raises. The rows of
    a node with very many links are split.
    """
    edges = links.where("u <> v").mapInPandas(_contract, _EDGE).distinct()
    edges = scratch.save(edges, f"{label}-0")
    before = None
    for k in range(1, MOST_ROUNDS):
        n = edges.count() if before is None else before[0]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = salted_join(both, least, ["u"], ["v"], 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.save(large, f"{label}-large-{k}")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        near = salted_join(large, least, ["u"], ["v"], 2 * n)
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        edges = scratch.save(small.mapInPandas(_contract, _EDGE).distinct(), f"{label}-{k}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"{label}-{k - 1}", f"{label}-large-{k}")
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
