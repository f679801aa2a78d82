"""Components over long chains, with estimates that stay flat."""

from __future__ import annotations

import random
import time

from entrack.operators import graph


def test_a_chain_of_shuffled_nodes_settles(spark):
    names = random.Random(3).sample(range(10**9), 1000)
    nodes = spark.createDataFrame([(n,) for n in [*names, -5]], "node long")
    links = spark.createDataFrame(list(zip(names, names[1:], strict=False)), "a long, b long")
    began = time.time()
    found = graph.groups(nodes, links)
    assert {(r.node, r.group_id) for r in found.collect()} == {*((n, min(names)) for n in names), (-5, -5)}
    assert time.time() - began < 120
    estimate = int(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert estimate < 2**63
