"""Name search by gram indexes against all pairs."""

from __future__ import annotations

import random

import pytest

from entrack.operators import names as N


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row: list[int], i: int, x: str, b: str) -> list[int]:
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def plain(queries: list, names: list, k: int) -> set:
    out = set()
    for q, text in queries:
        scored = sorted((-(1.0 if text == key else round(max(0.0, 1 - distance(text, key) / max(1, len(text), len(key))), 9)), pos, i) for pos, i, key in names)
        out |= {(q, r, i, -s) for r, (s, _, i) in enumerate(scored[:k], 1) if text}
    return out


@pytest.mark.parametrize(("letters", "k"), [("ab", 3), ("abcdefgh ", 5), ("abc", 400)])
def test_fuzzy_matches_equal_all_pairs(spark, letters, k):
    pick = random.Random(len(letters) + k)
    word = lambda n: "".join(pick.choice(letters) for _ in range(pick.randint(1, n))).strip() or "a"
    names = [(p, 1000 + p, word(14)) for p in range(150)]
    names += [(150 + p, 1150 + p, names[p][2]) for p in range(0, 30, 3)]
    queries = [(q, word(16)) for q in range(25)] + [(50, names[4][2]), (51, "zzzz"), (52, "z"), (53, ""), (54, names[7][2] + "x")]
    found = N.fuzzy_matches(spark.createDataFrame(queries, "query_id long, query string"), spark.createDataFrame(names, "pos long, id long, key string"), k)
    assert {(r.query_id, r["rank"], r.id, r.score) for r in found.collect()} == plain(queries, names, k)


def test_no_search_pairs_all_rows(spark):
    names = spark.createDataFrame([(p, p, f"name {p % 97} of {p}") for p in range(3000)], "pos long, id long, key string")
    queries = spark.createDataFrame([(q, f"name {q} of") for q in range(30)], "query_id long, query string")
    for found in (N.fuzzy_matches(queries, names, 5), N.tiered_search(queries, names, 5)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
