from __future__ import annotations

import random

import pytest

from phenospark.llm.components import UnionFind, components


@pytest.mark.parametrize("seed,n,m", [(1, 60, 40), (2, 300, 260), (3, 40, 0), (4, 200, 500)])
def test_random_graphs(spark, seed, n, m):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    want = UnionFind()
    for a, b in edges:
        want.join(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: want.root(x) for x in want.up if want.root(x) != x}


def test_long_path_and_star(spark):
    path = [(i, i + 1) for i in range(100)] + [(1000, x) for x in range(1001, 1100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 101)} | {x: 1000 for x in range(1001, 1100)}
