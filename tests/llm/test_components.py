"""Connected components against union-find, on chains, stars and random graphs."""

import random

import pytest

from lucidgraph.llm.components import connected_components


@pytest.mark.parametrize("kind", ["none", "chain", "random"])
def test_components(spark, kind):
    rng = random.Random(8)
    edges = {"none": [], "chain": [(i, i + 1) for i in range(30)] + [(5, 5)], "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(0, i) for i in range(40, 60)]}[kind]
    up = {n: n for e in edges for n in e}
    for a, b in edges:
        while up[a] != a:
            a = up[a]
        while up[b] != b:
            b = up[b]
        up[max(a, b)] = min(a, b)

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for n in up if root(n) != n}
