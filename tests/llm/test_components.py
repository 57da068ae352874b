import random

from govlake.llm.common import Scratch
from govlake.llm.components import connected


def test_chains_stars_and_loops(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 7)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    labels = {r.node: r.label for r in connected(Scratch(spark, "t"), spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert labels == {x: root(x) for x in parent if x != 7}
