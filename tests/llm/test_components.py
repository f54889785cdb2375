import random

from docmill.llm.common import Workspace
from docmill.llm.components import connected_components


def brute(edges):
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_chains_stars_cycles_and_repeats(spark):
    r = random.Random(1)
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    cycle = [(2000 + i, 2000 + (i + 1) % 7) for i in range(7)]
    loose = [(r.randrange(3000, 3300), r.randrange(3000, 3300)) for _ in range(180)]
    edges = [*chain, *star, *cycle, *loose, *chain[:5], (5000, 5000)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    got = connected_components(df, Workspace(spark, "test-cc"))
    want = {x: c for x, c in brute(edges).items() if x != 5000 and any(x in e and e[0] != e[1] for e in edges)}
    assert {r.node: r.component for r in got.collect()} == want


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "test-cc")).collect() == []
