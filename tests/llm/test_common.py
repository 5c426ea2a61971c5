import random

import pytest

from jsonloom.llm import common


def least_reachable(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


def shuffled(n, joined, first=0):
    """Edges between places, whose nodes have their numbers in no order."""
    number = list(range(first, first + n))
    random.Random(n).shuffle(number)
    return [(number[a], number[b]) for a, b in joined]


rng = random.Random(3)
GRAPHS = {
    "chain": shuffled(500, [(i, i + 1) for i in range(499)]),
    "chain in order": [(i, i + 1) for i in range(-250, 250)],
    "star": shuffled(300, [(0, i) for i in range(1, 300)]),
    "tree": shuffled(500, [(i, rng.randrange(i)) for i in range(1, 500)]),
    "many": shuffled(600, [rng.sample(range(600), 2) for _ in range(350)]),
    "two chains, repeated edges": shuffled(60, [(i, i + 1) for i in range(59)], -30) * 2 + shuffled(90, [(i, i + 1) for i in range(89)], 1000),
    "none": [],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components_in_few_rounds(spark, monkeypatch, name):
    written, stored = [], common.stored
    monkeypatch.setattr(common, "stored", lambda df: written.append(1) or stored(df))
    edges = GRAPHS[name]
    both = spark.createDataFrame(edges + [(b, a) for a, b in edges], "a long, b long")
    rows = common.components(both).collect()
    assert {r.node: r.root for r in rows} == least_reachable(edges) and len(rows) == len({x for e in edges for x in e})
    assert len(written) <= 14
