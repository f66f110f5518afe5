import random

import pytest

from lonepoint.llm.graph import components


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


SHAPES = {
    "chain": [(i, i + 1) for i in range(200)],
    "shuffled chain": [(7 * i % 199, 7 * (i + 1) % 199) for i in range(198)],
    "star": [(5, i) for i in range(300) if i != 5],
    "random": [(random.Random(i).randrange(150), random.Random(i + 999).randrange(150)) for i in range(90)],
    "loops": [(1, 1), (2, 2), (3, 4), (4, 3), (3, 4)],
    "none": [],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_components(spark, shape):
    edges = SHAPES[shape]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: v for k, v in brute(edges).items() if any(a != b and k in (a, b) for a, b in edges)}
    assert got == want
