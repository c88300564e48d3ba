import random

import pytest

from kbspark.llm.common import connected_components


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    return {x: find(x) for x in parent}


CASES = {
    "none": [],
    "loops and nulls": [(1, 1), (None, 2), (3, None)],
    "path": [(i, i + 1) for i in range(60)],
    "shuffled path": [(a, b) for a, b in zip(random.Random(1).sample(range(90), 90), random.Random(1).sample(range(90), 90)[1:])],
    "stars": [(i, i % 7 - 100) for i in range(200)] + [(-100, -99)],
    "random": [(random.Random(k).randrange(-300, 300), random.Random(-k).randrange(-300, 300)) for k in range(250)],
    "repeats": [(5, 2), (2, 5), (5, 2), (9, 5)],
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_components(spark, name):
    rows = connected_components(spark.createDataFrame(CASES[name], "a long, b long")).collect()
    assert {r.node: r.component for r in rows} == brute(CASES[name])
    assert len(rows) == len({r.node for r in rows})
