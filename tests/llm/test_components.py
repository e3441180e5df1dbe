"""Connected components against union-find, with hubs whose edges are dealt."""

import random

import pytest

from treelake.llm import common, components


@pytest.mark.parametrize(("local", "together"), [(200_000, 4096), (7, 5)])
def test_components(spark, monkeypatch, local, together):
    monkeypatch.setattr(components, "LOCAL", local)
    monkeypatch.setattr(common, "TOGETHER", together)
    rng = random.Random(1)
    edges = [(rng.randrange(900), rng.randrange(900)) for _ in range(500)] + [(i, i + 1) for i in range(2000, 2040)] + [(3000, 3000 + i) for i in range(60)] + [(4000 + i, 3999) for i in range(1, 40)]
    edges += [(5, 5), (None, 7), (8, None), edges[0], edges[0][::-1]]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = [(r.node, r.component) for r in components.components(spark.createDataFrame(edges, "x long, y long").repartition(5), "x", "y").collect()]
    assert len(got) == len(set(got)) and dict(got) == {x: find(x) for x in list(root)}
    assert components.components(spark.createDataFrame([], "x long, y long"), "x", "y").collect() == []
