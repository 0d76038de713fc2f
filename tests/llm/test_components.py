import random

import pytest

from folioscope.llm import components as c
from folioscope.llm.common import Scratch


def smallest(edges):
    """id -> smallest id that it reaches, by union and find."""
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


@pytest.mark.parametrize("few", [c.FEW, 0])
def test_against_union_and_find(spark, monkeypatch, few):
    """A hub, a chain, no edges, a self-loop, many pairs: with the table of nodes broadcast and with it split by weight."""
    monkeypatch.setattr(c, "FEW", few)
    r = random.Random(1)
    hub = [(0, i) for i in range(1, 4000)] + [(r.randrange(9000), r.randrange(9000)) for _ in range(3000)]
    for edges in (hub, [(i, i + 1) for i in range(20)], [], [(3, 3)], [(100 * i, 100 * i + 1) for i in range(2500)]):
        got = c.components(spark, spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "components")).collect()
        assert {x["id"]: x["component"] for x in got} == smallest([e for e in edges if e[0] != e[1]])
