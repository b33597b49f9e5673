"""Connected components against a search, on graphs of all shapes, with the last step's limit taken away."""

import random

import pytest

from emberline.operators import common


def searched(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for n in sorted(near):
        reach = [n]
        while reach:
            x = reach.pop()
            if x not in out:
                out[x] = n
                reach += near[x]
    return out


def graphs():
    rng = random.Random(3)
    yield "path", [(i, i + 1) for i in range(300)]
    yield "path of shuffled names", [(x, y) for order in [rng.sample(range(1000), 300)] for x, y in zip(order, order[1:])]
    yield "star", [(500, i) for i in range(400)]
    yield "random", [(rng.randrange(900), rng.randrange(900)) for _ in range(500)]
    yield "twice, loops", [(1, 2), (2, 1), (1, 2), (5, 5), (7, 8)]
    yield "words", [("b", "a"), ("é", "z"), ("z", "c"), ("x", "x")]


@pytest.mark.parametrize("limit", [0, 40, 200_000])
@pytest.mark.parametrize(("name", "edges"), list(graphs()), ids=lambda x: x if isinstance(x, str) else "")
def test_components(spark, monkeypatch, name, edges, limit):
    if limit and limit < 1000 and name == "words":
        pytest.skip("the same as without a limit")
    monkeypatch.setattr(common, "FEW_EDGES", limit)
    kind = "string" if isinstance(edges[0][0], str) else "long"
    found = common.components(spark.createDataFrame(edges, f"a {kind}, b {kind}")).collect()
    assert {r.node: r.root for r in found} == searched(edges) and len(found) == len(searched(edges))


def test_no_edges(spark):
    assert common.components(spark.createDataFrame([], "a binary, b binary")).collect() == []
