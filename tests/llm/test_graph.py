import random

import pytest

from roadweave.llm._graph import connected_components


def brute(edges):
    low = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            m = min(low[u], low[v])
            changed |= low[u] != m or low[v] != m
            low[u] = low[v] = m
    return low


def found(spark, edges, **more):
    got = connected_components(spark.createDataFrame(edges, "u long, v long"), **more).collect()
    assert len(got) == len({r.node for r in got})
    return {r.node: r.component for r in got}


def test_paths_stars_and_random_edges(spark):
    rnd = random.Random(8)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(299 - i, 299) for i in range(1, 20)]
    edges += [(400 + rnd.randrange(80), 400 + rnd.randrange(80)) for _ in range(60)] + [(7, 6), (6, 7)]
    edges = [e for e in edges if e[0] != e[1]]
    assert found(spark, edges) == brute(edges)


def test_no_edges(spark):
    assert found(spark, [(3, 3)]) == {}


def test_rounds_that_run_out_are_an_error(spark):
    with pytest.raises(RuntimeError, match="not whole"):
        found(spark, [(i, i + 1) for i in range(60)], most_rounds=2)
