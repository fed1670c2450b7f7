"""Connected components, of forests that one task closes and in rounds, against union by brute force."""

import random

import pytest

from molkeys.llm import common

RNG = random.Random(2)
EDGES = [(i, i + 1) for i in range(100, 400)] + [(-7, k) for k in range(500, 900)] + [(RNG.randrange(1000, 1400), RNG.randrange(1000, 1400)) for _ in range(250)] + [(5, 5)]


def brute(edges):
    up = {}
    for a, b in edges:
        x, y = sorted((find(up, a), find(up, b)))
        up[y] = x
    return {n: find(up, n) for a, b in edges if a != b for n in (a, b)}


def find(up, n):
    while up.setdefault(n, n) != n:
        n = up[n]
    return n


@pytest.mark.parametrize("few", [common.FEW_EDGES, 10])
def test_components_equal_brute_force(spark, monkeypatch, few):
    tables, write = [], common.materialise
    monkeypatch.setattr(common, "materialise", lambda *a, **k: (tables.append(a[1]), write(*a, **k))[1])
    edges = spark.createDataFrame(RNG.sample(EDGES, len(EDGES)), "a long, b long").repartition(7)
    got = common.connected_components(edges, few=few).collect()
    assert {r.node: r.component for r in got} == brute(EDGES) and len(got) == len(brute(EDGES))
    assert few == 10 or len(tables) == 2  # no round of jobs for some hundred edges
    assert common.connected_components(edges.where("a < -10"), few=few).count() == 0
