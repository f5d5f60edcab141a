"""Distances walked from both ends of a pair, against breadth-first search."""

import random

import pytest
from quarry.operators import entities


def steps(edges, start, goal, most):
    layer, seen = {start}, {start}
    for n in range(most + 1):
        if goal in layer:
            return n
        layer = {b for a, b in edges if a in layer} - seen
        seen |= layer
    return most + 1


@pytest.mark.parametrize("most", [1, 4, 7])
def test_distances_are_those_of_breadth_first_search(spark, most):
    r = random.Random(most)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(75)] + [(100 + i, 101 + i) for i in range(9)]
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(60)] + [(100, 107), (109, 100), (5, 5), (None, 3), (3, None), (100, 107)]
    got = entities.distances(spark.createDataFrame(edges, "src bigint, dst bigint"), spark.createDataFrame(pairs, "first bigint, second bigint"), most).collect()

    def want(a, b):
        n = most + 1 if a is None or b is None else min(steps(edges, a, b, most), steps(edges, b, a, most))
        return n if n <= most else -1

    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(((a, b, want(a, b)) for a, b in pairs), key=key)


def test_pairs_walk_no_further_than_half_way(spark, monkeypatch):
    kept = []
    whole = entities.graph.checkpointed
    monkeypatch.setattr(entities.graph, "checkpointed", lambda df: kept.append(whole(df)) or kept[-1])
    edges = [(0, k) for k in range(1, 31)] + [(a, 31 + b) for a in range(1, 31) for b in range(30)] + [(31 + a, 100 + b) for a in range(30) for b in range(200)] + [(100, 999)]
    (row,) = entities.distances(spark.createDataFrame(edges, "src bigint, dst bigint"), spark.createDataFrame([(0, 999)], "first bigint, second bigint"), 4).collect()
    assert row.distance == 4 and max(df.count() for df in kept[1:]) <= 61


def test_ways_of_any_length_and_pairs_without_one(spark):
    r = random.Random(8)
    edges = [(r.randrange(50), r.randrange(50)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)] + [(140, 7), (200, 201), (201, 200)]
    pairs = [(r.randrange(50), r.randrange(50)) for _ in range(60)] + [(100, 139), (138, 100), (100, 200), (200, 100), (100, 7), (777, 100), (100, 777), (778, 779), (777, 777)]
    want = sorted((a, b, min(steps(edges, a, b, 99), steps(edges, b, a, 99)) % 100) for a, b in pairs)
    want = [(a, b, -1 if a != b and n == 0 else n) for a, b, n in want]
    edges, pairs = spark.createDataFrame(edges, "src bigint, dst bigint"), spark.createDataFrame(pairs, "first bigint, second bigint")
    kinds = spark.createDataFrame([(i, "low" if i < 100 else "high" if i < 160 else "loop") for i in range(300)], "vid bigint, type string")
    for of in (None, kinds):
        assert sorted(map(tuple, entities.distances(edges, pairs, None, of).collect())) == want


def test_query_finds_ways_of_more_than_four_steps(spark):
    from quarry import catalog
    from quarry.plans.views import code_edges

    tables = "/root/testdata/sf0.1"
    got = {(r.first, r.second): r.distance for r in catalog.QUERIES["e5_distance"](spark, tables).collect()}
    out = {}
    for r in code_edges(spark, tables).select("src", "dst").distinct().toPandas().itertuples(index=False):
        out.setdefault(r.src, set()).add(r.dst)

    def plain(start, goal):
        layer, seen, n = {start}, {start}, 0
        while layer and goal not in layer:
            layer = set().union(*(out.get(v, ()) for v in layer)) - seen
            seen |= layer
            n += 1
        return n if layer else -1

    far = [p for p, n in got.items() if n > 4]
    assert far and all(got[p] == plain(*p) for p in far)
