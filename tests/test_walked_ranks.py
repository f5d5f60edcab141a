"""PageRank from few seeds by walks of each length, against plain iterations."""

import random

import pytest

from quarry.operators import graph


def plain(edges, ids, seeds, rounds):
    out, into = {}, {}
    for s, d in edges:
        out.setdefault(s, []).append(d)
        into.setdefault(d, []).append(s)
    restart = {v: (v in seeds) / len(seeds) for v in ids}
    rank = restart
    for _ in range(rounds):
        lost = sum(rank[v] for v in ids if v not in out)
        rank = {v: 0.15 * restart[v] + 0.85 * (sum(rank[s] / len(out[s]) for s in into.get(v, ())) + lost * restart[v]) for v in ids}
    return rank


@pytest.mark.parametrize("rounds", [1, 5, 8, 9, 20])
def test_ranks_from_few_seeds(spark, rounds):
    r = random.Random(rounds)
    ids, seeds = range(80), [3, 9]
    edges = [(r.randrange(60), r.randrange(80)) for _ in range(150)] + [(3, 70), (9, 9)]
    df, n = spark.createDataFrame(edges, "src bigint, dst bigint"), spark.createDataFrame([(v,) for v in ids], "vid bigint")
    got = {x.vid: x.rank for x in graph.pagerank(df, n, n.where("vid IN (3, 9)"), rounds=rounds).collect()}
    want = plain(edges, ids, seeds, rounds)
    assert set(got) == set(want) and all(abs(got[v] - want[v]) < 1e-12 for v in ids)


def test_no_round_is_made_once_all_walks_have_ended(spark, monkeypatch):
    written = []
    put = graph.Rounds.put
    monkeypatch.setattr(graph.Rounds, "put", lambda self, df: written.append(1) or put(self, df))
    edges = [(0, v) for v in range(1, 9)] + [(v, v + 8) for v in range(1, 9)] + [(v, v + 8) for v in range(9, 17)] + [(90, 0)]
    ids = [*range(25), 90, 91]
    df, n = spark.createDataFrame(edges, "src bigint, dst bigint"), spark.createDataFrame([(v,) for v in ids], "vid bigint")
    got = {x.vid: x.rank for x in graph.pagerank(df, n, n.where("vid = 0")).collect()}
    want = plain(edges, ids, [0], 20)
    assert all(abs(got[v] - want[v]) < 1e-12 for v in ids) and len(written) <= 6
