"""Queries without SQL, and grep, against brute force over whole tables and texts."""

from collections import Counter, defaultdict

import duckdb
import pytest

from pyspark.sql import functions as F

from quarry import catalog
from quarry.operators import graph, sparse
from quarry.plans.views import GRAPH_SQL


@pytest.fixture(scope="module")
def anchors(sf_dir):
    """Anchors of each file in rank order."""
    rows = duckdb.sql(f"SELECT 'o' || l_orderkey % 25, l_orderkey * 10 + l_linenumber, l_orderkey % 500, l_orderkey % 500 + l_linenumber FROM read_parquet('{sf_dir}/lineitem.parquet') ORDER BY 2").fetchall()
    by_file = {}
    for file, *rest in rows:
        by_file.setdefault(file, []).append(tuple(rest))
    return by_file


def test_first_fit_windows_reads_every_order(spark, sf_dir, anchors):
    want = []
    for file, rows in anchors.items():
        windows = []
        for _, first, last in rows:
            for w in windows:
                low, high = min(first, w[0]), max(last, w[1])
                if first - w[1] <= 8 and w[0] - last <= 8 and high - low < 200:
                    w[:] = low, high
                    break
            else:
                windows.append([first, last])
        want += [(file, *w) for w in windows]
    got = [(r.file, r["first"], r["last"]) for r in catalog.QUERIES["w11_first_fit_windows"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(want)


def test_distinct_spans_reads_every_order(spark, sf_dir, anchors):
    want = []
    for file, rows in anchors.items():
        taken = set()
        for rank, first, last in rows:
            lines = set(range(first, last + 1))
            if not lines & taken:
                taken |= lines
                want.append((file, rank, first, last))
    got = [(r.file, r["rank"], r["first"], r["last"]) for r in catalog.QUERIES["u11_distinct_spans"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(want)


def communities(vids, edges, rounds):
    """Each node takes the commonest label of its neighbours, the smallest among equals, all at once."""
    near = defaultdict(list)
    for src, dst in edges:
        if src != dst:
            near[src].append(dst)
            near[dst].append(src)
    label = {v: v for v in vids}
    for _ in range(rounds):
        votes = {v: Counter(label[w] for w in near[v]) for v in vids if near[v]}
        label |= {v: min(c, key=lambda x: (-c[x], x)) for v, c in votes.items()}
    return label


def test_communities_of_a_small_graph(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4), (4, 5), (7, 7)]
    nodes = spark.createDataFrame([(v,) for v in range(1, 9)], "vid bigint")
    got = graph.label_communities(spark.createDataFrame(edges, "src bigint, dst bigint"), nodes, 3)
    assert {r.vid: r.community for r in got.collect()} == communities(range(1, 9), edges, 3)


def test_communities_take_every_node_and_edge(spark, sf_dir):
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    vids = [v for (v,) in c.sql(f"WITH {GRAPH_SQL} SELECT vid FROM nodes").fetchall()]
    edges = c.sql(f"WITH {GRAPH_SQL} SELECT src, dst FROM edges WHERE src IN (SELECT vid FROM nodes) AND dst IN (SELECT vid FROM nodes)").fetchall()
    got = {r.vid: r.community for r in catalog.QUERIES["g21_communities"](spark, sf_dir).collect()}
    assert got == communities(vids, edges, 4)


@pytest.mark.parametrize("kind", [{}, {"use_regex": False}, {"case_sensitive": True}, {"use_regex": False, "case_sensitive": True}])
def test_grep_reads_whole_texts(spark, kind):
    df = spark.createDataFrame([(1, "x" * 9000 + " MIT License"), (2, "MIT License"), (3, "none"), (4, None)], "doc_id bigint, text string")
    assert {r.doc_id for r in sparse.grep(df, "MIT License", F.col("text"), **kind).collect()} == {1, 2}
    assert {r.doc_id for r in sparse.grep(df, "MIT License", F.col("text"), max_chars=8000, **kind).collect()} == {2}
