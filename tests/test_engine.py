import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.engine import Engine
from quarry.functions import text
from quarry.operators import fusion, graph, incremental, intervals, metrics, reports
from quarry.plans import planner
from quarry.sources import indexes, repository
from quarry.streaming import feed


def test_engine_over_a_folder(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "tests").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.py").write_text("def load_index(path):\n    return path\n\ndef save_index(x):\n    pass\n")
    (tmp_path / "tests" / "test_a.py").write_text("load_index('x')\n")
    (tmp_path / "node_modules" / "b.js").write_text("load_index\n")
    engine = Engine.from_repository(spark, str(tmp_path))
    assert {r.file for r in engine.chunks.collect()} == {"src/a.py", "tests/test_a.py"}
    queries = spark.createDataFrame([(1, "where is save_index")], "query_id bigint, query string")
    best = engine.bm25(queries, 1).join(engine.chunks, F.col("id") == F.col("chunk_id")).first()
    assert best.file == "src/a.py" and best["first"] == 3 and best.score == 0.0
    assert engine.bm25(queries, 5, drop_tests=True).count() <= engine.bm25(queries, 5).count()
    assert engine.grep("LOAD_index", glob="tests/*").count() == 1
    assert engine.plan(queries).first().plan == "hybrid_fusion"
    names = {r.unified_name for r in engine.nodes.collect()}
    assert {"src/a.py:load_index()", "src/a.py:save_index()", "src/a.py"} <= names
    assert engine.edges.where("type = 'reference'").count() == 0
    asked = queries.select("query_id", "query", F.array(*[F.lit(1.0)] * 64).alias("vector"))
    assert engine.search_with_context(asked, k=2).count() == 2
    engine.index(f"file://{tmp_path}/views")
    nodes, _ = repository.load_graph(spark, f"file://{tmp_path}/views")
    assert nodes.count() == engine.nodes.count()
    assert repository.load_vectors(spark, f"file://{tmp_path}/views", 1, "l2").count() == engine.chunks.count()
    tools = engine.tools()
    assert tools.get_manifest()["dense"] and tools.search_regex("save_").count() == 1
    assert tools.find_files("*.py").count() == 2 and tools.read_source("src/a.py", 1, 1).first().content == "def load_index(path):"


def test_paths(spark):
    df = spark.createDataFrame([("a/./b/../c.py",), ("/abs",), ("../up",), ("",), (None,), ("C:\\x",), ("x\\y.d.ts",)], "p string")
    assert [r[0] for r in df.select(text.normalized_path(F.col("p"))).collect()] == ["a/c.py", None, None, None, None, None, "x/y.d.ts"]
    assert [r[0] for r in df.select(text.is_declaration_file(F.col("p"))).collect()][-1]
    t = spark.createDataFrame([("a/tests/x.py",), ("a/FooTest.java",), ("a/contest.py",), ("testing.py",), (None,)], "p string")
    assert [r[0] for r in t.select(text.is_test_path(F.col("p"))).collect()] == [True, True, False, False, False]
    assert [r[0] for r in t.select(text.is_test_file(F.col("p"))).collect()] == [True, False, False, True, False]


def test_masks_do_not_commute_with_cuts(spark):
    from quarry.operators import dense

    rows = spark.createDataFrame([(i, [float(i), 1.0], i % 2) for i in range(10)], "id bigint, v array<float>, odd int")
    mask = rows.where("odd = 0")
    assert [r.id for r in dense.search_within(rows, mask, [1.0, 0.0], 2, "v", "id").collect()] == [8, 6]
    assert [r.id for r in dense.search_then_mask(rows, mask, [1.0, 0.0], 2, "v", "id").collect()] == [8]


def test_fusion_ties_and_zero_scores(spark):
    b = spark.createDataFrame([("x", 0, 1, 0.0, ""), ("y", 0, 2, 0.0, "c"), ("y", 1, 1, 0.5, "d"), ("z", 1, 2, None, "e")], "key string, branch int, rank int, score double, content string")
    got = {r.key: (r.score, r.rank, r.content) for r in fusion.fuse(b).collect()}
    assert got == {"x": (1.0, 1, None), "y": (1.0, 2, "c"), "z": (0.5, 3, "e")}


def test_balanced_split_edges(spark):
    df = spark.createDataFrame([(n, 0, n - 1) for n in (1, 4, 5, 7, 8, 9)], "n int, s int, e int")
    got = {}
    for r in intervals.balanced_split(df, "s", "e", 4).orderBy("n", "piece").collect():
        got.setdefault(r.n, []).append(r.piece_end - r.piece_start + 1)
    assert got == {1: [1], 4: [4], 5: [3, 2], 7: [4, 3], 8: [4, 4], 9: [3, 3, 3]}


def test_cycles_and_paths(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 4), (4, 3)], "src bigint, dst bigint").withColumn("type", F.lit("reference"))
    seeds = spark.createDataFrame([(1,)], "vid bigint")
    assert {(r.vid, r.depth) for r in graph.dependencies(e, seeds, 5).collect()} == {(2, 1), (4, 1), (3, 2)}
    assert graph.shortest_path(e, 1, 3).first().path == [1, 2, 3]
    assert graph.shortest_path(e, 4, 2, max_hops=1).count() == 0
    n = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "vid bigint")
    ranks = {r.vid: r.rank for r in graph.pagerank(e, n, rounds=40).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and max(ranks, key=ranks.get) in (1, 3)


def test_metrics_of_empty_truth(spark):
    df = spark.createDataFrame([(["a", "a"], ["a"]), (["a"], []), ([], ["a"])], "p array<string>, t array<string>")
    got = [tuple(r) for r in df.select(*metrics.set_metrics(F.col("p"), F.col("t"))).collect()]
    assert got == [(1, 0.5, 1.0, 1.0), (0, 0.0, 0.0, 0.0), (0, 0.0, 0.0, 0.0)]


def test_pareto_equals_pairwise_dominance(spark):
    r = np.random.default_rng(0)
    rows = [(i, int(a), int(b)) for i, (a, b) in enumerate(r.integers(0, 12, (80, 2)))]
    want = {i for i, a, b in rows if not any(x >= a and y <= b and (x > a or y < b) for _, x, y in rows)}
    got = reports.pareto(spark.createDataFrame(rows, "i int, up int, down int"), "i", "up", "down")
    assert {x.i for x in got.collect()} == want


def test_near_duplicates_miss_no_pair(spark):
    r = np.random.default_rng(1)
    sets = [sorted({f"t{x}" for x in r.integers(0, 14, 9)}) for _ in range(60)]
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if min(len(sets[i]), len(sets[j])) >= 6 and len(set(sets[i]) & set(sets[j])) / min(len(sets[i]), len(sets[j])) >= 0.85}
    df = spark.createDataFrame(list(enumerate(sets)), "id int, t array<string>")
    got = reports.near_duplicates(df, "id", F.col("t")).collect()
    first = {tuple(t): min(i for i, s in enumerate(sets) if s == t) for t in sets}
    classes = {(first[tuple(sets[i])], first[tuple(sets[j])]) for i, j in want}
    assert {(x.left_id, x.right_id) for x in got} == {(min(p), max(p)) for p in classes}
    assert all(x.left_n == sum(s == sets[x.left_id] for s in sets) for x in got)


def test_overlay_converges_to_a_rebuild(spark):
    feed_rows = [("a", 1, "upsert", "x"), ("b", 1, "upsert", "y"), ("a", 2, "upsert", "z"), ("b", 3, "delete", None), ("c", 1, "delete", None), ("c", 2, "upsert", "w")]
    df = spark.createDataFrame(feed_rows, "k string, n int, op string, digest string")
    state = incremental.overlay(df, "k", F.col("n"))
    rebuilt = spark.createDataFrame([("a", "z"), ("c", "w")], "k string, digest string")
    assert incremental.differences(state, rebuilt, "k", "digest").count() == 0
    assert incremental.delta_or_rebuild(spark.createDataFrame([(1,)], "copies int"), 10) == "delta"
    assert incremental.delta_or_rebuild(spark.createDataFrame([(2,)], "copies int"), 10) == "rebuild"


def test_stream_keeps_the_table_in_step(spark, tmp_path):
    schema = "ts timestamp, k string, n int, op string, digest string"
    for part, rows in enumerate([[("a", 1, "upsert", "x"), ("b", 1, "upsert", "y")], [("a", 2, "upsert", "z"), ("b", 3, "delete", None), ("b", 2, "upsert", "late")]]):
        df = spark.createDataFrame(rows, "k string, n int, op string, digest string").withColumn("ts", F.current_timestamp())
        df.select("ts", "k", "n", "op", "digest").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        feed.maintain(feed.read_feed(spark, str(tmp_path / "in"), schema), str(tmp_path / "state"), str(tmp_path / "cp"), "k", ["n"]).awaitTermination()
        got = {(r.k, r.digest) for r in feed.current(spark, str(tmp_path / "state"), part, "k", ["n"], "op").collect()}
        assert got == ({("a", "x"), ("b", "y")} if part == 0 else {("a", "z")})
    feed.compacted(spark, str(tmp_path / "state"), str(tmp_path / "small"), 1, "k", ["n"])
    assert {(r.k, r.digest) for r in feed.current(spark, str(tmp_path / "small"), None, "k", ["n"], "op").collect()} == {("a", "z")}


def test_index_occurrences(spark):
    body = 'metadata {\n}\ndocuments {\n  relative_path: "a.py"\n  occurrences {\n    range: 1\n    range: 2\n    range: 5\n    symbol: "sym `f`/"\n    symbol_roles: 1\n    enclosing_range: 1\n  }\n  occurrences {\n    range: 3\n    range: 0\n    range: 4\n    range: 1\n    symbol: "local 0"\n  }\n  occurrences {\n    range: 3\n    symbol: "x"\n  }\n}\ndocuments {\n  relative_path: "b.py"\n}\n'
    got = [tuple(r) for r in indexes.index_occurrences(spark.createDataFrame([(body,)], "value string")).collect()]
    assert got == [("a.py", 1, 2, 1, 5, 1, "sym `f`/"), ("a.py", 3, 0, 4, 1, 0, "local 0")]


def test_plans_follow_the_views(spark):
    df = spark.createDataFrame([("who calls foo",), ("parse_config",), ("how does caching work",), ("definitions of bar",), ("callback url import map",)], "q string")
    pick = lambda **o: [r[0] for r in df.select(planner.plan_for(F.col("q"), **o)).collect()]
    assert pick(views=("sparse", "dense", "graph")) == ["structural_graph", "hybrid_fusion", "semantic", "structural_graph", "hybrid_fusion"]
    assert pick(views=("sparse", "dense"), tier="cheap") == ["fast_lexical", "fast_lexical", "semantic", "fast_lexical", "fast_lexical"]
    assert pick(views=("dense",)) == ["semantic"] * 5 and pick(views=("sparse",)) == ["fast_lexical"] * 5
    with pytest.raises(ValueError):
        planner.plan_for(F.col("q"), views=("graph",))
    with pytest.raises(ValueError):
        planner.tier_of("slow")
