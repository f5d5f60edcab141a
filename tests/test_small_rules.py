"""Rules over fixed small inputs; no table is read, so they are no queries."""

from pyspark.sql import functions as F

from quarry.operators import fusion, incremental, reports, routes


def test_names_of_fusions():
    assert {n: fusion.normalized_fusion(n) for n in ("rrf", "reciprocal", "linear", "none", "weighted")} == {"rrf": "rrf", "reciprocal": "rrf", "linear": "weighted", "none": "weighted", "weighted": "weighted"}


def test_excluded_subtrees():
    assert sorted(incremental.exclusive_subtrees(["/repo/a/b/", "a/b/c", "c/", "/elsewhere/d", "../up", "."], "/repo")) == ["a/b", "c"]


def test_percentile_places(spark):
    want = {0: [], 1: [0], 4: [0, 1, 2, 3], 5: [0, 1, 2, 3, 4], 7: [0, 2, 3, 4, 6], 12: [0, 3, 6, 8, 11], 100: [0, 25, 50, 74, 99]}
    rows = spark.createDataFrame([(n,) for n in want], "n int").select("n", reports.percentile_places(F.col("n"), 5, [0.25, 0.5, 0.75]).alias("places"))
    assert {r.n: r.places for r in rows.collect()} == want


def test_specific_seeds(spark):
    want = {"parse_config": True, "Parser": False, "fooBar": True, "HTTP": True, "ab": False, "docs.python.org": False, "Foo.barBaz()": True, "a/b": True, "x y": False, "f(x)": False, "v2X": True, "": False}
    rows = spark.createDataFrame([(s,) for s in want], "seed string").select("seed", routes.is_specific_seed(F.col("seed")).alias("specific"))
    assert {r.seed: r.specific for r in rows.collect()} == want


def test_rebuild_speedup_rounds_halves_up_as_its_sql_does(spark, tmp_path):
    import duckdb

    from quarry import catalog

    keys = [k for k in range(1, 997 * 60, 997) if k % 5][:39] + [2]  # 39 patches of one second, one of two: a mean of 1.025
    spark.createDataFrame([(k, 1) for k in (*keys, 5)], "o_orderkey bigint, o_custkey bigint").write.parquet(f"file://{tmp_path}/orders.parquet")
    (got,) = catalog.QUERIES["a30_rebuild_speedup"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert [tuple(got)] == con.execute(catalog.ORACLE_SQL["a30_rebuild_speedup"]).fetchall() == [(1, 41, 40, 5.0, 1.03, 4.9)]
