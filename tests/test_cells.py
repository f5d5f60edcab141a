"""The kept view of vectors against plain search."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from quarry.operators import cells


def plain(points, queries, k):
    out = set()
    for i, q in queries:
        scored = sorted(((sum(a * b for a, b in zip(q, v)), key) for key, v in points), key=lambda x: (-x[0], x[1]))[:k]
        out |= {(i, key, round(s, 9), n + 1) for n, (s, key) in enumerate(scored)}
    return out


def found(df):
    return {(r.query_id, r.key, round(r.score, 9), r["rank"]) for r in df.collect()}


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    middles = rng.normal(0, 1, (12, 8)) * 4
    points = [(i, (middles[i % 12] + rng.normal(0, 0.05, 8)).tolist()) for i in range(900)]
    # A hot copy: one vector under many keys, and one key many times.
    points += [(1000 + i, points[0][1]) for i in range(400)] + [(7, points[7][1])] * 50
    return points


def test_equal_to_a_scan_and_reads_only_the_cells_it_needs(spark, tmp_path, clustered):
    df = spark.createDataFrame(clustered, "vec_id bigint, embedding array<double>").repartition(3)
    view = cells.build(df, "vec_id", "embedding", f"file://{tmp_path}/v", n_cells=12)
    assert view.cells.agg(F.sum("n")).first()[0] == len(clustered)
    assert view.blocks.agg(F.sum(F.size("keys"))).first()[0] == len(clustered)
    queries = [(i, clustered[i][1]) for i in range(0, 900, 100)]
    asked = spark.createDataFrame(queries, "query_id bigint, vector array<double>")
    got = cells.search(view, asked, 10, n_probe=1)
    assert found(got) == plain(clustered, queries, 10)
    assert "cell IN" not in read(got) and len(re.findall(r"parquet.*blocks", read(got))) == 0  # the nearest cells settled it
    more = cells.search(view, asked.where("query_id = 100"), 120, n_probe=1)
    assert found(more) == plain(clustered, queries[1:2], 120)
    folders = {r[0] for r in view.blocks.select("cell").distinct().collect()}
    assert 1 <= len(files_read(more)) < len(folders)


def files_read(df):
    """Cells whose folders the scans of a plan list after pruning."""
    scans = re.findall(r"FileScan parquet.*", df._jdf.queryExecution().optimizedPlan().toString()) or [df._jdf.queryExecution().optimizedPlan().toString()]
    return {c for s in scans for found in re.findall(r"cell#\d+ (?:IN \(|INSET |= )([\d, ]+)", s) for c in found.replace(" ", "").split(",")}


def read(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_cells_are_split_and_shuffled_probes_agree(spark, tmp_path, clustered, monkeypatch):
    monkeypatch.setattr(cells, "TASK_ROWS", 50)
    monkeypatch.setattr(cells, "PROBE_BYTES", 0)
    monkeypatch.setattr(cells, "ASKED", 3)
    df = spark.createDataFrame(clustered, "vec_id bigint, embedding array<double>").repartition(4)
    view = cells.build(df, "vec_id", "embedding", f"file://{tmp_path}/v", n_cells=4)
    hot = view.cells.orderBy(F.col("n").desc()).first()
    assert view.blocks.where(F.col("cell") == hot["cell"]).count() > 1
    queries = [(i, (-np.array(clustered[i][1])).tolist()) for i in range(0, 900, 90)]
    asked = spark.createDataFrame(queries, "query_id bigint, vector array<double>")
    assert found(cells.search(view, asked, 20, n_probe=2)) == plain(clustered, queries, 20)


def test_odd_vectors_and_empty_tables(spark, tmp_path):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None), ("d", []), ("e", [float("nan"), 1.0]), ("f", [None, 1.0]), ("g", [float("inf"), 0.0])]
    view = cells.build(spark.createDataFrame(rows, "name string, v array<double>"), "name", "v", f"file://{tmp_path}/odd", n_cells=5)
    asked = spark.createDataFrame([(1, [1.0, 0.5]), (2, None), (3, [float("nan"), 0.0])], "query_id bigint, vector array<double>")
    assert found(cells.search(view, asked, 9)) == {(1, "a", 1.0, 1), (1, "b", 0.5, 2)}
    empty = cells.build(spark.createDataFrame([], "name string, v array<double>"), "name", "v", f"file://{tmp_path}/none")
    assert cells.search(empty, asked, 3).collect() == []
    with pytest.raises(Exception, match="another length"):
        cells.search(view, spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "query_id bigint, vector array<double>"), 3).collect()
