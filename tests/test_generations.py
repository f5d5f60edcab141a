"""Two writers, reused units, whole generations."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from quarry.sources import generations as g


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}"


def test_digests_tell_rows_apart_in_any_order(spark):
    rows = [(1, "a"), (2, None), (2, None), (3, "b")]
    make = lambda rows, cols="k int, v string": spark.createDataFrame(rows, cols)
    base = g.digest_of(make(rows))
    assert base == g.digest_of(make(rows[::-1]).repartition(3))
    others = [make(rows[:2] + rows[3:]), make([*rows[:3], (3, "c")]), make(rows, "k bigint, v string"), make(rows, "k int, w string"), make([])]
    assert len({base, *map(g.digest_of, others)}) == 6


def test_unchanged_units_are_not_written_again(spark, root, tmp_path):
    facts, more = spark.range(5).toDF("k"), spark.range(7).toDF("k")
    assert g.newest(spark, root, "main") == 0 and g.load(spark, root, "main") == {}
    assert g.publish(spark, root, "main", {"a": facts, "b": more}, 0) == {"a": False, "b": False}
    before = {p: os.stat(p).st_mtime_ns for p in tmp_path.glob("units/*/*.parquet")}
    assert g.publish(spark, root, "main", {"a": facts.repartition(2), "b": more.where("k < 6")}, 1) == {"a": True, "b": False}
    assert all(os.stat(p).st_mtime_ns == t for p, t in before.items()) and len(list(tmp_path.glob("units/*"))) == 3
    assert g.load(spark, root, "main")["b"].count() == 6 and g.load(spark, root, "main", 1)["b"].count() == 7
    assert not list(tmp_path.glob("staged/*")) and g.units_of(spark, root, "main")["a"] == g.units_of(spark, root, "main", 1)["a"]


def test_of_two_writers_one_wins(spark, root):
    g.publish(spark, root, "main", {"a": spark.range(1).toDF("k")}, 0)
    # Both have read generation 1.
    g.publish(spark, root, "main", {"a": spark.range(2).toDF("k")}, 1)
    with pytest.raises(g.Conflict):
        g.publish(spark, root, "main", {"a": spark.range(3).toDF("k")}, 1)
    assert g.newest(spark, root, "main") == 2 and g.load(spark, root, "main")["a"].count() == 2
    # The pointer itself never replaces another, whatever was read before.
    path = f"{root}/refs/main/2.json"
    assert not g._created(spark, path, "{}") and g.load(spark, root, "main")["a"].count() == 2
    with pytest.raises(ValueError):
        g.newest(spark, root, "../x")


def test_the_loser_repeats_its_change(spark, root):
    g.publish(spark, root, "main", {"a": spark.createDataFrame([("base",)], "v string")}, 0)
    start = threading.Barrier(2)
    first = {"x": True, "y": True}

    def writer(name):
        def change(tables):
            if first[name]:
                first[name] = False
                start.wait(60)  # both have read generation 1 before either publishes
            return {"a": tables["a"].unionByName(spark.range(1).select(F.lit(name).alias("v")))}

        g.update(spark, root, "main", change)

    threads = [threading.Thread(target=writer, args=(n,)) for n in first]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert g.newest(spark, root, "main") == 3
    assert sorted(r.v for r in g.load(spark, root, "main")["a"].collect()) == ["base", "x", "y"]
