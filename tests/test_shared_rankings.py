"""Questions that ask alike share one ranking, and a ranked row lists its own windows alone."""

from pyspark.sql import functions as F

from quarry.operators import dense
from quarry.plans import composite


def test_questions_with_the_same_identifiers_share_one_ranking(spark):
    texts = {1: "that license is that", 2: "that only", 3: "other words", 4: "license and that", 5: "foo_bar() with that"}
    chunks = spark.createDataFrame([(k, "f", t, None) for k, t in texts.items()], "key bigint, file string, content string, vid bigint")
    asked = {7: "where `that` and `license`", 8: "why `license` and `that`", 9: "see `foo_bar`", 10: "nothing quoted"}
    questions = spark.createDataFrame(list(asked.items()), "query_id bigint, query string")
    found = composite.identifiers(composite.Views(chunks), questions, 3)
    got = sorted((r.query_id, r.rank, r.key) for r in found.collect())
    assert got == [(7, 1, 1), (7, 2, 4), (7, 3, 2), (8, 1, 1), (8, 2, 4), (8, 3, 2), (9, 1, 5)]
    # No row of a question and a chunk is made before the k best are known.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate [" in line and "query_id" in line.split("]")[0] and "key" in line.split("]")[0]]


def test_listwise_windows_of_a_row(spark):
    def by_hand(n, size, step):
        last = max(n - size, 0)
        starts = {*range(0, last + 1, step), last}
        return sorted((i, s) for i in range(n) for s in starts if s <= i < s + size)

    for n, size, step in ((1, 4, 3), (4, 4, 3), (5, 4, 3), (6, 4, 3), (13, 4, 3), (14, 4, 4), (11, 5, 2), (9, 1, 1), (10, 2, 5), (11, 2, 5), (3, 7, 2)):
        rows = spark.range(n).select(F.lit("a").alias("g"), "id", (F.col("id") * 3).alias("rank"))
        out = dense.listwise_windows(rows, ["g"], "rank", size, step)
        assert sorted((r.id, r.window) for r in out.collect()) == by_hand(n, size, step), (n, size, step)
    # A row's list of windows does not grow with its group.
    assert "sequence(0" not in out._jdf.queryExecution().optimizedPlan().toString()
