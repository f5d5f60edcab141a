"""Region metrics count lines by spans: against listed lines, with equal ranks, and on spans too long to list."""

import random

from quarry.operators import metrics

SPAN = "q bigint, rank bigint, file string, first bigint, last bigint"
CORE = "q bigint, file string, first bigint, last bigint"


def lines(rows):
    return {(f, x) for f, a, b in rows for x in range(a, b + 1)}


def test_spans_count_as_listed_lines_do(spark):
    r = random.Random(5)
    span = lambda: (r.choice("ab"), a := r.randint(1, 60), a + r.randint(-2, 25))
    regions = [(q, k // (1 + q % 2), *span()) for q in range(30) for k in range(r.randint(1, 9))]
    core = [(q, *span()) for q in range(30) for _ in range(r.randint(1, 4))]
    rdf, cdf = spark.createDataFrame(regions, SPAN), spark.createDataFrame(core, CORE)
    own = {q: lines(x[1:] for x in core if x[0] == q) for q in range(30)}
    got = metrics.covered(rdf, {"hits": cdf}, ["q", "file"]).collect()
    assert len(got) == len(regions)
    assert all(x.hits == len(lines([(x.file, x["first"], x["last"])]) & own[x.q]) for x in got)
    for budget in (10, 40):
        want = {}
        for q in range(30):
            read = sorted((k, line, f, a) for p, k, f, a, b in regions if p == q for line in range(a, b + 1))[:budget]
            if own[q]:
                want[q] = round(len({(f, line) for _, line, f, _ in read} & own[q]) / len(own[q]), 6)
        out = {x.q: x.recall for x in metrics.recall_at_lines(rdf, cdf.where("first <= last"), ["q"], "rank", budget).collect()}
        assert out == want


def test_spans_too_long_to_list(spark):
    far = 10**12
    regions = spark.createDataFrame([(1, 1, "a", 1, far), (1, 2, "b", 5, 7), (1, 3, "a", None, None)], SPAN)
    core = spark.createDataFrame([(1, "a", 11, far + 10), (1, "a", 100, 200), (1, "b", 1, 5)], CORE)
    main = spark.createDataFrame([(1, "b")], "q bigint, file string")
    gains = {(x["rank"], x.gain, x.lines) for x in metrics.region_gains(regions, core, main, ["q"], "rank").collect()}
    assert gains == {(1, float(far - 10), far), (2, 1.5, 3), (3, 0.0, 0)}
    assert [x.recall for x in metrics.recall_at_lines(regions, core, ["q"], "rank", far + 1).collect()] == [1.0]
    none = spark.createDataFrame([], "file string, n_lines bigint")
    (row,) = metrics.region_report(regions, core, core.limit(0), main, none, ["q"], budgets=(500,)).collect()
    assert (row.hit_file_rate, row.hit_region_rate, row.first_useful_hit, row.recall_at_500) == (1.0, 1.0, 1.0, 0.0)
