"""Spans folded island by island against folds of whole files."""

import random
from collections import Counter

import pytest

from quarry.operators import intervals


def rows(seed):
    r = random.Random(seed)
    out = []
    for file in "abc":
        for rank in range(250 if file == "a" else 40):
            first = r.randrange(-300, 6000 if file == "a" else 400)
            out.append((file, rank, first, first + int(r.paretovariate(1)) % 300))
    return [*out, ("d", 0, 5, 5), ("e", 0, 0, 9000), *[("e", 1 + k, 50 * k, 50 * k + 3) for k in range(100)]]


def windows(spans, gap, most):
    out = []
    for _, first, last in spans:
        for w in out:
            low, high = min(w[0], first), max(w[1], last)
            if first <= w[1] + gap and last >= w[0] - gap and high - low + 1 <= most:
                w[0], w[1] = low, high
                break
        else:
            out.append([first, last])
    return out


@pytest.mark.parametrize("stretch", [16, 4096])
def test_folds(spark, stretch):
    table = rows(stretch)
    df = spark.createDataFrame(table, "file string, rank int, first bigint, last bigint").repartition(4)
    by_file = {f: sorted((r[1:] for r in table if r[0] == f)) for f in "abcde"}
    got = intervals.first_fit_windows(df, 8, 60, stretch=stretch).collect()
    assert Counter(map(tuple, got)) == Counter((f, *w) for f, spans in by_file.items() for w in windows(spans, 8, 60))
    kept = Counter()
    for f, spans in by_file.items():
        held = []
        for rank, first, last in spans:
            if all(last < a or first > b for _, a, b in held):
                held.append((rank, first, last))
        kept.update((f, *h) for h in held)
    assert Counter(map(tuple, intervals.distinct_spans(df, stretch=stretch).collect())) == kept


@pytest.mark.parametrize("stretch", [16, 4096])
def test_islands_are_the_runs_without_a_gap(spark, stretch):
    table = rows(3)
    df = spark.createDataFrame(table, "file string, rank int, first bigint, last bigint").repartition(4)
    got = {(r.file, r["rank"]): r.island for r in intervals.with_island(df, 8, stretch=stretch).collect()}
    for file in "abcde":
        reach = island = None
        for first, last, rank in sorted((f, l, n) for name, n, f, l in table if name == file):
            if reach is None or first > reach + 9:
                island = first
            reach = last if reach is None else max(reach, last)
            assert got[file, rank] == island
    # Groups follow the gaps, not the files.
    assert len({i for (f, _), i in got.items() if f == "a"}) > 20


def test_many_small_groups_are_folded_without_a_python_call_each(spark):
    r = random.Random(8)
    table = [(q, f, n, first := r.randrange(60), first + r.randrange(-1, 20)) for q in range(300) for f in "ab" for n in range(r.randrange(1, 7))]
    df = spark.createDataFrame([*table, (7, None, 0, 1, 2), (7, "a", 9, None, 3)], "q bigint, file string, rank int, first bigint, last bigint").repartition(4)
    out = intervals.distinct_spans(df, by=["q", "file"])
    kept = Counter({(7, None, 0, 1, 2): 1, (7, "a", 9, None, 3): 1})
    for key in {row[:2] for row in table}:
        for proper in (True, False):  # spans that end before they begin meet only their like
            held = []
            for row in sorted(row for row in table if row[:2] == key and (row[3] <= row[4]) == proper):
                if all(row[4] < a or row[3] > b for *_, a, b in held) or not held:
                    held.append(row)
            kept.update(held) if proper else None
    assert Counter(x for x in map(tuple, out.collect()) if x[3] is None or x[3] <= x[4]) == kept
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
