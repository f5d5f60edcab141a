"""Canonical digests, batches, passes of a resolver, fronts by range and bootstraps, against plain Python."""

import hashlib
import json

import numpy as np
from pyspark.sql import functions as F
from quarry.functions import canonical
from quarry.operators import facts, reports


def test_canonical_json_is_that_of_the_standard_library(spark):
    kind = "struct<z:string, a:array<struct<n:bigint, B:boolean>>, m:map<string,array<int>>, s:struct<y:string, x:string>>"
    values = [
        {"z": "\x00\x1f\x0b\b\f\n\r\t \\\"/ü\u2028😀\x7f", "a": [{"n": 1, "B": True}, {"n": None, "B": None}, None], "m": {"k\"": [1, None], "": [], "é": None}, "s": {"y": "", "x": None}},
        {"z": None, "a": [], "m": {}, "s": None},
        {"z": "", "a": None, "m": None, "s": {"y": "y", "x": "x"}},
    ]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(3, None)], f"i int, v {kind}")
    got = df.select("i", canonical.to_json(F.col("v"), df.schema["v"].dataType).alias("j"), canonical.digest(F.col("v"), df.schema["v"].dataType).alias("d")).orderBy("i").collect()
    want = [json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for v in [*values, None]]
    assert [r.j for r in got] == want
    assert [r.d for r in got] == [hashlib.sha256(w.encode()).hexdigest() for w in want]


def test_batches_hold_every_fact_and_do_not_depend_on_order(spark):
    rows = [("a", i % 7, i, f"n{i}") for i in range(25)] + [("b", None, 1, None), (None, 3, 2, "x")]
    df = spark.createDataFrame(rows, "file string, line int, symbol int, name string")
    got = {(r.file, r.part): (tuple(tuple(x) for x in r.symbols), r.digest) for r in facts.batches(df, "file", ["line", "symbol", "name"], 10).collect()}
    again = {(r.file, r.part): (tuple(tuple(x) for x in r.symbols), r.digest) for r in facts.batches(df.orderBy(F.rand(1)).repartition(3), "file", ["line", "symbol", "name"], 10).collect()}
    assert got == again
    own = sorted(r[1:] for r in rows if r[0] == "a")
    assert [got["a", p][0] for p in range(3)] == [tuple(own[i : i + 10]) for i in (0, 10, 20)]
    assert got["b", 0][0] == ((None, 1, None),) and got[None, 0][0] == ((3, 2, "x"),)


def test_passes_close_edges_in_order_and_report(spark):
    symbols = spark.createDataFrame([("f", "m", 1), ("g", "n", 2), ("h", "n", 3), ("h", "o", 4), ("h", "o", 5)], "file string, moniker string, symbol bigint")
    edges = spark.createDataFrame([(1, "m", "h"), (2, "n", "h"), (3, "n", "f"), (4, "o", "h"), (5, None, "h")], "id bigint, moniker string, file string")
    out, report = facts.resolve_in_passes(edges, symbols, [("exact", facts.exact_pass), ("same_file", facts.same_file_pass)])
    assert {(r.id, r.target, r["pass"]) for r in out.collect()} == {(1, 1, "exact"), (2, 3, "same_file"), (3, None, None), (4, None, None), (5, None, None)}
    assert [tuple(r) for r in report.orderBy("place").collect()] == [("exact", 0, 5, 1), ("same_file", 1, 4, 1)]
    out, report = facts.resolve_in_passes(edges.limit(0), symbols, [("exact", facts.exact_pass)])
    assert out.count() == 0 and [tuple(r) for r in report.collect()] == [("exact", 0, 0, 0)]


def test_front_by_ranges(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(u), float(d)) for i, (u, d) in enumerate(rng.integers(0, 40, (600, 2)))] + [(900, None, 1.0), (901, 5.0, None)]
    df = spark.createDataFrame(rows, "name int, up double, down double")
    whole = [r for r in rows if r[1] is not None and r[2] is not None]
    want = {a[0] for a in whole if not any(b[1] >= a[1] and b[2] <= a[2] and b != a and (b[1] > a[1] or b[2] < a[2]) for b in whole)}
    assert {r.name for r in reports.pareto(df, "name", "up", "down").collect()} == want


def test_draws_split_over_ranges_add_up_and_follow_the_plain_rule(spark, monkeypatch):
    ends = np.array([0, 3, 3, 10, 14, 15])
    counts = np.array([[reports.draws_of_range(p, ends, s, 4) for p in range(5)] for s in range(3000)])
    assert (counts.sum(1) == 15).all() and (counts[:, 1] == 0).all()
    assert np.allclose(counts.mean(0), [3, 0, 7, 4, 1], atol=0.2)
    assert np.allclose(counts.var(0), [15 * p * (1 - p) for p in (0.2, 0, 7 / 15, 4 / 15, 1 / 15)], atol=0.3)
    monkeypatch.setattr(reports, "CLUSTERS", 8)
    rows = [(f"c{i % 60}" if i % 61 else None, float(i % 13)) for i in range(500)]
    df = spark.createDataFrame(rows, "c string, v double")
    got, again = (reports.bootstrap(x, "c", "v", samples=150, seed=3).first() for x in (df, df.repartition(5)))
    assert np.allclose(list(got), list(again))
    by = {}
    for c, v in rows:
        by.setdefault(c, []).append(v)
    sums, sizes = np.array([sum(v) for v in by.values()]), np.array([len(v) for v in by.values()])
    pick = np.random.default_rng(0).integers(0, len(sums), (20_000, len(sums)))
    low, high = np.percentile(sums[pick].sum(1) / sizes[pick].sum(1), [2.5, 97.5])
    assert np.isclose(got["mean"], sums.sum() / sizes.sum()) and abs(got["low"] - low) < 0.12 and abs(got["high"] - high) < 0.12
