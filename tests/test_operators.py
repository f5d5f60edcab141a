"""Operators whose outcome depends on order, and those without SQL, against plain Python."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry import skills
from quarry.functions import text
from quarry.operators import drafting, graph, incremental, intervals, metrics, ordered, projection, reports, routes, sparse
from quarry.sources import chunkers


def plain_excerpt(content, query, most):
    """The excerpt by its rules, rendering every choice."""
    if most <= 0:
        return ""
    if len(content) <= most:
        return content
    lines = content.splitlines()
    stop = set(projection.FOCUS_STOPWORDS)
    words = {w for w in re.findall("[a-z0-9_]+", query.lower()) if len(w) > 2 and w not in stop}

    def show(chosen):
        out, last = "", -1
        for i in [*sorted(chosen), None]:
            gap = (len(lines) if i is None else i) - last - 1
            if gap and last >= 0:
                out += f"... {gap} source lines omitted ...\n"
            if i is not None:
                out, last = out + lines[i] + "\n", i
        return out[:-1]

    head = set(range(min(5, len(lines))))
    chosen = set(head)
    scored = sorted((-sum(w in line.lower() for w in words), i) for i, line in enumerate(lines))
    for score, i in scored:
        near = {j for j in range(i - 2, i + 3) if 0 <= j < len(lines)}
        if score < 0 and len(show(chosen | near)) <= most:
            chosen |= near
    if chosen == head:
        for i in range(len(head), len(lines)):
            if len(show(chosen | {i})) > most:
                break
            chosen.add(i)
    out = show(chosen)
    end = "\n... source excerpt truncated ..."
    return out if len(out) <= most else (out[: most - len(end)].rstrip() + end if most > len(end) else end[:most])


def test_excerpts_follow_the_rules():
    r = random.Random(3)
    for _ in range(150):
        body = "\n".join(" ".join(r.choice(["alpha", "beta", "what", "gamma", "x"]) for _ in range(r.randrange(0, 9))) for _ in range(r.randrange(1, 40)))
        most = r.randrange(0, 500)
        assert projection.focused(body, "what about beta or gamma", most) == plain_excerpt(body, "what about beta or gamma", most)


def test_budgets_are_shared_out(spark):
    rows = spark.createDataFrame([(q, i, "word " * n if n else None, "p" * 5000) for q in (1, 2) for i, n in enumerate([400, 0, 300, 2, 500])], "q int, rank int, content string, file string")
    got = projection.evidence(rows.withColumn("query", F.lit("word")), ["q"], "rank", "query", total=1600, least=400, most=900).orderBy("q", "rank").collect()
    assert len(got) == 10 and all(len(r.file) == 4096 and projection.ELISION in r.file for r in got)
    for q in (1, 2):
        own = [r for r in got if r.q == q]
        assert sum(len(r.content or "") for r in own) <= 1600 and own[1].content is None and own[3].projection.strategy == "complete"


def test_drafts_against_plain_search(spark):
    r = random.Random(1)
    docs = [[r.randrange(4) for _ in range(r.randrange(0, 40))] for _ in range(12)]
    asked = [[r.randrange(4) for _ in range(r.randrange(1, 12))] for _ in range(20)]
    corpus = spark.createDataFrame(list(enumerate(docs)), "doc int, tokens array<int>")
    contexts = spark.createDataFrame(list(enumerate(asked)), "ctx int, tokens array<int>")

    def ngrams(c, key=3, most=5, k=2, budget=4):
        spots = [(d, p) for d, t in enumerate(docs) for p in range(len(t) - key + 1) if len(c) >= key and t[p : p + key] == c[-key:]][-most:]
        out = []
        for d, p in spots:
            m = key
            while m < len(c) and p - (m - key) - 1 >= 0 and docs[d][p - (m - key) - 1] == c[-m - 1]:
                m += 1
            if docs[d][p + key : p + key + budget]:
                out.append((m, docs[d][p + key : p + key + budget]))
        return [x for x in sorted(out, key=lambda x: -x[0])[:k]]

    got = {}
    for x in drafting.ngram_continuations(corpus, contexts, 3, 5, 2, 4).orderBy("ctx", "rank").collect():
        got.setdefault(x.ctx, []).append((x.match, x.tokens))
    assert got == {i: ngrams(c) for i, c in enumerate(asked) if ngrams(c)}

    def copy(c, least=2, budget=4):
        for n in range(len(c) - 1, least - 1, -1):
            for p in range(len(c) - n - 1, -1, -1):
                if c[p : p + n] == c[-n:]:
                    return n, c[p + n : p + n + budget]
        return None

    assert {x.ctx: (x.match, x.tokens) for x in drafting.copied(contexts, 2, 32, 4).collect()} == {i: copy(c) for i, c in enumerate(asked) if copy(c)}

    def suffix(c, least=2):
        for n in range(len(c), least - 1, -1):
            for d in range(len(docs) - 1, -1, -1):
                for p in range(len(docs[d]) - n, -1, -1):
                    if docs[d][p : p + n] == c[-n:]:
                        return n, docs[d][p + n : p + n + 4]
        return None

    want = {i: suffix(c) for i, c in enumerate(asked) if suffix(c) and suffix(c)[1]}
    assert {x.ctx: (x.match, x.tokens) for x in drafting.longest_suffix(corpus, contexts, 2, 64, 4).collect()} == want
    branches = spark.createDataFrame([(0, 0, "copy", [1, 2, 3]), (0, 1, "net", [1, 2, 4]), (0, 2, "net", [5])], "ctx int, tree int, source string, tokens array<int>")
    nodes = drafting.fused_drafts(branches, 4).collect()
    assert {(tuple(n.path), n.source) for n in nodes} == {((1,), "copy"), ((5,), "net"), ((1, 2), "copy"), ((1, 2, 3), "copy")}


def test_places_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RANGES", 7)
    r = random.Random(5)
    rows = [(i, float(r.randrange(9)) if i % 11 else None) for i in range(300)]
    got = {x.vid: x.place for x in ordered.places(spark.createDataFrame(rows, "vid bigint, s double"), "s", "vid").collect()}
    want = {v: n for n, (_, v) in enumerate(sorted((s if s is not None else float("-inf"), v) for v, s in rows))}
    assert got == want


def test_ranks_equal_plain_iterations(spark):
    edges = [(1, 2), (1, 2), (2, 3), (3, 1), (4, 1), (2, 4), (5, 5), (6, 1)]
    ids = range(1, 8)
    seeds = {1, 4}
    out = {v: [d for s, d in edges if s == v] for v in ids}
    rank = {v: (1 / 2 if v in seeds else 0.0) for v in ids}
    for _ in range(12):
        lost = sum(rank[v] for v in ids if not out[v])
        rank = {v: 0.15 * (v in seeds) / 2 + 0.85 * (sum(rank[s] / len(out[s]) for s, d in edges if d == v) + lost * (v in seeds) / 2) for v in ids}
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    n = spark.createDataFrame([(v,) for v in ids], "vid bigint")
    got = {r.vid: r.rank for r in graph.pagerank(df, n, n.where("vid IN (1, 4)"), rounds=12).collect()}
    assert all(abs(got[v] - rank[v]) < 1e-12 for v in ids)


def test_resolved_regions(spark):
    cases = [(3, 5, 10), (0, 4, None), (-3, -1, 10), (2, -1, 10), (-3, 8, None), (2, -1, None), (4, 0, 10), (2, 99, 10), (-30, 99, 10), (1, -1, 0)]
    want = [(3, 5), (1, 4), (8, 10), (2, 10), None, None, None, (2, 99), (1, 10), None]
    df = spark.createDataFrame(cases, "f bigint, l bigint, t bigint")
    first, last = metrics.resolved(F.col("f"), F.col("l"), F.col("t"))
    assert [None if r[0] is None else tuple(r) for r in df.select(first, last).collect()] == want


def test_balanced_cases_of_uneven_groups(spark):
    import hashlib

    sizes = {"a": 1, "b": 9, "c": 3, "d": 6}
    rows = [(g, f"{g}{i}") for g, n in sizes.items() for i in range(n)]
    rank = lambda x: hashlib.sha256(f"s:{x}".encode()).hexdigest()
    for count in (4, 9, 13, 19):
        quota = {g: min(n, count // 4) for g, n in sizes.items()}
        left = count - sum(quota.values())
        while left:
            for g in sorted((g for g in sizes if quota[g] < sizes[g]), key=lambda g: (quota[g] - sizes[g], rank(g), g)):
                if left:
                    quota[g], left = quota[g] + 1, left - 1
        got = reports.balanced_cases(spark.createDataFrame(rows, "g string, k string"), "g", "k", count, "s").orderBy("position").collect()
        own = {g: sorted((k for x, k in rows if x == g), key=rank) for g in sizes}
        want = [own[g][i] for i in range(9) for g in sorted(sizes) if i < quota[g]]
        assert [r.k for r in got] == want


def test_bootstrap_draws_whole_clusters(spark):
    rows = [(c, float((c * 7 + i) % 5)) for c in range(9) for i in range(c % 4 + 1)]
    df = spark.createDataFrame(rows, "c int, v double")
    sums = [(r.h, sum(v for k, v in rows if k == r.c), sum(1 for k, _ in rows if k == r.c)) for r in df.select("c", F.xxhash64(F.lit(False), "c").alias("h")).distinct().collect()]
    sums.sort()
    means = []
    for sample in range(40):
        # All clusters are one range, which gets all draws.
        times = np.random.default_rng([3, sample, 0]).multinomial(9, [1 / 9] * 9)
        assert times.sum() == 9
        means.append(sum(t * s for t, (_, s, _) in zip(times, sums)) / sum(t * n for t, (_, _, n) in zip(times, sums)))
    means.sort()
    at = lambda q: means[int(q * 39)] + (q * 39 - int(q * 39)) * (means[min(int(q * 39) + 1, 39)] - means[int(q * 39)])
    got = reports.bootstrap(df, "c", "v", 40, 3).first()
    assert abs(got.low - at(0.025)) < 1e-12 and abs(got.high - at(0.975)) < 1e-12 and abs(got["mean"] - sum(v for _, v in rows) / len(rows)) < 1e-12


def test_publishing_needs_the_expected_generation(spark):
    refs = spark.createDataFrame([("r", "main", "s1", 1), ("r", "main", "s2", 2)], "repository string, ref string, snapshot string, generation bigint")
    assert incremental.published(refs, "r", "main", "s3", 2).count() == 3
    assert incremental.published(refs, "r", "new", "s3", 0).where("ref = 'new'").first().generation == 1
    with pytest.raises(Exception, match="generation"):
        incremental.published(refs, "r", "main", "s3", 1).collect()


def test_leases_are_fenced(spark):
    rows = [("j", 0, "a", 10), ("j", 5, "b", 10), ("j", 6, "a", 10), ("j", 16, "b", 3), ("j", 17, "a", 1), ("k", 3, "b", 1)]
    got = {(r.job, r["at"]): (r.granted, r.token) for r in incremental.leases(spark.createDataFrame(rows, "job string, at int, owner string, lasts int")).collect()}
    assert got == {("j", 0): (True, 1), ("j", 5): (False, 0), ("j", 6): (True, 1), ("j", 16): (True, 2), ("j", 17): (False, 0), ("k", 3): (True, 1)}


def test_search_atoms():
    q = sparse.parsed_query('foo file:src/.*py$ case:yes regex:"a b" "two words"')
    assert q == {"files": ["src/.*py$"], "regex": ["a b"], "plain": ["foo", "two words"], "case": True}


def test_terms_of_odd_names(spark):
    df = spark.createDataFrame([("HTTPServer getURLs parse_configs",), ("",), (None,)], "t string")
    got = [sorted(r[0]) for r in df.select(routes.route_terms(F.col("t"))).collect()]
    assert {"http", "server", "get", "parse", "configs", "config"} <= set(got[0]) and got[1:] == [[], []]


def test_skills_check_their_arguments():
    assert skills.coherent(["bm25_search", "crossencoder_rerank"], ["sparse"]) == []
    assert skills.coherent(["code_to_query", "llm_rerank", "nothing"], []) == ["llm_rerank needs the sparse view", "llm_rerank takes List[QueriedNode], code_to_query gives List[str]", "unknown skill nothing"]
    assert skills.arguments(skills.REGISTRY["bm25_search"], {"k": "10.5"}) == {"k": 10}
    for bad in ({"k": "x"}, {"k": True}, {"q": 1}):
        with pytest.raises(ValueError):
            skills.arguments(skills.REGISTRY["bm25_search"], bad)
    fits = lambda a, b: skills.fits(skills.parsed_kind(a), skills.parsed_kind(b))
    assert fits("List[X]", "List[List[X]]") and fits("Any", "int") and fits("Optional[int]", "int") and fits("Dict[str, List[int]]", "Dict[str, List[int]]")
    assert not fits("int", "str") and not fits("List[X]", "X") and not fits("Y", "X")
    assert len(skills.REGISTRY) == 14


SOURCES = {
    "python": ("import os\n\n@deco\ndef f(a,\n      b):\n    return {\n 'x': 1}\n\nclass A(B):\n    x = 1\n    async def m(self):\n        pass\n\nprint(1)\n", [("function", "f", 2, 6), ("method", "A.m", 10, 11)]),
    "go": ('package m\n\ntype T struct {\n\tA int\n}\n\nfunc (t *T) Run(x int) error {\n\treturn Errorf("}")\n}\n\nfunc main() {\n}\n', [("struct", "T", 2, 4), ("method", "T.Run", 6, 8), ("function", "main", 10, 11)]),
    "rust": ("pub struct P { x: i32 }\n\nimpl P {\n    pub fn new() -> Self {\n        P { x: 1 }\n    }\n}\n\nfn main() {}\n", [("struct", "P", 0, 0), ("method", "P.new", 3, 5), ("function", "main", 8, 8)]),
    "cpp": ("#include <a>\nnamespace n {\nclass C {\n  int get() const { return 1; }\n};\nint C::other(int a) {\n  return a;\n}\n}\nstatic int helper(int a)\n{\n  return a;\n}\n", [("method", "C.get", 3, 3), ("method", "C.other", 5, 7), ("function", "helper", 9, 12)]),
    "typescript": ("export interface I {\n  x: number;\n}\nexport class K {\n  run(y: string): void {\n    if (y) { return; }\n  }\n}\nexport const f = (z: number) => {\n  return z;\n};\n", [("interface", "I", 0, 2), ("method", "K.run", 4, 6), ("function", "f", 8, 10)]),
    "ruby": ("module M\n  class C\n    def run(x)\n      if x\n        1\n      end\n    end\n  end\nend\n\ndef top\n  2\nend\n", [("method", "C.run", 2, 6), ("function", "top", 10, 12)]),
    "java": ('package p;\npublic class Q {\n  public int getX() {\n    return x;\n  }\n  @Override\n  public String toString() { return "}"; }\n}\n', [("method", "Q.getX", 2, 4), ("method", "Q.toString", 5, 6)]),
    "lua": ("local M = {}\nfunction M.run(x)\n  if x then\n    return 1\n  end\nend\nlocal function h()\nend\n", [("method", "M.run", 1, 5), ("function", "h", 6, 7)]),
    "kotlin": ("class A(val x: Int) {\n  fun f(): Int {\n    return x\n  }\n}\nfun top() = 1\n", [("method", "A.f", 1, 3), ("function", "top", 5, 5)]),
    "php": ("<?php\nclass A {\n  public function f($x) {\n    return $x;\n  }\n}\nfunction g() { return 1; }\n", [("method", "A.f", 2, 4), ("function", "g", 6, 6)]),
    "csharp": ("namespace N {\n  public class A {\n    public int F(int x) {\n      return x;\n    }\n  }\n}\n", [("method", "A.F", 2, 4)]),
    "scala": ("object O {\n  def f(x: Int): Int = {\n    x\n  }\n}\n", [("method", "O.f", 1, 3)]),
    "swift": ("struct S {\n  func f() -> Int {\n    return 1\n  }\n}\nfunc g() {\n}\n", [("method", "S.f", 1, 3), ("function", "g", 5, 6)]),
    "javascript": ("class A {\n  run(x) {\n    return x;\n  }\n}\nfunction f() {\n}\nconst g = (x) => x;\n", [("method", "A.run", 1, 3), ("function", "f", 5, 6), ("function", "g", 7, 7)]),
}


LINES_IN_STRINGS = [
    ("python", 'def f(x):\n    """Says\ndef fake():\n    }\n"""\n    return f"{"\n\nclass A:\n    s = \'\'\'\n  def g(self):\n\'\'\'\n    def m(self):\n        pass\n', [("function", "f", 0, 5), ("method", "A.m", 11, 12)]),
    ("go", "func A() string {\n\treturn `}\nfunc Fake() {\n`\n}\n\nfunc B() {\n}\n", [("function", "A", 0, 4), ("function", "B", 6, 7)]),
    ("javascript", "function a() {\n  return `}\nfunction fake() {\n${x} \\` `;\n}\nfunction b() {\n}\n", [("function", "a", 0, 4), ("function", "b", 5, 6)]),
    ("rust", 'fn a() -> &str {\n    "}\nfn fake() {"\n}\nfn b() { r#"}"#; }\n', [("function", "a", 0, 3), ("function", "b", 4, 4)]),
    ("kotlin", 'fun a(): String {\n  return """}\nfun fake() {\n"""\n}\nfun b() { /* }\nfun fake() { */\n}\n', [("function", "a", 0, 4), ("function", "b", 5, 7)]),
    ("php", "<?php\nfunction a() {\n  return '}\nfunction fake() {\n';\n}\nfunction b() { }\n", [("function", "a", 1, 5), ("function", "b", 6, 6)]),
    ("lua", "function a()\n  local s = [[\nend\nfunction fake()\n]]\nend\nfunction b()\nend\n", [("function", "a", 0, 5), ("function", "b", 6, 7)]),
]


@pytest.mark.parametrize("name, source, want", LINES_IN_STRINGS)
def test_definitions_are_not_found_or_ended_inside_strings(name, source, want):
    assert [(k, n, a, b) for k, n, a, b, _ in chunkers.definitions(source, chunkers.BY_NAME[name]) if k != "class"] == want


@pytest.mark.parametrize("name", sorted(SOURCES))
def test_definitions_of_every_language(name):
    source, want = SOURCES[name]
    got = [(k, n, a, b) for k, n, a, b, _, _ in chunkers.chunked(source, "p", chunkers.BY_NAME[name]) if k not in ("header", "epilogue")]
    assert got == want
    assert set(SOURCES) == set(chunkers.BY_NAME)


def test_spans_and_sentences(spark):
    rows = [("f", 1, 5, 9), ("f", 2, 1, 5), ("f", 3, 10, 12), ("f", 4, 0, 4), ("g", 1, 1, 1)]
    got = intervals.distinct_spans(spark.createDataFrame(rows, "file string, rank int, first int, last int")).collect()
    assert {(r.file, r["rank"]) for r in got} == {("f", 1), ("f", 3), ("f", 4), ("g", 1)}
    body = "## Part\n`Loader` reads the files, e.g. big ones, from the store. `Loader` reads the files from a store.\n\nIt says 'Stop. Now!' and ends there quietly."
    s = reports.sentences(spark.createDataFrame([(1, body)], "page int, md string"), "page", "md")
    assert [r.sentence for r in s.orderBy("n").collect()] == ["`Loader` reads the files, e.g. big ones, from the store.", "`Loader` reads the files from a store.", "It says 'Stop. Now!' and ends there quietly."]
    assert [(r.left, r.right) for r in reports.sentence_redundancy(s, least=0.7, least_terms=4).collect()] == [(1, 2)]


def test_generated_and_supporting_files(spark):
    df = spark.createDataFrame([("a/dist/x.js",), ("a/x.min.js",), ("docs/x.py",), ("README.md",), ("src/x.py",), (None,)], "p string")
    assert [tuple(r) for r in df.select(text.is_generated_file(F.col("p")), text.is_supporting(F.col("p"))).collect()] == [(True, True), (True, True), (False, True), (False, True), (False, False), (False, False)]


def test_lookups_with_ties_against_plain_search(spark):
    r = random.Random(9)
    spans = [(f"f{r.randrange(2)}", a, a + r.choice([-1, 0, 3, 90]), v) for v in range(80) for a in [r.randrange(0, 200)]]
    spans += [("f0", 5, 9, 900), ("f0", 5, 9, 901)]
    points = [(q, f"f{r.randrange(3)}", r.randrange(0, 200)) for q in range(150)] + [(900, "f0", 7), (900, "f0", 7), (901, None, 7), (902, "f0", None)]
    s = spark.createDataFrame(spans, "file string, first int, last int, vid int")
    p = spark.createDataFrame(points, "q int, file string, line int")
    order = [F.col("last") - F.col("first"), -F.col("first"), F.col("vid")]
    got = {(x.q, x.vid) for x in intervals.points_in_intervals(p, s, ["file"], "line", "first", "last", order).collect()}
    want = set()
    for q, file, line in points:
        held = [(b - a, -a, v) for f, a, b, v in spans if f == file and line is not None and a <= line <= b]
        if held:
            want.add((q, min(held)[2]))
    assert got == want and len([x for x in got if x[0] == 900]) == 1
    occ = [(f"f{r.randrange(2)}", a, c, a, c + r.randrange(1, 9), r.randrange(2), r.choice(["x", "y", "local 1"])) for _ in range(120) for a in [r.randrange(0, 70)] for c in [r.randrange(0, 20)]]
    asked = [(i, f"f{r.randrange(2)}", r.randrange(0, 70), r.randrange(0, 20)) for i in range(60)]
    o = spark.createDataFrame(occ, "file string, start_line int, start_char int, end_line int, end_char int, roles int, symbol string")
    found = {}
    for x in intervals.references(spark.createDataFrame(asked, "query_id int, file string, line int, character int"), o, k=5).orderBy("query_id", "rank").collect():
        found.setdefault(x.query_id, []).append((x.file, x.start_line, x.start_char, x.end_line, x.end_char))
    for i, file, line, ch in asked:
        held = [(e - a, d - c, a, c, s) for f, a, c, e, d, _, s in occ if f == file and (a, c) <= (line, ch) < (e, d)]
        if not held:
            assert i not in found
            continue
        symbol = min(held)[4]
        places = sorted({(f, a, c, e, d) for f, a, c, e, d, _, s in occ if s == symbol and (not s.startswith("local ") or f == file)})
        assert found[i] == places[:5]
