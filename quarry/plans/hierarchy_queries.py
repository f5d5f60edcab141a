"""Queries over containment trees, code and module maps, and regions of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import communities, containment, graph
from quarry.registry import query

from .views import CODE_SQL, code_edges, code_files, code_nodes

_C = f"WITH RECURSIVE {CODE_SQL}"
# These tables' files lie below src0, src1, ...: no common source root.
_TREE = """pth AS (SELECT path, string_split(path, '/') AS p FROM cf),
dg AS (SELECT s.vid, count(e.v) AS degree FROM sym s LEFT JOIN (SELECT unnest([src, dst]) AS v FROM ce WHERE type = 'reference') e ON e.v = s.vid GROUP BY 1),
imp AS (SELECT vid, round(ln(1 + degree) / ln(1 + (SELECT max(degree) FROM dg)), 4) AS importance FROM dg),
tn AS (SELECT 'root' AS hid, NULL AS parent, 'root' AS kind, NULL::BIGINT AS vid, NULL AS file, 0.0::DOUBLE AS doi
  UNION ALL SELECT DISTINCT 'dir::' || array_to_string(p[1:k], '/'), CASE WHEN k = 1 THEN 'root' ELSE 'dir::' || array_to_string(p[1:k - 1], '/') END, 'directory', NULL, NULL, 0.0 FROM pth, (VALUES (1), (2), (3), (4)) t(k) WHERE k < len(p)
  UNION ALL SELECT 'file::' || path, CASE WHEN len(p) = 1 THEN 'root' ELSE 'dir::' || array_to_string(p[1:len(p) - 1], '/') END, 'file', NULL, path, 0.0 FROM pth
  UNION ALL SELECT 'symbol::' || vid, CASE WHEN type = 'method' THEN 'symbol::' || (vid - 2) ELSE 'file::' || file END, 'symbol', vid, file, importance FROM sym JOIN imp USING (vid))"""
_CHAINS = f"""{_TREE},
chn(hid, chain, top) AS (SELECT hid, [hid], parent FROM tn UNION ALL SELECT chn.hid, list_append(chain, tn.hid), tn.parent FROM chn JOIN tn ON tn.hid = chn.top),
ch AS (SELECT hid, chain FROM chn WHERE top IS NULL)"""


def _tree(spark: SparkSession, d: str) -> DataFrame:
    return graph.checkpointed(containment.tree(code_files(spark, d).select("path"), code_nodes(spark, d), code_edges(spark, d)))


@query("g28_containment_tree", f"WITH {CODE_SQL}, {_TREE} SELECT hid, parent, kind, doi FROM tn")
def g28(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).select("hid", "parent", "kind", "doi")


@query("g29_rollup", f"""{_C}, {_CHAINS}, x AS (SELECT unnest(chain) AS up, hid FROM ch), s AS (SELECT up AS hid, count(*) FILTER (WHERE kind = 'symbol') AS symbol_count, round(max(doi), 4) AS doi FROM x JOIN tn ON tn.hid = x.hid GROUP BY 1)
SELECT hid, (SELECT count(*) FROM tn c WHERE c.parent = s.hid) AS child_count, symbol_count, doi FROM s""")
def g29(spark: SparkSession, d: str) -> DataFrame:
    t = _tree(spark, d)
    return containment.rollup(t, containment.chains(t))


@query("g30_depths", f"{_C}, {_CHAINS} SELECT kind, (len(chain) - 1)::INTEGER AS depth, count(*) AS n FROM ch JOIN tn USING (hid) GROUP BY 1, 2")
def g30(spark: SparkSession, d: str) -> DataFrame:
    t = _tree(spark, d)
    return containment.with_depths(t, containment.chains(t)).groupBy("kind", "depth").agg(F.count("*").alias("n"))


_RT = """e2 AS (SELECT DISTINCT src AS source, dst AS target FROM ce WHERE type = 'reference' AND src <> dst), ab AS (SELECT source, target, a.chain AS a, b.chain AS b FROM e2 JOIN ch a ON a.hid = 'symbol::' || source JOIN ch b ON b.hid = 'symbol::' || target),
lc AS (SELECT *, list_filter(a, lambda x: list_contains(b, x))[1] AS lca FROM ab)"""


def _refs(spark: SparkSession, d: str) -> DataFrame:
    return code_edges(spark, d).where("type = 'reference' AND src <> dst").select(F.col("src").alias("source"), F.col("dst").alias("target")).distinct()


@query("g32_routes", f"{_C}, {_CHAINS}, {_RT} SELECT source, target, lca, len(a[1:list_position(a, lca)] || b[1:list_position(b, lca) - 1])::INTEGER AS length FROM lc")
def g32(spark: SparkSession, d: str) -> DataFrame:
    t = _tree(spark, d)
    return containment.routed_edges(_refs(spark, d), t, containment.chains(t)).select("source", "target", "lca", F.size("bundle_path").alias("length"))


@query("g34_edge_routes", f"""{_C}, {_CHAINS}, {_RT} SELECT source, target, array_to_string(a[1:list_position(a, lca)] || list_reverse(b[1:list_position(b, lca) - 1]), '>') AS path, t.kind AS lca_kind, (SELECT file FROM sym WHERE vid = source) <> (SELECT file FROM sym WHERE vid = target) AS cross_file
FROM lc JOIN tn t ON t.hid = lca""")
def g34(spark: SparkSession, d: str) -> DataFrame:
    t = _tree(spark, d)
    out = containment.routed_edges(_refs(spark, d), t, containment.chains(t))
    return out.select("source", "target", F.array_join("bundle_path", ">").alias("path"), "lca_kind", "cross_file")


@query("g33_view")
def g33(spark: SparkSession, d: str) -> DataFrame:
    t = _tree(spark, d)
    shown = code_nodes(spark, d).where("type <> 'file' AND vid % 9 = 0").select("vid", (F.col("vid") == 8000000000).alias("is_root"), F.when(F.col("vid") == 8000000000, 0).otherwise(1).alias("depth"), F.lit(0.6).alias("importance"))
    return containment.view(t, containment.chains(t), shown).select("hid", "parent", "kind", "child_count", "symbol_count", "doi", "open")


@query("g26_entry_affinity", f"""{_C}, en AS (SELECT path, (doc_id // 10)::INTEGER AS rank FROM cf WHERE doc_id % 10 = 0)
SELECT vid, min(rank * 2)::INTEGER AS affinity FROM sym JOIN en ON sym.file = en.path GROUP BY 1""")
def g26(spark: SparkSession, d: str) -> DataFrame:
    entries = code_files(spark, d).where("doc_id % 10 = 0").selectExpr("path", "int(doc_id div 10) AS rank")
    return containment.entry_affinity(code_nodes(spark, d), code_edges(spark, d), entries)


@query("g27_default_seed", f"""{_C}, en AS (SELECT path, (doc_id // 10)::INTEGER AS rank FROM cf WHERE doc_id % 10 = 3), o AS (SELECT src, count(*) AS n FROM ce WHERE type = 'reference' GROUP BY 1)
SELECT vid, name FROM sym JOIN en ON sym.file = en.path LEFT JOIN o ON src = vid ORDER BY rank, coalesce(n, 0) DESC, name DESC LIMIT 1""")
def g27(spark: SparkSession, d: str) -> DataFrame:
    entries = code_files(spark, d).where("doc_id % 10 = 3").selectExpr("path", "int(doc_id div 10) AS rank")
    return containment.default_seed(code_nodes(spark, d), code_edges(spark, d), entries)


@query("g10_region", f"""{_C}, b AS (SELECT src, dst FROM ce WHERE type = 'reference' UNION SELECT dst, src FROM ce WHERE type = 'reference'), w(vid, depth) AS (SELECT vid, 0 FROM sym WHERE vid IN (8000000010, 8000000050) UNION SELECT dst, depth + 1 FROM w JOIN b ON src = vid WHERE depth < 2)
SELECT vid, min(depth)::INTEGER AS depth FROM w GROUP BY 1""")
def g10(spark: SparkSession, d: str) -> DataFrame:
    n = code_nodes(spark, d)
    return graph.region(n, code_edges(spark, d), n.where("vid IN (8000000010, 8000000050)"), 2, ["reference"]).select("vid", "depth")


@query("g12_region_nodes", f"""{_C}, b AS (SELECT src, dst FROM ce UNION SELECT dst, src FROM ce), w(vid, depth) AS (SELECT 8000000010::BIGINT, 0 UNION SELECT dst, depth + 1 FROM w JOIN b ON src = vid WHERE depth < 1)
SELECT DISTINCT vid FROM w JOIN sym USING (vid) WHERE start_line <> end_line AND type IN ('class', 'method') AND NOT regexp_matches(lower(file), '(^|/)(test|tests|spec|specs|__tests__)/') AND NOT regexp_matches(regexp_extract(lower(file), '[^/]*$'), '^test|_test[.][a-z]+$|[.](test|spec)[.]')""")
def g12(spark: SparkSession, d: str) -> DataFrame:
    n = code_nodes(spark, d)
    keep = graph.usable_nodes() & F.col("type").isin("class", "method")
    return graph.region(n, code_edges(spark, d), n.where("vid = 8000000010"), 1, keep=keep).select("vid")


@query("g4_bounded_edges", f"""{_C}, e AS (SELECT DISTINCT src, dst FROM ce WHERE type = 'reference'), l1 AS (SELECT * FROM e WHERE src = 8000000011 ORDER BY src, dst LIMIT 12) SELECT DISTINCT dst AS vid, 1 AS depth FROM l1 WHERE dst <> 8000000011""")
def g4(spark: SparkSession, d: str) -> DataFrame:
    seeds = spark.createDataFrame([(8000000011,)], "vid bigint")
    return graph.dependencies(code_edges(spark, d), seeds, 1, max_edges=12)


@query("g8_trace", f"""{_C}, e AS (SELECT DISTINCT src, dst FROM ce WHERE type = 'contain'), p AS (SELECT src FROM e WHERE dst = 8000000006) SELECT 0 AS hop, (SELECT src FROM e WHERE dst = (SELECT src FROM p)) AS vid UNION ALL SELECT 1, src FROM p UNION ALL SELECT 2, 8000000006""")
def g8(spark: SparkSession, d: str) -> DataFrame:
    return graph.trace(code_edges(spark, d).where("type = 'contain'"), 7000000001, 8000000006, 4)


@query("g9_callers_callees", f"""{_C}, a(symbol, k, c) AS (VALUES ('sym3', 8000000003, 1), ('twice', NULL, 2), ('none', NULL, 0)),
r AS (SELECT symbol, 'callee' AS relation, dst AS vid FROM a JOIN ce ON src = k UNION ALL SELECT symbol, 'caller', src FROM a JOIN ce ON dst = k), x AS (SELECT symbol, 'found' AS status, relation, vid, row_number() OVER (PARTITION BY symbol ORDER BY relation, vid)::INTEGER AS rank FROM r)
SELECT * FROM x WHERE rank <= 40 UNION ALL SELECT symbol, CASE c WHEN 0 THEN 'not found' ELSE 'ambiguous' END, NULL, NULL, 0 FROM a WHERE c <> 1""")
def g9(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame([("sym3", 8000000003, 1), ("twice", None, 2), ("none", None, 0)], "symbol string, vid bigint, candidates int")
    return graph.callers_and_callees(code_nodes(spark, d), code_edges(spark, d), asked)


@query("g14_tree_rows", f"""{_C}, e AS (SELECT DISTINCT src, dst FROM ce WHERE type = 'contain'), w(vid, level, parent) AS (SELECT 7000000001::BIGINT, 0, NULL::BIGINT UNION ALL SELECT dst, level + 1, src FROM w JOIN e ON src = w.vid)
SELECT vid, level::INTEGER AS level, parent FROM w""")
def g14(spark: SparkSession, d: str) -> DataFrame:
    n = code_nodes(spark, d).withColumn("name", F.lit("x"))
    return graph.tree_rows(n, code_edges(spark, d), 7000000001, hops=-1, edge_types=["contain"]).select("vid", "level", "parent")


_SEED = "8000000010, 8000000023, 8000000035"


def _seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(int(v), i + 1, 1.0 / (i + 1)) for i, v in enumerate(_SEED.split(", "))], "vid bigint, rank int, score double")


_REG = f"""b AS (SELECT src, dst FROM ce UNION SELECT dst, src FROM ce), w(vid, depth) AS (SELECT vid, 0 FROM sym WHERE vid IN ({_SEED}) UNION SELECT dst, depth + 1 FROM w JOIN b ON src = vid WHERE depth < 2),
rg AS (SELECT DISTINCT vid FROM w JOIN sym USING (vid) WHERE start_line <> end_line AND NOT regexp_matches(lower(file), '(^|/)(test|tests|spec|specs|__tests__)/') AND NOT regexp_matches(regexp_extract(lower(file), '[^/]*$'), '^test|_test[.][a-z]+$|[.](test|spec)[.]')),
rk AS (SELECT vid, row_number() OVER (ORDER BY vid)::INTEGER AS rank FROM rg ORDER BY vid LIMIT 30)"""


@query("g15_expand_region", f"{_C}, {_REG} SELECT vid, rank FROM rk")
def g15(spark: SparkSession, d: str) -> DataFrame:
    return graph.expand_region(code_nodes(spark, d), code_edges(spark, d), _seeds(spark), 30)


@query("g16_expand_candidates", f"""{_C}, {_REG}, sd(vid, r) AS (VALUES {", ".join(f"({v}, {i + 1})" for i, v in enumerate(_SEED.split(", ")[:2]))}),
b2 AS (SELECT src, dst FROM ce UNION SELECT dst, src FROM ce), w2(vid, depth) AS (SELECT vid, 0 FROM sd UNION SELECT dst, depth + 1 FROM w2 JOIN b2 ON src = vid WHERE depth < 2),
r2 AS (SELECT vid, row_number() OVER (ORDER BY vid) AS r FROM (SELECT DISTINCT vid FROM w2 JOIN sym USING (vid) WHERE start_line <> end_line AND NOT regexp_matches(lower(file), '(^|/)(test|tests|spec|specs|__tests__)/') AND NOT regexp_matches(regexp_extract(lower(file), '[^/]*$'), '^test|_test[.][a-z]+$|[.](test|spec)[.]')) ORDER BY vid LIMIT 20),
u AS (SELECT vid, min((t, r)) AS k, min(t) AS t FROM (SELECT vid, 0 AS t, r FROM sd UNION ALL SELECT vid, 1, r FROM r2) GROUP BY 1)
SELECT vid, CASE t WHEN 0 THEN 'seed' ELSE 'expanded' END AS source, row_number() OVER (ORDER BY k, vid)::INTEGER AS rank FROM u ORDER BY k, vid LIMIT 20""")
def g16(spark: SparkSession, d: str) -> DataFrame:
    return graph.expand_candidates(code_nodes(spark, d), code_edges(spark, d), _seeds(spark), 2, 20)


_PJ = """m AS (SELECT vid, regexp_replace(file, '/[^/]*$', '') AS m FROM sym), pj AS (SELECT a.m AS source, b.m AS target, count(DISTINCT (src, dst)) AS weight FROM ce JOIN m a ON src = a.vid JOIN m b ON dst = b.vid WHERE type = 'reference' AND a.m <> b.m GROUP BY 1, 2),
md AS (SELECT m, sum(weight)::BIGINT AS degree FROM (SELECT source AS m, weight FROM pj UNION ALL SELECT target, weight FROM pj) GROUP BY 1)"""


def _modules(spark: SparkSession, d: str) -> DataFrame:
    return code_nodes(spark, d).where("type <> 'file'").withColumn("module", F.regexp_replace("file", "/[^/]*$", ""))


@query("g19_focus_modules", f"""{_C}, {_PJ}, s AS (SELECT min(source) AS f FROM pj), tie AS (SELECT a, b, sum(weight) AS w FROM (SELECT source AS a, target AS b, weight FROM pj UNION ALL SELECT target, source, weight FROM pj) GROUP BY 1, 2),
n AS (SELECT b AS module, 1 + row_number() OVER (ORDER BY w DESC, b) AS place FROM tie, s WHERE a = f) SELECT f AS module, 0 AS hops, 1::BIGINT AS place FROM s UNION ALL SELECT module, 1, place FROM n WHERE place <= 6""")
def g19(spark: SparkSession, d: str) -> DataFrame:
    p = graph.project_modules(_modules(spark, d), code_edges(spark, d), "module")
    focus = p.agg(F.min("source")).first()[0]
    return graph.focus_modules(p, focus, 1, 6)


@query("g20_module_hops", f"""{_C}, {_PJ}, b AS (SELECT source AS src, target AS dst FROM pj UNION SELECT target, source FROM pj), w(module, hops) AS (SELECT min(source), 0 FROM pj UNION SELECT dst, hops + 1 FROM w JOIN b ON src = module WHERE hops < 4) SELECT module, min(hops)::INTEGER AS hops FROM w GROUP BY 1""")
def g20(spark: SparkSession, d: str) -> DataFrame:
    p = graph.project_modules(_modules(spark, d), code_edges(spark, d), "module")
    return graph.module_hops(p, p.agg(F.min("source")).first()[0])


@query("g21_module_scores")
def g21(spark: SparkSession, d: str) -> DataFrame:
    p = graph.project_modules(_modules(spark, d), code_edges(spark, d), "module")
    return communities.module_scores(p.select(F.col("source").alias("module")).union(p.select("target")).distinct(), p)


@query("g22_symbol_scores")
def g22(spark: SparkSession, d: str) -> DataFrame:
    n = code_nodes(spark, d).where("type <> 'file'")
    return containment.symbol_scores(n, code_edges(spark, d), n.where("type = 'field'"), communities=True)


@query("g23_codemap", f"""{_C}, b AS (SELECT src, dst FROM ce WHERE type = 'reference' UNION SELECT dst, src FROM ce WHERE type = 'reference'), w(vid, depth) AS (SELECT 8000000010::BIGINT, 0 UNION SELECT dst, depth + 1 FROM w JOIN b ON src = vid WHERE depth < 2),
r AS (SELECT vid, min(depth)::INTEGER AS depth FROM w GROUP BY 1) SELECT vid, depth, depth = 0 AS is_root FROM r ORDER BY depth, vid LIMIT 40""")
def g23(spark: SparkSession, d: str) -> DataFrame:
    n, _ = containment.codemap(code_nodes(spark, d), code_edges(spark, d), spark.createDataFrame([(8000000010,)], "vid bigint"))
    return n.select("vid", "depth", "is_root")


@query("g24_page_subgraph", f"""{_C}, c AS (SELECT vid FROM sym WHERE vid % 5 = 0 ORDER BY vid LIMIT 18) SELECT src AS source, dst AS target, count(*) AS weight FROM ce WHERE type = 'reference' AND src <> dst AND src IN (SELECT vid FROM c) AND dst IN (SELECT vid FROM c) GROUP BY 1, 2""")
def g24(spark: SparkSession, d: str) -> DataFrame:
    n = code_nodes(spark, d)
    cited = n.where("type <> 'file' AND vid % 5 = 0").select("vid", F.col("vid").alias("rank"))
    _, e = containment.page_subgraph(n, code_edges(spark, d), cited)
    return e


@query("g25_modulemap", f"""{_C}, {_PJ}, t AS (SELECT m, degree FROM md ORDER BY degree DESC, m LIMIT 8), i AS (SELECT * FROM pj WHERE source IN (SELECT m FROM t) AND target IN (SELECT m FROM t))
SELECT m AS module, degree, (SELECT count(*) FROM i WHERE target = m) AS ref_count FROM t""")
def g25(spark: SparkSession, d: str) -> DataFrame:
    modules, _ = containment.modulemap(_modules(spark, d), code_edges(spark, d), "module", max_nodes=8)
    return modules.select("module", "degree", "ref_count")
