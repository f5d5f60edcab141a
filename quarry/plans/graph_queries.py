"""Queries over the property graph, source positions and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators import communities, containment, facts, graph, intervals
from quarry.registry import query, table

from .views import GRAPH_SQL, edges, nodes

_G = f"WITH RECURSIVE {GRAPH_SQL}"


def _seeds(spark: SparkSession, *ids: int) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "vid bigint")


@query("j1_successors", f"{_G} SELECT src AS seed, dst AS vid FROM edges WHERE src BETWEEN 2000000001 AND 2000000020")
def j1(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return graph.successors(n, edges(spark, d), n.where("vid BETWEEN 2000000001 AND 2000000020"))


@query("j1_successors_typed", f"{_G} SELECT DISTINCT src AS seed, dst AS vid FROM edges WHERE src BETWEEN 2000000001 AND 2000000020 AND type = 'reference'")
def j1_typed(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return graph.successors(n, edges(spark, d), n.where("vid BETWEEN 2000000001 AND 2000000020"), ["reference"])


@query("j2_predecessors", f"{_G} SELECT dst AS seed, src AS vid FROM edges WHERE dst BETWEEN 3000000001 AND 3000000010")
def j2(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return graph.predecessors(n, edges(spark, d), n.where("vid BETWEEN 3000000001 AND 3000000010"))


@query("j3_neighbors", f"{_G} SELECT DISTINCT v AS vid FROM (SELECT dst AS v FROM edges WHERE src = 3000000001 UNION ALL SELECT src FROM edges WHERE dst = 3000000001)")
def j3(spark: SparkSession, d: str) -> DataFrame:
    return graph.directed(edges(spark, d), "both").where("src = 3000000001").select(F.col("dst").alias("vid")).distinct()


@query("j5_seed_expansion", f"""{_G}, s AS (SELECT vid AS seed, row_number() OVER (ORDER BY vid) AS seed_rank, 1.0 / row_number() OVER (ORDER BY vid) AS sc FROM nodes WHERE vid BETWEEN 2000000001 AND 2000000010),
h AS (SELECT DISTINCT seed, seed_rank, sc, dst AS vid, 0 AS side FROM s JOIN edges ON seed = src UNION ALL SELECT DISTINCT seed, seed_rank, sc, src, 1 FROM s JOIN edges ON seed = dst),
f AS (SELECT h.*, row_number() OVER (PARTITION BY seed, side ORDER BY h.vid) AS nth FROM h JOIN nodes USING (vid) WHERE type <> 'nation'),
c AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY nth, side)::INTEGER AS n FROM f) SELECT seed, seed_rank::INTEGER AS seed_rank, n, vid, (sc * 0.5)::DOUBLE AS score FROM c WHERE n <= 3""")
def j5(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    seeds = n.where("vid BETWEEN 2000000001 AND 2000000010").select("vid", F.row_number().over(W.orderBy("vid")).alias("rank")).withColumn("score", 1.0 / F.col("rank"))
    return graph.expand_seeds(n, edges(spark, d), seeds, 3, F.col("type") != "nation")


@query("j7_symbol_resolution", f"""{_G}, b AS (SELECT vid, name, regexp_extract(name, '[^ #]*$') AS bare FROM nodes WHERE type IN ('nation', 'region', 'supplier')),
a(symbol) AS (VALUES ('FRANCE'), ('Supplier#000000001'), ('ASIA'), ('000000002'), ('missing')),
t AS (SELECT symbol, vid, 0 AS tier FROM a JOIN b ON name = symbol UNION ALL SELECT symbol, vid, 1 FROM a JOIN b ON name = symbol || '()' UNION ALL SELECT symbol, vid, 2 FROM a JOIN b ON bare = symbol),
m AS (SELECT *, min(tier) OVER (PARTITION BY symbol) AS best FROM t) SELECT symbol, vid, tier, count(*) OVER (PARTITION BY symbol) AS candidates, row_number() OVER (PARTITION BY symbol ORDER BY vid)::INTEGER AS rank FROM m WHERE tier = best""")
def j7(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).where("type IN ('nation', 'region', 'supplier')").withColumn("bare", F.regexp_extract("name", "[^ #]*$", 0))
    asked = spark.createDataFrame([(s,) for s in ("FRANCE", "Supplier#000000001", "ASIA", "000000002", "missing")], "symbol string")
    return graph.resolve(n, asked)


@query("j9_range_query", f"""{_G}, i AS (SELECT vid FROM nodes WHERE file = 'o7' AND start_line <= 6 AND end_line >= 3)
SELECT 'node' AS kind, vid AS src, vid AS dst, CAST(NULL AS BIGINT) AS anchor_line FROM i UNION ALL SELECT 'outgoing', src, dst, anchor_line FROM edges WHERE anchor_file = 'o7' AND anchor_line BETWEEN 3 AND 6
UNION ALL SELECT 'incoming', src, dst, anchor_line FROM edges WHERE dst IN (SELECT vid FROM i) AND src <> dst""")
def j9(spark: SparkSession, d: str) -> DataFrame:
    return graph.range_query(nodes(spark, d), edges(spark, d), "o7", 3, 6)


@query("j11_point_in_interval", f"""{_G}, p AS (SELECT l_orderkey * 10 + l_linenumber AS q, 'o' || l_orderkey % 25 AS file, l_orderkey * 7 % 500 AS line FROM lineitem),
h AS (SELECT q, vid, row_number() OVER (PARTITION BY q ORDER BY end_line - start_line, start_line DESC, vid) AS n FROM p JOIN nodes ON nodes.file = p.file AND line BETWEEN start_line AND end_line)
SELECT q, vid FROM h WHERE n = 1""")
def j11(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS q", "concat('o', l_orderkey % 25) AS file", "l_orderkey * 7 % 500 AS line")
    order = [F.col("end_line") - F.col("start_line"), -F.col("start_line"), F.col("vid")]
    return intervals.points_in_intervals(points, nodes(spark, d), ["file"], "line", "start_line", "end_line", order).select("q", "vid")


_OCC = """occ AS (SELECT 'o' || l_orderkey % 25 AS file, (l_orderkey % 300)::INTEGER AS start_line, (l_linenumber * 8)::INTEGER AS start_char, (l_orderkey % 300)::INTEGER AS end_line,
  (l_linenumber * 8 + 5)::INTEGER AS end_char, CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS roles, CASE WHEN l_partkey % 3 = 0 THEN 'local ' || l_partkey % 20 ELSE 'sym' || l_partkey % 40 END AS symbol FROM lineitem),
pt AS (SELECT l_orderkey AS query_id, 'o' || l_orderkey % 25 AS pf, l_orderkey % 300 AS line, l_linenumber * 8 + 2 AS ch FROM lineitem WHERE l_linenumber = 2),
held AS (SELECT * FROM (SELECT query_id, file, symbol, row_number() OVER (PARTITION BY query_id ORDER BY end_line - start_line, end_char - start_char, start_line, start_char, symbol) AS n FROM pt JOIN occ ON pf = file
  WHERE (start_line < line OR start_line = line AND start_char <= ch) AND (line < end_line OR line = end_line AND ch < end_char)) WHERE n = 1)"""
_OCC_OUT = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY file, start_line, start_char, end_line, end_char)::INTEGER AS rank FROM
  (SELECT DISTINCT query_id, o.file, start_line, start_char, end_line, end_char, o.symbol FROM held JOIN occ o ON held.symbol = o.symbol AND (o.symbol NOT LIKE 'local %' OR o.file = held.file) WHERE {})) WHERE rank <= {}"""


def _occurrences(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "lineitem")
    occ = rows.selectExpr(
        "concat('o', l_orderkey % 25) AS file", "int(l_orderkey % 300) AS start_line", "int(l_linenumber * 8) AS start_char", "int(l_orderkey % 300) AS end_line", "int(l_linenumber * 8 + 5) AS end_char",
        "if(l_linenumber = 1, 1, 0) AS roles", "if(l_partkey % 3 = 0, concat('local ', l_partkey % 20), concat('sym', l_partkey % 40)) AS symbol",
    )
    points = rows.where("l_linenumber = 2").selectExpr("l_orderkey AS query_id", "concat('o', l_orderkey % 25) AS file", "int(l_orderkey % 300) AS line", "int(l_linenumber * 8 + 2) AS character")
    return points, occ


@query("j12_definitions", f"WITH {_OCC} {_OCC_OUT.format('roles & 1 = 1', 8)}")
def j12(spark: SparkSession, d: str) -> DataFrame:
    return intervals.definitions(*_occurrences(spark, d))


@query("j13_references", f"WITH {_OCC} {_OCC_OUT.format('roles & 1 = 0', 40)}")
def j13(spark: SparkSession, d: str) -> DataFrame:
    return intervals.references(*_occurrences(spark, d), include_declaration=False)


@query("j16_definition_index", "WITH f AS (SELECT p_partkey AS symbol, p_type || p_size % 5 AS moniker FROM part) SELECT moniker, count(*) AS n, CASE WHEN count(*) = 1 THEN min(symbol) END AS symbol FROM f GROUP BY 1")
def j16(spark: SparkSession, d: str) -> DataFrame:
    return facts.definition_index(table(spark, d, "part").selectExpr("p_partkey AS symbol", "concat(p_type, p_size % 5) AS moniker"), "moniker", "symbol")


@query("j17_edge_resolution", """WITH f AS (SELECT p_partkey AS symbol, p_type || p_size % 5 AS moniker FROM part), u AS (SELECT moniker, min(symbol) AS symbol FROM f GROUP BY 1 HAVING count(*) = 1),
e AS (SELECT l_orderkey, l_linenumber, p_type || p_size % 5 AS moniker FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, l_linenumber, u.symbol AS target, CASE WHEN u.symbol IS NULL THEN 'unresolved' ELSE 'exact' END AS provenance FROM e LEFT JOIN u USING (moniker)""")
def j17(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").selectExpr("p_partkey", "concat(p_type, p_size % 5) AS moniker")
    e = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "moniker")
    return facts.resolve_edges(e, part.withColumnRenamed("p_partkey", "symbol"), "moniker", "symbol").select("l_orderkey", "l_linenumber", "target", "provenance")


# Edges name parts by type (and by size and brand); a pass for those that are unique, then one within the brand.
_PASSES = """WITH f AS (SELECT p_partkey AS symbol, p_type || p_size % 5 AS moniker, p_brand AS file FROM part),
e AS (SELECT l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS id, any_value(p_type || p_size % 5) AS moniker, any_value(p_brand) AS file FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
u AS (SELECT moniker, min(symbol) AS target FROM f GROUP BY 1 HAVING count(*) = 1), o AS (SELECT file, moniker, min(symbol) AS target FROM f GROUP BY 1, 2 HAVING count(*) = 1),
r AS (SELECT id, coalesce(u.target, o.target) AS target, CASE WHEN u.target IS NOT NULL THEN 'exact' WHEN o.target IS NOT NULL THEN 'same_file' END AS pass FROM e LEFT JOIN u USING (moniker) LEFT JOIN o USING (file, moniker))"""


def _passes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, d, "part").selectExpr("p_partkey AS symbol", "concat(p_type, p_size % 5) AS moniker", "p_brand AS file")
    e = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("symbol")).selectExpr("l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS id", "moniker", "file").dropDuplicates(["id"])
    return facts.resolve_in_passes(e, part, [("exact", facts.exact_pass), ("same_file", facts.same_file_pass)])


@query("x6_resolved_in_passes", f"{_PASSES} SELECT id, target, pass FROM r")
def x6(spark: SparkSession, d: str) -> DataFrame:
    return _passes(spark, d)[0].select("id", "target", "pass")


@query("x6_pass_report", f"""{_PASSES} SELECT 'exact' AS pass, 0 AS place, count(*) AS seen, count(*) FILTER (WHERE pass = 'exact') AS resolved FROM r
UNION ALL SELECT 'same_file', 1, count(*) FILTER (WHERE pass IS DISTINCT FROM 'exact'), count(*) FILTER (WHERE pass = 'same_file') FROM r""")
def x6_report(spark: SparkSession, d: str) -> DataFrame:
    return _passes(spark, d)[1]


@query("j18_rule_edges", """WITH f AS (SELECT p_partkey AS symbol, p_type || p_size AS moniker FROM part), u AS (SELECT moniker, min(symbol) AS symbol FROM f GROUP BY 1 HAVING count(*) = 1),
r AS (SELECT DISTINCT a.p_type || a.p_size AS source_moniker, b.p_type || b.p_size AS target_moniker FROM lineitem JOIN part a ON l_partkey = a.p_partkey JOIN part b ON b.p_partkey = l_partkey // 2 + l_suppkey)
SELECT s.symbol AS source, t.symbol AS target, 'route' AS kind, 0.9::DOUBLE AS confidence FROM r JOIN u s ON s.moniker = source_moniker JOIN u t ON t.moniker = target_moniker""")
def j18(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "part").selectExpr("p_partkey AS symbol", "concat(p_type, p_size) AS moniker")
    pairs = table(spark, d, "lineitem").selectExpr("l_partkey AS one", "l_partkey div 2 + l_suppkey AS two").distinct()
    one, two = f.selectExpr("symbol AS one", "moniker AS source_moniker"), f.selectExpr("symbol AS two", "moniker AS target_moniker")
    return facts.rule_edges(pairs.join(one, "one").join(two, "two").select("source_moniker", "target_moniker").distinct(), f, "route")


@query("e39_fact_batches", """WITH s AS (SELECT p_brand AS file, p_size::BIGINT AS line, p_partkey AS symbol, p_name AS name FROM part),
n AS (SELECT *, (row_number() OVER (PARTITION BY file ORDER BY line, symbol) - 1) // 50 AS part FROM s),
b AS (SELECT file, part, count(*) AS symbols, '{"file":' || to_json(file) || ',"part":' || part || ',"symbols":[' || string_agg('{"line":' || line || ',"name":' || to_json(name) || ',"symbol":' || symbol || '}', ',' ORDER BY line, symbol) || ']}' AS j FROM n GROUP BY 1, 2)
SELECT file, part, symbols, sha256(j) AS digest FROM b""")
def e39(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "part").selectExpr("p_brand AS file", "CAST(p_size AS BIGINT) AS line", "p_partkey AS symbol", "p_name AS name")
    return facts.batches(s, "file", ["line", "symbol", "name"], 50).select("file", "part", F.size("symbols").cast("bigint").alias("symbols"), "digest")


@query("j22_span_overlap", f"""{_G} SELECT a.vid AS a, b.vid AS b FROM nodes a JOIN nodes b ON a.file = b.file AND a.start_line <= b.end_line AND b.start_line <= a.end_line WHERE a.type = 'supplier' AND b.type = 'supplier' AND a.vid < b.vid""")
def j22(spark: SparkSession, d: str) -> DataFrame:
    s = nodes(spark, d).where("type = 'supplier'")
    a = s.selectExpr("vid AS a", "file", "start_line AS s1", "end_line AS e1")
    b = s.selectExpr("vid AS b", "file", "start_line AS s2", "end_line AS e2")
    return intervals.overlap_join(a, b, ["file"], "s1", "e1", "s2", "e2").where("a < b").select("a", "b")


@query("j27_graph_difference", f"""{_G}, r AS (SELECT DISTINCT src, dst, type FROM edges WHERE type <> 'contain'), c AS (SELECT DISTINCT src, dst, type FROM edges WHERE src % 7 <> 0)
SELECT 'missing' AS side, type, count(*) AS n FROM (SELECT * FROM r EXCEPT SELECT * FROM c) GROUP BY 2 UNION ALL SELECT 'extra', type, count(*) FROM (SELECT * FROM c EXCEPT SELECT * FROM r) GROUP BY 2""")
def j27(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d).select("src", "dst", "type")
    return facts.set_difference(e.where("type <> 'contain'"), e.where("src % 7 <> 0")).groupBy("side", "type").agg(F.count("*").alias("n"))


@query("j30_parent_inference", """WITH s AS (SELECT p_partkey AS vid, p_brand AS file, p_brand || '.' || p_partkey AS label, p_partkey % 50 AS s, p_partkey % 50 + 3 AS e FROM part),
c AS (SELECT DISTINCT p_brand AS file, p_brand AS label, 0 AS s, 40 AS e FROM part) SELECT s.vid, max(c.label) AS parent FROM s LEFT JOIN c ON s.file = c.file AND starts_with(s.label, c.label || '.') AND c.s <= s.s AND s.e <= c.e GROUP BY 1""")
def j30(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    s = part.selectExpr("p_partkey AS vid", "p_brand AS file", "concat(p_brand, '.', p_partkey) AS label", "p_partkey % 50 AS start_line", "p_partkey % 50 + 3 AS end_line")
    c = part.selectExpr("p_brand AS file", "p_brand AS label", "0L AS start_line", "40L AS end_line").distinct()
    return facts.infer_parents(s, c)


def _reach(start: int, step: str, depth: int, where: str = "") -> str:
    return f"w(vid, depth) AS (SELECT {start}::BIGINT, 0 UNION SELECT {step}, depth + 1 FROM w JOIN edges ON {where} WHERE depth < {depth})"


@query("g1_impact", f"{_G}, {_reach(3000000001, 'src', 3, chr(100) + 'st = vid AND type = ' + chr(39) + 'reference' + chr(39))} SELECT vid, min(depth)::INTEGER AS depth FROM w GROUP BY 1 HAVING min(depth) > 0")
def g1(spark: SparkSession, d: str) -> DataFrame:
    return graph.impact(edges(spark, d), _seeds(spark, 3000000001), 3)


@query("g2_dependencies", f"{_G}, {_reach(1000000001, 'dst', 2, 'src = vid AND type = ' + chr(39) + 'reference' + chr(39))} SELECT vid, min(depth)::INTEGER AS depth FROM w GROUP BY 1 HAVING min(depth) > 0")
def g2(spark: SparkSession, d: str) -> DataFrame:
    return graph.dependencies(edges(spark, d), _seeds(spark, 1000000001), 2)


@query("g3_neighborhood", f"""{_G}, b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), w(vid, depth) AS (SELECT 4000000001::BIGINT, 0 UNION SELECT dst, depth + 1 FROM w JOIN b ON src = vid WHERE depth < 2)
SELECT vid, min(depth)::INTEGER AS depth FROM w GROUP BY 1 HAVING min(depth) > 0""")
def g3(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighborhood(edges(spark, d), _seeds(spark, 4000000001), 2)


@query("g6_files_touched", f"{_G}, {_reach(3000000001, 'src', 3, chr(100) + 'st = vid AND type = ' + chr(39) + 'reference' + chr(39))}, m AS (SELECT vid, min(depth) AS depth FROM w GROUP BY 1 HAVING min(depth) > 0) SELECT file, min(depth)::INTEGER AS depth FROM m JOIN nodes USING (vid) GROUP BY 1")
def g6(spark: SparkSession, d: str) -> DataFrame:
    return graph.files_touched(graph.impact(edges(spark, d), _seeds(spark, 3000000001), 3), nodes(spark, d))


@query("g7_shortest_path", f"""{_G}, b AS (SELECT DISTINCT src, dst FROM edges), w(vid, path) AS (SELECT 6000000000::BIGINT, [6000000000::BIGINT] UNION ALL SELECT dst, list_append(path, dst) FROM w JOIN b ON src = vid WHERE len(path) <= 3)
SELECT path, (len(path) - 1)::INTEGER AS hops FROM w WHERE vid = (SELECT min(2000000000 + o_orderkey) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0) ORDER BY len(path), path LIMIT 1""")
def g7(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation").where("n_regionkey = 0"), F.col("c_nationkey") == F.col("n_nationkey"))
    goal = o.agg(F.min(F.col("o_orderkey") + 2000000000)).first()[0]
    return graph.shortest_path(edges(spark, d), 6000000000, goal)


@query("g13_induced", f"{_G}, k AS (SELECT vid FROM nodes WHERE type IN ('nation', 'supplier')) SELECT src, dst, type FROM edges WHERE src IN (SELECT vid FROM k) AND dst IN (SELECT vid FROM k)")
def g13(spark: SparkSession, d: str) -> DataFrame:
    return graph.induced(edges(spark, d), nodes(spark, d).where("type IN ('nation', 'supplier')")).select("src", "dst", "type")


_PROJ = """pr AS (SELECT a.file AS source, b.file AS target, count(DISTINCT (src, dst)) AS weight, count(*) AS refs, min(anchor_line) AS first_anchor,
  list_sort(list(DISTINCT {'file': anchor_file, 'line': anchor_line + 1}))[1:12] AS anchors FROM edges JOIN nodes a ON src = a.vid JOIN nodes b ON dst = b.vid
WHERE edges.type = 'reference' AND a.file <> b.file GROUP BY 1, 2)"""


@query("g17_module_projection", f"{_G}, {_PROJ} SELECT source, target, weight, refs AS \"references\", first_anchor, list_transform(anchors, lambda x: x.file || ':' || x.line) AS anchors FROM pr")
def g17(spark: SparkSession, d: str) -> DataFrame:
    rows = graph.project_modules(nodes(spark, d), edges(spark, d), "file")
    return rows.withColumn("anchors", F.transform("anchors", lambda x: F.concat(x["file"], F.lit(":"), x["line"])))


@query("g18_module_degree", f"{_G}, {_PROJ} SELECT m AS module, sum(weight)::BIGINT AS degree FROM (SELECT source AS m, weight FROM pr UNION ALL SELECT target, weight FROM pr) GROUP BY 1")
def g18(spark: SparkSession, d: str) -> DataFrame:
    return graph.module_degree(graph.project_modules(nodes(spark, d), edges(spark, d), "file"))


@query("g19_top_modules", f"{_G}, {_PROJ} SELECT m AS module, sum(weight)::BIGINT AS degree FROM (SELECT source AS m, weight FROM pr UNION ALL SELECT target, weight FROM pr) GROUP BY 1 ORDER BY degree DESC, module LIMIT 10")
def g19(spark: SparkSession, d: str) -> DataFrame:
    return graph.module_degree(graph.project_modules(nodes(spark, d), edges(spark, d), "file")).orderBy(F.col("degree").desc(), "module").limit(10)


@query("g31_importance", f"""{_G}, dg AS (SELECT vid, count(e.v) AS degree FROM nodes LEFT JOIN (SELECT unnest([src, dst]) AS v FROM edges WHERE type = 'reference') e ON e.v = vid GROUP BY 1)
SELECT vid, degree, round(ln(1 + degree) / ln(1 + (SELECT max(degree) FROM dg)), 4) AS importance FROM dg""")
def g31(spark: SparkSession, d: str) -> DataFrame:
    return containment.importance(edges(spark, d), nodes(spark, d))


@query("g35_layers", f"{_G} SELECT type, count(*) AS edges, (SELECT count(DISTINCT v) FROM (SELECT src AS v FROM edges x WHERE x.type = e.type UNION ALL SELECT dst FROM edges x WHERE x.type = e.type)) AS nodes FROM edges e GROUP BY 1")
def g35(spark: SparkSession, d: str) -> DataFrame:
    return graph.layer_summary(edges(spark, d))


@query("g11_ppr")
def g11(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return graph.pagerank(edges(spark, d), n, n.where("type = 'region'")).select("vid", F.round("rank", 6).alias("rank"))


@query("g21_rank_percentile", f"{_G}, dg AS (SELECT dst AS vid, count(*) AS s FROM edges WHERE type = 'contain' GROUP BY 1) SELECT vid, round((row_number() OVER (ORDER BY s, vid) - 1) / ((SELECT count(*) FROM dg) - 1), 4) AS percentile FROM dg")
def g21(spark: SparkSession, d: str) -> DataFrame:
    s = edges(spark, d).where("type = 'contain'").groupBy(F.col("dst").alias("vid")).agg(F.count("*").alias("s"))
    return graph.rank_percentile(s, "s", "vid").select("vid", "percentile")


@query("g21_communities")
def g21_communities(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return graph.label_communities(graph.induced(edges(spark, d), n), n, 4)


@query("g21_modularity_communities")
def g21_modularity(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return communities.modular_communities(edges(spark, d), n)


@query("g5_display_labels", f"{_G} SELECT vid, CASE WHEN count(*) OVER (PARTITION BY file) > 1 THEN name ELSE file END AS display FROM nodes WHERE type = 'supplier'")
def g5(spark: SparkSession, d: str) -> DataFrame:
    return graph.display_labels(nodes(spark, d).where("type = 'supplier'"), "file", "name").select("vid", "display")


@query("g29_ancestors", f"{_G}, p AS (SELECT dst AS vid, src AS parent FROM edges WHERE type = 'contain'), a(vid, ancestor, distance) AS (SELECT vid, parent, 1 FROM p UNION ALL SELECT a.vid, p.parent, distance + 1 FROM a JOIN p ON a.ancestor = p.vid) SELECT ancestor, distance::INTEGER AS distance, count(*) AS n FROM a GROUP BY 1, 2")
def g29(spark: SparkSession, d: str) -> DataFrame:
    parents = edges(spark, d).where("type = 'contain'").select(F.col("dst").alias("vid"), F.col("src").alias("parent"))
    return graph.ancestors(parents).groupBy("ancestor", "distance").agg(F.count("*").alias("n"))


@query("u13_edge_dedup", f"{_G} SELECT type, count(*) AS n FROM (SELECT DISTINCT src, dst, type, anchor_file, anchor_line FROM edges) GROUP BY 1")
def u13(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return graph.distinct_edges(e.unionByName(e)).groupBy("type").agg(F.count("*").alias("n"))


@query("u12_graph_merge", f"{_G}, x AS (SELECT vid, file, 1 AS def FROM nodes WHERE vid % 2 = 0 UNION ALL SELECT vid, NULL, 0 FROM nodes WHERE vid % 3 = 0) SELECT vid, arg_max(file, def) AS file, max(def)::INTEGER AS defined FROM x GROUP BY 1")
def u12(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    known = n.where("vid % 2 = 0").select("vid", "file", F.lit(1).alias("defined"))
    referenced = n.where("vid % 3 = 0").select("vid", F.lit(None).cast("string").alias("file"), F.lit(0).alias("defined"))
    return facts.merge_nodes(known, referenced, "vid", "defined")


@query("u14_fact_conflicts", "WITH f AS (SELECT p_brand AS symbol_id, p_size % 2 AS kind FROM part) SELECT symbol_id, count(DISTINCT kind) AS variants FROM f GROUP BY 1 HAVING count(DISTINCT kind) > 1")
def u14(spark: SparkSession, d: str) -> DataFrame:
    return facts.conflicts(table(spark, d, "part").selectExpr("p_brand AS symbol_id", "p_size % 2 AS kind"), "symbol_id", ["kind"])


@query("f18_surface", f"{_G}, k AS (SELECT vid FROM nodes WHERE NOT starts_with(file, 'c')) SELECT type, count(*) AS n FROM edges WHERE src IN (SELECT vid FROM k) AND dst IN (SELECT vid FROM k) GROUP BY 1")
def f18(spark: SparkSession, d: str) -> DataFrame:
    return graph.induced(edges(spark, d), nodes(spark, d).where("NOT startswith(file, 'c')")).groupBy("type").agg(F.count("*").alias("n"))


@query("e2_narrowest_entity", f"""{_G}, p AS (SELECT DISTINCT 'c' || n_nationkey AS file, n_nationkey * 13 % 500 AS line FROM nation),
h AS (SELECT p.file, line, vid, row_number() OVER (PARTITION BY p.file, line ORDER BY end_line - start_line, start_line DESC, vid) AS n FROM p JOIN nodes ON nodes.file = p.file AND line BETWEEN start_line AND end_line) SELECT file, line, vid FROM h WHERE n = 1""")
def e2(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "nation").selectExpr("concat('c', n_nationkey) AS file", "n_nationkey * 13 % 500 AS line")
    order = [F.col("end_line") - F.col("start_line"), -F.col("start_line"), F.col("vid")]
    return intervals.points_in_intervals(p, nodes(spark, d), ["file"], "line", "start_line", "end_line", order).select("file", "line", "vid")


@query("e20_line_windows", f"""WITH a AS (SELECT DISTINCT 'o' || l_orderkey % 25 AS file, l_orderkey % 500 - 10 AS s, l_orderkey % 500 + 10 AS e FROM lineitem),
m AS (SELECT *, max(e) OVER (PARTITION BY file ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM a),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT file, min(s) AS s, max(e) AS e, count(*) AS n FROM i GROUP BY file, k""")
def e20(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "lineitem").selectExpr("concat('o', l_orderkey % 25) AS file", "l_orderkey % 500 - 10 AS s", "l_orderkey % 500 + 10 AS e").distinct()
    return intervals.islands(a, ["file"], "s", "e", 1)


@query("w11_first_fit_windows")
def w11(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "lineitem").selectExpr("concat('o', l_orderkey % 25) AS file", "l_orderkey * 10 + l_linenumber AS rank", "l_orderkey % 500 AS first", "l_orderkey % 500 + l_linenumber AS last")
    return intervals.first_fit_windows(a)


@query("u11_distinct_spans")
def u11(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "lineitem").selectExpr("concat('o', l_orderkey % 25) AS file", "l_orderkey * 10 + l_linenumber AS rank", "l_orderkey % 500 AS first", "l_orderkey % 500 + l_linenumber AS last")
    return intervals.distinct_spans(a)
