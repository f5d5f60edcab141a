"""Queries over named entities: lookup, adjacency, walks, reading, navigation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import entities, graph, intervals, projection
from quarry.registry import query, table

from .graph_queries import _OCC, _occurrences
from .views import CODE_SQL, code_edges, code_files, code_nodes, files

_C = f"WITH RECURSIVE {CODE_SQL}"
_ENT = """en AS (SELECT cn.*, CASE WHEN type = 'file' THEN '' ELSE regexp_replace(split_part(unified_name, ':', 2), '\\(\\)$', '') END AS q FROM cn),
ent AS (SELECT *, CASE WHEN q = '' THEN '' ELSE string_split(q, '.')[-1] END AS simple FROM en)"""


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return entities.entity_table(code_nodes(spark, d), code_edges(spark, d))


def _some(spark: SparkSession, d: str, where: str) -> DataFrame:
    return code_nodes(spark, d).where(where)


@query("e1_find_entities", f"""{_C}, {_ENT}, names(q) AS (VALUES ('Widget8'), ('run3'), ('sym12'), ('`value5`'), ('nothing at all'), ('Widget8.run3()')),
k AS (SELECT q, regexp_replace(trim(q, '`'), '\\(\\)$', '') AS key FROM names),
a AS (SELECT vid, unnest(list_distinct([name, regexp_replace(unified_name, '\\(\\)$', ''), ent.q, simple])) AS key FROM ent)
SELECT k.q AS query, vid, 0 AS tier, count(*) OVER (PARTITION BY k.q) AS n FROM k JOIN a USING (key)""")
def e1(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame([(q,) for q in ("Widget8", "run3", "sym12", "`value5`", "nothing at all", "Widget8.run3()")], "query string")
    return entities.find(_entities(spark, d), asked)


@query("e1_find_by_file", f"""{_C}, {_ENT} SELECT regexp_extract(file, '[^/]*$') || ':' || simple AS query, vid, 2 AS tier, count(*) OVER (PARTITION BY file, simple) AS n FROM ent WHERE file IN (SELECT path FROM cf WHERE doc_id < 10) AND type = 'field'""")
def e1_file(spark: SparkSession, d: str) -> DataFrame:
    e = _entities(spark, d)
    some = code_files(spark, d).where("doc_id < 10").select(F.col("path").alias("file"))
    leaf = F.element_at(F.split("file", "/"), -1)
    asked = e.where("type = 'field'").join(some, "file", "left_semi").select(F.concat(leaf, F.lit(":"), "simple").alias("query"), F.lit("field").alias("kind")).distinct()
    return entities.find(e, asked)


@query("e1_find_fuzzy", f"""{_C}, {_ENT}, a AS (SELECT vid, unnest(list_distinct([name, regexp_replace(unified_name, '\\(\\)$', ''), q, simple])) AS key FROM ent WHERE type <> 'file' UNION SELECT vid, name FROM ent WHERE type = 'file')
SELECT 'WIDGET1' AS query, vid, 3 AS tier, count(*) OVER () AS n FROM (SELECT DISTINCT vid FROM a WHERE contains(lower(key), 'widget1'))""")
def e1_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return entities.find(_entities(spark, d), spark.createDataFrame([("WIDGET1",)], "query string"), fuzzy=True)


@query("e3_adjacent", f"{_C} SELECT DISTINCT s.vid, src, dst, ce.type FROM (SELECT vid FROM cn WHERE vid % 50 = 0) s JOIN ce ON s.vid IN (src, dst) WHERE ce.type IN ('contain', 'reference')")
def e3(spark: SparkSession, d: str) -> DataFrame:
    return entities.adjacent(code_nodes(spark, d), code_edges(spark, d), _some(spark, d, "vid % 50 = 0"), "both", ["contain", "reference"])


@query("e4_traverse", f"""{_C}, st AS (SELECT vid FROM cn WHERE type = 'file'), e AS (SELECT DISTINCT src, dst FROM ce WHERE type IN ('contain', 'import')),
w(start, vid, level) AS (SELECT vid, vid, 0 FROM st UNION SELECT start, dst, level + 1 FROM w JOIN e ON src = vid WHERE level < 3)
SELECT start, vid, min(level)::INTEGER AS level FROM w GROUP BY 1, 2 HAVING min(level) > 0""")
def e4(spark: SparkSession, d: str) -> DataFrame:
    out = entities.traverse(code_nodes(spark, d), code_edges(spark, d), _some(spark, d, "type = 'file'"), depth=3, edge_types=["contain", "import"], max_nodes=None)
    return out.select("start", "vid", "level")


@query("e5_distance", f"""{_C}, e AS (SELECT DISTINCT src, dst FROM ce), p AS (SELECT 7000000000 + doc_id AS a, 8000000000 + doc_id * 5 AS b FROM cf WHERE doc_id % 10 = 0),
w(start, vid, k) USING KEY (start, vid) AS (SELECT x, x, 0 FROM (SELECT a AS x FROM p UNION SELECT b FROM p)
  UNION SELECT w.start, dst, min(w.k) + 1 FROM w JOIN e ON src = w.vid LEFT JOIN recurring.w r ON r.start = w.start AND r.vid = dst WHERE r.vid IS NULL GROUP BY 1, 2)
SELECT a AS first, b AS second, coalesce(least(x.k, y.k), x.k, y.k, -1)::INTEGER AS distance FROM p LEFT JOIN w x ON x.start = a AND x.vid = b LEFT JOIN w y ON y.start = b AND y.vid = a""")
def e5(spark: SparkSession, d: str) -> DataFrame:
    pairs = code_files(spark, d).where("doc_id % 10 = 0").selectExpr("7000000000 + doc_id AS first", "8000000000 + doc_id * 5 AS second")
    return entities.distances(code_edges(spark, d), pairs, most=None, kinds=code_nodes(spark, d).select("vid", "type"))


@query("e17_query_distance", f"""{_C}, {_ENT}, e AS (SELECT DISTINCT src, dst FROM ce), u AS (SELECT simple, min(vid) AS vid FROM ent WHERE simple <> '' GROUP BY 1 HAVING count(*) = 1),
p(x, y) AS (VALUES ('Widget0', 'Widget4'), ('Widget0', 'run2'), ('Widget8', 'nothing')),
r AS (SELECT x, y, a.vid AS va, b.vid AS vb FROM p LEFT JOIN u a ON a.simple = x LEFT JOIN u b ON b.simple = y),
w(start, vid, k) AS (SELECT v, v, 0 FROM (SELECT va AS v FROM r UNION SELECT vb FROM r) WHERE v IS NOT NULL UNION SELECT start, dst, k + 1 FROM w JOIN e ON src = vid WHERE k < 4),
m AS (SELECT start, vid, min(k) AS k FROM w GROUP BY 1, 2)
SELECT x AS query1, y AS query2, coalesce(least(f.k, g.k), f.k, g.k, -1)::INTEGER AS distance FROM r LEFT JOIN m f ON f.start = va AND f.vid = vb LEFT JOIN m g ON g.start = vb AND g.vid = va""")
def e17(spark: SparkSession, d: str) -> DataFrame:
    p = spark.createDataFrame([("Widget0", "Widget4"), ("Widget0", "run2"), ("Widget8", "nothing")], "query1 string, query2 string")
    asked = p.select(F.col("query1").alias("query")).union(p.select("query2")).distinct()
    one = entities.find(_entities(spark, d), asked).where("n = 1").select("query", "vid")
    rows = p.join(one.select(F.col("query").alias("query1"), F.col("vid").alias("first")), "query1", "left").join(one.select(F.col("query").alias("query2"), F.col("vid").alias("second")), "query2", "left")
    return entities.distances(code_edges(spark, d), rows, most=4).select("query1", "query2", "distance")


@query("e6_children", f"""{_C}, h AS (SELECT DISTINCT src AS vid, dst AS child FROM ce WHERE type = 'contain' AND src < 8000000000)
SELECT vid, child, row_number() OVER (PARTITION BY h.vid ORDER BY file, start_line, name, child)::INTEGER AS place FROM (SELECT h.vid, child, file, start_line, name FROM h JOIN cn ON cn.vid = child) h""")
def e6(spark: SparkSession, d: str) -> DataFrame:
    return entities.children(_entities(spark, d), code_edges(spark, d), _some(spark, d, "type = 'file'"))


@query("e7_entities_in_file", f"{_C} SELECT vid, name, start_line FROM cn WHERE file = (SELECT path FROM cf WHERE doc_id = 7) AND type IN ('class', 'function') ORDER BY start_line, end_line, name, vid")
def e7(spark: SparkSession, d: str) -> DataFrame:
    path = code_files(spark, d).where("doc_id = 7").select("path").scalar()
    return entities.in_file(_entities(spark, d), path, ["class", "function"]).select("vid", "name", "start_line")


@query("e8_matched_files", f"{_C} SELECT path FROM cf WHERE regexp_matches(path, '/mod[^/]*[.]py$') OR regexp_matches(path, '^mod[^/]*[.]py$')")
def e8(spark: SparkSession, d: str) -> DataFrame:
    return entities.match_files(code_files(spark, d), "**/mod*.py")


@query("e8_found_files", f"""{_C}, q AS (SELECT regexp_extract(path, '[^/]*$') AS q FROM cf WHERE doc_id % 9 = 0)
SELECT DISTINCT q AS query, path, count(*) OVER (PARTITION BY q) AS n FROM (SELECT DISTINCT q, path FROM q JOIN cf ON path = q OR ends_with(path, '/' || q))""")
def e8_found(spark: SparkSession, d: str) -> DataFrame:
    f = code_files(spark, d)
    asked = f.where("doc_id % 9 = 0").select(F.element_at(F.split("path", "/"), -1).alias("query")).distinct()
    return entities.find_files(f, asked)


@query("e9_file_tree", f"""{_C}, x AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:k], '/') AS path, k AS depth, k = len(string_split(path, '/')) AS is_file FROM cf, (VALUES (1), (2), (3)) t(k) WHERE k <= len(string_split(path, '/'))),
s AS (SELECT *, CASE WHEN depth = 1 THEN '' ELSE regexp_replace(path, '/[^/]*$', '') END AS parent, regexp_extract(path, '[^/]*$') AS label FROM x),
l AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY NOT is_file, label) = count(*) OVER (PARTITION BY parent) AS last FROM s)
SELECT l.path, l.depth::INTEGER AS depth, l.is_file, CASE WHEN l.depth = 1 THEN '' WHEN l.depth = 2 THEN CASE WHEN a.last THEN '    ' ELSE '|   ' END
  ELSE CASE WHEN b.last THEN '    ' ELSE '|   ' END || CASE WHEN a.last THEN '    ' ELSE '|   ' END END || CASE WHEN l.last THEN '`-- ' ELSE '|-- ' END || l.label AS line
FROM l LEFT JOIN l a ON a.path = l.parent LEFT JOIN l b ON b.path = a.parent""")
def e9(spark: SparkSession, d: str) -> DataFrame:
    return entities.file_tree(code_files(spark, d), 3).drop("key")


_LINES = "regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+')".replace("\\n", "\n")


@query("e10_skeleton", f"""{_C}, {_ENT}, st AS (SELECT vid FROM ent WHERE type = 'class'), m AS (SELECT vid, vid AS child, 0 AS place FROM st UNION ALL
  SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) FROM (SELECT DISTINCT src, dst FROM ce WHERE type = 'contain' AND src IN (SELECT vid FROM st))),
r AS (SELECT m.vid, place, ent.q, simple, regexp_replace(coalesce({_LINES}[start_line + 1], ''), '^\\s+|\\s+$', '', 'g') AS s FROM m JOIN ent ON ent.vid = child JOIN cf ON cf.path = ent.file)
SELECT vid, string_agg(CASE WHEN place > 0 THEN '    ' ELSE '' END || CASE WHEN s = '' THEN q ELSE s END, chr(10) ORDER BY place) AS skeleton FROM r GROUP BY 1""")
def e10(spark: SparkSession, d: str) -> DataFrame:
    return entities.skeletons(_entities(spark, d), code_edges(spark, d), _some(spark, d, "type = 'class'"), code_files(spark, d))


@query("e11_read_range", """WITH l AS (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)) END AS ls FROM documents)
SELECT doc_id, CASE WHEN len(ls) = 0 OR 2 > len(ls) - 1 THEN '' ELSE array_to_string(ls[3:6], chr(10)) END AS content, CASE WHEN len(ls) = 0 THEN 0 ELSE 2 END::BIGINT AS first,
  CASE WHEN len(ls) = 0 THEN 0 WHEN len(ls) - 1 < 2 THEN 2 ELSE least(5, len(ls) - 1) END::BIGINT AS last FROM l""")
def e11(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", entities.read_range(F.col("text"), F.lit(2), F.lit(5)).alias("r")).select("doc_id", "r.*")


@query("e12_snippets", f"""{_C}, p AS (SELECT DISTINCT file, line FROM (SELECT file, start_line AS line FROM sym WHERE label = 'value5') UNION SELECT path, 3 FROM cf WHERE doc_id < 20),
s AS (SELECT p.file, line, greatest(line - 2, 0) AS a, line + 2 AS b FROM p)
SELECT s.file, line, array_to_string({_LINES}[a + 1:b + 1], '') AS content FROM s JOIN cf ON cf.path = s.file WHERE len({_LINES}) > a""")
def e12(spark: SparkSession, d: str) -> DataFrame:
    by_name = entities.find(_entities(spark, d), spark.createDataFrame([("value5",)], "query string")).join(code_nodes(spark, d), "vid").select("file", F.col("start_line").alias("line"))
    by_line = code_files(spark, d).where("doc_id < 20").select(F.col("path").alias("file"), F.lit(3).cast("bigint").alias("line"))
    rows = by_name.union(by_line).distinct().withColumn("start_line", F.greatest(F.col("line") - 2, F.lit(0))).withColumn("end_line", F.col("line") + 2)
    return projection.read_spans(rows, code_files(spark, d)).where("content IS NOT NULL").select("file", "line", "content")


@query("e13_graph_walk", f"""{_C}, e AS (SELECT DISTINCT src, dst FROM ce WHERE type = 'contain'), w(vid, level) AS (SELECT 7000000003::BIGINT, 0 UNION ALL SELECT dst, level + 1 FROM w JOIN e ON src = w.vid WHERE level < 2)
SELECT w.vid, level::INTEGER AS level, e.src AS parent, CASE WHEN e.src IS NULL THEN '' ELSE 'contain' END AS relation FROM w LEFT JOIN e ON e.dst = w.vid AND level > 0""")
def e13(spark: SparkSession, d: str) -> DataFrame:
    n = code_nodes(spark, d).withColumn("name", F.lit("x"))  # the files of these tables are named like tests
    return graph.tree_rows(n, code_edges(spark, d), 7000000003, hops=2, edge_types=["contain"]).select("vid", "level", "parent", "relation")


@query("e14_entity_contents", f"""{_C}, {_ENT}, h AS (SELECT simple, min(vid) AS vid, count(*) AS n FROM ent WHERE simple IN ('Widget12', 'Widget40', 'run1') GROUP BY 1)
SELECT simple AS query, n, CASE WHEN n = 1 AND len({_LINES}) > start_line THEN array_to_string({_LINES}[start_line + 1:end_line + 1], '') END AS content FROM h JOIN cn USING (vid) JOIN cf ON cf.path = cn.file""")
def e14(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame([(q,) for q in ("Widget12", "Widget40", "run1")], "query string")
    hit = entities.find(_entities(spark, d), asked).groupBy("query").agg(F.min("vid").alias("vid"), F.max("n").alias("n"))
    rows = projection.read_spans(hit.join(code_nodes(spark, d), "vid"), code_files(spark, d))
    return rows.select("query", "n", F.when(F.col("n") == 1, F.col("content")).alias("content"))


@query("e15_fragment_entity", f"""{_C}, f AS (SELECT path AS file, doc_id, substr(text, 200, 20) AS frag, text FROM cf WHERE length(text) > 300),
l AS (SELECT doc_id AS query, file, length(regexp_replace(left(text, strpos(text, frag) - 1), '[^\n]', '', 'g')) AS line FROM f),
h AS (SELECT query, l.file, line, vid, row_number() OVER (PARTITION BY query ORDER BY end_line - start_line, start_line DESC, name, vid) AS n FROM l JOIN sym ON sym.file = l.file AND line BETWEEN start_line AND end_line)
SELECT query, file, line::INTEGER AS line, vid FROM h WHERE n = 1""")
def e15(spark: SparkSession, d: str) -> DataFrame:
    f = code_files(spark, d)
    asked = f.where(F.length("text") > 300).select(F.col("doc_id").alias("query"), F.col("path").alias("file"), F.substring("text", 200, 20).alias("fragment"))
    return entities.containing(entities.fragment_lines(f, asked).where("line IS NOT NULL"), code_nodes(spark, d)).select("query", "file", "line", "vid")


@query("e16_method_in_class", f"""{_C}, {_ENT} SELECT q AS query, vid, 0 AS tier, 1::BIGINT AS n FROM ent WHERE type = 'method' AND vid % 100 = 2""")
def e16(spark: SparkSession, d: str) -> DataFrame:
    e = _entities(spark, d)
    asked = e.where("type = 'method' AND vid % 100 = 2").select(F.col("qualified").alias("query"), F.lit("method").alias("kind"), "class_name")
    return entities.find(e, asked)


@query("e18_imports", """SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda t: starts_with(t, 'import') OR (starts_with(t, 'from') AND contains(t, 'import'))) AS imports FROM
(SELECT doc_id, 'import a' || chr(10) || text || chr(10) || 'from b import c' || chr(10) || 'from nowhere' AS text FROM documents)""")
def e18(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat_ws("\n", F.lit("import a"), "text", F.lit("from b import c"), F.lit("from nowhere"))
    return entities.import_lines(table(spark, d, "documents").select(F.col("doc_id").alias("path"), body.alias("text"))).withColumnRenamed("path", "doc_id")


@query("e19_locations", f"""{_C}, {_ENT}, a AS (SELECT vid AS query, file, CASE WHEN type = 'class' THEN 'class' ELSE 'function' END AS kind, q AS name, type FROM ent WHERE type IN ('class', 'method') AND vid % 3 = 0),
m AS (SELECT a.query, b.type AS kind, a.name, b.start_line + 1 AS first, b.end_line + 1 AS last, row_number() OVER (PARTITION BY a.query ORDER BY b.start_line, b.end_line) AS n FROM a JOIN ent b ON a.file = b.file AND a.type = b.type AND a.name = b.q)
SELECT query, kind, name, first, last FROM m WHERE n = 1""")
def e19(spark: SparkSession, d: str) -> DataFrame:
    e = _entities(spark, d)
    asked = e.where("type IN ('class', 'method') AND vid % 3 = 0").select(F.col("vid").alias("query"), "file", F.when(F.col("type") == "class", "class").otherwise("function").alias("kind"), F.col("qualified").alias("name"))
    return entities.located(e, asked)


@query("e21_jump", f"""WITH {_OCC.replace('pt AS', 'pt0 AS').replace('FROM pt JOIN', 'FROM pt0 JOIN')}, b AS (SELECT *, regexp_replace(symbol, '^local ', '') AS nm FROM occ), a AS (SELECT DISTINCT file, nm FROM b WHERE nm LIKE 'sym1%'),
o AS (SELECT b.*, a.file || a.nm AS query_id, row_number() OVER (PARTITION BY a.file, a.nm ORDER BY start_line, start_char, end_line, end_char, symbol) AS n FROM a JOIN b USING (file, nm)),
s AS (SELECT query_id, file, start_line AS line, start_char AS ch FROM o WHERE n = 2),
h AS (SELECT * FROM (SELECT s.query_id, occ.file, symbol, row_number() OVER (PARTITION BY s.query_id ORDER BY end_line - start_line, end_char - start_char, start_line, start_char, symbol) AS n FROM s JOIN occ ON s.file = occ.file
  WHERE (start_line < line OR start_line = line AND start_char <= ch) AND (line < end_line OR line = end_line AND ch < end_char)) WHERE n = 1),
r AS (SELECT DISTINCT h.query_id, o.file, o.start_line, o.start_char, o.end_line, o.end_char, o.symbol FROM h JOIN occ o ON h.symbol = o.symbol AND (o.symbol NOT LIKE 'local %' OR o.file = h.file) WHERE roles & 1 = 1)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY file, start_line, start_char, end_line, end_char)::INTEGER AS rank FROM r) WHERE rank <= 8""")
def e21(spark: SparkSession, d: str) -> DataFrame:
    _, occ = _occurrences(spark, d)
    names = occ.select("file", F.regexp_replace("symbol", "^local ", "").alias("name")).where("name LIKE 'sym1%'").distinct()
    return entities.jump(occ, names.select(F.concat("file", "name").alias("query_id"), "file", "name", F.lit(1).alias("index")))


@query("e26_span_index", f"""{_C}, {_ENT}, x AS (SELECT vid, file, start_line, end_line, 0 AS k, name AS leaf FROM ent WHERE file IS NOT NULL UNION ALL SELECT vid, file, start_line, end_line, 1, simple FROM ent WHERE file IS NOT NULL)
SELECT file, leaf, arg_min(start_line, (vid, k)) + 1 AS first, arg_min(end_line, (vid, k)) + 1 AS last FROM x GROUP BY 1, 2""")
def e26(spark: SparkSession, d: str) -> DataFrame:
    return entities.span_index(code_nodes(spark, d))


@query("e27_verified_claims", f"""{_C}, {_ENT}, c AS (SELECT path AS claim FROM cf UNION SELECT path || ':Widget0' FROM cf UNION SELECT 'missing.py') SELECT claim, claim IN (SELECT file FROM ent WHERE file IS NOT NULL UNION SELECT file || ':' || simple FROM ent WHERE file IS NOT NULL) AS known FROM c""")
def e27(spark: SparkSession, d: str) -> DataFrame:
    p = code_files(spark, d).select(F.col("path").alias("claim"))
    claims = p.union(p.select(F.concat("claim", F.lit(":Widget0")))).union(spark.createDataFrame([("missing.py",)], "claim string"))
    return entities.verified(claims, code_nodes(spark, d))


@query("e45_commit_grep", """WITH f AS (SELECT doc_id % 3 AS commit, source || '/' || doc_id AS path, text FROM documents) SELECT commit, path FROM f WHERE commit = 1 AND regexp_matches(text, '(?i)licen[sc]e')""")
def e45(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").selectExpr("doc_id % 3 AS commit", "concat(source, '/', doc_id) AS path", "text")
    from quarry.operators import sparse

    return sparse.grep(rows, "licen[sc]e", F.col("text"), where=F.col("commit") == 1).select("commit", "path")


@query("j4_filtered_neighbors", f"""{_C}, s AS (SELECT vid FROM cn WHERE vid % 20 = 0), e AS (SELECT src AS vid, dst AS neighbor, 'forward' AS direction, type, anchor_line FROM ce WHERE src IN (SELECT vid FROM s)
  UNION ALL SELECT dst, src, 'backward', type, anchor_line FROM ce WHERE dst IN (SELECT vid FROM s) AND src <> dst),
k AS (SELECT vid FROM cn WHERE type IN ('class', 'method') AND NOT regexp_matches(lower(file), '(^|/)(test|tests|spec|specs|__tests__)/') AND NOT regexp_matches(regexp_extract(lower(file), '[^/]*$'), '^test|_test[.][a-z]+$|[.](test|spec)[.]'))
SELECT vid, neighbor, direction, type, anchor_line FROM e WHERE type = 'reference' AND neighbor IN (SELECT vid FROM k)""")
def j4(spark: SparkSession, d: str) -> DataFrame:
    out = entities.neighbors(code_nodes(spark, d), code_edges(spark, d), _some(spark, d, "vid % 20 = 0"), "both", ["class", "method"], ["reference"])
    return out.drop("anchor_file")


@query("j4_neighbor_budget", f"""{_C}, e AS (SELECT src AS vid, dst AS neighbor, type, anchor_file, anchor_line, row_number() OVER (PARTITION BY src ORDER BY dst, type, anchor_file NULLS FIRST, anchor_line NULLS FIRST) AS n FROM ce WHERE src % 20 = 0)
SELECT vid, neighbor, type, anchor_line FROM e WHERE n <= 3""")
def j4_budget(spark: SparkSession, d: str) -> DataFrame:
    out = entities.neighbors(code_nodes(spark, d), code_edges(spark, d), _some(spark, d, "vid % 20 = 0"), ignore_tests=False, budget=3)
    return out.select("vid", "neighbor", "type", "anchor_line")


_RES = """rs(symbol, s, b) AS (VALUES ('sym7', 'sym7', 'sym7'), ('Widget16', 'Widget16', 'Widget16'), ('run4', 'run4', 'run4'), ('VALUE1', 'VALUE1', 'VALUE1'), ('no such thing', 'no such thing', 'no such thing')),
sn AS (SELECT vid, name, unified_name AS shown, trim(regexp_replace(regexp_split_to_array(unified_name, '[:.#]')[-1], '[()]+$', '')) AS bare FROM cn),
th AS (SELECT symbol, vid, 0 AS tier FROM rs JOIN sn ON name = s UNION ALL SELECT symbol, vid, 1 FROM rs JOIN sn ON shown = s UNION ALL SELECT symbol, vid, 2 FROM rs JOIN sn ON shown = s || '()'
  UNION ALL SELECT symbol, vid, 3 FROM rs JOIN sn ON bare = b UNION ALL SELECT symbol, vid, 4 FROM rs JOIN sn ON contains(lower(shown), lower(b))
  UNION ALL SELECT symbol, vid, 5 FROM rs JOIN sn ON ends_with(name, '.' || s) OR string_split(name, '.')[-1] = s),
tb AS (SELECT symbol, vid, tier FROM (SELECT *, min(tier) OVER (PARTITION BY symbol) AS best FROM th) WHERE tier = best),
tr AS (SELECT symbol, vid, tier, count(*) OVER (PARTITION BY symbol) AS candidates, row_number() OVER (PARTITION BY symbol ORDER BY vid)::INTEGER AS rank FROM tb)"""
_NAMES = ("sym7", "Widget16", "run4", "VALUE1", "no such thing")


@query("j7_symbol_tiers", f"{_C}, {_RES} SELECT * FROM tr")
def j7(spark: SparkSession, d: str) -> DataFrame:
    return entities.resolve_tiers(code_nodes(spark, d), spark.createDataFrame([(s,) for s in _NAMES], "symbol string"))


@query("j8_symbol_candidates", f"{_C}, {_RES} SELECT * FROM tr WHERE rank <= 8")
def j8(spark: SparkSession, d: str) -> DataFrame:
    return entities.resolve_tiers(code_nodes(spark, d), spark.createDataFrame([(s,) for s in _NAMES], "symbol string"), 8)


@query("j6_seed_resolution", f"""{_C} SELECT vid AS seed, CASE WHEN vid % 3 = 2 AND (SELECT count(*) FROM cn b WHERE b.unified_name = a.unified_name) > 1 THEN NULL ELSE vid END AS vid FROM cn a WHERE type = 'class' AND vid % 40 = 0""")
def j6(spark: SparkSession, d: str) -> DataFrame:
    own = _some(spark, d, "type = 'class' AND vid % 40 = 0")
    none = F.lit(None).cast("string")
    leaf = F.regexp_replace("unified_name", "^[^:]*:", "")
    seeds = own.select(F.col("vid").alias("seed"), F.when(F.expr("vid % 3 = 0"), F.col("name")).otherwise(none).alias("node_id"), F.when(F.expr("vid % 3 = 1"), F.col("unified_name")).otherwise(leaf).alias("node_name"), "file")
    return entities.resolve_seeds(code_nodes(spark, d), seeds).select("seed", "vid")


@query("j10_range_by_symbol", f"""{_C}, s AS (SELECT name AS symbol, file, start_line AS s, end_line AS e FROM cn WHERE vid IN (8000000004, 8000000008)),
i AS (SELECT DISTINCT symbol, vid FROM s JOIN cn ON cn.file = s.file AND start_line <= e AND end_line >= s.s)
SELECT symbol, 'node' AS kind, vid AS src, vid AS dst, NULL::BIGINT AS anchor_line FROM i UNION ALL SELECT symbol, 'outgoing', src, dst, anchor_line FROM s JOIN ce ON anchor_file = s.file AND anchor_line BETWEEN s.s AND e
UNION ALL SELECT symbol, 'incoming', src, dst, anchor_line FROM i JOIN ce ON dst = vid WHERE src <> dst""")
def j10(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame([("sym4",), ("sym8",)], "symbol string")
    return entities.range_by_symbol(code_nodes(spark, d), code_edges(spark, d), asked)


_PT = "gp AS (SELECT doc_id AS query_id, path AS file, (doc_id * 3)::BIGINT AS line FROM cf)"


def _points(spark: SparkSession, d: str) -> DataFrame:
    return code_files(spark, d).select(F.col("doc_id").alias("query_id"), F.col("path").alias("file"), (F.col("doc_id") * 3).alias("line"))


@query("j14_graph_definitions", f"""{_C}, {_PT}, x AS (SELECT query_id, dst AS vid, 0 AS tier FROM gp JOIN ce ON anchor_file = gp.file AND anchor_line = line AND type = 'reference'
  UNION SELECT query_id, vid, 1 FROM gp JOIN sym ON sym.file = gp.file AND line BETWEEN start_line AND end_line),
b AS (SELECT x.*, min(tier) OVER (PARTITION BY query_id) AS best FROM x), y AS (SELECT query_id, b.vid, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN tier = 1 THEN end_line - start_line ELSE 0 END, start_line, file, b.vid)::INTEGER AS rank FROM b JOIN sym USING (vid) WHERE tier = best)
SELECT * FROM y WHERE rank <= 8""")
def j14(spark: SparkSession, d: str) -> DataFrame:
    return entities.graph_definitions(code_nodes(spark, d), code_edges(spark, d), _points(spark, d))


@query("j15_graph_references", f"""{_C}, t AS (SELECT vid AS query_id, vid AS target FROM sym WHERE vid % 25 = 0),
r AS (SELECT query_id, 'definition' AS kind, file, start_line AS line, vid FROM t JOIN sym ON vid = target UNION SELECT query_id, 'reference', anchor_file, anchor_line, src FROM t JOIN ce ON dst = target WHERE type = 'reference')
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kind <> 'definition', file, line, vid)::INTEGER AS rank FROM r) WHERE rank <= 40""")
def j15(spark: SparkSession, d: str) -> DataFrame:
    targets = _some(spark, d, "type <> 'file' AND vid % 25 = 0").select(F.col("vid").alias("query_id"), "vid")
    return entities.graph_references(code_nodes(spark, d), code_edges(spark, d), targets)


@query("j19_outgoing_edges", """WITH f AS (SELECT p_partkey AS symbol, p_type || p_size AS moniker FROM part), u AS (SELECT moniker, min(symbol) AS one FROM f GROUP BY 1 HAVING count(*) = 1),
e AS (SELECT l_suppkey AS source, moniker, CASE WHEN l_partkey % 3 = 0 THEN l_partkey END AS target FROM lineitem JOIN f ON symbol = l_partkey),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY moniker, target NULLS FIRST)::INTEGER AS rank FROM e) SELECT source, moniker, coalesce(target, one) AS target, rank FROM r LEFT JOIN u USING (moniker) WHERE rank <= 20""")
def j19(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "part").selectExpr("p_partkey AS symbol", "concat(p_type, p_size) AS moniker")
    e = table(spark, d, "lineitem").join(f, F.col("symbol") == F.col("l_partkey")).selectExpr("l_suppkey AS source", "moniker", "if(l_partkey % 3 = 0, l_partkey, NULL) AS target")
    return entities.outgoing(e, f, 20)


@query("j25_changed_symbols", f"""{_C}, b AS (SELECT vid AS id, file, start_line, end_line, name AS content FROM sym WHERE vid % 7 <> 1), a AS (SELECT vid AS id, file, start_line, CASE WHEN vid % 11 = 0 THEN end_line + 1 ELSE end_line END AS end_line, CASE WHEN vid % 5 = 0 THEN name || '!' ELSE name END AS content FROM sym WHERE vid % 7 <> 2),
r AS (SELECT path AS file, 20 AS first, 60 AS last FROM cf WHERE doc_id % 2 = 0), x AS (SELECT * FROM b WHERE file IN (SELECT file FROM r)), y AS (SELECT * FROM a WHERE file IN (SELECT file FROM r)),
m AS (SELECT DISTINCT id FROM y JOIN r ON y.file = r.file AND start_line <= last AND end_line >= first)
SELECT * FROM (SELECT coalesce(x.id, y.id) AS id, CASE WHEN x.id IS NULL THEN 'added' WHEN y.id IS NULL THEN 'deleted' WHEN x.end_line - x.start_line <> y.end_line - y.start_line OR (x.id IN (SELECT id FROM m) AND x.content <> y.content) THEN 'modified' END AS change FROM x FULL JOIN y ON x.id = y.id) WHERE change IS NOT NULL""")
def j25(spark: SparkSession, d: str) -> DataFrame:
    s = _some(spark, d, "type <> 'file'").select(F.col("vid").alias("id"), "file", "start_line", "end_line", F.col("name").alias("content"))
    before, after = s.where("id % 7 <> 1"), s.where("id % 7 <> 2")
    after = after.withColumn("end_line", F.expr("if(id % 11 = 0, end_line + 1, end_line)")).withColumn("content", F.expr("if(id % 5 = 0, concat(content, '!'), content)"))
    ranges = code_files(spark, d).where("doc_id % 2 = 0").select(F.col("path").alias("file"), F.lit(20).alias("first"), F.lit(60).alias("last"))
    return entities.changed_symbols(before, after, ranges)


@query("j28_citations", f"""{_C}, c AS (SELECT doc_id AS cite, path AS file, doc_id * 3 AS line FROM cf), m AS (SELECT cite, vid, CASE WHEN start_line = line THEN 0 ELSE 1 END AS tier, abs(start_line - line) AS gap FROM c JOIN sym ON sym.file = c.file WHERE abs(start_line - line) < 3)
SELECT cite, arg_min(vid, (tier, gap, vid)) AS vid, min(tier)::INTEGER AS tier FROM m GROUP BY 1""")
def j28(spark: SparkSession, d: str) -> DataFrame:
    c = code_files(spark, d).select(F.col("doc_id").alias("cite"), F.col("path").alias("file"), (F.col("doc_id") * 3).alias("line"))
    return entities.nearest_vertices(c, code_nodes(spark, d))


@query("j29_scope", f"""{_C}, {_PT}, h AS (SELECT query_id, vid, row_number() OVER (PARTITION BY query_id ORDER BY end_line - start_line, start_line DESC, name, vid) AS n FROM gp JOIN sym ON sym.file = gp.file AND line BETWEEN start_line AND end_line) SELECT query_id, vid FROM h WHERE n = 1""")
def j29(spark: SparkSession, d: str) -> DataFrame:
    return entities.containing(_points(spark, d), code_nodes(spark, d)).select("query_id", "vid")
