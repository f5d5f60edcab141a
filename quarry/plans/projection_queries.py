"""Queries over candidates on their way out: identities, source text, excerpts, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import fusion, intervals, projection
from quarry.registry import query, table

from .views import CODE_SQL, FILES_SQL, code_files, code_nodes, files

_C = f"WITH {CODE_SQL}"
_LINES = "regexp_extract_all(text, '[^\n]*\n|[^\n]+')"
_RANKED = "r AS (SELECT doc_id, source, text, lang, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents)"


def _ranked(spark: SparkSession, d: str, k: int) -> DataFrame:
    top = table(spark, d, "documents").orderBy(F.col("n_chars").desc(), "doc_id").limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.col("n_chars").desc(), "doc_id")))


@query("p2_rank_scores", f"WITH {_RANKED} SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 0.0 ELSE doc_id END, 1.0 / rank)::DOUBLE AS score, CASE WHEN doc_id % 2 = 0 THEN 'id' || doc_id ELSE 'name' || doc_id END AS node_id FROM r WHERE rank <= 100")
def p2(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.expr("doc_id % 3 = 1"), F.lit(0.0)).when(F.expr("doc_id % 3 = 2"), F.col("doc_id").cast("double"))
    own = F.when(F.expr("doc_id % 2 = 0"), F.concat(F.lit("id"), "doc_id")).when(F.expr("doc_id % 4 = 1"), F.lit(""))
    return _ranked(spark, d, 100).select("doc_id", projection.ranked_score(raw, F.col("rank")).alias("score"), projection.node_ids(own, F.concat(F.lit("name"), "doc_id")).alias("node_id"))


@query("p3_hydrated", f"""{_C}, x AS (SELECT vid, file, start_line, end_line, CASE WHEN vid % 4 = 0 THEN 'kept' WHEN vid % 4 = 1 THEN '' END AS content FROM sym)
SELECT vid, CASE WHEN content <> '' THEN content WHEN len({_LINES}) > start_line THEN array_to_string({_LINES}[start_line + 1:end_line + 1], '') ELSE content END AS content FROM x JOIN cf ON cf.path = x.file""")
def p3(spark: SparkSession, d: str) -> DataFrame:
    rows = code_nodes(spark, d).where("type <> 'file'").withColumn("content", F.expr("CASE WHEN vid % 4 = 0 THEN 'kept' WHEN vid % 4 = 1 THEN '' END"))
    return projection.hydrated(rows, code_files(spark, d)).select("vid", "content")


@query("p4_rescored", f"WITH {_RANKED} SELECT doc_id, rank * 0.5 AS score, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE lang END AS content FROM r WHERE rank <= 50")
def p4(spark: SparkSession, d: str) -> DataFrame:
    rows = _ranked(spark, d, 50).select("doc_id", "rank", F.col("lang").alias("content"))
    return projection.rescored(rows, F.col("rank") * 0.5, F.when(F.expr("doc_id % 2 = 0"), F.lit("new"))).select("doc_id", "score", "content")


@query("p5_focused_excerpts")
def p5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", projection.excerpt(F.col("text"), F.lit("the license of that"), F.lit(600).cast("bigint")).alias("excerpt"))


@query("p6_projections")
def p6(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", projection.projected(F.col("text"), F.lit("license"), F.lit(900)).alias("p")).select("doc_id", "p.original_chars", "p.returned_chars", "p.truncated", "p.strategy")


@query("p7_content_budgets", """WITH c AS (SELECT n_nationkey + 1 AS n FROM nation), a AS (SELECT n, least(n, 12) AS adm FROM c), e AS (SELECT n, adm, least(2400, 10000 // adm) AS each, unnest(range(1, n + 1)) AS nth FROM a)
SELECT n::BIGINT AS n, nth::BIGINT AS nth, (CASE WHEN nth > adm THEN 0 WHEN nth = adm THEN least(each + 10000 - each * adm, 2400) ELSE each END)::BIGINT AS budget FROM e""")
def p7(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").select((F.col("n_nationkey") + 1).cast("bigint").alias("n")).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")))
    return rows.select("n", "nth", projection.excerpt_budget(F.col("nth"), F.col("n")).alias("budget"))


@query("p8_evidence_rows", f"""WITH {_RANKED}, k AS (SELECT *, rank % 5 <> 0 AS has FROM r WHERE rank <= 200), c AS (SELECT *, sum(has::INT) OVER (PARTITION BY source ORDER BY rank) AS nth, sum(has::INT) OVER (PARTITION BY source) AS n FROM k),
b AS (SELECT *, least(n, 12) AS adm, CASE WHEN n > 0 THEN least(2400, 10000 // least(n, 12)) END AS each FROM c)
SELECT doc_id, CASE WHEN has THEN length(text) END::INTEGER AS original_chars, CASE WHEN has THEN length(text) > CASE WHEN nth > adm THEN 0 WHEN nth = adm THEN least(each + 10000 - each * adm, 2400) ELSE each END END AS truncated FROM b""")
def p8(spark: SparkSession, d: str) -> DataFrame:
    rows = _ranked(spark, d, 200).withColumn("content", F.when(F.expr("rank % 5 <> 0"), F.col("text"))).withColumn("query", F.lit("license")).drop("text")
    return projection.evidence(rows, ["source"], "rank", "query").select("doc_id", "projection.original_chars", "projection.truncated")


@query("p10_file_keys", f"""WITH {FILES_SQL}, p AS (SELECT doc_id, replace(path, '\\', '/') AS p FROM files) SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL WHEN doc_id % 4 = 2 THEN 'abs/' || p ELSE p END AS key FROM p""")
def p10(spark: SparkSession, d: str) -> DataFrame:
    plain = text.posix(F.col("path"))
    node_id = F.expr("CASE doc_id % 4 WHEN 0 THEN concat('./', replace(path, '\\\\', '/'), ':f') WHEN 1 THEN concat(replace(path, '\\\\', '/'), ':f') WHEN 2 THEN 'other.py:f' ELSE 'nofile' END")
    file = F.when(F.expr("doc_id % 4 = 3"), F.lit(" ")).when(F.expr("doc_id % 4 = 1"), plain).otherwise(F.concat(F.lit("abs/"), plain))
    return files(spark, d).select("doc_id", projection.file_key(node_id, file).alias("key"))


@query("p11_node_keys", """SELECT CASE WHEN doc_id % 3 = 0 THEN 'node_id' ELSE 'span' END AS kind, count(DISTINCT CASE WHEN doc_id % 3 = 0 THEN lang ELSE lang || source END) AS n FROM documents GROUP BY 1""")
def p11(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents")
    key = projection.node_key(F.when(F.expr("doc_id % 3 = 0"), F.col("lang")), F.col("source"), F.col("lang"), F.lit(1), F.lit(2))
    return rows.select(key.alias("k")).distinct().groupBy("k.kind").agg(F.count("*").alias("n"))


@query("f2_has_span", "SELECT count(*) AS n FROM lineitem WHERE l_linenumber <> 3 AND l_suppkey % 2 = 0")
def f2(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").selectExpr("if(l_suppkey % 2 = 0, 'f', NULL) AS file", "if(l_linenumber = 3, NULL, l_linenumber) AS start_line", "l_linenumber AS end_line")
    return rows.where(fusion.has_span()).agg(F.count("*").alias("n"))


@query("f4_symbol_types", f"{_C} SELECT type, count(*) AS n FROM cn WHERE type IN ('symbol', 'class', 'function', 'method', 'field') GROUP BY 1")
def f4(spark: SparkSession, d: str) -> DataFrame:
    return code_nodes(spark, d).where(fusion.is_symbol()).groupBy("type").agg(F.count("*").alias("n"))


@query("f9_built_filters", f"""{_C} SELECT vid FROM cn WHERE type <> 'file' AND ends_with(lower(file), '.py') AND NOT regexp_matches(file, '^src1.*$') AND start_line IS NOT NULL
  AND NOT (regexp_matches(lower(file), '(^|/)(test|tests|testing|spec|specs|__tests__)(/|$)') OR regexp_matches(lower(regexp_extract(file, '[^/]*$')), '^test_|_tests?\\.py$|\\.test\\.|\\.spec\\.') OR regexp_matches(regexp_replace(regexp_extract(file, '[^/]*$'), '\\.[^.]*$', ''), '(Test|Tests|Spec)$'))""")
def f9(spark: SparkSession, d: str) -> DataFrame:
    rows = code_nodes(spark, d)
    for p in fusion.candidate_filters(require_span=True, symbol_only=True, drop_tests=True, include_exts=["py"], exclude_globs=["src1*"]):
        rows = rows.where(p)
    return rows.select("vid")


@query("f16_layers", f"{_C} SELECT 'dependency' AS layer, count(*) AS n FROM ce WHERE type IN ('reference', 'import', 'type_use') UNION ALL SELECT 'containment', count(*) FROM ce WHERE type = 'contain' UNION ALL SELECT 'all', count(*) FROM ce")
def f16(spark: SparkSession, d: str) -> DataFrame:
    from quarry.operators import graph

    from .views import code_edges

    e = code_edges(spark, d)
    out = None
    for layer in ("dependency", "containment", "all"):
        n = graph.of_layer(e, layer).agg(F.lit(layer).alias("layer"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@query("f17_path_policy", f"""WITH {FILES_SQL}, p AS (SELECT replace(path, '\\', '/') AS p FROM files) SELECT p AS path FROM p WHERE (p = 'src1' OR starts_with(p, 'src1/')) AND NOT regexp_matches(p, '^.*/tests/.*$') AND NOT starts_with(p, 'src1/lib/')""")
def f17(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).where(text.path_allowed(F.col("path"), "src1", ["*/tests/*", "src1/lib/**"])).select(text.posix(F.col("path")).alias("path"))


@query("f22_supporting_evidence", f"""WITH {FILES_SQL}, p AS (SELECT doc_id, replace(path, '\\', '/') AS p, lower(replace(path, '\\', '/')) AS l FROM files)
SELECT doc_id, (regexp_matches(l, '(^|/)(test|tests|spec|specs|__tests__)/') OR regexp_matches(regexp_extract(l, '[^/]*$'), '^test|_test\\.[a-z]+$|\\.(test|spec)\\.') OR ends_with(l, '.d.ts') OR ends_with(l, '.md')) AS supporting FROM p""")
def f22(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("doc_id", text.is_supporting(F.col("path")).alias("supporting"))


@query("f19_selection_report", f"""{_C}, k AS (SELECT vid FROM cn WHERE coalesce(file, name) IN (SELECT path FROM cf WHERE doc_id % 3 = 0)) SELECT (SELECT count(*) FROM cn) AS nodes_before, (SELECT count(*) FROM k) AS nodes_after, (SELECT count(*) FROM ce) AS edges_before,
 (SELECT count(*) FROM ce WHERE src IN (SELECT vid FROM k) AND dst IN (SELECT vid FROM k)) AS edges_after""")
def f19(spark: SparkSession, d: str) -> DataFrame:
    from quarry.operators import graph

    from .views import code_edges

    n = code_nodes(spark, d).withColumn("_path", F.coalesce("file", "name"))
    kept = code_files(spark, d).where("doc_id % 3 = 0").select(F.col("path").alias("_path"))
    _, _, report = graph.selected(n, code_edges(spark, d), kept, "_path")
    return report


@query("p12_labels", f"{_C} SELECT vid, trim(regexp_replace(regexp_split_to_array(unified_name, '[.:#/]+')[-1], '\\(\\)$', '')) AS label FROM cn")
def p12(spark: SparkSession, d: str) -> DataFrame:
    return code_nodes(spark, d).select("vid", text.bare_symbol(F.col("unified_name")).alias("label"))


@query("p14_symbol_ids", f"""WITH {FILES_SQL} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'bare' ELSE replace(path, '\\', '/') || ':Foo.bar()' END AS symbol FROM files""")
def p14(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.expr("doc_id % 3 = 0"), F.lit("bare")).otherwise(F.concat(F.lit("./"), "path", F.lit(":Foo.bar()")))
    return files(spark, d).select("doc_id", text.normalized_symbol(raw).alias("symbol"))


@query("sc24_span_reads", f"""SELECT doc_id, CASE WHEN len(ls) > 1 THEN array_to_string(ls[2:4], '') END AS content FROM (SELECT doc_id, {_LINES} AS ls FROM documents)""")
def sc24(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("commit", F.col("doc_id") % 3)
    rows = docs.select("doc_id", F.col("doc_id").alias("file"), "commit", F.lit(1).alias("start_line"), F.lit(3).alias("end_line"))
    return projection.read_spans(rows, docs.select(F.col("doc_id").alias("path"), "commit", "text")).select("doc_id", "content")


@query("sc25_node_contents", f"""{_C} SELECT vid, CASE WHEN type = 'file' THEN length(f.text) ELSE coalesce(length(array_to_string({_LINES.replace('text', 'f.text')}[start_line + 1:end_line + 1], '')), 0) END::INTEGER AS chars FROM cn LEFT JOIN cf f ON f.path = coalesce(file, name)""")
def sc25(spark: SparkSession, d: str) -> DataFrame:
    out = projection.node_contents(code_nodes(spark, d), code_files(spark, d), ("symbol", "class", "function", "method", "field"))
    return out.select("vid", F.length("content").alias("chars"))


@query("j24_benchmark_cases", "SELECT item_id, doc_id FROM benchmark JOIN documents ON item_id = doc_id")
def j24(spark: SparkSession, d: str) -> DataFrame:
    from quarry.operators import incremental

    cases = table(spark, d, "benchmark").select(F.concat(F.lit("instance_x__"), "item_id").alias("instance_id"), "item_id")
    sources = table(spark, d, "documents").select(F.concat(F.lit("x__"), "doc_id").alias("instance_id"), "doc_id")
    return incremental.benchmark_cases(cases, sources, require=True).select("item_id", "doc_id")


@query("o8_early_limit", f"WITH {_RANKED} SELECT doc_id, rank::INTEGER AS rank FROM r WHERE rank <= 100 AND lang = 'en' ORDER BY rank LIMIT 7")
def o8(spark: SparkSession, d: str) -> DataFrame:
    return fusion.filtered(_ranked(spark, d, 100), [F.col("lang") == "en"], 7).select("doc_id", "rank")


@query("o9_fast_ranks", f"{_C}, r AS (SELECT dst AS vid, count(*) AS n FROM ce WHERE type = 'reference' GROUP BY 1), t AS (SELECT file, sum(n)::BIGINT AS n FROM r JOIN sym USING (vid) GROUP BY 1) SELECT file, n FROM t ORDER BY n DESC, file LIMIT 10")
def o9(spark: SparkSession, d: str) -> DataFrame:
    from .views import code_edges

    refs = code_edges(spark, d).where("type = 'reference'").groupBy(F.col("dst").alias("vid")).agg(F.count("*").alias("n"))
    return refs.join(code_nodes(spark, d).where("type <> 'file'"), "vid").groupBy("file").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "file").limit(10)
