"""Queries over identifiers, paths and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import intervals, sparse
from quarry.registry import query, table

from .views import FILES_SQL, files, kept


@query("p15_lexical_tokens", """
SELECT doc_id, list_filter(regexp_split_to_array(lower(regexp_replace(text, '\\(\\)', '', 'g')), '[^a-z0-9]+'), lambda t: t <> '') AS tokens FROM documents""".replace("\\\\", "\\"))
def p15(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.lexical_tokens(F.col("text")).alias("tokens"))


@query("p16_path_tokens", f"""WITH {FILES_SQL}, p AS (SELECT doc_id, regexp_replace(regexp_replace(path, '\\.[A-Za-z0-9]+$', ''), '[\\\\/]+', '_', 'g') AS s FROM files)
SELECT doc_id, list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(s, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'),
  lambda t: lower(t)), lambda t: length(t) > 1) AS tokens FROM p""")
def p16(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("doc_id", text.path_tokens(F.col("path")).alias("tokens"))


@query("p13_normalized_path", f"""WITH {FILES_SQL} SELECT doc_id, replace(path, '\\', '/') AS path FROM files""")
def p13(spark: SparkSession, d: str) -> DataFrame:
    odd = F.concat(F.lit("./x/.././"), "path")
    return files(spark, d).select("doc_id", text.normalized_path(odd).alias("path"))


@query("f5_extension_filter", f"""WITH {FILES_SQL} SELECT doc_id, path FROM files WHERE lower(regexp_extract(path, '(\\.[^.]+)$', 1)) IN ('.md', '.go')""")
def f5(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).where(text.has_extension(F.col("path"), [".md", "GO"])).select("doc_id", "path")


@query("f6_glob_exclude", f"""WITH {FILES_SQL} SELECT doc_id FROM files WHERE NOT regexp_matches(replace(path, '\\', '/'), '^src1.*\\.py$') AND NOT regexp_matches(replace(path, '\\', '/'), '^.*/tests/.*$')""")
def f6(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).where(~text.matches_any(F.col("path"), ["src1*.py", "*/tests/*"])).select("doc_id")


@query("f7_test_paths", f"""WITH {FILES_SQL}, p AS (SELECT doc_id, replace(path, '\\', '/') AS p, regexp_extract(replace(path, '\\', '/'), '[^/]*$') AS f FROM files)
SELECT doc_id, (regexp_matches(lower(p), '(^|/)(test|tests|testing|spec|specs|__tests__)(/|$)') OR regexp_matches(lower(f), '^test_|_tests?\\.py$|\\.test\\.|\\.spec\\.')
  OR regexp_matches(lower(regexp_replace(f, '\\.[^.]*$', '')), '[_-](test|tests|spec)$') OR regexp_matches(regexp_replace(f, '\\.[^.]*$', ''), '(Test|Tests|Spec)$')) AS is_test FROM p""")
def f7(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("doc_id", text.is_test_path(F.col("path")).alias("is_test"))


@query("f8_test_files", f"""WITH {FILES_SQL}, p AS (SELECT doc_id, lower(replace(path, '\\', '/')) AS p FROM files)
SELECT doc_id, (regexp_matches(p, '(^|/)(test|tests|spec|specs|__tests__)/') OR regexp_matches(regexp_extract(p, '[^/]*$'), '^test|_test\\.[a-z]+$|\\.(test|spec)\\.')) AS is_test FROM p""")
def f8(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("doc_id", text.is_test_file(F.col("path")).alias("is_test"))


@query("f10_file_class", f"""WITH {FILES_SQL}, p AS (SELECT doc_id, lower(path) AS l, replace(path, '\\', '/') AS p FROM files)
SELECT doc_id, CASE WHEN l LIKE '%.d.ts' THEN 'declaration' WHEN regexp_matches(p, '/tests/|/test_|Test[.]') THEN 'test'
  WHEN regexp_matches(l, '[.](py|go)$') THEN 'source' ELSE 'other' END AS class FROM p""")
def f10(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("doc_id", text.file_class(F.col("path")).alias("class"))


@query("sc2_visible_files", f"""WITH {FILES_SQL} SELECT source, count(*) AS n_files, sum(n_chars)::BIGINT AS chars FROM files
WHERE NOT list_has_any(string_split(replace(path, '\\', '/'), '/'), ['tests', '.git', 'node_modules']) AND NOT starts_with(replace(path, '\\', '/'), 'src3/') GROUP BY 1""")
def sc2(spark: SparkSession, d: str) -> DataFrame:
    from quarry.sources.repository import visible

    return files(spark, d).where(visible(F.col("path"), ignored=("tests", ".git", "node_modules"), excluded=("src3",))).groupBy("source").agg(F.count("*").alias("n_files"), F.sum("n_chars").alias("chars"))


@query("sc6_minified", "SELECT doc_id, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) > 1500 AS minified FROM documents")
def sc6(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.is_minified(F.col("text"), 1500).alias("minified"))


@query("sc7_language", f"""WITH {FILES_SQL}, e AS (SELECT source, lower(regexp_extract(path, '([.][^.]+)$', 1)) AS x FROM files),
l AS (SELECT source, CASE x WHEN '.go' THEN 'go' WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' END AS lang, CASE x WHEN '.go' THEN 1 WHEN '.py' THEN 2 ELSE 3 END AS p FROM e)
SELECT source, arg_min(lang, p) AS language FROM l WHERE lang IS NOT NULL GROUP BY 1""")
def sc7(spark: SparkSession, d: str) -> DataFrame:
    from quarry.sources.repository import main_language

    return main_language(files(spark, d), "source", F.col("path"), [("go", (".go",)), ("python", (".py",)), ("typescript", (".ts",))])


@query("sc11_balanced_split", """WITH c AS (SELECT doc_id, 0 AS s, len(string_split(text, chr(10))) - 1 AS e FROM documents),
n AS (SELECT *, e - s + 1 AS t, greatest(ceil((e - s + 1) / 4.0), 1)::BIGINT AS p FROM c), x AS (SELECT *, unnest(range(0, p)) AS piece FROM n)
SELECT doc_id, piece::INTEGER AS piece, (s + piece * (t // p) + least(piece, t % p))::BIGINT AS piece_start,
  (s + piece * (t // p) + least(piece, t % p) + (t // p) + CASE WHEN piece < t % p THEN 1 ELSE 0 END - 1)::BIGINT AS piece_end FROM x""")
def sc11(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "documents").select("doc_id", F.lit(0).alias("s"), (F.size(text.lines_of(F.col("text"))) - 1).alias("e"))
    return intervals.balanced_split(chunks, "s", "e", 4).select("doc_id", "piece", "piece_start", "piece_end")


@query("sc23_line_window", "SELECT doc_id, substr(array_to_string(string_split(text, chr(10))[2:4], chr(10)), 1, 16000) AS content FROM documents")
def sc23(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.line_window(F.col("text"), 2, 4).alias("content"))


@query("p9_numbered_lines", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)
SELECT doc_id, array_to_string(list_transform(range(1, len(ls) + 1), lambda i: lpad((i + 8)::VARCHAR, length((8 + len(ls))::VARCHAR)::INTEGER, ' ') || ' | ' || ls[i]), chr(10)) AS content FROM l""")
def p9(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.numbered(text.lines_of(F.col("text")), F.lit(9)).alias("content"))


_PATCH = "'--- a/src/a' || doc_id || '.py' || chr(10) || '+++ b/src/b' || doc_id || '.py' || chr(10) || '@@ -1,2 +' || (doc_id % 90 + 1) || ',' || (doc_id % 4) || ' @@' || chr(10) || '+x' || chr(10) || '-y' || chr(10) || '@@ -9 +' || (doc_id % 7 + 100) || ' @@' || chr(10) || '+z'"


@query("p20_patch_hunks", """SELECT doc_id, 'src/b' || doc_id || '.py' AS file, unnest(CASE WHEN doc_id % 4 = 0 THEN [{'f': doc_id % 7 + 100, 'l': doc_id % 7 + 100}]
  ELSE [{'f': doc_id % 90 + 1, 'l': doc_id % 90 + doc_id % 4}, {'f': doc_id % 7 + 100, 'l': doc_id % 7 + 100}] END, recursive := true) FROM documents""".replace("SELECT doc_id, 'src", "SELECT doc_id, file, f::INTEGER AS first, l::INTEGER AS last FROM (SELECT doc_id, 'src").replace("FROM documents", "FROM documents)"))
def p20(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").selectExpr("doc_id", f"{_PATCH} AS patch")
    return rows.select("doc_id", F.explode(text.patch_hunks(F.col("patch"))).alias("h")).select("doc_id", "h.*")


@query("p21_changed_loc", "SELECT doc_id, 3 AS loc FROM documents")
def p21(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").selectExpr("doc_id", f"{_PATCH} AS patch").select("doc_id", text.changed_loc(F.col("patch")).alias("loc"))


@query("p18_prose_terms", """SELECT conv_id, turn, list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[`*_\\[\\]()#>/-]', ' ', 'g'), '[^a-z0-9]+'),
  lambda t: length(t) > 1 AND t NOT IN ('a','an','and','are','as','at','be','by','for','from','in','into','is','it','of','on','or','that','the','then','this','through','to','with')))) AS terms
FROM conversations""")
def p18(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_sort(text.prose_terms(F.col("text"))).alias("terms"))


@query("p19_redundancy_terms", """WITH t AS (SELECT p_partkey, unnest(regexp_split_to_array(lower(p_name || ' stories running walked classes passes'), '[^a-z0-9]+')) AS t FROM part),
b AS (SELECT p_partkey, CASE WHEN t LIKE '%ies' AND length(t) > 4 THEN left(t, length(t) - 3) || 'y' WHEN t LIKE '%ing' AND length(t) > 6 THEN left(t, length(t) - 3)
  WHEN t LIKE '%ed' AND length(t) > 5 THEN left(t, length(t) - 2) WHEN t LIKE '%s' AND t NOT LIKE '%ss' AND length(t) > 4 THEN left(t, length(t) - 1) ELSE t END AS t FROM t
  WHERE length(t) > 1 AND t NOT IN ('also','function','method','a','an','and','are','as','at','be','by','for','from','in','into','is','it','of','on','or','that','the','then','this','through','to','with'))
SELECT p_partkey, list_sort(list(DISTINCT t)) AS terms FROM b GROUP BY 1""")
def p19(spark: SparkSession, d: str) -> DataFrame:
    words = F.concat("p_name", F.lit(" stories running walked classes passes"))
    return table(spark, d, "part").select("p_partkey", F.array_sort(text.redundancy_terms(words)).alias("terms"))


@query("p22_modules", f"""WITH {FILES_SQL} SELECT regexp_replace(replace(path, '\\', '/'), '/[^/]*$', '') AS module, count(*) AS n FROM files GROUP BY 1""")
def p22(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).groupBy(text.module_of(text.posix(F.col("path"))).alias("module")).agg(F.count("*").alias("n"))


@query("f12_regex_grep", "SELECT doc_id FROM documents WHERE lang = 'en' AND regexp_matches(substr(text, 1, 8000), '(?i)(apache|mit) licen[sc]e')")
def f12(spark: SparkSession, d: str) -> DataFrame:
    return sparse.grep(table(spark, d, "documents"), "(apache|mit) licen[sc]e", F.col("text"), where=F.col("lang") == "en", max_chars=8000).select("doc_id")


@query("f13_identifier_occurrences", """SELECT doc_id, len(regexp_extract_all(text, '\\bthe\\s*\\('))::INTEGER AS calls FROM documents
WHERE regexp_matches(text, '(^|[^A-Za-z0-9_])the($|[^A-Za-z0-9_])') ORDER BY calls DESC, doc_id LIMIT 20""")
def f13(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return sparse.occurrences(docs, "the", F.col("text"), F.col("source"), F.col("doc_id")).select("doc_id", "calls")


@query("f14_trigram_search", f"WITH {FILES_SQL} SELECT doc_id FROM files WHERE contains(lower(text), 'license') AND regexp_matches(text, '(?i)(mit|apache) licen[sc]e') AND regexp_matches(path, 'py$')")
def f14(spark: SparkSession, d: str) -> DataFrame:
    return sparse.trigram_search(files(spark, d), "License regex:\"(mit|apache) licen[sc]e\" file:py$", "doc_id", F.col("text"), F.col("path")).select("doc_id")


def _trigrams(spark: SparkSession, d: str) -> DataFrame:
    folder = kept(spark, d, "trigrams", lambda to: sparse.keep_trigrams(table(spark, d, "documents"), "doc_id", F.col("text"), to))
    return spark.read.schema("gram string, id bigint").parquet(folder)


@query("f14_trigram_index", """WITH d AS (SELECT doc_id, lower(text) AS t FROM documents), g AS (SELECT DISTINCT doc_id, substr(t, i, 3) AS gram FROM (SELECT doc_id, t, unnest(range(1, length(t) - 1)) AS i FROM d))
SELECT gram, count(*) AS n FROM g GROUP BY 1""")
def f14_index(spark: SparkSession, d: str) -> DataFrame:
    return _trigrams(spark, d).groupBy("gram").agg(F.count("*").alias("n"))


@query("f14_indexed_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'that')")
def f14_indexed(spark: SparkSession, d: str) -> DataFrame:
    return sparse.trigram_search(table(spark, d, "documents"), "That", "doc_id", F.col("text"), index=_trigrams(spark, d)).select("doc_id")


@query("f14_regex_plan", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(apache|mit|bsd) licen[sc]es?|cc[ -]by|warrant(y|ies)')")
def f14_regex(spark: SparkSession, d: str) -> DataFrame:
    return sparse.trigram_search(table(spark, d, "documents"), 'regex:"(apache|mit|bsd) licen[sc]es?|cc[ -]by|warrant(y|ies)"', "doc_id", F.col("text"), index=_trigrams(spark, d)).select("doc_id")


@query("f15_file_matches", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
SELECT doc_id, min(n)::INTEGER AS first, max(n)::INTEGER AS last, count(*) AS hits FROM l WHERE contains(line, 'that') GROUP BY 1""")
def f15(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(text.lines_of(F.col("text"))).alias("n", "line")).where(F.col("line").contains("that"))
    return lines.groupBy("doc_id").agg(F.min(F.col("n") + 1).alias("first"), F.max(F.col("n") + 1).alias("last"), F.count("*").alias("hits"))


@query("f21_vocabulary_leaks", """WITH b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '') AS q,
  list_distinct(list_filter(regexp_split_to_array(lower(text || ' zzz yyy'), '[^a-z0-9]+'), lambda t: t <> '')) AS g FROM benchmark)
SELECT item_id, round(len(list_intersect(g, q)) / len(g), 6) AS overlap, len(list_intersect(g, q)) / len(g) > 0.5 AS leaks FROM b""")
def f21(spark: SparkSession, d: str) -> DataFrame:
    from quarry.operators import reports

    rows = table(spark, d, "benchmark")
    target = text.lexical_tokens(F.concat("text", F.lit(" zzz yyy")))
    return reports.leaks(rows, F.col("text"), target).select("item_id", "overlap", "leaks")
