"""Queries over sources: scans, chunks, symbol indexes, summaries, entry points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.registry import query, table
from quarry.sources import chunkers, indexes, repository

from .views import FILES_SQL, files

_VIS = "NOT list_has_any(string_split(replace(path, '\\', '/'), '/'), ['.git', '.hg', '.svn', 'node_modules', '__pycache__', '.venv', 'venv', 'dist', 'build', 'target', '.tox', '.mypy_cache'])"


@query("sc1_scanned_files", f"WITH {FILES_SQL} SELECT lang, count(*) AS n FROM files WHERE {_VIS} AND octet_length(encode(text)) <= 10485760 GROUP BY 1")
def sc1(spark: SparkSession, d: str) -> DataFrame:
    rows = files(spark, d).where(repository.visible(F.col("path"))).where(F.octet_length("text") <= repository.MOST_BYTES)
    return rows.groupBy("lang").agg(F.count("*").alias("n"))


@query("sc3_visible_count", f"WITH {FILES_SQL} SELECT count(*) AS n_files FROM files WHERE {_VIS} AND NOT starts_with(replace(path, '\\', '/'), 'src2/')")
def sc3(spark: SparkSession, d: str) -> DataFrame:
    return repository.count_visible(files(spark, d), F.col("path"), excluded=("src2",))


@query("sc5_discovered_files", f"""WITH {FILES_SQL}, p AS (SELECT *, replace(path, '\\', '/') AS p FROM files)
SELECT doc_id, CASE WHEN ends_with(lower(p), '.py') THEN 'python' WHEN ends_with(lower(p), '.go') THEN 'go' ELSE 'typescript' END AS language FROM p WHERE {_VIS} AND regexp_matches(lower(p), '[.](py|go|ts)$')
 AND list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) <= 1500 AND NOT (regexp_matches(lower(p), '(^|/)(test|tests|testing|spec|specs|__tests__)(/|$)') OR regexp_matches(lower(regexp_extract(p, '[^/]*$')), '^test_|_tests?\\.py$|\\.test\\.|\\.spec\\.')
 OR regexp_matches(regexp_replace(regexp_extract(p, '[^/]*$'), '\\.[^.]*$', ''), '(Test|Tests|Spec)$') OR regexp_matches(lower(regexp_replace(regexp_extract(p, '[^/]*$'), '\\.[^.]*$', '')), '[_-](test|tests|spec)$'))""")
def sc5(spark: SparkSession, d: str) -> DataFrame:
    known = {".py": "python", ".go": "go", ".ts": "typescript"}
    return repository.discovered(files(spark, d), F.col("path"), F.col("text"), known, drop_tests=True, line_limit=1500).select("doc_id", "language")


@query("sc8_statistics", f"WITH {FILES_SQL} SELECT lower(regexp_extract(regexp_extract(replace(path, '\\', '/'), '[^/]*$'), '[^.]([.][^.]+)$', 1)) AS extension, count(*) AS n_files, sum(n_chars)::BIGINT AS bytes FROM files GROUP BY 1")
def sc8(spark: SparkSession, d: str) -> DataFrame:
    return repository.statistics(files(spark, d), F.col("path"), F.col("n_chars"))


# A file a document: a function with the text as its docstring, a definition in that too, then a class of one method or two.
_SOURCE_SQL = """s AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, source || '/m' || doc_id || '.py' AS file, length(t) - length(replace(t, chr(10), '')) + 2 AS b, length(t) % 2 = 0 AS two, length(t) + 9 AS widest FROM s)"""


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """Documents as Python files: the text is the docstring of a function, with what looks like a definition; every other text has a second method."""
    body = F.translate(F.coalesce("text", F.lit("")), "\"'\\", "   ")
    put = F.when(F.length(F.coalesce("text", F.lit(""))) % 2 == 0, "\n    def put(self, y):\n        pass\n").otherwise("")
    code = F.concat(
        F.lit("import os\n\n\ndef first_"), "doc_id", F.lit('(x):\n    """What it does.\ndef fake():\n'), body, F.lit('\n"""\n    return x\n\n\nclass Holder'), "doc_id",
        F.lit(":\n    def get(self):\n        return first_"), "doc_id", F.lit("(1)\n"), put, F.lit("\n\nNOTE = '"), F.translate(body, "\n", " "), F.lit("'\n"),
    )
    return table(spark, d, "documents").select(F.concat("source", F.lit("/m"), "doc_id", F.lit(".py")).alias("path"), code.alias("text"), "doc_id")


_CHUNKS = _SOURCE_SQL + """, c AS (SELECT doc_id, file, unnest([{'kind': 'header', 'name': 'header', 'first': 0, 'last': 2}, {'kind': 'function', 'name': 'first_' || doc_id, 'first': 3, 'last': 6 + b},
  {'kind': 'method', 'name': 'Holder' || doc_id || '.get', 'first': 10 + b, 'last': 11 + b}, {'kind': 'method', 'name': 'Holder' || doc_id || '.put', 'first': 13 + b, 'last': 14 + b},
  {'kind': 'epilogue', 'name': 'epilogue', 'first': 12 + b + if(two, 3, 0), 'last': 15 + b + if(two, 3, 0)}]) AS x, two FROM m),
k AS (SELECT doc_id, file, x.kind AS kind, x.name AS name, x.first::BIGINT AS first, x.last::BIGINT AS last FROM c WHERE two OR x.name NOT LIKE '%.put')"""


@query("sc9_definition_chunks", f"WITH {_CHUNKS} SELECT file, kind, name, first, last FROM k")
def sc9(spark: SparkSession, d: str) -> DataFrame:
    return chunkers.chunk_files(_sources(spark, d)).select("file", "kind", "name", "first", "last")


@query("sc4_chunked_repository", f"WITH {_CHUNKS} SELECT kind, count(*) AS n, count(DISTINCT name) AS names FROM k JOIN m USING (doc_id) WHERE widest <= 10000 GROUP BY 1")
def sc4(spark: SparkSession, d: str) -> DataFrame:
    rows = repository.discovered(_sources(spark, d), F.col("path"), F.col("text"), chunkers.extension_languages())
    return chunkers.chunk_files(rows).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))


@query("sc10_chunk_order", f"WITH {_CHUNKS} SELECT doc_id, string_agg(kind, ',' ORDER BY first) AS kinds FROM k GROUP BY 1")
def sc10(spark: SparkSession, d: str) -> DataFrame:
    rows = chunkers.chunk_files(_sources(spark, d)).withColumn("doc_id", F.regexp_extract("file", "m([0-9]+)", 1).cast("bigint"))
    ordered = F.array_sort(F.collect_list(F.struct("first", "kind")))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["kind"]), ",").alias("kinds"))


@query("sc12_skeletons", f"WITH {_SOURCE_SQL} SELECT doc_id, 'def first_' || doc_id || '(x):' || chr(10) || 'class Holder' || doc_id || ':' || chr(10) || '    def get(self):' || if(two, chr(10) || '    def put(self, y):', '') AS content FROM m")
def sc12(spark: SparkSession, d: str) -> DataFrame:
    rows = chunkers.chunk_files(_sources(spark, d), skeleton=True)
    return rows.select(F.regexp_extract("file", "m([0-9]+)", 1).cast("bigint").alias("doc_id"), "content")


_ENDINGS = {".py": "python", ".go": "go", ".RS": "rust", ".hpp": "cpp", ".h": "cpp", ".cs": "csharp", ".java": "java", ".kt": "kotlin", ".lua": "lua", ".php": "php", ".rb": "ruby", ".scala": "scala", ".swift": "swift", ".tsx": "typescript", ".mjs": "javascript", ".txt": None, "": None}
_ENDING_SQL = f"[{', '.join(repr(e) for e in _ENDINGS)}][doc_id % {len(_ENDINGS)} + 1]"
_LANGUAGE_SQL = f"[{', '.join('NULL' if v is None else repr(v) for v in _ENDINGS.values())}][doc_id % {len(_ENDINGS)} + 1]"


def _any_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files of many languages."""
    ending = F.element_at(F.array(*[F.lit(e) for e in _ENDINGS]), (F.col("doc_id") % len(_ENDINGS) + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/m"), F.col("doc_id").cast("string"), ending).alias("path"))


@query("sc13_languages", f"SELECT source || '/m' || doc_id || {_ENDING_SQL} AS path, {_LANGUAGE_SQL} AS language FROM documents")
def sc13(spark: SparkSession, d: str) -> DataFrame:
    return _any_files(spark, d).select("path", chunkers.language_of(F.col("path")).alias("language"))


@query("e48_language_map", f"SELECT {_LANGUAGE_SQL} AS language, count(*) AS files FROM documents WHERE {_LANGUAGE_SQL} IS NOT NULL AND source IS NOT NULL GROUP BY 1")
def e48(spark: SparkSession, d: str) -> DataFrame:
    known = chunkers.extension_languages()
    pairs = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    ending = F.lower(F.regexp_extract("path", r"(\.[A-Za-z]+)$", 1))
    return _any_files(spark, d).select(F.get(F.array(pairs), F.lit(0))[ending].alias("language")).where("language is not null").groupBy("language").agg(F.count("*").alias("files"))


@query("w9_file_bounds", f"WITH {_SOURCE_SQL} SELECT file, 2::BIGINT AS header_last, (12 + b + if(two, 3, 0))::BIGINT AS epilogue_first FROM m")
def w9(spark: SparkSession, d: str) -> DataFrame:
    rows = _sources(spark, d)
    found = chunkers.chunk_files(rows).where("kind NOT IN ('header', 'epilogue')")
    return chunkers.file_bounds(found, rows.select(F.col("path").alias("file"), F.size(F.split("text", "\n")).alias("n_lines")))


@query("sc16_code_graph", f"""WITH {_CHUNKS}, n AS (SELECT *, file || ':' || name || '()' AS symbol FROM k WHERE kind IN ('function', 'method'))
SELECT 'contain' AS type, file AS src, symbol AS dst, NULL::VARCHAR AS anchor_file, NULL::BIGINT AS anchor_line FROM n
UNION ALL SELECT 'reference', a.symbol, b.symbol, a.file, a.last FROM n a JOIN n b USING (doc_id) WHERE a.name LIKE '%.get' AND b.kind = 'function'""")
def sc16(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = chunkers.code_graph(_sources(spark, d))
    end = lambda name: nodes.select(F.col("vid").alias(name), F.col("unified_name").alias(f"_{name}"))
    return edges.join(end("src"), "src").join(end("dst"), "dst").select("type", F.col("_src").alias("src"), F.col("_dst").alias("dst"), "anchor_file", "anchor_line")


def _index_texts(spark: SparkSession, d: str) -> DataFrame:
    """Decoded index texts made from parts: a file a brand, a definition a part, a use of the part before it."""
    occ = F.concat(F.lit('  occurrences {\n    range: '), F.col("p_size").cast("string"), F.lit("\n    range: 4\n    range: 9\n    symbol: \"pkg `x`/sym"), F.col("p_partkey").cast("string"), F.lit("().\"\n    symbol_roles: 1\n  }\n  occurrences {\n    range: "), F.col("p_size").cast("string"), F.lit("\n    range: 12\n    range: "), (F.col("p_size") + 1).cast("string"), F.lit("\n    range: 3\n    symbol: \"local "), (F.col("p_partkey") % 7).cast("string"), F.lit('"\n  }\n'))
    body = table(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", occ.alias("o")))), lambda x: x["o"]), "").alias("o"))
    return body.select(F.concat(F.lit("metadata {\n  text_document_encoding: UTF8\n}\ndocuments {\n  relative_path: \"src/"), "p_brand", F.lit(".ts\"\n"), "o", F.lit("}\nexternal_symbols {\n}\n")).alias("value"))


@query("sc14_index_occurrences", """SELECT 'src/' || p_brand || '.ts' AS file, p_size AS start_line, 4 AS start_char, p_size AS end_line, 9 AS end_char, 1 AS roles, 'pkg `x`/sym' || p_partkey || '().' AS symbol FROM part
UNION ALL SELECT 'src/' || p_brand || '.ts', p_size, 12, p_size + 1, 3, 0, 'local ' || p_partkey % 7 FROM part""")
def sc14(spark: SparkSession, d: str) -> DataFrame:
    return indexes.index_occurrences(_index_texts(spark, d))


@query("sc15_occurrence_ranges", "SELECT 'src/' || p_brand || '.ts' AS file, count(*) AS three, count(*) AS four FROM part GROUP BY 1")
def sc15(spark: SparkSession, d: str) -> DataFrame:
    occ = indexes.index_occurrences(_index_texts(spark, d))
    return occ.groupBy("file").agg(F.count_if(F.col("start_line") == F.col("end_line")).alias("three"), F.count_if(F.col("start_line") < F.col("end_line")).alias("four"))


@query("sc17_occurrence_graph", "SELECT 'contain' AS type, count(*) AS n FROM part")
def sc17(spark: SparkSession, d: str) -> DataFrame:
    _, edges = indexes.graph_from_occurrences(indexes.index_occurrences(_index_texts(spark, d)))
    return edges.groupBy("type").agg(F.count("*").alias("n"))


@query("e40_occurrence_facts", "SELECT 'src/' || p_brand || '.ts' AS file, count(*) + count(DISTINCT p_partkey % 7) AS symbols, 2 * count(*) AS occurrences FROM part GROUP BY 1")
def e40(spark: SparkSession, d: str) -> DataFrame:
    out = indexes.occurrence_facts(indexes.index_occurrences(_index_texts(spark, d)))
    return out.select("file", F.size("symbols").cast("bigint").alias("symbols"), "occurrences")


def _trees(spark: SparkSession, d: str) -> DataFrame:
    span = lambda a, b: f'"range": {{"start": {{"line": {a}}}, "end": {{"line": {b}}}}}'
    tree = F.concat(F.lit('[{"name": "C'), F.col("n_nationkey"), F.lit(f'", "kind": 5, {span(1, 9)}, "children": [{{"name": "run", "kind": 6, {span(2, 4)}, "children": [{{"name": "tmp", "kind": 13, {span(3, 3)}}}]}}, {{"name": "x", "kind": 8, {span(5, 5)}}}]}}, {{"name": "s", "kind": 15, {span(11, 11)}}}]'))
    return table(spark, d, "nation").select(F.concat(F.lit("src/r"), "n_regionkey", F.lit("/"), "n_name", F.lit(".kt")).alias("path"), tree.alias("symbols"))


@query("sc18_symbol_trees", """SELECT n_nationkey AS k, t.name, t.type, t.depth FROM nation, (VALUES ('C', 'class', 1), ('run', 'method', 2), ('x', 'field', 2)) t(name, type, depth)""")
def sc18(spark: SparkSession, d: str) -> DataFrame:
    rows = indexes.symbol_rows(_trees(spark, d), "path", "symbols")
    nodes, _ = indexes.graph_from_trees(rows)
    s = nodes.where("type NOT IN ('file', 'directory')").withColumn("label", F.regexp_replace("unified_name", "^[^:]*:", ""))
    parts = F.split(F.regexp_replace("label", r"\(\)$", ""), r"\.")
    return s.select(F.regexp_extract("file", "NATION_([0-9]+)", 1).cast("int").alias("k"), F.regexp_replace(F.element_at(parts, -1), "^C[0-9]+$", "C").alias("name"), "type", F.size(parts).alias("depth"))


@query("sc18_tree_edges", "SELECT count(*) * 3 + count(*) + count(DISTINCT n_regionkey) AS n FROM nation")
def sc18_edges(spark: SparkSession, d: str) -> DataFrame:
    _, edges = indexes.graph_from_trees(indexes.symbol_rows(_trees(spark, d), "path", "symbols"))
    return edges.agg(F.count("*").alias("n"))


@query("sc26_readme_summaries", """SELECT doc_id, 'Project ' || doc_id || ' keeps small things in order for you.' AS summary FROM documents""")
def sc26(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("# Title\n\n[![badge](x)](y)\n\n```\ncode here is long enough to be a sentence\n```\n> a quote that is long enough to be taken\n\nPlease install it with one of the many tools first\n\n**Project** "), "doc_id", F.lit(" keeps [small](http://x) things\nin order for you.\n\nMore text that nobody will ever read here.\n"))
    return table(spark, d, "documents").select("doc_id", repository.readme_summary(body).alias("summary"))


@query("sc27_entry_points", """SELECT n_nationkey::VARCHAR AS repo, unnest(CASE n_nationkey % 4 WHEN 0 THEN ['src/a.ts', 'lib/b.js', 'bin/c.js'] WHEN 1 THEN ['src/pk/cli.py', 'src/pk/__init__.py'] WHEN 2 THEN ['src/main.rs', 'src/lib.rs'] ELSE ['main.go', 'cmd/tool/main.go'] END) AS path FROM nation""")
def sc27(spark: SparkSession, d: str) -> DataFrame:
    manifests = {
        0: ("package.json", '{"name": "p", "source": "./src/a.ts", "main": "lib/b.js", "bin": {"c": "./bin/c.js"}}', ["src/a.ts", "lib/b.js", "bin/c.js"]),
        1: ("pyproject.toml", '[project]\nname = "pk"\n\n[project.scripts]\npk = "pk.cli:main"\n', ["src/pk/cli.py", "src/pk/__init__.py"]),
        2: ("Cargo.toml", '[package]\nname = "c"\n', ["src/main.rs", "src/lib.rs"]),
        3: ("go.mod", "module m\n", ["main.go", "cmd/tool/main.go", "internal/main.go"]),
    }
    rows = spark.createDataFrame([(k, path, body if path == name else "") for k, (name, body, paths) in manifests.items() for path in [name, *paths]], "k int, path string, text string")
    repos = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("repo"), (F.col("n_nationkey") % 4).alias("k"))
    return repository.entry_points(repos.join(rows, "k").select("repo", "path", "text")).select("repo", "path")


@query("e38_supplemented_graph", f"WITH {_SOURCE_SQL} SELECT file, 3 + two::BIGINT AS added FROM m WHERE doc_id % 2 = 0")
def e38(spark: SparkSession, d: str) -> DataFrame:
    rows = _sources(spark, d)
    nodes, edges = chunkers.code_graph(rows.where("doc_id % 2 = 1"))
    more, _ = indexes.supplemented(nodes, edges, rows)
    new = more.join(nodes.select("vid"), "vid", "left_anti")
    return new.groupBy(F.coalesce("file", "name").alias("file")).agg(F.count("*").alias("added"))


@query("f10_generated_files", f"WITH {FILES_SQL} SELECT doc_id, doc_id % 3 = 0 OR ends_with(path, '.d.ts') AS generated FROM files")
def f10(spark: SparkSession, d: str) -> DataFrame:
    path = F.when(F.expr("doc_id % 3 = 0"), F.concat(F.lit("x/dist/"), "path")).otherwise(F.col("path"))
    return files(spark, d).select("doc_id", text.is_generated_file(path).alias("generated"))
