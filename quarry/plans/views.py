"""The engine's abstractions over the test tables, as Spark views and as SQL with the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import cells, impact
from quarry.operators.graph import shared_base
from quarry.registry import table

#: Views this application has built over the test tables: folder by (application, tables, name).
_BUILT: dict[tuple[str, str, str], str] = {}


def kept(spark: SparkSession, d: str, name: str, build) -> str:
    """The folder of a view over the tables of ``d``, built at its first use and read by all later queries of the application."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _BUILT:
        folder = f"{shared_base(spark)}/views-{uuid.uuid4().hex}/{name}"
        build(folder)
        _BUILT[key] = folder
    return _BUILT[key]


def word_tokens(column: str) -> Column:
    """Tokens between white space, as they are."""
    return F.filter(F.split(F.col(column), r"\s+"), lambda t: t != "")


def lexical_view(spark: SparkSession, d: str, words: bool = False) -> impact.View:
    """The kept lexical view of ``documents``: of lower-cased letters and digits, or of the words between white space."""
    tokens = word_tokens("text") if words else text.lexical_tokens(F.col("text"))
    folder = kept(spark, d, "words" if words else "lexical", lambda to: impact.build(table(spark, d, "documents"), "doc_id", tokens, to))
    return impact.load(spark, folder)


def vector_view(spark: SparkSession, d: str) -> cells.View:
    """The kept view of ``embeddings`` by cell."""
    return cells.load(spark, kept(spark, d, "vectors", lambda to: cells.build(table(spark, d, "embeddings"), "vec_id", "embedding", to)))


FILES_SQL = r"""files AS (SELECT doc_id, text, lang, source, n_chars, source || CASE doc_id % 5 WHEN 0 THEN '/tests/mod' WHEN 1 THEN '/src/test_'
  WHEN 2 THEN '/lib/WidgetTest' WHEN 3 THEN '\src\core' ELSE '/pkg/mod' END || doc_id || CASE lang WHEN 'en' THEN '.py' WHEN 'de' THEN '.go'
  WHEN 'fr' THEN '.d.ts' ELSE '.MD' END AS path FROM documents)"""


def files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as source files: path, text, lang, source."""
    docs = table(spark, d, "documents")
    stem = F.when(F.expr("doc_id % 5 = 0"), "/tests/mod").when(F.expr("doc_id % 5 = 1"), "/src/test_").when(F.expr("doc_id % 5 = 2"), "/lib/WidgetTest")
    stem = stem.when(F.expr("doc_id % 5 = 3"), "\\src\\core").otherwise("/pkg/mod")
    ext = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "de", ".go").when(F.col("lang") == "fr", ".d.ts").otherwise(".MD")
    return docs.withColumn("path", F.concat("source", stem, F.col("doc_id").cast("string"), ext))


GRAPH_SQL = """nodes AS (
  SELECT 1000000000 + c_custkey AS vid, c_name AS name, 'customer' AS type, 'c' || c_nationkey AS file, c_custkey % 500 AS start_line, c_custkey % 500 + 20 AS end_line FROM customer
  UNION ALL SELECT 2000000000 + o_orderkey, 'order' || o_orderkey, 'order', 'o' || o_custkey % 25, o_orderkey % 500, o_orderkey % 500 + 10 FROM orders
  UNION ALL SELECT 3000000000 + p_partkey, p_name, 'part', p_brand, p_partkey % 500, p_partkey % 500 + p_size FROM part
  UNION ALL SELECT 4000000000 + s_suppkey, s_name, 'supplier', 's' || s_nationkey, s_suppkey % 500, s_suppkey % 500 + 5 FROM supplier
  UNION ALL SELECT 5000000000 + n_nationkey, n_name, 'nation', 'world', n_nationkey, n_nationkey FROM nation
  UNION ALL SELECT 6000000000 + r_regionkey, r_name, 'region', 'world', r_regionkey, r_regionkey FROM region),
edges AS (
  SELECT 1000000000 + o_custkey AS src, 2000000000 + o_orderkey AS dst, 'reference' AS type, 'c' || o_custkey % 25 AS anchor_file, o_orderkey % 100 AS anchor_line FROM orders
  UNION ALL SELECT 2000000000 + l_orderkey, 3000000000 + l_partkey, 'reference', 'o' || l_orderkey % 25, l_linenumber FROM lineitem
  UNION ALL SELECT DISTINCT 3000000000 + l_partkey, 4000000000 + l_suppkey, 'import', CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT) FROM lineitem
  UNION ALL SELECT 6000000000 + n_regionkey, 5000000000 + n_nationkey, 'contain', 'world', n_nationkey FROM nation
  UNION ALL SELECT 5000000000 + c_nationkey, 1000000000 + c_custkey, 'contain', 'world', c_custkey % 100 FROM customer
  UNION ALL SELECT 5000000000 + s_nationkey, 4000000000 + s_suppkey, 'contain', 'world', s_suppkey % 100 FROM supplier)"""


def nodes(spark: SparkSession, d: str) -> DataFrame:
    def part(name: str, base: int, key: str, *cols: str) -> DataFrame:
        return table(spark, d, name).selectExpr(f"CAST({base} AS BIGINT) + {key} AS vid", *[f"{c} AS {n}" for c, n in zip(cols, ("name", "type", "file", "start_line", "end_line"))])

    out = part("customer", 1000000000, "c_custkey", "c_name", "'customer'", "concat('c', c_nationkey)", "c_custkey % 500", "c_custkey % 500 + 20")
    out = out.unionByName(part("orders", 2000000000, "o_orderkey", "concat('order', o_orderkey)", "'order'", "concat('o', o_custkey % 25)", "o_orderkey % 500", "o_orderkey % 500 + 10"))
    out = out.unionByName(part("part", 3000000000, "p_partkey", "p_name", "'part'", "p_brand", "p_partkey % 500", "p_partkey % 500 + p_size"))
    out = out.unionByName(part("supplier", 4000000000, "s_suppkey", "s_name", "'supplier'", "concat('s', s_nationkey)", "s_suppkey % 500", "s_suppkey % 500 + 5"))
    out = out.unionByName(part("nation", 5000000000, "n_nationkey", "n_name", "'nation'", "'world'", "CAST(n_nationkey AS BIGINT)", "CAST(n_nationkey AS BIGINT)"))
    return out.unionByName(part("region", 6000000000, "r_regionkey", "r_name", "'region'", "'world'", "CAST(r_regionkey AS BIGINT)", "CAST(r_regionkey AS BIGINT)"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    def part(name: str, src: str, dst: str, type_: str, file: str, line: str) -> DataFrame:
        return table(spark, d, name).selectExpr(f"CAST({src} AS BIGINT) AS src", f"CAST({dst} AS BIGINT) AS dst", f"'{type_}' AS type", f"{file} AS anchor_file", f"CAST({line} AS BIGINT) AS anchor_line")

    out = part("orders", "1000000000 + o_custkey", "2000000000 + o_orderkey", "reference", "concat('c', o_custkey % 25)", "o_orderkey % 100")
    out = out.unionByName(part("lineitem", "2000000000 + l_orderkey", "3000000000 + l_partkey", "reference", "concat('o', l_orderkey % 25)", "l_linenumber"))
    out = out.unionByName(part("lineitem", "3000000000 + l_partkey", "4000000000 + l_suppkey", "import", "CAST(NULL AS STRING)", "NULL").distinct())
    out = out.unionByName(part("nation", "6000000000 + n_regionkey", "5000000000 + n_nationkey", "contain", "'world'", "n_nationkey"))
    out = out.unionByName(part("customer", "5000000000 + c_nationkey", "1000000000 + c_custkey", "contain", "'world'", "c_custkey % 100"))
    return out.unionByName(part("supplier", "5000000000 + s_nationkey", "4000000000 + s_suppkey", "contain", "'world'", "s_suppkey % 100"))


# A code graph: documents as files, parts as symbols of them (a class and its method share a file), order lines as references.
CODE_SQL = FILES_SQL + r""",
cf AS (SELECT doc_id, replace(path, '\', '/') AS path, text FROM files),
sym AS (SELECT 8000000000 + p_partkey AS vid, 'sym' || p_partkey AS name, path AS file,
  CASE p_partkey % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'function' WHEN 2 THEN 'method' ELSE 'field' END AS type,
  CASE p_partkey % 4 WHEN 0 THEN 'Widget' || p_partkey WHEN 1 THEN 'get_' || string_split(p_name, ' ')[1] || '_' || p_partkey % 97 || '()'
    WHEN 2 THEN 'Widget' || (p_partkey - 2) || '.run' || p_partkey % 7 || '()' ELSE 'value' || p_partkey % 13 END AS label,
  (p_partkey % 300)::BIGINT AS start_line, (p_partkey % 300 + p_size)::BIGINT AS end_line
  FROM part JOIN cf ON doc_id = ((p_partkey - p_partkey % 4) // 4) % (SELECT count(*) FROM documents)),
cn AS (SELECT vid, name, file || ':' || label AS unified_name, type, file, start_line, end_line FROM sym
  UNION ALL SELECT 7000000000 + doc_id, path, path, 'file', NULL, NULL, NULL FROM cf),
ce AS (SELECT 7000000000 + doc_id AS src, vid AS dst, 'contain' AS type, NULL::VARCHAR AS anchor_file, NULL::BIGINT AS anchor_line FROM sym JOIN cf ON file = path WHERE type <> 'method'
  UNION ALL SELECT vid - 2, vid, 'contain', NULL, NULL FROM sym WHERE type = 'method'
  UNION ALL SELECT 7000000000 + doc_id, 7000000000 + doc_id * 3 % (SELECT count(*) FROM documents), 'import', NULL, NULL FROM cf
  UNION ALL SELECT s.vid, 8000000000 + (l_partkey * 7 + l_suppkey) % (SELECT count(*) FROM part), 'reference', s.file, s.start_line + l_linenumber FROM lineitem JOIN sym s ON s.vid = 8000000000 + l_partkey)"""


def code_files(spark: SparkSession, d: str) -> DataFrame:
    """path, text and doc_id of the code graph's files."""
    return files(spark, d).withColumn("path", F.replace("path", F.lit("\\"), F.lit("/")))


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").agg(F.count("*")).scalar()
    part = table(spark, d, "part").withColumn("doc_id", F.expr("(p_partkey - p_partkey % 4) div 4") % n)
    kind = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'function' WHEN 2 THEN 'method' ELSE 'field' END")
    label = F.expr("""CASE p_partkey % 4 WHEN 0 THEN concat('Widget', p_partkey) WHEN 1 THEN concat('get_', split(p_name, ' ')[0], '_', p_partkey % 97, '()')
      WHEN 2 THEN concat('Widget', p_partkey - 2, '.run', p_partkey % 7, '()') ELSE concat('value', p_partkey % 13) END""")
    rows = part.join(code_files(spark, d).select("doc_id", F.col("path").alias("file")), "doc_id")
    return rows.select(
        (F.lit(8000000000) + F.col("p_partkey")).alias("vid"), F.concat(F.lit("sym"), "p_partkey").alias("name"), "file", kind.alias("type"), label.alias("label"),
        (F.col("p_partkey") % 300).alias("start_line"), (F.col("p_partkey") % 300 + F.col("p_size")).cast("bigint").alias("end_line"), "doc_id",
    )


def code_nodes(spark: SparkSession, d: str) -> DataFrame:
    s = _symbols(spark, d).select("vid", "name", F.concat("file", F.lit(":"), "label").alias("unified_name"), "type", "file", "start_line", "end_line")
    none = F.lit(None)
    f = code_files(spark, d).select((F.lit(7000000000) + F.col("doc_id")).alias("vid"), F.col("path").alias("name"), F.col("path").alias("unified_name"), F.lit("file").alias("type"), none.cast("string").alias("file"), none.cast("bigint").alias("start_line"), none.cast("bigint").alias("end_line"))
    return s.unionByName(f)


def code_edges(spark: SparkSession, d: str) -> DataFrame:
    s = _symbols(spark, d)
    no_file, no_line = F.lit(None).cast("string").alias("anchor_file"), F.lit(None).cast("bigint").alias("anchor_line")
    edge = lambda df, src, dst, kind, *anchor: df.select(src.cast("bigint").alias("src"), dst.cast("bigint").alias("dst"), F.lit(kind).alias("type"), *(anchor or (no_file, no_line)))
    f = code_files(spark, d)
    out = edge(s.where("type <> 'method'"), F.lit(7000000000) + F.col("doc_id"), F.col("vid"), "contain")
    out = out.unionByName(edge(s.where("type = 'method'"), F.col("vid") - 2, F.col("vid"), "contain"))
    out = out.unionByName(edge(f, F.lit(7000000000) + F.col("doc_id"), F.lit(7000000000) + F.col("doc_id") * 3 % table(spark, d, "documents").agg(F.count("*")).scalar(), "import"))
    n = table(spark, d, "part").agg(F.count("*")).scalar()
    lines = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber").join(s, F.col("vid") == F.lit(8000000000) + F.col("l_partkey"))
    refs = edge(lines, F.col("vid"), F.lit(8000000000) + (F.col("l_partkey") * 7 + F.col("l_suppkey")) % n, "reference", F.col("file").alias("anchor_file"), (F.col("start_line") + F.col("l_linenumber")).alias("anchor_line"))
    return out.unionByName(refs)
