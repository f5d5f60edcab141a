"""Queries over lexical and vector retrieval, and fusion of rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import cells, dense, fusion, impact, sparse
from quarry.registry import query, table

from . import planner
from .views import lexical_view, vector_view, word_tokens

_TOKENS = "list_filter(regexp_split_to_array(lower(regexp_replace({}, '\\(\\)', '', 'g')), '[^a-z0-9]+'), lambda t: t <> '')"
_SPACE = "list_filter(regexp_split_to_array({}, '\\s+'), lambda t: t <> '')"


def bm25_sql(tokens: str, k: int, name: str = "bm") -> str:
    return f"""dt AS (SELECT doc_id AS id, {tokens.format('text')} AS ts FROM documents),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(ts)) AS mean FROM dt),
po AS (SELECT id, len(ts) AS dl, term, count(*) AS tf FROM (SELECT id, ts, unnest(ts) AS term FROM dt) GROUP BY ALL),
i0 AS (SELECT term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM po, st GROUP BY 1),
i1 AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM i0) ELSE idf END AS idf FROM i0),
qt AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({tokens.format('text')}) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT query_id, id, sum(round(times * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) * 1099511627776.0)::BIGINT)::BIGINT AS units FROM qt JOIN i1 USING (term) JOIN po USING (term), st GROUP BY ALL),
sd0 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY units DESC, id) AS r FROM sc),
sz AS (SELECT item_id AS query_id, id, 0::BIGINT AS units FROM benchmark, (SELECT DISTINCT id FROM dt WHERE id IS NOT NULL) WHERE item_id NOT IN (SELECT query_id FROM sd0 WHERE units > 0 AND r = {k})),
sa AS (SELECT query_id, id, units FROM sd0 WHERE r <= {k} UNION ALL SELECT sz.* FROM sz LEFT JOIN sc ON sc.query_id = sz.query_id AND sc.id = sz.id WHERE sc.id IS NULL),
{name} AS (SELECT query_id, id, round(units / 1099511627776.0, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY units DESC, id)::INTEGER AS rank FROM sa QUALIFY rank <= {k})"""


def _bm25(spark: SparkSession, d: str, k: int) -> DataFrame:
    return impact.search(lexical_view(spark, d), table(spark, d, "benchmark"), "item_id", k, text.lexical_tokens(F.col("text")))


@query("t1_bm25_topk", f"WITH {bm25_sql(_SPACE, 10)} SELECT query_id, id AS doc_id, score, rank FROM bm")
def t1(spark: SparkSession, d: str) -> DataFrame:
    out = impact.search(lexical_view(spark, d, words=True), table(spark, d, "benchmark"), "item_id", 10, word_tokens("text"))
    return out.select("query_id", F.col("id").alias("doc_id"), "score", "rank")


@query("t1_bm25_scan", f"WITH {bm25_sql(_SPACE, 10)} SELECT query_id, id AS doc_id, score, rank FROM bm")
def t1_scan(spark: SparkSession, d: str) -> DataFrame:
    out = sparse.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id", 10, word_tokens("text"), word_tokens("text"))
    return out.select("query_id", F.col("id").alias("doc_id"), "score", "rank")


@query("t2_bm25_search", f"""WITH {bm25_sql(_TOKENS, 20)}, k AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INTEGER AS rank, score AS bm25 FROM bm WHERE id % 5 <> 0)
SELECT query_id, id AS doc_id, 0.0::DOUBLE AS score, bm25, rank FROM k WHERE rank <= 10""")
def t2(spark: SparkSession, d: str) -> DataFrame:
    tokens = text.lexical_tokens(F.col("text"))
    out = sparse.search(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id", 10, 20, tokens, tokens, is_test=F.col("doc_id") % 5 == 0, view=lexical_view(spark, d))
    return out.select("query_id", F.col("id").alias("doc_id"), "score", "bm25", "rank")


@query("sc21_lexical_view", f"""WITH d AS (SELECT doc_id AS id, {_TOKENS.format('text')} AS ts FROM documents), p AS (SELECT id, term, count(*) AS tf, any_value(len(ts)) AS dl FROM (SELECT id, ts, unnest(ts) AS term FROM d) GROUP BY 1, 2),
s AS (SELECT term, least(7, floor(tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(len(ts)) FROM d))) * 3.2))::INTEGER AS level FROM p)
SELECT level, count(*) AS postings, count(DISTINCT term) AS terms FROM s GROUP BY 1""")
def sc21(spark: SparkSession, d: str) -> DataFrame:
    return lexical_view(spark, d).levels.groupBy("level").agg(F.sum("n").alias("postings"), F.count("*").alias("terms"))


@query("t3_postings", f"WITH d AS (SELECT doc_id AS id, {_TOKENS.format('text')} AS ts FROM documents) SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM (SELECT id, unnest(ts) AS term FROM d) GROUP BY 1")
def t3(spark: SparkSession, d: str) -> DataFrame:
    post = sparse.postings(table(spark, d, "documents"), "doc_id", text.lexical_tokens(F.col("text")))
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("t3_first_chunks", "SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2")
def t3_first(spark: SparkSession, d: str) -> DataFrame:
    return sparse.first_chunks(table(spark, d, "documents"), ["source", "lang"], "doc_id").select("source", "lang", "doc_id")


_Q = "(SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"
_RAW = f"list_inner_product(embedding::DOUBLE[], {_Q}::DOUBLE[])"


def _six() -> Column:
    return F.round("score", 6).alias("score")



def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return list(table(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()[0])


@query("t5_dense_topk", f"SELECT vec_id, round({_RAW}, 6) AS score FROM embeddings ORDER BY {_RAW} DESC, vec_id LIMIT 10")
def t5(spark: SparkSession, d: str) -> DataFrame:
    return dense.search(table(spark, d, "embeddings"), _query_vector(spark, d), 10, "embedding", "vec_id").select("vec_id", _six())


@query("t5_dense_l2", f"SELECT vec_id, round(l, 6) AS score FROM (SELECT vec_id, list_sum(list_transform(range(1, len(embedding) + 1), lambda i: (embedding[i]::DOUBLE - q[i]::DOUBLE) * (embedding[i]::DOUBLE - q[i]::DOUBLE))) AS l FROM (SELECT *, {_Q} AS q FROM embeddings)) ORDER BY l, vec_id LIMIT 10")
def t5_l2(spark: SparkSession, d: str) -> DataFrame:
    return dense.search(table(spark, d, "embeddings"), _query_vector(spark, d), 10, "embedding", "vec_id", metric="l2").select("vec_id", _six())


@query("f11_threshold", f"SELECT vec_id, round({_RAW}, 6) AS score FROM embeddings WHERE {_RAW} >= 0.2 ORDER BY {_RAW} DESC, vec_id LIMIT 50")
def f11(spark: SparkSession, d: str) -> DataFrame:
    return dense.search(table(spark, d, "embeddings"), _query_vector(spark, d), 50, "embedding", "vec_id", threshold=0.2).select("vec_id", _six())


@query("t7_with_content", f"WITH t AS (SELECT vec_id, {_RAW} AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 10) SELECT vec_id, round(s, 6) AS score, length(text)::INTEGER AS chars FROM t LEFT JOIN documents ON doc_id = vec_id")
def t7(spark: SparkSession, d: str) -> DataFrame:
    found = dense.search(table(spark, d, "embeddings"), _query_vector(spark, d), 10, "embedding", "vec_id").select("vec_id", _six())
    return dense.with_content(found, table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.length("text").alias("chars")), "vec_id")


@query("j20_masked_dense", f"SELECT vec_id, round({_RAW}, 6) AS score FROM embeddings WHERE label = 0 ORDER BY {_RAW} DESC, vec_id LIMIT 10")
def j20(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return dense.search_within(rows, rows.where("label = 0"), _query_vector(spark, d), 10, "embedding", "vec_id").select("vec_id", _six())


@query("j21_postmask_dense", f"WITH t AS (SELECT vec_id, label, {_RAW} AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 10) SELECT vec_id, round(s, 6) AS score FROM t WHERE label = 0")
def j21(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return dense.search_then_mask(rows, rows.where("label = 0"), _query_vector(spark, d), 10, "embedding", "vec_id").select("vec_id", _six())


@query("j23_hierarchical", f"""WITH f AS (SELECT label, max({_RAW}) AS s FROM embeddings GROUP BY 1 ORDER BY s DESC, label LIMIT 2),
t AS (SELECT vec_id, label, {_RAW} AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 30) SELECT vec_id, round(s, 6) AS score FROM t WHERE label IN (SELECT label FROM f) ORDER BY s DESC, vec_id LIMIT 10""")
def j23(spark: SparkSession, d: str) -> DataFrame:
    rows, q = table(spark, d, "embeddings"), _query_vector(spark, d)
    best = dense.scored(rows, q, "embedding").groupBy("label").agg(F.max("score").alias("s")).orderBy(F.col("s").desc(), "label").limit(2)
    found = dense.search(rows, q, 30, "embedding", "vec_id").join(best.select("label"), "label", "left_semi")
    return found.orderBy(*dense.order("ip", "vec_id")).limit(10).select("vec_id", _six())


@query("w12_best_vector_per_node", f"SELECT label, round(max({_RAW}), 6) AS score FROM embeddings GROUP BY 1 ORDER BY max({_RAW}) DESC, label LIMIT 5")
def w12(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return dense.search_within(rows, rows.select("label").distinct(), _query_vector(spark, d), 5, "embedding", "label").select("label", _six())


@query("t6_ivf_probe", f"SELECT vec_id, round({_RAW}, 6) AS score FROM embeddings ORDER BY {_RAW} DESC, vec_id LIMIT 10")
def t6(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame([(0, _query_vector(spark, d))], "query_id bigint, vector array<double>")
    return cells.search(vector_view(spark, d), asked, 10).select(F.col("key").alias("vec_id"), _six())


@query("sc22_vector_cells", """WITH q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, list_inner_product(embedding::DOUBLE[], qe::DOUBLE[]) AS s FROM embeddings, q)
SELECT query_id, vec_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id)::INTEGER AS rank FROM s QUALIFY rank <= 10""")
def sc22(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return cells.search(vector_view(spark, d), asked, 10).select("query_id", F.col("key").alias("vec_id"), _six(), "rank")


@query("sc22_vector_counts", "SELECT count(*) AS vectors, len(any_value(embedding))::BIGINT * count(*) AS components FROM embeddings WHERE embedding IS NOT NULL")
def sc22_counts(spark: SparkSession, d: str) -> DataFrame:
    return vector_view(spark, d).blocks.agg(F.sum(F.size("keys")).alias("vectors"), F.sum(F.size("vectors").cast("bigint")).alias("components"))


@query("t10_indexed_rerank", f"""WITH c AS (SELECT vec_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM embeddings JOIN documents ON doc_id = vec_id QUALIFY rank <= 100),
s AS (SELECT vec_id, CASE WHEN label <> 1 THEN {_RAW} END AS s FROM embeddings) SELECT c.vec_id, round(s, 6) AS score, row_number() OVER (ORDER BY s IS NULL, s DESC, rank)::INTEGER AS rank FROM c JOIN s USING (vec_id)""")
def t10(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    rows = table(spark, d, "embeddings")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "n_chars").join(rows.select("vec_id"), "vec_id", "left_semi")
    top = docs.orderBy(F.col("n_chars").desc(), "vec_id").limit(100)
    candidates = top.select("vec_id", F.row_number().over(W.orderBy(F.col("n_chars").desc(), "vec_id")).alias("rank"))
    return dense.rerank_by_index(candidates, rows.where("label <> 1"), _query_vector(spark, d), "embedding", "vec_id", "rank").select("vec_id", _six(), "rank")


# A query of the benchmark has the vector of its number.
_QV = "qv AS (SELECT item_id AS query_id, embedding AS qe FROM benchmark JOIN embeddings ON vec_id = item_id)"


def _query_vectors(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    return q.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id")


def dense_sql(k: int, name: str = "dn") -> str:
    return f"""{_QV}, {name}0 AS (SELECT query_id, vec_id, list_inner_product(embedding::DOUBLE[], qe::DOUBLE[]) AS s FROM embeddings, qv),
{name} AS (SELECT query_id, vec_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id)::INTEGER AS rank FROM {name}0 QUALIFY rank <= {k})"""


@query("q2_dense_batch", f"WITH {dense_sql(10)} SELECT query_id, vec_id, round(s, 6) AS score, rank FROM dn")
def q2(spark: SparkSession, d: str) -> DataFrame:
    out = dense.search_batch(table(spark, d, "embeddings"), _query_vectors(spark, d), 10, "embedding", "vec_id")
    return out.select("query_id", "vec_id", _six(), "rank")


# Two branches per query: BM25, whose scores count as 0, and vectors (a vector's number is its document's).
_BRANCHES = f"""{bm25_sql(_TOKENS, 20)}, {dense_sql(20)},
br AS (SELECT query_id, id AS key, 0 AS branch, rank, 0.0 AS score FROM bm UNION ALL SELECT query_id, vec_id, 1, rank, s FROM dn)"""


def _branches(spark: SparkSession, d: str) -> DataFrame:
    one = _bm25(spark, d, 20).select("query_id", F.col("id").alias("key"), F.lit(0).alias("branch"), "rank", F.lit(0.0).alias("score"))
    two = dense.search_batch(table(spark, d, "embeddings"), _query_vectors(spark, d), 20, "embedding", "vec_id")
    return one.unionByName(two.select("query_id", F.col("vec_id").alias("key"), F.lit(1).alias("branch"), "rank", "score"))


_FUSED = """SELECT query_id, key AS doc_id, score, rank FROM (SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first)::INTEGER AS rank
  FROM (SELECT query_id, key, round(sum({}), 9) AS score, min((branch, rank)) AS first FROM br GROUP BY 1, 2)) WHERE rank <= 10"""


@query("u2_rrf", f"WITH {_BRANCHES} {_FUSED.format('1.0 / (60 + rank)')}")
def u2_rrf(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse(_branches(spark, d), k=10, fusion="rrf", by=["query_id"]).withColumnRenamed("key", "doc_id")


@query("u2_weighted", f"WITH {_BRANCHES} {_FUSED.format('CASE branch WHEN 0 THEN 0.6 ELSE 0.4 END * CASE WHEN score = 0 THEN 1.0 / rank ELSE score END')}")
def u2_weighted(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse(_branches(spark, d), [0.6, 0.4], 10, by=["query_id"]).withColumnRenamed("key", "doc_id")


_ONE = """r AS (SELECT doc_id, source, text, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
s AS (SELECT doc_id, source, text, row_number() OVER (ORDER BY n_chars, doc_id) AS rank FROM documents)"""


def _ranked(spark: SparkSession, d: str, up: bool, k: int = 100) -> DataFrame:
    from pyspark.sql import Window as W

    docs = table(spark, d, "documents")
    order = F.col("n_chars").asc() if up else F.col("n_chars").desc()
    top = docs.orderBy(order, "doc_id").limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(order, "doc_id")))


@query("u3_file_rrf", f"""WITH {_ONE}, b AS (SELECT 0 AS branch, source, rank FROM r WHERE rank <= 100 UNION ALL SELECT 1, source, rank FROM s WHERE rank <= 100),
f AS (SELECT branch, source, row_number() OVER (PARTITION BY branch ORDER BY min(rank)) AS rank FROM b GROUP BY 1, 2),
g AS (SELECT source, round(sum(1.0 / (60 + rank)), 9) AS score, min((branch, rank)) AS first FROM f GROUP BY 1)
SELECT source, score, row_number() OVER (ORDER BY score DESC, first)::INTEGER AS rank FROM g""")
def u3(spark: SparkSession, d: str) -> DataFrame:
    both = _ranked(spark, d, False).withColumn("branch", F.lit(0)).unionByName(_ranked(spark, d, True).withColumn("branch", F.lit(1)))
    return fusion.fuse_files(both, "source").select("source", "score", "rank")


@query("u4_interleave", f"WITH {_ONE}, b AS (SELECT 0 AS branch, doc_id, rank FROM r WHERE rank <= 20 UNION ALL SELECT 1, doc_id, rank FROM s WHERE rank <= 20) SELECT doc_id, row_number() OVER (ORDER BY rank, branch)::INTEGER AS position FROM b")
def u4(spark: SparkSession, d: str) -> DataFrame:
    both = _ranked(spark, d, False, 20).withColumn("branch", F.lit(0)).unionByName(_ranked(spark, d, True, 20).withColumn("branch", F.lit(1)))
    return fusion.interleave(both).select("doc_id", "position")


@query("u5_route_rrf", f"""WITH {_ONE}, b AS (SELECT 'long' AS route, source AS key, rank FROM r WHERE rank <= 100 UNION ALL SELECT 'short', source, rank FROM s WHERE rank <= 100),
o AS (SELECT route, key, min(rank) AS rank FROM b GROUP BY 1, 2), g AS (SELECT key, round(sum(1.0 / (60 + rank)), 9) AS score, min(rank) AS best, list_sort(list(route)) AS routes FROM o GROUP BY 1)
SELECT key, score, best::INTEGER AS best, routes, row_number() OVER (ORDER BY score DESC, best, key)::INTEGER AS rank FROM g""")
def u5(spark: SparkSession, d: str) -> DataFrame:
    both = _ranked(spark, d, False).withColumn("route", F.lit("long")).unionByName(_ranked(spark, d, True).withColumn("route", F.lit("short")))
    return fusion.fuse_routes(both.withColumnRenamed("source", "key"))


@query("u6_diversify", f"WITH {_ONE}, w AS (SELECT doc_id, source, rank, row_number() OVER (PARTITION BY source ORDER BY rank) > 2 AS late FROM r WHERE rank <= 100), p AS (SELECT doc_id, source, row_number() OVER (ORDER BY late, rank)::INTEGER AS position FROM w) SELECT * FROM p WHERE position <= 50")
def u6(spark: SparkSession, d: str) -> DataFrame:
    return fusion.diversify(_ranked(spark, d, False), "source", 50).select("doc_id", "source", "position")


@query("u7_dedup", f"WITH {_ONE} SELECT source, lang, min_by(r.doc_id, rank) AS doc_id FROM r JOIN documents USING (doc_id, source) WHERE rank <= 100 GROUP BY 1, 2")
def u7(spark: SparkSession, d: str) -> DataFrame:
    return fusion.dedup(_ranked(spark, d, False), ["source", "lang"]).select("source", "lang", "doc_id")


@query("u8_dedup_files", f"WITH {_ONE} SELECT source, min(rank)::INTEGER AS rank FROM r WHERE rank <= 100 GROUP BY 1")
def u8(spark: SparkSession, d: str) -> DataFrame:
    return fusion.dedup(_ranked(spark, d, False), ["source"]).select("source", "rank")


@query("f1_filter_chain", f"WITH {_ONE} SELECT doc_id, rank::INTEGER AS rank FROM r JOIN documents USING (doc_id, source) WHERE rank <= 100 AND regexp_matches(documents.text, '\\S') AND lang IN ('en', 'fr') ORDER BY rank LIMIT 20")
def f1(spark: SparkSession, d: str) -> DataFrame:
    return fusion.filtered(_ranked(spark, d, False), [fusion.has_content("text"), F.col("lang").isin("en", "fr")], 20).select("doc_id", "rank")


@query("p1_normalized_scores", f"WITH {_ONE} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1.0 / rank ELSE doc_id::DOUBLE END AS score FROM r WHERE rank <= 100")
def p1(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.expr("doc_id % 3 <> 0"), F.col("doc_id").cast("double")).otherwise(F.lit(0.0))
    return _ranked(spark, d, False).select("doc_id", fusion.candidate_scores(raw, F.col("rank")).alias("score"))


@query("q3_cascade", f"""WITH {bm25_sql(_TOKENS, 128)}, {_QV}, s AS (SELECT bm.query_id, vec_id, list_inner_product(embedding::DOUBLE[], qe::DOUBLE[]) AS s FROM bm JOIN embeddings ON id = vec_id JOIN qv ON qv.query_id = bm.query_id)
SELECT query_id, vec_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id)::INTEGER AS rank FROM s QUALIFY rank <= 50""")
def q3(spark: SparkSession, d: str) -> DataFrame:
    mask = _bm25(spark, d, 128).select("query_id", F.col("id").alias("vec_id"))
    return planner.cascade(mask, table(spark, d, "embeddings"), _query_vectors(spark, d), "embedding", "vec_id", 50).select("query_id", "vec_id", _six(), "rank")


_ANY = lambda patterns, flag="": " OR ".join(f"regexp_matches(text, '{flag}{p}')" for p in patterns)
SIGNALS_SQL = f"""sg AS (SELECT item_id, ({_ANY(text.STRUCTURAL_PATTERNS, '(?i)')}) AS structural, ({_ANY(text.LEXICAL_PATTERNS)}) AS lex, regexp_matches(text, '(?i){text.SEMANTIC_WORDS}') OR len(regexp_extract_all(text, '[A-Za-z0-9_]+')) >= 10 AS semantic,
  len(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS n FROM bq), sq AS (SELECT item_id, structural, lex OR (NOT semantic AND n BETWEEN 1 AND 4) AS lexical, semantic FROM sg)"""
_BQ = """bq AS (SELECT item_id, CASE item_id % 6 WHEN 0 THEN text WHEN 1 THEN 'definitions of bar' WHEN 2 THEN 'parse_config' WHEN 3 THEN 'reachable from Foo.bar' WHEN 4 THEN 'callback url import map' ELSE left(text, 12) END AS text FROM benchmark)"""


def _questions(spark: SparkSession, d: str) -> DataFrame:
    asked = F.expr("CASE item_id % 6 WHEN 0 THEN text WHEN 1 THEN 'definitions of bar' WHEN 2 THEN 'parse_config' WHEN 3 THEN 'reachable from Foo.bar' WHEN 4 THEN 'callback url import map' ELSE left(text, 12) END")
    return table(spark, d, "benchmark").select("item_id", asked.alias("text"))


@query("x_query_signals", f"WITH {_BQ}, {SIGNALS_SQL} SELECT * FROM sq")
def query_signals(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark, d).select("item_id", text.query_signals(F.col("text")).alias("s")).select("item_id", "s.*")


@query("q_plan_choice", f"""WITH {_BQ}, {SIGNALS_SQL} SELECT item_id, CASE WHEN structural THEN 'structural_graph' WHEN semantic AND NOT lexical THEN 'semantic' ELSE 'hybrid_fusion' END AS plan,
  CASE WHEN lexical THEN 'fast_lexical' ELSE 'semantic' END AS fast FROM sq""")
def q_plan(spark: SparkSession, d: str) -> DataFrame:
    views = ("sparse", "dense", "graph")
    return _questions(spark, d).select("item_id", planner.plan_for(F.col("text"), views, "balanced").alias("plan"), planner.plan_for(F.col("text"), views, "cheap").alias("fast"))
