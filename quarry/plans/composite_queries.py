"""Queries over composite plans, reranking, drafting and the catalog."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import dense, drafting, fusion, graph, incremental
from quarry.registry import query, table
from quarry.sources import generations

from . import composite
from .retrieval_queries import _QV, _six, _TOKENS, bm25_sql, dense_sql
from .views import CODE_SQL, code_edges, code_files, code_nodes, lexical_view

_C = f"WITH RECURSIVE {CODE_SQL}"
_USABLE = "start_line <> end_line AND NOT regexp_matches(lower(file), '(^|/)(test|tests|spec|specs|__tests__)/') AND NOT regexp_matches(regexp_extract(lower(file), '[^/]*$'), '^test|_test[.][a-z]+$|[.](test|spec)[.]')"
_CHUNK = "chunk AS (SELECT doc_id AS key, path AS file, text, CASE WHEN 8000000000 + doc_id * 4 + 1 IN (SELECT vid FROM sym) THEN 8000000000 + doc_id * 4 + 1 END AS vid FROM cf)"


def _views(spark: SparkSession, d: str) -> composite.Views:
    """A document's node is the function among its parts."""
    nodes = code_nodes(spark, d)
    own = nodes.where("type = 'function'").select("vid")
    chunks = code_files(spark, d).select(F.col("doc_id").alias("key"), F.col("path").alias("file"), F.col("text").alias("content"), (F.lit(8000000000) + F.col("doc_id") * 4 + 1).alias("vid"))
    chunks = chunks.join(own.withColumn("_has", F.lit(1)), "vid", "left").withColumn("vid", F.when(F.col("_has") == 1, F.col("vid"))).drop("_has")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    return composite.Views(chunks, vectors, nodes, code_edges(spark, d), code_files(spark, d), lexical_view(spark, d))


def _questions(spark: SparkSession, d: str, more: str = "") -> DataFrame:
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat("text", F.lit(more)).alias("query"))
    return q.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id", "left")


_REGION = f"""sd AS (SELECT query_id, vid, rank FROM bm JOIN chunk ON key = id WHERE vid IS NOT NULL), ub AS (SELECT src, dst FROM ce UNION SELECT dst, src FROM ce),
w(query_id, vid, depth) AS (SELECT query_id, vid, 0 FROM sd UNION SELECT query_id, dst, depth + 1 FROM w JOIN ub ON src = vid WHERE depth < 2), rg AS (SELECT DISTINCT query_id, w.vid FROM w JOIN sym ON sym.vid = w.vid WHERE {_USABLE})"""


@query("q4_graph_seeded", f"{_C}, {_CHUNK}, {bm25_sql(_TOKENS, 5)}, {_REGION} SELECT query_id, vid, row_number() OVER (PARTITION BY query_id ORDER BY vid)::INTEGER AS rank FROM rg QUALIFY rank <= 50")
def q4(spark: SparkSession, d: str) -> DataFrame:
    return composite.graph_seeded(_views(spark, d), _questions(spark, d))


@query("q4_graph_masked", f"""{_C}, {_CHUNK}, {bm25_sql(_TOKENS, 5)}, {_REGION}, {_QV}, mk AS (SELECT DISTINCT query_id, key FROM rg JOIN chunk ON chunk.vid = rg.vid),
s AS (SELECT mk.query_id, key, list_inner_product(embedding::DOUBLE[], qe::DOUBLE[]) AS s FROM mk JOIN embeddings ON vec_id = key JOIN qv ON qv.query_id = mk.query_id)
SELECT query_id, key, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, key)::INTEGER AS rank FROM s QUALIFY rank <= 50""")
def q4_masked(spark: SparkSession, d: str) -> DataFrame:
    return composite.graph_seeded(_views(spark, d), _questions(spark, d), masked=True).select("query_id", "key", _six(), "rank")


_HOPS = f"""re AS (SELECT DISTINCT src, dst FROM ce WHERE type = 'reference'), hp AS (SELECT query_id, vid AS seed, rank AS sr, dst AS vid, 0 AS side FROM sd JOIN re ON src = vid UNION ALL SELECT query_id, vid, rank, src, 1 FROM sd JOIN re ON dst = vid),
hu AS (SELECT hp.*, row_number() OVER (PARTITION BY query_id, seed, side ORDER BY hp.vid) AS nth FROM hp JOIN sym ON sym.vid = hp.vid WHERE {_USABLE}),
nb AS (SELECT query_id, vid, sr, n FROM (SELECT *, row_number() OVER (PARTITION BY query_id, seed ORDER BY nth, side) AS n FROM hu) WHERE n <= {{}})"""


@query("q5_graph_expanded", f"""{_C}, {_CHUNK}, {dense_sql(20)}, sd AS (SELECT query_id, vid, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM dn JOIN chunk ON key = vec_id WHERE vid IS NOT NULL), {_HOPS.format(5)},
bo AS (SELECT query_id, key, min(rank) AS rank FROM (SELECT query_id, vec_id AS key, rank FROM dn UNION ALL SELECT query_id, key, 20 + sr * 5 + n FROM nb JOIN chunk ON chunk.vid = nb.vid) GROUP BY 1, 2),
ag AS (SELECT bo.query_id, key, row_number() OVER (PARTITION BY bo.query_id ORDER BY list_inner_product(embedding::DOUBLE[], qe::DOUBLE[]) DESC, key) AS rank FROM bo JOIN embeddings ON vec_id = key JOIN qv ON qv.query_id = bo.query_id QUALIFY rank <= 100),
br AS (SELECT query_id, vec_id AS key, 0 AS branch, rank FROM dn UNION ALL SELECT query_id, key, 1, rank FROM ag), fi AS (SELECT query_id, branch, file, min(rank) AS rank FROM br JOIN chunk ON chunk.key = br.key GROUP BY 1, 2, 3),
an AS (SELECT query_id, branch, file, row_number() OVER (PARTITION BY query_id, branch ORDER BY rank, file) AS rank FROM fi), fu AS (SELECT query_id, file, round(sum(1.0 / (60 + rank)), 9) AS score, min((branch, rank)) AS first FROM an GROUP BY 1, 2)
SELECT query_id, file, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first)::INTEGER AS rank FROM fu QUALIFY rank <= 10""")
def q5(spark: SparkSession, d: str) -> DataFrame:
    return composite.graph_expanded(_views(spark, d), _questions(spark, d))


@query("q6_planned_search")
def q6(spark: SparkSession, d: str) -> DataFrame:
    return composite.planned(_views(spark, d), _questions(spark, d)).select("query_id", "key", "plan", "rank")


@query("q8_exploration")
def q8(spark: SparkSession, d: str) -> DataFrame:
    parts = composite.explored(_views(spark, d), _questions(spark, d))
    n = [df.groupBy(F.col("query_id").cast("string").alias("query_id")).agg(F.count("*").alias("n")).withColumn("part", F.lit(name)) for name, df in parts.items()]
    out = n[0]
    for x in n[1:]:
        out = out.unionByName(x)
    return out


@query("q9_search_context")
def q9(spark: SparkSession, d: str) -> DataFrame:
    out = composite.searched(_views(spark, d), _questions(spark, d), expand=3, total=4000, least=400, most=900)
    return out.select("query_id", "key", "plan", "rank", F.length("content").alias("chars"), "projection.strategy")


@query("q10_dependency_subgraph", f"""{_C}, e AS (SELECT DISTINCT src, dst FROM ce WHERE type = 'reference'), w(start, vid, depth) AS (SELECT vid, vid, 0 FROM sym WHERE vid % 100 = 10 UNION SELECT start, dst, depth + 1 FROM w JOIN e ON src = vid WHERE depth < 2)
SELECT start AS query_id, vid, min(depth)::INTEGER AS depth FROM w JOIN (SELECT vid AS known FROM cn) ON known = vid GROUP BY 1, 2""")
def q10(spark: SparkSession, d: str) -> DataFrame:
    v = _views(spark, d)
    seeds = v.nodes.where("type <> 'file' AND vid % 100 = 10").select(F.col("vid").alias("query_id"), "vid")
    return composite.region_by(v.nodes, v.edges.where("type = 'reference'"), seeds, 2, "forward")


_MORE = " `that` and `license`"
_BM = f"benchmark AS (SELECT item_id, text || '{_MORE}' AS text FROM main.benchmark)"
_IDENT = """iw AS (SELECT doc_id AS key, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS word FROM documents), ik AS (SELECT key, count(*) AS words FROM iw WHERE word IN ('that', 'license') GROUP BY 1),
idn AS (SELECT item_id AS query_id, key, row_number() OVER (PARTITION BY item_id ORDER BY words DESC, key) AS rank FROM ik, benchmark QUALIFY rank <= {})"""
_SUPPORT = "(regexp_matches(lower(file), '(^|/)(test|tests|spec|specs|__tests__)/') OR regexp_matches(regexp_extract(lower(file), '[^/]*$'), '^test|_test[.][a-z]+$|[.](test|spec)[.]') OR ends_with(lower(file), '.d.ts') OR ends_with(lower(file), '.md'))"


@query("t21_repository_search", f"""WITH {CODE_SQL}, {_CHUNK}, {_BM}, {bm25_sql(_TOKENS, 50)}, {dense_sql(50)}, {_IDENT.format(50)}, kp AS (SELECT key FROM chunk WHERE NOT {_SUPPORT}),
al AS (SELECT query_id, id AS key, 0 AS branch, rank FROM bm UNION ALL SELECT query_id, vec_id, 1, rank FROM dn UNION ALL SELECT query_id, key, 2, rank FROM idn), cl AS (SELECT query_id, al.key, branch, row_number() OVER (PARTITION BY query_id, branch ORDER BY rank) AS rank FROM al JOIN kp ON kp.key = al.key),
fu AS (SELECT query_id, key, round(sum(CASE branch WHEN 2 THEN 2.0 ELSE 1.0 END / (60 + rank)), 9) AS score, min((branch, rank)) AS first FROM cl GROUP BY 1, 2)
SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first)::INTEGER AS rank FROM fu QUALIFY rank <= 10""")
def t21(spark: SparkSession, d: str) -> DataFrame:
    return composite.repository_search(_views(spark, d), _questions(spark, d, _MORE))


@query("t22_composed_context", f"""WITH {CODE_SQL}, {_CHUNK}, {_BM}, {bm25_sql(_TOKENS, 20)}, {dense_sql(20)}, {_IDENT.format(20)}, al AS (SELECT query_id, key, rank, 0 AS branch FROM idn UNION ALL SELECT query_id, vec_id, rank, 1 FROM dn UNION ALL SELECT query_id, id, rank, 2 FROM bm),
tg AS (SELECT query_id, key, min((rank, branch)) AS m FROM al GROUP BY 1, 2), tn AS (SELECT query_id, key, r AS rank FROM (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY m, key) AS r FROM tg) WHERE r <= 5), sd AS (SELECT query_id, vid, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM tn JOIN chunk ON chunk.key = tn.key WHERE vid IS NOT NULL), {_HOPS.format(4)},
bo AS (SELECT query_id, key, 'seed' AS source, rank FROM tn UNION ALL SELECT query_id, key, 'neighbor', 5 + sr * 4 + n FROM nb JOIN chunk ON chunk.vid = nb.vid), f1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY rank) AS k FROM bo)
SELECT query_id, key, source, row_number() OVER (PARTITION BY query_id ORDER BY rank, key)::INTEGER AS rank FROM f1 WHERE k = 1""")
def t22(spark: SparkSession, d: str) -> DataFrame:
    return composite.composed_context(_views(spark, d), _questions(spark, d, _MORE))


@query("e24_preload_candidates", f"""WITH {CODE_SQL}, {bm25_sql(_TOKENS, 10)} SELECT query_id, id AS key, rank FROM bm""")
def e24(spark: SparkSession, d: str) -> DataFrame:
    return composite.retrieved(_views(spark, d), "bm25", _questions(spark, d), 10).select("query_id", "key", "rank")


@query("e25_retrievers", f"WITH {dense_sql(7)} SELECT query_id, vec_id AS key, rank FROM dn")
def e25(spark: SparkSession, d: str) -> DataFrame:
    return composite.retrieved(_views(spark, d), "embedding", _questions(spark, d), 7).select("query_id", "key", "rank")


@query("u1_single_stage", f"WITH {bm25_sql(_TOKENS, 5)} SELECT query_id, id AS key, 0.0::DOUBLE AS score, rank FROM bm")
def u1(spark: SparkSession, d: str) -> DataFrame:
    one = composite.lexical(_views(spark, d), _questions(spark, d), 20)
    return fusion.run_stages([one], [0.7], 5, by=["query_id"])


_LISTS = """a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 50), b AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS rank FROM documents QUALIFY rank <= 50)"""


@query("u9_hybrid_lists", f"""WITH {_LISTS}, x AS (SELECT doc_id, 0 AS branch, rank, 0.0 AS s FROM a UNION ALL SELECT doc_id, 1, rank, 1.0 / rank FROM b), f AS (SELECT doc_id, round(sum(0.5 * CASE WHEN s = 0 THEN 1.0 / rank ELSE s END), 9) AS score, min((branch, rank)) AS first FROM x GROUP BY 1)
SELECT 'f' || doc_id AS file, score, row_number() OVER (ORDER BY score DESC, first)::INTEGER AS rank FROM f QUALIFY rank <= 30""")
def u9(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")

    def ranked(order) -> DataFrame:
        top = docs.orderBy(order, "doc_id").limit(50)
        return top.select(F.concat(F.lit("f"), "doc_id").alias("file"), F.lit("n").alias("name"), F.lit(1).alias("first"), F.row_number().over(W.orderBy(order, "doc_id")).alias("rank"))

    a = ranked(F.col("n_chars").desc()).withColumn("score", F.lit(0.0))
    b = ranked(F.col("n_chars").asc()).withColumn("score", 1.0 / F.col("rank"))
    return fusion.hybrid_lists(a, b, ["file", "name", "first"], k=30).select("file", "score", "rank")


_EMB = "list_transform(range(0, 16), lambda i: len(list_filter(list_transform({t}, lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 16), lambda b: b = i))::DOUBLE)"


@query("t9_content_rerank", f"""WITH c AS (SELECT item_id % 5 AS q, item_id, text, {_EMB.format(t=_TOKENS.format('text'))} AS v, {_EMB.format(t="['that', 'license', 'the']")} AS qv FROM benchmark),
n AS (SELECT q, item_id, list_transform(v, lambda x: CASE WHEN list_inner_product(v, v) > 0 THEN x / sqrt(list_inner_product(v, v)) ELSE x END) AS v, list_transform(qv, lambda x: x / sqrt(list_inner_product(qv, qv))) AS qv FROM c), s AS (SELECT q, item_id, round(list_inner_product(v, qv), 9) AS s FROM n)
SELECT q, item_id, s AS score FROM s""")
def t9(spark: SparkSession, d: str) -> DataFrame:
    embed = lambda c: dense.hashed_embedding(text.lexical_tokens(c), 16)
    rows = table(spark, d, "benchmark").select((F.col("item_id") % 5).alias("q"), "item_id", F.col("text").alias("content"), F.lit("that license the").alias("query"))
    return dense.rerank_by_content(rows, embed, "query", "content", ["q"], "item_id").select("q", "item_id", F.round("score", 9).alias("score"))


@query("t11_scorer_rerank", """WITH c AS (SELECT doc_id, source, n_chars, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents), s AS (SELECT *, CASE WHEN doc_id % 4 > 0 THEN (n_chars % 97)::DOUBLE END AS s FROM c)
SELECT * FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY s IS NULL, s DESC, rank)::INTEGER AS rank FROM s) WHERE rank <= 5""")
def t11(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").withColumn("rank", F.row_number().over(W.partitionBy("source").orderBy("doc_id")))
    rows = rows.select("source", "doc_id", "n_chars", "rank", F.when(F.expr("doc_id % 4 > 0"), F.lit("x")).alias("content"))
    scorer = lambda df: df.withColumn("pair_score", (F.col("n_chars") % 97).cast("double"))
    return dense.rerank_by_scorer(rows, scorer, ["source"], "rank", k=5).select("source", "doc_id", "rank")


@query("t12_yes_probability", "SELECT p_partkey, round(1 / (1 + exp(p_size % 3 - p_size % 5)), 9) AS p FROM part")
def t12(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.round(dense.yes_probability((n % 5).cast("double"), (n % 3).cast("double")), 9).alias("p"))


_LW = """c AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents),
w AS (SELECT *, unnest(list_distinct(list_filter(range(0, greatest(n - 4, 0) + 1, 3), lambda s: s <= i AND i < s + 4) || list_filter([greatest(n - 4, 0)], lambda s: s <= i AND i < s + 4))) AS wd FROM c)"""


@query("t13_listwise_windows", f"WITH {_LW} SELECT source, doc_id, wd::INTEGER AS \"window\" FROM w")
def t13_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").withColumn("rank", F.row_number().over(W.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id")))
    return dense.listwise_windows(rows, ["source"], "rank", 4, 3).select("source", "doc_id", "window")


@query("t13_listwise_rerank", f"""WITH {_LW}, s AS (SELECT source, doc_id, avg((doc_id * 7 + wd) % 11) AS m FROM w WHERE doc_id % 5 > 0 GROUP BY 1, 2)
SELECT c.source, c.doc_id, round(coalesce(m, 0.25), 6)::DOUBLE AS score, row_number() OVER (PARTITION BY c.source ORDER BY m IS NULL, m DESC, i)::INTEGER AS rank FROM c LEFT JOIN s ON s.source = c.source AND s.doc_id = c.doc_id""")
def t13(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").withColumn("rank", F.row_number().over(W.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id"))).select("source", "doc_id", "rank", F.lit(0.25).alias("first"))
    windows = dense.listwise_windows(rows, ["source"], "rank", 4, 3)
    scores = windows.where("doc_id % 5 > 0").select("source", "doc_id", ((F.col("doc_id") * 7 + F.col("window")) % 11).cast("double").alias("score"))
    return dense.rerank_listwise(rows, scores, ["source"], "doc_id", "rank", "first").select("source", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("t4_graph_documents", f"WITH {CODE_SQL}, dd AS (SELECT vid, {_TOKENS.format('CASE WHEN type = ' + chr(39) + 'file' + chr(39) + ' THEN name ELSE unified_name END')} AS ts FROM cn) SELECT term, count(DISTINCT vid) AS df FROM (SELECT vid, unnest(ts) AS term FROM dd) GROUP BY 1")
def t4(spark: SparkSession, d: str) -> DataFrame:
    from quarry.operators import sparse

    docs = sparse.graph_documents(code_nodes(spark, d))
    return sparse.postings(docs, "vid", text.lexical_tokens(F.col("text"))).groupBy("term").agg(F.count("*").alias("df"))


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc"), F.transform(F.split(F.lower("text"), r"\s+"), lambda t: F.length(t).cast("int")).alias("tokens"))


@query("t18_ngram_drafts")
def t18(spark: SparkSession, d: str) -> DataFrame:
    corpus = _tokens(spark, d)
    contexts = corpus.select(F.col("doc").alias("ctx"), F.slice("tokens", 1, 12).alias("tokens"))
    return drafting.ngram_continuations(corpus, contexts, 3)


@query("t19_suffix_drafts")
def t19(spark: SparkSession, d: str) -> DataFrame:
    corpus = _tokens(spark, d)
    return drafting.suffix_drafts(corpus, corpus.select(F.col("doc").alias("ctx"), F.slice("tokens", 1, 12).alias("tokens")))


@query("t20_copy_drafts")
def t20(spark: SparkSession, d: str) -> DataFrame:
    return drafting.copied(_tokens(spark, d).withColumnRenamed("doc", "ctx"))


@query("u15_fused_drafts")
def u15(spark: SparkSession, d: str) -> DataFrame:
    corpus = _tokens(spark, d)
    contexts = corpus.select(F.col("doc").alias("ctx"), F.slice("tokens", 1, 12).alias("tokens"))
    one = drafting.copied(contexts).select("ctx", F.lit(0).alias("tree"), F.lit("copy").alias("source"), "tokens")
    two = drafting.ngram_continuations(corpus, contexts, 3).select("ctx", F.col("rank").alias("tree"), F.lit("retrieval").alias("source"), "tokens")
    return drafting.fused_drafts(one.unionByName(two), 24).select("ctx", F.array_join(F.transform("path", lambda t: t.cast("string")), ",").alias("path"), "depth", "source")


# ---- the catalog and incremental views


_OLD = "SELECT doc_id AS path, md5(text) AS digest FROM documents WHERE doc_id % 10 <> 3"
_NEW = "SELECT CASE WHEN doc_id % 13 = 5 THEN doc_id + 5000000 ELSE doc_id END AS path, CASE WHEN doc_id % 11 = 0 THEN md5(text || 'x') ELSE md5(text) END AS digest FROM documents WHERE doc_id % 10 <> 7"


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    old = docs.where("doc_id % 10 <> 3").select(F.col("doc_id").cast("string").alias("path"), F.md5("text").alias("digest"))
    new = docs.where("doc_id % 10 <> 7").select(F.expr("if(doc_id % 13 = 5, doc_id + 5000000, doc_id)").cast("string").alias("path"), F.when(F.expr("doc_id % 11 = 0"), F.md5(F.concat("text", F.lit("x")))).otherwise(F.md5("text")).alias("digest"))
    return old, new


@query("i2_renames", f"""WITH o AS (SELECT path::VARCHAR AS path, digest FROM ({_OLD})), n AS (SELECT path::VARCHAR AS path, digest FROM ({_NEW})), ch AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'A' WHEN n.path IS NULL THEN 'D' ELSE 'M' END AS status FROM o FULL JOIN n ON o.path = n.path WHERE o.digest IS DISTINCT FROM n.digest),
g AS (SELECT ch.path AS old_path, digest, row_number() OVER (PARTITION BY digest ORDER BY ch.path) AS k FROM ch JOIN o USING (path) WHERE status = 'D'), c AS (SELECT ch.path, digest, row_number() OVER (PARTITION BY digest ORDER BY ch.path) AS k FROM ch JOIN n USING (path) WHERE status = 'A'), m AS (SELECT path, old_path FROM c JOIN g USING (digest, k))
SELECT path, status, NULL::VARCHAR AS old_path FROM ch WHERE path NOT IN (SELECT path FROM m) AND path NOT IN (SELECT old_path FROM m) UNION ALL SELECT path, 'R', old_path FROM m""")
def i2(spark: SparkSession, d: str) -> DataFrame:
    return incremental.changes_with_renames(*_snapshots(spark, d), "path", "digest")


@query("i3_hunk_ranges", """SELECT doc_id, unnest([doc_id % 50 + 1, 200]) AS old_first, unnest([doc_id % 50 + doc_id % 4, 200]) AS old_last, unnest([doc_id % 60 + 1, 210]) AS new_first, unnest([doc_id % 60 + 2, 209]) AS new_last FROM documents""")
def i3(spark: SparkSession, d: str) -> DataFrame:
    n = lambda e: F.expr(e).cast("string")
    patch = F.concat(F.lit("--- a/x\n+++ b/x\n@@ -"), n("doc_id % 50 + 1"), F.lit(","), n("doc_id % 4"), F.lit(" +"), n("doc_id % 60 + 1"), F.lit(",2 @@ f()\n-a\n+b\n@@ -200 +210,0 @@\n-c\n"))
    return incremental.hunk_ranges(table(spark, d, "documents").select("doc_id", patch.alias("patch")), "patch")


@query("i7_updated_chunks", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT path, digest FROM n")
def i7(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(spark, d)
    feed = incremental.changes(old, new, "path", "digest")
    fresh = new.join(feed.where("status <> 'D'"), "path", "left_semi")
    out = incremental.updated_chunks(old.withColumnRenamed("path", "file"), fresh.withColumnRenamed("path", "file"), feed)
    return out.select(F.col("file").cast("bigint").alias("path"), "digest")


@query("i8_patched_index", f"""WITH o AS ({_OLD}), n AS ({_NEW}), a AS (SELECT digest, row_number() OVER (PARTITION BY digest) AS k FROM o), b AS (SELECT digest, row_number() OVER (PARTITION BY digest) AS k FROM n),
x AS (SELECT CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'kept' END AS change FROM a FULL JOIN b ON a.digest = b.digest AND a.k = b.k)
SELECT change, count(*) AS n, CASE WHEN (SELECT count(*) FROM x WHERE change <> 'kept') / (SELECT count(*) FROM o) > 0.1 THEN 'rebuild' ELSE 'delta' END AS mode FROM x GROUP BY 1""")
def i8(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(spark, d)
    vec = lambda df: df.withColumn("v", F.substring("digest", 1, 4))
    return incremental.patched_index(vec(old), vec(new), "digest", "v").groupBy("change", "mode").agg(F.count("*").alias("n"))


@query("i9_rebuilt_vectors", f"WITH o AS (SELECT DISTINCT digest FROM ({_OLD})), n AS ({_NEW}) SELECT 'cached' AS kind, count(*) FILTER (WHERE digest IN (SELECT digest FROM o)) AS n FROM n UNION ALL SELECT 'missing', count(*) FILTER (WHERE digest NOT IN (SELECT digest FROM o)) FROM n")
def i9(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(spark, d)
    have, lost = incremental.rebuilt_vectors(new, old.select("digest").distinct().withColumn("v", F.lit(1.0)), "digest")
    return have.agg(F.lit("cached").alias("kind"), F.count("*").alias("n")).unionByName(lost.agg(F.lit("missing").alias("kind"), F.count("*").alias("n")))


@query("i12_graph_patch", f"""WITH {CODE_SQL}, f AS (SELECT path FROM cf WHERE doc_id = 7), g AS (SELECT vid FROM cn WHERE file IN (SELECT path FROM f) OR (type = 'file' AND name IN (SELECT path FROM f)))
SELECT (SELECT count(*) FROM cn) - (SELECT count(*) FROM g) AS nodes, (SELECT count(*) FROM ce WHERE src NOT IN (SELECT vid FROM g) AND dst NOT IN (SELECT vid FROM g)) AS edges, (SELECT count(*) FROM ce WHERE (src IN (SELECT vid FROM g)) <> (dst IN (SELECT vid FROM g))) AS severed,
  (SELECT count(*) FROM (SELECT DISTINCT * FROM ce) WHERE NOT (src IN (SELECT vid FROM g) AND dst IN (SELECT vid FROM g))) AS reconnected""")
def i12(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = code_nodes(spark, d), code_edges(spark, d)
    path = code_files(spark, d).where("doc_id = 7").select("path").first()[0]
    left, kept, cut = incremental.without_file(nodes, edges, path)
    again = incremental.reconnected(nodes, kept, cut)
    n = lambda df: df.agg(F.count("*")).scalar()
    return spark.range(1).select(n(left).alias("nodes"), n(kept).alias("edges"), n(cut).alias("severed"), n(again).alias("reconnected"))


@query("i12_renamed_file", f"WITH {CODE_SQL}, f AS (SELECT path FROM cf WHERE doc_id = 7) SELECT count(*) AS n FROM cn WHERE file IN (SELECT path FROM f) OR name IN (SELECT path FROM f)")
def i12_rename(spark: SparkSession, d: str) -> DataFrame:
    path = code_files(spark, d).where("doc_id = 7").select("path").first()[0]
    nodes, _ = incremental.renamed_file(code_nodes(spark, d), code_edges(spark, d), path, "moved/to.py")
    return nodes.where("file = 'moved/to.py' OR name = 'moved/to.py'").agg(F.count("*").alias("n"))


def _refs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr("concat('repo', o_custkey % 50) AS repository", "'main' AS ref", "concat('snap', o_orderkey) AS snapshot", "o_orderkey AS generation")


@query("i16_published", "SELECT 'repo' || o_custkey % 50 AS repository, count(*) + CASE WHEN o_custkey % 50 = 3 THEN 1 ELSE 0 END AS n FROM orders GROUP BY o_custkey % 50")
def i16(spark: SparkSession, d: str) -> DataFrame:
    refs = _refs(spark, d)
    now = refs.where("repository = 'repo3'").agg(F.max("generation")).first()[0]
    return incremental.published(refs, "repo3", "main", "snap-new", now).groupBy("repository").agg(F.count("*").alias("n"))


@query("i17_staged_generations", "SELECT count(DISTINCT (o_custkey % 50, o_orderpriority)) AS n, count(DISTINCT (o_custkey % 50, o_orderpriority)) AS ids FROM orders")
def i17(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").selectExpr("concat('repo', o_custkey % 50) AS repository", "o_orderpriority AS view")
    none = spark.createDataFrame([], "repository string, view string, generation_id string")
    once = incremental.staged(none, rows, ["repository", "view"])
    twice = incremental.staged(once, rows, ["repository", "view"])
    return twice.agg(F.count("*").alias("n"), F.countDistinct("generation_id").alias("ids"))


_MANIFEST = """rf AS (SELECT o_custkey % 50 AS r, max(o_orderkey) AS g FROM orders GROUP BY 1), sn AS (SELECT l_orderkey AS o, l_partkey AS gen FROM lineitem)
SELECT 'repo' || r AS repository, 'main' AS ref, 'snap' || g AS snapshot, g AS generation, p_type AS view, p_brand AS profile, 'obj' || p_partkey % 40 AS digest, (p_partkey % 40)::BIGINT AS size FROM rf JOIN sn ON o = g JOIN part ON p_partkey = gen"""


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    snapshots = table(spark, d, "lineitem").selectExpr("concat('snap', l_orderkey) AS snapshot", "l_partkey AS generation_id")
    generations = part.selectExpr("p_partkey AS generation_id", "p_type AS view", "p_brand AS profile_id", "concat('obj', p_partkey % 40) AS digest")
    profiles = part.selectExpr("p_brand AS profile_id", "p_brand AS profile").distinct()
    objects = part.selectExpr("concat('obj', p_partkey % 40) AS digest", "p_partkey % 40 AS size").distinct()
    return incremental.manifest(_refs(spark, d), snapshots, generations, profiles, objects)


@query("j31_catalog_manifest", f"WITH {_MANIFEST}")
def j31(spark: SparkSession, d: str) -> DataFrame:
    return _manifest(spark, d)


@query("i18_resolved_refs", "WITH rf AS (SELECT o_custkey % 50 AS r, max(o_orderkey) AS g FROM orders GROUP BY 1) SELECT 'repo' || r AS repository, g AS generation, count(*) AS views FROM rf JOIN lineitem ON l_orderkey = g JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def i18(spark: SparkSession, d: str) -> DataFrame:
    return _manifest(spark, d).groupBy("repository", "generation").agg(F.count("*").alias("views"))


@query("e42_fact_generations", """WITH u AS (SELECT o_orderpriority AS unit, count(*) AS n FROM orders GROUP BY 1), f AS (SELECT *, row_number() OVER (ORDER BY unit) = 1 AS changed FROM u)
SELECT unit, 2::BIGINT AS generation, n - CASE WHEN changed THEN (SELECT count(*) FROM orders WHERE o_orderpriority = f.unit AND o_orderkey % 10 = 0) ELSE 0 END AS rows, NOT changed AS reused FROM f""")
def e42(spark: SparkSession, d: str) -> DataFrame:
    """The orders of each priority as a unit, published twice; the first unit loses every tenth key in between."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    names = [r[0] for r in orders.select("o_orderpriority").distinct().orderBy("o_orderpriority").collect()]  # a handful of units
    root = f"{graph.shared_base(spark)}/generations-{uuid.uuid4().hex}"
    units = {n: orders.where(F.col("o_orderpriority") == n) for n in names}
    generations.publish(spark, root, "facts", units, 0)
    units[names[0]] = units[names[0]].where("o_orderkey % 10 <> 0")
    reused = generations.publish(spark, root, "facts", units, 1)
    at = generations.newest(spark, root, "facts")
    held = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("unit"), F.lit(at).cast("bigint").alias("generation"), "rows", F.lit(reused[n]).alias("reused")) for n, df in generations.load(spark, root, "facts").items()]
    out = held[0]
    for other in held[1:]:
        out = out.unionByName(other)
    return out


@query("i20_admission", f"WITH i AS (SELECT path::VARCHAR AS path, digest FROM ({_OLD})), r AS (SELECT path::VARCHAR AS path, digest FROM ({_NEW})), x AS (SELECT count(*) AS n FROM i FULL JOIN r ON i.path = r.path WHERE i.digest IS DISTINCT FROM r.digest) SELECT n AS differences, n = 0 AS admitted FROM x")
def i20(spark: SparkSession, d: str) -> DataFrame:
    return incremental.admitted(*_snapshots(spark, d), "path", "digest")


@query("i15_view_currency", "SELECT doc_id, NOT (doc_id % 5 = 0 OR doc_id % 7 = 0) AS current FROM documents")
def i15(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").selectExpr("doc_id", "lang AS commit", "if(doc_id % 5 = 0, 'other', lang) AS commit2", "if(doc_id % 7 = 0, NULL, 'd') AS digest", "'d' AS digest2")
    return rows.select("doc_id", incremental.is_current(["commit", "digest"], ["commit2", "digest2"]).alias("current"))
