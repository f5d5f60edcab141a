"""Queries over routes: terms of questions, roles, seeds and the route itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import reports, routes
from quarry.registry import query, table

from .views import CODE_SQL, code_edges, code_nodes

_C = f"WITH {CODE_SQL}"
_STOP = ", ".join(f"'{w}'" for w in routes.ROUTE_STOPWORDS)


def terms_sql(text: str) -> str:
    """Route terms for texts without runs of capitals before a small letter."""
    words = f"flatten(list_transform(regexp_extract_all({text}, '[A-Za-z_][A-Za-z0-9_]*'), lambda w: string_split(w, '_')))"
    parts = f"flatten(list_transform(list_filter({words}, lambda p: p <> ''), lambda p: regexp_extract_all(p, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')))"
    low = f"list_filter(list_transform({parts}, lambda t: lower(t)), lambda t: length(t) >= 3 AND t NOT IN ({_STOP}))"
    forms = ", ".join(f"CASE WHEN ends_with(t, '{s}') AND length(t) > {len(s) + 2} THEN left(t, length(t) - {len(s)}) END" for s in routes.SUFFIXES)
    return f"list_distinct(flatten(list_transform({low}, lambda t: list_filter([t, {forms}], lambda z: z IS NOT NULL))))"


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_SYN = "MAP {" + ", ".join(f"'{k}': {_list(v)}" for k, v in routes.SYNONYMS.items()) + "}"


def asked_sql(text: str) -> str:
    return f"list_distinct({terms_sql(text)} || flatten(list_transform({terms_sql(text)}, lambda t: coalesce(({_SYN})[t], []))))"


_QUESTIONS = ((0, "how is the small widget value resolved"), (1, "get red ring from the cache directory"), (2, "Widget runners and locations"), (3, "and the of"))
_Q = "qs(query_id, q) AS (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in _QUESTIONS) + f"), qa AS (SELECT query_id, {asked_sql('q')} AS asked FROM qs)"
_D = f"""dn AS (SELECT vid, name, type, unified_name AS label, {terms_sql("coalesce(file, '') || ' ' || unified_name || ' ' || name")} AS terms, {terms_sql("unified_name || ' ' || name")} AS name_terms,
  greatest(coalesce(end_line, start_line, 0) - coalesce(start_line, 0) + 1, 0) AS lines, lower(trim(regexp_replace(regexp_split_to_array(unified_name, '[:.#]')[-1], '[()]+$', ''))) AS leaf FROM cn)"""
_ROLE = f"""CASE WHEN type IN ('class', 'field') THEN 'type' WHEN regexp_matches(leaf, '^(get|default)') OR (list_has_any(terms, {_list(routes.PROVIDER_TERMS)}) AND list_has_any(terms, asked)) THEN 'provider'
  WHEN regexp_matches(leaf, '^(new|make|build)') OR (list_has_any(terms, {_list(routes.BRIDGE_TERMS)}) AND list_has_any(terms, asked)) THEN 'bridge'
  WHEN type IN ('function', 'method') AND (lines > 1 OR list_has_any(terms, {_list(routes.ENDPOINT_TERMS)})) THEN 'endpoint' ELSE 'support' END"""
_BONUS = "CASE role WHEN 'endpoint' THEN 4.0 WHEN 'bridge' THEN 3.0 WHEN 'provider' THEN 2.0 WHEN 'type' THEN 1.0 ELSE 0.0 END"


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(_QUESTIONS), "query_id int, q string").select("query_id", routes.query_terms(F.col("q")).alias("asked"))


@query("p17_route_terms", f"SELECT item_id, list_sort({asked_sql(chr(39) + 'Locations of cached ' + chr(39) + ' || text')}) AS terms FROM benchmark WHERE NOT regexp_matches(text, '[A-Z][A-Z][a-z]')")
def p17(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benchmark").where(~F.col("text").rlike("[A-Z][A-Z][a-z]"))
    return rows.select("item_id", F.array_sort(routes.query_terms(F.concat(F.lit("Locations of cached "), "text"))).alias("terms"))


@query("p23_symbol_seeds", """SELECT item_id, ['parse_config', 'Foo.barBaz', 'HTTP_ERR'] AS seeds FROM benchmark""")
def p23(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("In `parse_config` the Foo.barBaz call, TODO: Parse_Config and HTTP_ERR. "), F.lower(F.regexp_replace("text", "[^A-Za-z ]", " ")))
    return table(spark, d, "benchmark").select("item_id", routes.symbol_seeds(text).alias("seeds"))


@query("p24_scenario", "SELECT item_id, 'python:' || (item_id % 2 = 0)::VARCHAR AS scenario FROM benchmark")
def p24(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.expr("item_id % 2 = 0"), F.concat("text", F.lit("\nTraceback (most recent call last):\n"))).otherwise(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", reports.scenario(text, F.lit("python")).alias("scenario"))


@query("t17_roles", f"{_C}, {_Q}, {_D} SELECT query_id, vid, {_ROLE} AS role FROM qa, dn WHERE query_id < 2")
def t17(spark: SparkSession, d: str) -> DataFrame:
    # Each of two questions against every node; the questions are an array of a node's row.
    asked = {r["query_id"]: r["asked"] for r in _asked(spark).where("query_id < 2").collect()}
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("query_id"), F.array(*[F.lit(t) for t in a]).alias("asked")) for i, a in asked.items()])).alias("q")
    rows = routes.described(code_nodes(spark, d)).select("*", each).select("*", "q.*")
    return rows.select("query_id", "vid", routes.role(F.col("type"), F.col("label"), F.col("terms"), F.col("asked"), F.col("lines")).alias("role"))


_SEEDS = f"""ov AS (SELECT query_id, asked, dn.*, len(list_intersect(name_terms, asked)) AS overlap FROM qa, dn WHERE type IN ('class', 'field', 'function', 'method')),
o2 AS (SELECT *, {_ROLE} AS role, row_number() OVER (PARTITION BY query_id ORDER BY vid) - 1 AS place FROM ov WHERE overlap >= 2),
o3 AS (SELECT *, 5.0 * len(list_intersect(terms, asked)) + greatest(8 - place, 0) + {_BONUS} + 6.0 * overlap AS score FROM o2),
sd AS (SELECT * FROM (SELECT query_id, vid, overlap, role, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label, vid)::INTEGER AS rank FROM o3) WHERE rank <= 12)"""


@query("t16_query_seeds", f"{_C}, {_Q}, {_D}, {_SEEDS} SELECT query_id, vid, overlap::BIGINT AS overlap, role, score, rank FROM sd")
def t16(spark: SparkSession, d: str) -> DataFrame:
    return routes.query_seeds(routes.described(code_nodes(spark, d)), _asked(spark))


_ROUTE = f"""base AS (SELECT sd.query_id, asked, vid, rank - 1 AS seed_rank FROM sd JOIN qa USING (query_id)), pe AS (SELECT DISTINCT src, dst FROM ce),
cand AS (SELECT query_id, asked, vid, seed_rank, 0 AS side, vid AS via FROM base UNION ALL SELECT query_id, asked, dst, seed_rank, 1, src FROM base JOIN pe ON vid = src UNION ALL SELECT query_id, asked, src, seed_rank, 2, dst FROM base JOIN pe ON vid = dst),
cr AS (SELECT cand.*, label, terms, {_ROLE} AS role FROM cand JOIN dn USING (vid)),
ck AS (SELECT * FROM cr WHERE side = 0 OR (CASE WHEN len(asked) = 0 THEN role IN ('endpoint', 'bridge') ELSE role <> 'support' AND (list_has_any(terms, asked) OR role IN ('endpoint', 'bridge')) END)),
cp AS (SELECT *, CASE WHEN side = 0 THEN seed_rank ELSE seed_rank + row_number() OVER (PARTITION BY query_id ORDER BY seed_rank, via, side, vid) - 1 END AS place,
  5.0 * len(list_intersect(terms, asked)) + CASE WHEN side = 0 THEN greatest(8 - seed_rank, 0) ELSE 3.0 END + {_BONUS} AS score, CASE role WHEN 'endpoint' THEN 0 WHEN 'bridge' THEN 1 WHEN 'provider' THEN 2 WHEN 'type' THEN 3 ELSE 4 END AS rr FROM ck),
c1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, vid ORDER BY least(side, 1), score DESC, rr, place, label) AS k FROM cp) WHERE k = 1),
rt AS (SELECT query_id, vid, role, CASE WHEN side = 0 THEN 'seed' ELSE 'neighbor' END AS source, score, row_number() OVER (PARTITION BY query_id ORDER BY least(side, 1), score DESC, rr, place, label)::INTEGER AS rank FROM c1)"""


def _route(spark: SparkSession, d: str, k: int) -> DataFrame:
    n, asked = code_nodes(spark, d), _asked(spark)
    seeds = routes.query_seeds(routes.described(n), asked).select("query_id", "vid", (F.col("rank") - 1).alias("seed_rank"))
    return routes.route(n, code_edges(spark, d), seeds, asked, k)


@query("t15_route", f"{_C}, {_Q}, {_D}, {_SEEDS}, {_ROUTE} SELECT query_id, vid, role, source, score, rank FROM rt WHERE rank <= 20")
def t15(spark: SparkSession, d: str) -> DataFrame:
    return _route(spark, d, 20)


@query("t14_route_scores", f"{_C}, {_Q}, {_D}, {_SEEDS}, {_ROUTE} SELECT query_id, source, role, count(*) AS n, max(score) AS best FROM rt WHERE rank <= 200 GROUP BY 1, 2, 3")
def t14(spark: SparkSession, d: str) -> DataFrame:
    return _route(spark, d, 200).groupBy("query_id", "source", "role").agg(F.count("*").alias("n"), F.max("score").alias("best"))


@query("o2_route_order", f"{_C}, {_Q}, {_D}, {_SEEDS}, {_ROUTE} SELECT query_id, string_agg(vid::VARCHAR, ',' ORDER BY rank) AS vids FROM rt WHERE rank <= 12 GROUP BY 1")
def o2(spark: SparkSession, d: str) -> DataFrame:
    ranked = F.array_sort(F.collect_list(F.struct("rank", F.col("vid").cast("string").alias("v"))))
    return _route(spark, d, 12).groupBy("query_id").agg(F.array_join(F.transform(ranked, lambda x: x["v"]), ",").alias("vids"))
