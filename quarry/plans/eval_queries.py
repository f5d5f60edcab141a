"""Queries over metrics, reports and incremental maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import incremental, metrics, reports
from quarry.registry import query, table

_KS = [1, 5, 10, 50]


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "doc_id", F.row_number().over(W.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id")).alias("rank"))
    return docs.where("rank <= 50")


def _relevant(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels").where("quality = 1"), "doc_id").select("source", "doc_id")


_M = """r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
t AS (SELECT DISTINCT source, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
x AS (SELECT r.source, k, count(*) AS n, count(DISTINCT t.doc_id) AS hits FROM r CROSS JOIN (VALUES (1), (5), (10), (50)) ks(k) LEFT JOIN t ON r.source = t.source AND r.doc_id = t.doc_id WHERE rank <= k GROUP BY 1, 2),
m AS (SELECT source, k, hits, round(hits / n, 6) AS precision, round(coalesce(hits / nt, 0.0), 6) AS recall, CASE WHEN hits = nt THEN 1.0 ELSE 0.0 END::DOUBLE AS accuracy
  FROM x LEFT JOIN (SELECT source, count(*) AS nt FROM t GROUP BY 1) USING (source))"""


@query("a2_metrics_at_k", f"WITH {_M} SELECT * FROM m")
def a2(spark: SparkSession, d: str) -> DataFrame:
    return metrics.at_cutoffs(_ranked(spark, d), _relevant(spark, d), ["source"], "doc_id", "rank", _KS)


@query("a4_averages", f"WITH {_M} SELECT k, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, count(*) AS n FROM m GROUP BY 1")
def a4(spark: SparkSession, d: str) -> DataFrame:
    return metrics.averaged(metrics.at_cutoffs(_ranked(spark, d), _relevant(spark, d), ["source"], "doc_id", "rank", _KS), ["k"], ["precision", "recall"])


@query("a1_set_metrics", """WITH p AS (SELECT c_custkey, [c_custkey % 7, c_custkey % 5, c_custkey % 3, c_custkey % 3] AS p, [c_custkey % 4, 2, 2] AS t FROM customer),
h AS (SELECT *, len(list_distinct(list_intersect(p, t))) AS hits, len(list_distinct(t)) AS nt FROM p)
SELECT c_custkey, hits::INTEGER AS hits, hits / 4 AS precision, hits / nt AS recall, CASE WHEN hits = nt THEN 1.0 ELSE 0.0 END::DOUBLE AS accuracy FROM h""")
def a1(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").selectExpr("c_custkey", "array(c_custkey % 7, c_custkey % 5, c_custkey % 3, c_custkey % 3) AS p", "array(c_custkey % 4, 2L, 2L) AS t")
    return rows.select("c_custkey", *metrics.set_metrics(F.col("p"), F.col("t")))


_SPANS = """s AS (SELECT l_orderkey AS q, 'f' || l_partkey % 3 AS file, l_linenumber * 20 AS first, l_linenumber * 20 + l_quantity::BIGINT AS last, l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey % 1000 AS rank FROM lineitem),
b AS (SELECT o_orderkey AS q, 'f' || o_custkey % 3 AS file, o_custkey % 60 AS first, o_custkey % 60 + 40 AS last FROM orders)"""


def _spans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, d, "lineitem").selectExpr("l_orderkey AS q", "concat('f', l_partkey % 3) AS file", "bigint(l_linenumber * 20) AS first", "l_linenumber * 20 + bigint(l_quantity) AS last", "l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey % 1000 AS rank")
    b = table(spark, d, "orders").selectExpr("o_orderkey AS q", "concat('f', o_custkey % 3) AS file", "o_custkey % 60 AS first", "o_custkey % 60 + 40 AS last")
    return s, b


@query("a5_block_metrics", f"""WITH {_SPANS}, m AS (SELECT s.q, s.file, s.first AS s1, s.last AS e1, b.first AS s2, b.last AS e2 FROM s JOIN b ON s.q = b.q AND s.file = b.file AND s.first <= b.last AND b.first <= s.last),
h AS (SELECT q, count(DISTINCT (file, s1, e1)) AS sh, count(DISTINCT (file, s2, e2)) AS bh FROM m GROUP BY 1), n AS (SELECT coalesce(x.q, y.q) AS q, coalesce(spans, 0) AS spans, coalesce(blocks, 0) AS blocks
  FROM (SELECT q, count(*) AS spans FROM s GROUP BY 1) x FULL JOIN (SELECT q, count(*) AS blocks FROM b GROUP BY 1) y ON x.q = y.q)
SELECT q, spans, blocks, CASE WHEN spans = 0 THEN 0.0 ELSE coalesce(sh, 0) / spans END::DOUBLE AS precision, CASE WHEN blocks = 0 THEN 0.0 ELSE coalesce(bh, 0) / blocks END::DOUBLE AS recall FROM n LEFT JOIN h USING (q)""")
def a5(spark: SparkSession, d: str) -> DataFrame:
    return metrics.block_metrics(*_spans(spark, d), ["q"])


_GAINS = """g AS (SELECT l_orderkey AS q, l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey % 1000 AS rank, l_partkey % 5 AS gain, l_quantity::BIGINT AS lines FROM lineitem),
c AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rank) AS i, sum(lines) OVER (PARTITION BY q ORDER BY rank) AS run FROM g),
x AS (SELECT q, sum(gain / log2(i + 1)) AS dcg FROM c WHERE run <= 100 OR i = 1 GROUP BY 1)"""


def _gains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr("l_orderkey AS q", "l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey % 1000 AS rank", "l_partkey % 5 AS gain", "bigint(l_quantity) AS lines")


@query("a11_dcg_budget", f"WITH {_GAINS} SELECT q, round(dcg, 6) AS dcg FROM x")
def a11(spark: SparkSession, d: str) -> DataFrame:
    return metrics.dcg(_gains(spark, d), ["q"], "rank", "gain", "lines", 100).select("q", F.round("dcg", 6).alias("dcg"))


@query("a12_ndcg_budget", f"""WITH {_GAINS}, o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY gain / greatest(lines, 1) DESC, rank) AS r FROM g),
p AS (SELECT *, sum(lines) OVER (PARTITION BY q ORDER BY r) AS run FROM o), y AS (SELECT q, sum(gain / log2(r + 1)) AS best FROM p WHERE run <= 100 OR r = 1 GROUP BY 1)
SELECT q, round(CASE WHEN best = 0 THEN 0.0 ELSE least(dcg / best, 1.0) END, 6) AS ndcg FROM x JOIN y USING (q)""")
def a12(spark: SparkSession, d: str) -> DataFrame:
    return metrics.ndcg(_gains(spark, d), ["q"], "rank", "gain", "lines", 100)


@query("a13_recall_budget", f"""WITH {_SPANS}, l AS (SELECT q, file, rank, unnest(range(first, last + 1)) AS line FROM s), n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rank, line) AS k FROM l),
t AS (SELECT DISTINCT q, file, unnest(range(first, last + 1)) AS line FROM b), h AS (SELECT n.q, count(DISTINCT (n.file, n.line)) AS hits FROM n JOIN t ON n.q = t.q AND n.file = t.file AND n.line = t.line WHERE k <= 60 GROUP BY 1)
SELECT q, round(coalesce(any_value(hits), 0) / count(*), 6) AS recall FROM t LEFT JOIN h USING (q) GROUP BY 1""")
def a13(spark: SparkSession, d: str) -> DataFrame:
    s, b = _spans(spark, d)
    return metrics.recall_at_lines(s, b, ["q"], "rank", 60)


@query("a14_first_useful", f"WITH {_GAINS} SELECT q, coalesce(1 - (min(CASE WHEN gain = 4 THEN i END) - 1) / count(*), 0.0)::DOUBLE AS first_useful FROM c GROUP BY 1")
def a14(spark: SparkSession, d: str) -> DataFrame:
    g = _gains(spark, d).withColumn("i", F.row_number().over(W.partitionBy("q").orderBy("rank")))
    return metrics.first_useful(g, F.col("gain") == 4, ["q"], "i")


_REGION = "l_linenumber - 3 AS f, l_partkey % 9 - 1 AS l, CASE WHEN l_suppkey % 4 > 0 THEN l_suppkey % 4 * 2 END AS t"


@query("a9_resolved_regions", f"""WITH x AS (SELECT l_orderkey, l_linenumber, {_REGION} FROM lineitem), y AS (SELECT *, l = -1 OR f < 0 AS need FROM x)
SELECT l_orderkey, l_linenumber, (CASE WHEN need AND t >= 1 THEN greatest(1, least(CASE WHEN f < 0 THEN t + f + 1 ELSE f END, t)) WHEN NOT need AND l >= 1 THEN greatest(1, f) END)::BIGINT AS first,
  (CASE WHEN need AND t >= 1 THEN greatest(1, least(CASE WHEN l = -1 THEN t ELSE l END, t)) WHEN NOT need AND l >= 1 THEN l END)::BIGINT AS last FROM y""")
def a9(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", *_REGION.split(", "))
    first, last = metrics.resolved(F.col("f").cast("bigint"), F.col("l"), F.col("t"))
    return rows.select("l_orderkey", "l_linenumber", first.alias("first"), last.alias("last"))


@query("a10_region_gains", """WITH r AS (SELECT l_orderkey AS q, l_linenumber AS rank, 'f' || l_partkey % 3 AS file, l_linenumber * 20 AS first, l_linenumber * 20 + l_quantity::BIGINT AS last FROM lineitem WHERE l_quantity > 3),
c AS (SELECT DISTINCT o_orderkey AS q, 'f' || o_custkey % 3 AS file, unnest(range(o_custkey % 60, o_custkey % 60 + 41)) AS line FROM orders), h AS (SELECT r.q, rank, count(*) AS n FROM r JOIN c ON c.q = r.q AND c.file = r.file AND line BETWEEN first AND last GROUP BY 1, 2)
SELECT r.q, r.rank, (coalesce(n, 0) * CASE WHEN r.file = 'f1' THEN 1.5 ELSE 1.0 END)::DOUBLE AS gain, last - first + 1 AS lines FROM r LEFT JOIN h ON h.q = r.q AND h.rank = r.rank""")
def a10(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "lineitem").where("l_quantity > 3").selectExpr("l_orderkey AS q", "l_linenumber AS rank", "concat('f', l_partkey % 3) AS file", "bigint(l_linenumber * 20) AS first", "l_linenumber * 20 + bigint(l_quantity) AS last")
    c = table(spark, d, "orders").selectExpr("o_orderkey AS q", "concat('f', o_custkey % 3) AS file", "o_custkey % 60 AS first", "o_custkey % 60 + 40 AS last")
    return metrics.region_gains(r, c, r.where("file = 'f1'"), ["q"], "rank")


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr("o_orderkey AS cell_id", "o_custkey AS unit", "o_orderpriority AS arm", "o_totalprice AS cost", "o_orderkey % 10 / 10 AS quality", "o_orderstatus = 'F' AS success", "o_orderkey % 1000 AS total_tokens", "o_orderkey % 700 AS prompt_tokens", "o_orderkey % 300 AS completion_tokens")


_C = """c AS (SELECT o_orderkey AS cell_id, o_custkey AS unit, o_orderpriority AS arm, o_totalprice AS cost, (o_orderkey % 10) / 10 AS quality, o_orderstatus = 'F' AS success, o_orderkey % 1000 AS total_tokens,
  o_orderkey % 700 AS prompt_tokens, o_orderkey % 300 AS completion_tokens FROM orders)"""


@query("a22_arm_means", f"WITH {_C}, i AS (SELECT arm, unit, avg(cost) AS cost, avg(quality) AS quality FROM c WHERE success GROUP BY 1, 2) SELECT arm, count(*) AS units, round(avg(cost), 6) AS cost, round(avg(quality), 6) AS quality FROM i GROUP BY 1")
def a22(spark: SparkSession, d: str) -> DataFrame:
    return reports.arm_means(reports.usable(_cells(spark, d)), "arm", "unit", ["cost", "quality"])


_FOLD = "f AS (SELECT cell_id % 3 AS category, arm, unit, avg(quality) AS quality, min(cost) AS cost, min(turns) AS turns FROM (SELECT *, cell_id % 9 + 1 AS turns FROM c) WHERE success GROUP BY 1, 2, 3)"


def _folded(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d).withColumn("category", F.col("cell_id") % 3).withColumn("turns", F.col("cell_id") % 9 + 1)
    return reports.folded(cells, ["category", "arm", "unit"], ["quality"], ["cost", "turns"])


@query("a25_fold_reps", f"WITH {_C}, {_FOLD} SELECT category, arm, unit, round(quality, 6) AS quality, cost, turns FROM f")
def a25(spark: SparkSession, d: str) -> DataFrame:
    return _folded(spark, d)


@query("a26_paired_categories", f"""WITH {_C}, {_FOLD}, b AS (SELECT * REPLACE (round(quality, 6) AS quality) FROM f), x AS (SELECT o.arm, unnest([o.category::VARCHAR, 'ALL']) AS category, o.quality - s.quality AS dq, CASE WHEN s.cost <> 0 THEN 100 * (o.cost - s.cost) / s.cost END AS dc, o.turns - s.turns AS dt
  FROM b o JOIN b s ON s.arm = '1-URGENT' AND o.arm <> '1-URGENT' AND s.category = o.category AND s.unit = o.unit)
SELECT category, arm, count(*) AS n, round(avg(dq), 6) AS quality_delta, round(avg(dc), 6) AS cost_percent, round(avg(dt), 6) AS turns_delta, count(*) FILTER (WHERE dq > 1e-9) AS wins, count(*) FILTER (WHERE abs(dq) <= 1e-9) AS ties, count(*) FILTER (WHERE dq < -1e-9) AS losses FROM x GROUP BY 1, 2""")
def a26(spark: SparkSession, d: str) -> DataFrame:
    rows = _folded(spark, d).withColumn("category", F.col("category").cast("string"))
    return reports.paired_by_category(rows, "category", "arm", "unit", "1-URGENT")


@query("a26_verdicts", "SELECT p_partkey, CASE WHEN p_size % 7 - 3 < 0 THEN 'REGRESS' WHEN p_size % 5 - 2 >= 0 AND p_size % 3 - 1 < 0 THEN 'SAVE' ELSE 'inconclusive' END AS verdict FROM part")
def a26_verdict(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", reports.verdict(n % 5 - 2, n % 7 - 3, n % 3 - 1).alias("verdict"))


@query("a15_paired_units", f"""WITH {_C}, u AS (SELECT DISTINCT success, arm, unit FROM c), e AS (SELECT success, unit, count(*) AS held, max((arm = '1-URGENT')::INT) AS base FROM u GROUP BY 1, 2), n AS (SELECT success, count(DISTINCT arm) AS arms FROM u GROUP BY 1),
s AS (SELECT e.success, count(*) AS total, count(*) FILTER (WHERE held = arms) AS common FROM e JOIN n USING (success) GROUP BY 1)
SELECT u.success, arm, count(*) AS units, any_value(common) AS common, any_value(total) - count(*) AS missing, count(*) FILTER (WHERE base = 0) AS extra FROM u JOIN e ON e.success = u.success AND e.unit = u.unit JOIN s ON s.success = u.success GROUP BY 1, 2""")
def a15_units(spark: SparkSession, d: str) -> DataFrame:
    return reports.paired_units(_cells(spark, d), ["success"], "arm", ["unit"], "1-URGENT")


@query("a24_pareto", "WITH p AS (SELECT p_partkey AS name, p_size AS up, p_retailprice AS down FROM part) SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.up >= a.up AND b.down <= a.down AND (b.up > a.up OR b.down < a.down))")
def a24(spark: SparkSession, d: str) -> DataFrame:
    return reports.pareto(table(spark, d, "part").selectExpr("p_partkey AS name", "p_size AS up", "p_retailprice AS down"), "name", "up", "down")


@query("a15_paired_arms", f"""WITH {_C}, b AS (SELECT unit, avg(quality) AS base FROM c WHERE arm = '1-URGENT' GROUP BY 1), o AS (SELECT arm, unit, avg(quality) AS own FROM c WHERE arm <> '1-URGENT' GROUP BY 1, 2), x AS (SELECT arm, own - base AS delta FROM o JOIN b USING (unit))
SELECT arm, count(*) AS units, round(avg(delta), 6) AS mean_delta, count(*) FILTER (WHERE delta > 1e-9) AS wins, count(*) FILTER (WHERE abs(delta) <= 1e-9) AS ties, count(*) FILTER (WHERE delta < -1e-9) AS losses FROM x GROUP BY 1""")
def a15(spark: SparkSession, d: str) -> DataFrame:
    return reports.paired(_cells(spark, d), "arm", "unit", "quality", "1-URGENT")


@query("a16_bootstrap")
def a16(spark: SparkSession, d: str) -> DataFrame:
    return reports.bootstrap(_cells(spark, d), "unit", "quality", samples=100)


@query("e30_noninferiority")
def e30(spark: SparkSession, d: str) -> DataFrame:
    base = _cells(spark, d).withColumn("delta", F.col("quality") - 0.45)
    return reports.noninferiority(base, "unit", "delta", 0.05, samples=100).select("noninferior")


@query("a17_percentiles", f"WITH {_C} SELECT arm, round(quantile_cont(cost, 0.5), 6) AS p50, round(quantile_cont(cost, 0.95), 6) AS p95 FROM c GROUP BY 1")
def a17(spark: SparkSession, d: str) -> DataFrame:
    return reports.percentiles(_cells(spark, d), ["arm"], "cost", [0.5, 0.95])


@query("a18_constrained_best", f"""WITH {_C}, a AS (SELECT arm, avg(quality) AS quality, avg(cost) AS cost FROM c GROUP BY 1), q AS (SELECT * FROM a WHERE quality >= 0.45 OR arm = '2-HIGH'), b AS (SELECT cost AS base FROM a WHERE arm = '2-HIGH'), m AS (SELECT arm, cost FROM q ORDER BY cost, arm LIMIT 1)
SELECT arm AS selected_arm, round(cost, 4) AS value, round(base, 4) AS baseline_value, round(cost / base, 6) AS ratio_to_baseline, round(1 - cost / base, 6) AS savings, NULL::VARCHAR AS reason FROM m, b""")
def a18(spark: SparkSession, d: str) -> DataFrame:
    arms = _cells(spark, d).groupBy("arm").agg(F.avg("quality").alias("quality"), F.avg("cost").alias("cost"))
    out = reports.constrained_best(arms, "arm", "quality", "cost", 0.45, "2-HIGH")
    return out.withColumn("value", F.round("value", 4)).withColumn("baseline_value", F.round("baseline_value", 4))


@query("a19_token_report", f"WITH {_C} SELECT arm, count(*) AS attempts, count(*) FILTER (WHERE success) AS successes, sum(total_tokens)::BIGINT AS tokens, round(sum(total_tokens) / count(*), 6) AS per_attempt, round(coalesce(sum(total_tokens) / nullif(count(*) FILTER (WHERE success), 0), 0), 6) AS per_success FROM c GROUP BY 1")
def a19(spark: SparkSession, d: str) -> DataFrame:
    return reports.token_report(_cells(spark, d), "arm", F.col("success"))


_PRICES = "p(arm, i, k, o) AS (VALUES ('1-URGENT', 3.0, 0.3, 15.0), ('2-HIGH', 1.0, NULL, 5.0))"


def _priced(spark: SparkSession, d: str) -> DataFrame:
    prices = spark.createDataFrame([("1-URGENT", 3.0, 0.3, 15.0), ("2-HIGH", 1.0, None, 5.0)], "arm string, usd_in double, usd_cached double, usd_out double")
    return reports.projected_cost(_cells(spark, d).withColumn("cached_tokens", F.col("cell_id") % 200), prices, "arm")


@query("a20_projected_cost", f"""WITH {_C}, {_PRICES} SELECT cell_id, round((greatest(prompt_tokens - cell_id % 200, 0) * i + cell_id % 200 * coalesce(k, i) + completion_tokens * o) / 1e6, 9)::DOUBLE AS usd, CASE WHEN i IS NULL THEN 'no price for model' END AS reason FROM c LEFT JOIN p USING (arm)""")
def a20(spark: SparkSession, d: str) -> DataFrame:
    return _priced(spark, d).select("cell_id", "usd", "reason")


@query("a21_chosen_cost", f"""WITH {_C}, {_PRICES}, x AS (SELECT cell_id, (greatest(prompt_tokens - cell_id % 200, 0) * i + cell_id % 200 * coalesce(k, i) + completion_tokens * o) / 1e6 AS usd, cost FROM c LEFT JOIN p USING (arm)) SELECT cell_id, round(coalesce(usd, cost), 10)::DOUBLE AS usd FROM x""")
def a21(spark: SparkSession, d: str) -> DataFrame:
    return _priced(spark, d).select("cell_id", F.round(reports.chosen_usd(F.col("usd"), F.col("cost")), 10).alias("usd"))


@query("a43_token_costs", f"""WITH {_C}, x AS (SELECT arm, CASE WHEN cell_id % 13 > 0 THEN (greatest(prompt_tokens - cell_id % 900, 0) * 2.0 + cell_id % 900 * 0.2 + (completion_tokens + total_tokens) * 8.0) / 1000000 END AS usd FROM c)
SELECT arm, count(usd) AS priced, round(sum(usd), 6)::DOUBLE AS total, round(avg(usd), 9)::DOUBLE AS mean FROM x GROUP BY 1""")
def a43(spark: SparkSession, d: str) -> DataFrame:
    rows = _cells(spark, d).withColumn("input", F.when(F.col("cell_id") % 13 > 0, F.col("prompt_tokens")))
    usd = reports.token_cost(F.col("input"), F.col("cell_id") % 900, F.col("completion_tokens"), F.col("total_tokens"), F.lit(2.0), F.lit(0.2), F.lit(8.0), output_includes_reasoning=False)
    return rows.groupBy("arm").agg(F.count(usd).alias("priced"), F.round(F.sum(usd), 6).alias("total"), F.round(F.avg(usd), 9).alias("mean"))


@query("a27_feedback", f"""WITH {_C}, a AS (SELECT arm, count(*) AS cells, round(avg(quality), 6) AS quality FROM c GROUP BY 1) SELECT arm, cells, quality, CASE WHEN arm <> '5-LOW' THEN round(quality - (SELECT quality FROM a WHERE arm = '5-LOW'), 6) END AS quality_delta FROM a""")
def a27(spark: SparkSession, d: str) -> DataFrame:
    return reports.feedback(_cells(spark, d), "arm", ["quality"], "5-LOW")


@query("e29_format_failures", f"""WITH {_C} SELECT arm, count(*) AS n, round(avg((cell_id % 4 = 0)::INT), 6) AS format_fail_rate, round(avg(quality), 6) AS quality_all, round(coalesce(avg(quality) FILTER (WHERE cell_id % 4 <> 0), 0), 6) AS quality_formatted FROM c GROUP BY 1""")
def e29(spark: SparkSession, d: str) -> DataFrame:
    return reports.format_report(_cells(spark, d), "arm", F.col("cell_id") % 4 == 0, ["quality"])


@query("e28_selected_queries", f"""WITH {_C}, s AS (SELECT * FROM c WHERE arm IN ('1-URGENT', '2-HIGH', '5-LOW')), i AS (SELECT unit, min(cell_id) AS f FROM s GROUP BY 1 ORDER BY f, unit LIMIT 50),
t AS (SELECT s.*, row_number() OVER (PARTITION BY unit, arm ORDER BY cell_id) AS turn FROM s JOIN i USING (unit)), n AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY turn, arm) AS k FROM t) SELECT unit, arm, cell_id FROM n WHERE k <= 3""")
def e28(spark: SparkSession, d: str) -> DataFrame:
    rows = reports.select_queries(_cells(spark, d), "unit", "cell_id", "arm", ["1-URGENT", "2-HIGH", "5-LOW"], max_instances=50, max_queries=3, round_robin=True)
    return rows.select("unit", "arm", "cell_id")


@query("e31_replay_summary", """WITH r AS (SELECT l_returnflag AS lang, l_quantity AS s, l_quantity * (1 + l_suppkey % 5) AS l, l_partkey % 3 > 0 AS eq FROM lineitem)
SELECT lang, count(*) AS requests, round(avg(eq::INT), 6) AS equivalent_rate, round(quantile_cont(s, 0.5), 6) AS static_p50, round(quantile_cont(s, 0.95), 6) AS static_p95, round(quantile_cont(l, 0.5), 6) AS live_p50, round(quantile_cont(l, 0.95), 6) AS live_p95,
  round(quantile_cont(l / s, 0.5) FILTER (WHERE eq AND s > 0), 6) AS speedup_p50 FROM r GROUP BY 1""")
def e31(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "lineitem").selectExpr("l_returnflag AS lang", "l_quantity AS s", "l_quantity * (1 + l_suppkey % 5) AS l", "l_partkey % 3 > 0 AS eq")
    return reports.replay_summary(r, ["lang"], "s", "l", "eq")


@query("e32_latency_pairs", "SELECT o_orderkey, o_totalprice AS dynamic_ms, o_orderkey % 97 AS replay_ms, round(o_totalprice - o_orderkey % 97, 6) AS overhead_ms FROM orders")
def e32(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders")
    return reports.latency_pairs(rows.withColumn("ms", F.col("o_totalprice")), rows.withColumn("ms", F.col("o_orderkey") % 97), ["o_orderkey"])


@query("e33_promotion_gate", """SELECT n_nationkey, (CASE WHEN n_nationkey % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN n_nationkey % 5 = 0 THEN 1 ELSE 0 END)::INTEGER AS failures, n_nationkey % 4 <> 0 AND n_nationkey % 3 <> 0 AND n_nationkey % 5 <> 0 AS ready FROM nation""")
def e33(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").selectExpr(
        "n_nationkey", "if(n_nationkey % 4 = 0, ' ', 'contract') AS runtime_contract", "'delta' AS raw_behavior_delta", "if(n_nationkey % 3 = 0, 'other', 'latency') AS failure_category", "1 AS smoke", "2 AS holdout",
        "n_nationkey % 5 = 0 AS model_specific", "1 AS systems", "0 AS scorer_dependencies", "0 AS benchmark_dependencies",
    )
    return reports.promotion_failures(rows, ["latency", "quality"]).select("n_nationkey", F.size("failures").alias("failures"), "ready")


@query("e35_cell_coverage", """WITH w AS (SELECT c_custkey AS cs, p FROM customer, (VALUES ('a'), ('b')) t(p)), g AS (SELECT c_custkey AS cs, 'a' AS p, c_custkey % 7 = 0 AS f FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT c_custkey, 'b', false FROM customer UNION ALL SELECT 0 - c_custkey - 1, 'b', false FROM customer WHERE c_custkey < 5),
j AS (SELECT coalesce(w.p, g.p) AS provider, w.cs AS want, g.cs AS got, f FROM w FULL JOIN g ON w.cs = g.cs AND w.p = g.p)
SELECT provider, count(want) AS requested, count(got) FILTER (WHERE want IS NOT NULL) AS observed, count(*) FILTER (WHERE got IS NULL) AS missing, count(*) FILTER (WHERE want IS NOT NULL AND f) AS failed, count(*) FILTER (WHERE want IS NULL) AS unexpected, 0::BIGINT AS repeated FROM j GROUP BY 1""")
def e35(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    got = c.where("c_custkey % 3 > 0").selectExpr("c_custkey AS case", "'a' AS provider", "c_custkey % 7 = 0 AS failed")
    got = got.unionByName(c.selectExpr("c_custkey AS case", "'b' AS provider", "false AS failed")).unionByName(c.where("c_custkey < 5").selectExpr("0 - c_custkey - 1 AS case", "'b' AS provider", "false AS failed"))
    return reports.cell_coverage(c.select(F.col("c_custkey").alias("case")), got, ["a", "b"])


_LOC = """p AS (SELECT DISTINCT l_orderkey AS q, CASE WHEN l_linenumber % 2 = 0 THEN 'files' ELSE 'functions' END AS scope, l_partkey % 5 AS item FROM lineitem), g AS (SELECT o_orderkey AS q, 'files' AS scope, o_custkey % 5 AS item FROM orders UNION SELECT o_orderkey, 'functions', o_custkey % 3 FROM orders),
j AS (SELECT coalesce(p.q, g.q) AS q, coalesce(p.scope, g.scope) AS scope, p.item AS pi, g.item AS gi FROM p FULL JOIN g ON p.q = g.q AND p.scope = g.scope AND p.item = g.item),
lz AS (SELECT q, scope, count(*) FILTER (WHERE pi IS NOT NULL AND gi IS NOT NULL) = count(gi) AS match, CASE WHEN count(pi) > 0 THEN round(count(*) FILTER (WHERE pi IS NOT NULL AND gi IS NOT NULL) / count(pi), 6) ELSE 1.0 END AS precision FROM j GROUP BY 1, 2)"""


def _localized(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").selectExpr("l_orderkey AS q", "if(l_linenumber % 2 = 0, 'files', 'functions') AS scope", "l_partkey % 5 AS item")
    o = table(spark, d, "orders")
    g = o.selectExpr("o_orderkey AS q", "'files' AS scope", "o_custkey % 5 AS item").unionByName(o.selectExpr("o_orderkey AS q", "'functions' AS scope", "o_custkey % 3 AS item"))
    return metrics.localization(p, g, ["q"])


@query("e36_localization", f"WITH {_LOC} SELECT * FROM lz")
def e36(spark: SparkSession, d: str) -> DataFrame:
    return _localized(spark, d)


@query("e36_localization_summary", f"WITH {_LOC} SELECT scope, count(*) AS n, count(*) FILTER (WHERE match) AS matches, round(avg(match::INT), 6) AS match_rate, round(avg(precision), 6) AS precision_mean FROM lz GROUP BY 1")
def e36_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.localization_summary(_localized(spark, d))


@query("a30_rebuild_speedup", """WITH c AS (SELECT o_custkey AS w, o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'cold' ELSE 'patched' END AS m, o_orderkey % 997 AS s FROM orders), g AS (SELECT w, count(*) AS n, count(*) FILTER (WHERE m = 'patched') AS p, arg_min(s, o_orderkey) FILTER (WHERE m = 'cold') AS cold, avg(s) FILTER (WHERE m = 'patched') AS patch FROM c GROUP BY 1)
SELECT w, n AS commit_count, p AS patched_count, round(cold::DECIMAL(28, 9), 2)::DOUBLE AS cold_seconds, round(patch::DECIMAL(28, 9), 2)::DOUBLE AS mean_patch_seconds, CASE WHEN cold > 0 AND patch > 0 THEN round((cold / patch)::DECIMAL(28, 9), 1)::DOUBLE END AS speedup FROM g""")
def a30(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "orders").selectExpr("o_custkey AS w", "o_orderkey", "if(o_orderkey % 5 = 0, 'cold', 'patched') AS method", "o_orderkey % 997 AS build_seconds")
    return reports.rebuild_speedup(c, ["w"], "o_orderkey")


@query("a32_view_coverage", "SELECT count(DISTINCT c_custkey) AS required, count(DISTINCT o_custkey) AS covered, round(count(DISTINCT o_custkey) / count(DISTINCT c_custkey), 6) AS ratio, count(DISTINCT c_custkey) = count(DISTINCT o_custkey) AS complete FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def a32(spark: SparkSession, d: str) -> DataFrame:
    return reports.coverage(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("a36_audit_summary", "SELECT count(*) AS pages, count(*) FILTER (WHERE n_chars > 500) AS publishable, count(*) FILTER (WHERE lang = 'en') AS repaired FROM documents")
def a36(spark: SparkSession, d: str) -> DataFrame:
    return reports.audit_summary(table(spark, d, "documents").selectExpr("n_chars > 500 AS publishable", "lang = 'en' AS repaired"), ["publishable", "repaired"])


@query("a38_difficulties", "SELECT doc_id, (doc_id % 7 + 1)::INTEGER AS changed_loc FROM documents")
def a38(spark: SparkSession, d: str) -> DataFrame:
    patch = F.concat(F.lit("--- a/x\n+++ b/x\n@@ -1,9 +1,9 @@\n same\n-old\n"), F.expr("repeat('+new\n', int(doc_id % 7))"))
    return reports.difficulties(table(spark, d, "documents").select("doc_id", patch.alias("patch")), "patch").select("doc_id", "changed_loc")


@query("a39_representative_groups", """WITH r AS (SELECT p_brand, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) - 1 AS place, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_brand, p_partkey, p_size, place::INTEGER AS place FROM r WHERE place IN (0, n - 1, round_even(0.25 * (n - 1), 0), round_even(0.5 * (n - 1), 0), round_even(0.75 * (n - 1), 0)) OR n <= 5""")
def a39_groups(spark: SparkSession, d: str) -> DataFrame:
    return reports.representative_groups(table(spark, d, "part"), "p_brand", "p_size", "p_partkey")


@query("a41_repo_quotas", """WITH a AS (SELECT c_custkey AS repo, c_nationkey % 4 AS grp, count(o_orderkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2), b AS (SELECT *, least(n, 3) AS base FROM a), t AS (SELECT 3 * count(*) + 77 AS total, sum(n) AS every, sum(base) AS based FROM b),
m AS (SELECT repo, grp, unnest(range(0, n - base)) AS r FROM b), o AS (SELECT *, row_number() OVER (ORDER BY r, grp, repo) AS p FROM m), x AS (SELECT repo, count(*) AS extra FROM o, t WHERE p <= total - based GROUP BY 1)
SELECT b.repo, grp, n AS available, (CASE WHEN total > every THEN n ELSE base + coalesce(extra, 0) END)::BIGINT AS quota FROM b LEFT JOIN x ON x.repo = b.repo, t""")
def a41(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_custkey").alias("repo"), (F.col("c_nationkey") % 4).alias("grp")).agg(F.count("o_orderkey").alias("n"))
    return reports.repo_quotas(a, "repo", "grp", 3, 3 * a.count() + 77)


@query("a44_index_stats", "SELECT lang AS level, count(*) AS rows, count(DISTINCT source) AS files FROM documents GROUP BY 1")
def a44(spark: SparkSession, d: str) -> DataFrame:
    return reports.index_stats(table(spark, d, "documents").withColumnRenamed("lang", "level"), "level", "source")


@query("a45_hit_rate", "SELECT user_id, round(coalesce(count(*) FILTER (WHERE event_type = 'view') / nullif(count(*) FILTER (WHERE event_type IN ('view', 'click')), 0), 0), 6) AS rate FROM events GROUP BY 1")
def a45(spark: SparkSession, d: str) -> DataFrame:
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    return table(spark, d, "events").groupBy("user_id").agg(F.round(reports.hit_rate(n("view"), n("click")), 6).alias("rate"))


def _nodes_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr("l_orderkey AS q", "(l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey % 1000) * 100 + bigint(l_quantity) AS rank", "concat('f', l_partkey % 3, '.py:sym', l_partkey % 7) AS node_id", "'abs/x.py' AS file", "l_linenumber * 20 - 1 AS start_line", "l_linenumber * 20 - 1 + bigint(l_quantity) AS end_line", "l_tax AS score")


_NODES = "nd AS (SELECT l_orderkey AS q, (l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey % 1000) * 100 + l_quantity::BIGINT AS rank, 'f' || l_partkey % 3 || '.py' AS file, 'f' || l_partkey % 3 || '.py:sym' || l_partkey % 7 AS sym, l_linenumber * 20 AS first, l_linenumber * 20 + l_quantity::BIGINT AS last, l_tax AS score FROM lineitem)"


@query("a3_predictions", f"""WITH {_NODES}, f AS (SELECT q, file AS item, min(rank) AS r FROM nd GROUP BY 1, 2) SELECT q, 'file' AS scope, item, row_number() OVER (PARTITION BY q ORDER BY r)::INTEGER AS rank FROM f
UNION ALL SELECT q, 'symbol', sym, row_number() OVER (PARTITION BY q ORDER BY rank)::INTEGER FROM nd""")
def a3(spark: SparkSession, d: str) -> DataFrame:
    f, s = metrics.predictions(_nodes_of(spark, d), ["q"], "rank")
    return f.select("q", F.lit("file").alias("scope"), "item", "rank").unionByName(s.select("q", F.lit("symbol").alias("scope"), "item", "rank"))


@query("a7_node_spans", f"WITH {_NODES} SELECT q, file, first, last, row_number() OVER (PARTITION BY q ORDER BY score DESC, rank)::INTEGER AS rank FROM nd")
def a7(spark: SparkSession, d: str) -> DataFrame:
    return metrics.node_spans(_nodes_of(spark, d), ["q"])


@query("a7_answer_spans", """SELECT item_id, 'src/a' || item_id || '.py' AS file, 10::BIGINT AS first, (10 + item_id)::BIGINT AS last, 1 AS rank FROM benchmark UNION ALL SELECT item_id, 'b.go', 7, 7, 2 FROM benchmark""")
def a7_answers(spark: SparkSession, d: str) -> DataFrame:
    answer = F.concat("text", F.lit("\nsee c.py:1\n**Locations:** ./src/a"), "item_id", F.lit(".py:10-"), (F.col("item_id") + 10).cast("string"), F.lit(", b.go:7\n"))
    return metrics.answer_spans(table(spark, d, "benchmark").select("item_id", answer.alias("answer")), ["item_id"], "answer")


@query("a6_blocks_at_k")
def a6(spark: SparkSession, d: str) -> DataFrame:
    from quarry.operators import intervals

    s, b = _spans(spark, d)
    kept = intervals.distinct_spans(s.withColumn("_q", F.col("q")), by=["q", "file"]).drop("_q")
    return metrics.blocks_at(kept, b, ["q"], [1, 3, 5])


_RR = """rg AS (SELECT l_orderkey AS q, l_linenumber AS rank, 'f' || l_partkey % 4 AS file, CASE WHEN l_suppkey % 6 = 0 THEN -5 ELSE l_linenumber * 9 END AS first, CASE WHEN l_partkey % 8 = 0 THEN -1 ELSE l_linenumber * 9 + l_quantity::BIGINT END AS last FROM lineitem),
co AS (SELECT o_orderkey AS q, 'f' || o_custkey % 4 AS file, o_custkey % 30 AS first, o_custkey % 30 + 25 AS last FROM orders), op AS (SELECT o_orderkey AS q, 'f' || (o_custkey + 1) % 4 AS file, 5 AS first, 20 AS last FROM orders WHERE o_orderkey % 3 = 0),
nl(file, t) AS (VALUES ('f0', 60), ('f1', 45), ('f2', 90)),
st AS (SELECT k, q, rank, x.file, CASE WHEN need AND t >= 1 THEN greatest(1, least(CASE WHEN first < 0 THEN t + first + 1 ELSE first END, t)) WHEN NOT need AND last >= 1 THEN greatest(1, first) END AS f, CASE WHEN need AND t >= 1 THEN greatest(1, least(CASE WHEN last = -1 THEN t ELSE last END, t)) WHEN NOT need AND last >= 1 THEN last END AS l
  FROM (SELECT 'p' AS k, *, last = -1 OR first < 0 AS need FROM rg UNION ALL SELECT 'c', q, 0, file, first, last, last = -1 OR first < 0 FROM co UNION ALL SELECT 'o', q, 0, file, first, last, false FROM op) x LEFT JOIN nl ON nl.file = x.file),
li AS (SELECT DISTINCT k, q, file, unnest(range(f, l + 1)) AS line FROM st WHERE f <= l),
mk AS (SELECT q, file, line, max((k = 'p')::INT) AS p, max((k = 'c')::INT) AS c, max((k = 'o')::INT) AS o FROM li GROUP BY 1, 2, 3),
sm AS (SELECT q, sum(p) AS p, sum(c) AS c, sum(o) AS o, sum(p * c) AS pc, sum(p * greatest(c, o)) AS pu, sum(p * o) AS po FROM mk GROUP BY 1),
fl AS (SELECT q, sum(v) AS v, sum(cf) AS cf, sum(v * cf) AS vc, sum(v * (1 - greatest(cf, f2))) AS noise FROM (SELECT q, file, max((k = 'p')::INT) AS v, max((k = 'c')::INT) AS cf, max((k = 'o')::INT) AS f2 FROM st GROUP BY 1, 2) GROUP BY 1),
tg AS (SELECT st.q, rank, max(greatest(c, o)) AS hit, max(c) AS useful FROM st JOIN mk ON mk.q = st.q AND mk.file = st.file AND line BETWEEN f AND l WHERE k = 'p' GROUP BY 1, 2),
nr AS (SELECT q, count(*) AS n, row_number() OVER () AS z FROM rg GROUP BY 1), on_t AS (SELECT q, sum(hit) AS ok, min(CASE WHEN useful = 1 THEN rank END) AS u FROM tg GROUP BY 1),
ui AS (SELECT q, rank, row_number() OVER (PARTITION BY q ORDER BY rank) - 1 AS i FROM rg),
cv AS (SELECT st.q, avg(p) AS share, max(p) AS met, CASE WHEN st.file = 'f1' THEN 3.0 ELSE 2.0 END AS w FROM st JOIN mk ON mk.q = st.q AND mk.file = st.file AND line BETWEEN f AND l WHERE k = 'c' GROUP BY st.q, st.file),
cw AS (SELECT q, sum(w * share) / sum(w) AS wc, sum(met) AS met FROM cv GROUP BY 1)"""


@query("a8_region_report", f"""WITH {_RR}, z AS (SELECT s.q, coalesce(p, 0) AS p, coalesce(c, 0) AS c, coalesce(o, 0) AS o, pc, pu, po, v, cf, vc, noise, coalesce(n, 0) AS n, coalesce(ok, 0) AS ok, wc, met, u FROM sm s JOIN fl ON fl.q = s.q LEFT JOIN nr ON nr.q = s.q LEFT JOIN on_t ON on_t.q = s.q LEFT JOIN cw ON cw.q = s.q)
SELECT z.q, round(CASE WHEN p > 0 THEN pc / p ELSE 0 END, 6)::DOUBLE AS precision, round(CASE WHEN c > 0 THEN pc / c ELSE 0 END, 6)::DOUBLE AS recall, round(CASE WHEN pc > 0 THEN 2 * (pc / p) * (pc / c) / (pc / p + pc / c) ELSE 0 END, 6)::DOUBLE AS f1_score,
  round(CASE WHEN cf > 0 THEN vc / cf ELSE 0 END, 6)::DOUBLE AS hit_file_rate, round(CASE WHEN v > 0 THEN noise / v ELSE 0 END, 6)::DOUBLE AS noise_file_rate, round(coalesce(met, 0) / 1, 6)::DOUBLE AS hit_region_rate,
  round(CASE WHEN n > 0 THEN (n - ok) / n ELSE 0 END, 6)::DOUBLE AS noise_region_rate, round(coalesce(wc, 0), 6)::DOUBLE AS weighted_core_coverage, round(CASE WHEN p > 0 THEN pu / p ELSE 0 END, 6)::DOUBLE AS context_efficiency, round(CASE WHEN o > 0 THEN po / o ELSE 0 END, 6)::DOUBLE AS optional_coverage,
  round(CASE WHEN c > 0 AND u IS NOT NULL THEN 1 - i / n ELSE 0 END, 6)::DOUBLE AS first_useful_hit FROM z LEFT JOIN ui ON ui.q = z.q AND ui.rank = z.u""")
def a8(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "lineitem").selectExpr("l_orderkey AS q", "l_linenumber AS rank", "concat('f', l_partkey % 4) AS file", "bigint(if(l_suppkey % 6 = 0, -5, l_linenumber * 9)) AS first", "if(l_partkey % 8 = 0, -1L, l_linenumber * 9 + bigint(l_quantity)) AS last")
    o = table(spark, d, "orders")
    core = o.selectExpr("o_orderkey AS q", "concat('f', o_custkey % 4) AS file", "o_custkey % 30 AS first", "o_custkey % 30 + 25 AS last")
    opt = o.where("o_orderkey % 3 = 0").selectExpr("o_orderkey AS q", "concat('f', (o_custkey + 1) % 4) AS file", "5L AS first", "20L AS last")
    n = spark.createDataFrame([("f0", 60), ("f1", 45), ("f2", 90)], "file string, n_lines bigint")
    out = metrics.region_report(r, core, opt, core.where("file = 'f1'").select("q", "file"), n, ["q"], budgets=())
    return out


@query("a12_budget_reports")
def a12_budgets(spark: SparkSession, d: str) -> DataFrame:
    s, b = _spans(spark, d)
    none = spark.createDataFrame([], "file string, n_lines bigint")
    return metrics.region_report(s, b, b.limit(0), b.where("file = 'f1'").select("q", "file"), none, ["q"], budgets=(100, 500)).select("q", "ndcg_at_100", "recall_at_100", "recall_at_500")


@query("e22_ranked_regions", "SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id)::INTEGER AS rank, 1::BIGINT AS first, least(len(string_split(text, chr(10))), 40)::BIGINT AS last FROM documents ORDER BY n_chars DESC, doc_id LIMIT 30")
def e22(spark: SparkSession, d: str) -> DataFrame:
    top = table(spark, d, "documents").orderBy(F.col("n_chars").desc(), "doc_id").limit(30)
    nodes = top.select("doc_id", F.concat(F.lit("d"), "doc_id", F.lit(".py:x")).alias("node_id"), F.lit(None).cast("string").alias("file"), F.lit(0).alias("start_line"), (F.least(F.size(F.split("text", "\n")), F.lit(40)) - 1).alias("end_line"), F.col("n_chars").cast("double").alias("score"), F.col("doc_id").alias("rank"))
    spans = metrics.node_spans(nodes.withColumn("_all", F.lit(0)), ["_all"])
    return spans.select(F.regexp_extract("file", "[0-9]+", 0).cast("bigint").alias("doc_id"), "rank", F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"))


@query("e23_flat_results", "SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INTEGER AS rank, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 5")
def e23(spark: SparkSession, d: str) -> DataFrame:
    nested = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("regions"))
    return metrics.flattened(nested, "regions", 5).select("o_custkey", "rank", F.col("item").alias("o_orderkey"))


@query("a28_trace_summary", """WITH e AS (SELECT *, min(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM conversations)
SELECT role, count(*) AS n, count(nxt) AS answered, round(avg(nxt - turn), 6) AS mean_gap, sum(length(text))::BIGINT AS size FROM e GROUP BY 1""")
def a28(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    return reports.trace_summary(rows, "conv_id", "turn", "role", F.length("text").cast("bigint"))


_TERMS = """list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[`*_\\[\\]()#>/-]', ' ', 'g'), '[^a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN
 ('a','an','and','are','as','at','be','by','for','from','in','into','is','it','of','on','or','that','the','then','this','through','to','with')))"""


@query("a33_near_duplicates", f"""WITH d AS (SELECT source, doc_id AS id, list_sort({_TERMS}) AS t FROM documents), f AS (SELECT source, t, min(id) AS id, count(*) AS n FROM d WHERE len(t) >= 6 GROUP BY 1, 2)
SELECT a.source, a.id AS left_id, b.id AS right_id, a.n AS left_n, b.n AS right_n, round(len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)), 6) AS overlap FROM f a JOIN f b ON a.source = b.source AND (a.id < b.id OR (a.id = b.id AND a.n > 1))
WHERE len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)) >= 0.85""")
def a33(spark: SparkSession, d: str) -> DataFrame:
    return reports.near_duplicates(table(spark, d, "documents"), "doc_id", text.prose_terms(F.col("text")), by=["source"])


@query("a33_duplicate_prose", f"""WITH b AS (SELECT conv_id, turn, text, {_TERMS} AS t FROM conversations), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM b WHERE len(t) >= 6)
SELECT x.conv_id AS page, x.n::INTEGER AS "left", y.n::INTEGER AS "right", round(len(list_intersect(x.t, y.t)) / least(len(x.t), len(y.t)), 6) AS overlap FROM n x JOIN n y ON x.conv_id = y.conv_id AND x.n < y.n WHERE len(list_intersect(x.t, y.t)) / least(len(x.t), len(y.t)) >= 0.2""")
def a33_prose(spark: SparkSession, d: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", F.regexp_replace("text", "\n", " ").alias("t"))))
    pages = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: x["t"]), "\n\n").alias("markdown"))
    return reports.duplicate_prose(pages, "conv_id", "markdown", least=0.2)


@query("a34_sentence_redundancy")
def a34(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "documents").select("doc_id", F.concat(F.lit("## Part\n"), "text").alias("markdown"))
    return reports.sentence_redundancy(reports.sentences(pages, "doc_id", "markdown"))


_CITE = "ct AS (SELECT l_orderkey AS page, l_linenumber % 5 AS section, 'E' || l_partkey % 6 AS e FROM lineitem)"


@query("a35_section_evidence", f"""WITH {_CITE}, x AS (SELECT DISTINCT page, section, e FROM ct), y AS (SELECT *, min(section) FILTER (WHERE section <> 1) OVER (PARTITION BY page, e) AS f, max((section = 0)::INT) OVER (PARTITION BY page, e) AS i FROM x)
SELECT page, section, count(*) AS cited, count(*) FILTER (WHERE f IS NULL OR f >= section) AS novel, min(i) = 1 AS intro_only FROM y WHERE section > 0 GROUP BY 1, 2""")
def a35_sections(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").selectExpr("l_orderkey AS page", "l_linenumber % 5 AS section", "concat('E', l_partkey % 6) AS e")
    return reports.section_evidence(c, "page", "section", "e", framing=F.col("section") == 1)


@query("a35_section_similarity", f"""WITH b AS (SELECT conv_id AS page, turn AS section, {_TERMS} AS t FROM conversations), m AS (SELECT x.page, x.section, y.section AS prior, CASE WHEN least(len(x.t), len(y.t)) >= 6 THEN len(list_intersect(x.t, y.t)) / least(len(x.t), len(y.t)) ELSE 0 END AS o FROM b x JOIN b y ON x.page = y.page AND y.section < x.section),
w AS (SELECT page, section, max(o) AS o, arg_max(prior, (o, 0 - prior)) AS prior FROM m WHERE o > 0 GROUP BY 1, 2)
SELECT b.page, b.section, w.prior AS against, round(coalesce(o, 0), 3)::DOUBLE AS overlap, coalesce(o >= 0.8, false) AS redundant FROM b LEFT JOIN w ON w.page = b.page AND w.section = b.section WHERE b.section > 0""")
def a35_similarity(spark: SparkSession, d: str) -> DataFrame:
    return reports.section_similarity(table(spark, d, "conversations"), "conv_id", "turn", "text")


@query("a37_grounding", """SELECT doc_id AS page, 2 AS blocks, (1 + (doc_id % 2))::INTEGER AS cited_blocks, CASE WHEN doc_id % 2 = 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS coverage, 1::BIGINT AS cited_evidence, CASE WHEN doc_id % 3 = 0 THEN ['E9'] ELSE []::VARCHAR[] END AS unknown_citations,
  doc_id % 2 = 1 AND doc_id % 3 <> 0 AS valid, doc_id % 2 = 1 AND doc_id % 3 <> 0 AS grounded FROM documents""")
def a37(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    long = "a claim about the system that is long enough to be counted as one"
    body = F.concat(F.lit(f"# Title\n\n{long} [E1]"), F.when(F.expr("doc_id % 3 = 0"), " [E9]").otherwise(""), F.lit(f"\n\n- {long}"), F.when(F.expr("doc_id % 2 = 1"), " [E1](x)").otherwise(""), F.lit("\n\nshort [E1]\n\n```\n[E1]\n```"))
    evidence = docs.select(F.col("doc_id").alias("page"), F.lit("E1").alias("id"))
    return reports.grounding(docs.select("doc_id", body.alias("markdown")), evidence, "doc_id", "markdown")


@query("a35_novel_evidence", """WITH s AS (SELECT conv_id AS page, turn AS section, unnest(list_distinct(regexp_split_to_array(lower(text), '[^a-z]+'))) AS w FROM conversations), f AS (SELECT page, w, min(section) AS section FROM s GROUP BY 1, 2)
SELECT page, section, count(DISTINCT w) AS cited, (SELECT count(*) FROM f WHERE f.page = s.page AND f.section = s.section) AS novel FROM s GROUP BY 1, 2""")
def a35(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("section"), F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("w"))
    return reports.novel_evidence(s, "page", "section", "w")


@query("a39_representatives", """WITH r AS (SELECT p_brand, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) - 1 AS place, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_brand, p_partkey, p_size, place::INTEGER AS place FROM r WHERE place IN (round_even(0.0 * (n - 1), 0), round_even(0.25 * (n - 1), 0), round_even(0.5 * (n - 1), 0), round_even(1.0 * (n - 1), 0))""")
def a39(spark: SparkSession, d: str) -> DataFrame:
    return reports.representatives(table(spark, d, "part"), "p_brand", "p_size", "p_partkey", [0.0, 0.25, 0.5, 1.0])


@query("a42_consensus", """WITH v AS (SELECT l_orderkey AS q, l_partkey % 4 AS item, l_linenumber AS run FROM lineitem), r AS (SELECT q, count(DISTINCT run) AS runs FROM v GROUP BY 1)
SELECT q, item, count(DISTINCT run) AS votes, any_value(runs) AS runs FROM v JOIN r USING (q) GROUP BY 1, 2 HAVING count(DISTINCT run) >= ceil(any_value(runs) / 2)""")
def a42(spark: SparkSession, d: str) -> DataFrame:
    return reports.consensus(table(spark, d, "lineitem").selectExpr("l_orderkey AS q", "l_partkey % 4 AS item", "l_linenumber AS run"), ["q"], "item", "run")


@query("e34_balanced_cases", """WITH sz AS (SELECT c_nationkey AS g, count(*) AS n FROM customer GROUP BY 1), k AS (SELECT *, least(n, 160 // (SELECT count(*) FROM sz)) AS eq FROM sz), l AS (SELECT 160 - sum(eq) AS l FROM k),
m AS (SELECT g, n - eq AS spare, unnest(range(0, least(n - eq, (SELECT l FROM l)::BIGINT))) AS r FROM k), o AS (SELECT g, row_number() OVER (ORDER BY r, spare - r DESC, sha256('0:' || g), g) AS p FROM m), x AS (SELECT g, count(*) AS e FROM o WHERE p <= (SELECT l FROM l) GROUP BY 1),
q AS (SELECT k.g, eq + coalesce(e, 0) AS quota FROM k LEFT JOIN x USING (g)), t AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('0:' || c_custkey), c_custkey) AS turn FROM customer), z AS (SELECT t.* FROM t JOIN q ON g = c_nationkey WHERE turn <= quota)
SELECT c_nationkey, c_custkey, turn::INTEGER AS turn, row_number() OVER (ORDER BY turn, c_nationkey)::INTEGER AS position FROM z""")
def e34(spark: SparkSession, d: str) -> DataFrame:
    return reports.balanced_cases(table(spark, d, "customer"), "c_nationkey", "c_custkey", 160)


@query("a31_quality_gates", """SELECT unnest(['documents', 'languages', 'long enough', 'covered']) AS "check", unnest([count(*) >= 100, count(DISTINCT lang) = 4, avg(n_chars) > 1e6, count(text) = count(*)]) AS passed FROM documents""")
def a31(spark: SparkSession, d: str) -> DataFrame:
    row = table(spark, d, "documents").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("langs"), F.avg("n_chars").alias("mean"), F.count("text").alias("texts"))
    return reports.gates(row, {"documents": "n >= 100", "languages": "langs = 4", "long enough": "mean > 1e6", "covered": "texts = n"})


_OLD = "SELECT doc_id AS path, md5(text) AS digest FROM documents WHERE doc_id % 10 <> 3"
_NEW = "SELECT doc_id AS path, CASE WHEN doc_id % 11 = 0 THEN md5(text || 'x') ELSE md5(text) END AS digest FROM documents WHERE doc_id % 10 <> 7"


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    old = docs.where("doc_id % 10 <> 3").select(F.col("doc_id").alias("path"), F.md5("text").alias("digest"))
    new = docs.where("doc_id % 10 <> 7").select(F.col("doc_id").alias("path"), F.when(F.expr("doc_id % 11 = 0"), F.md5(F.concat("text", F.lit("x")))).otherwise(F.md5("text")).alias("digest"))
    return old, new


@query("i1_changed_files", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'A' WHEN n.path IS NULL THEN 'D' ELSE 'M' END AS status FROM o FULL JOIN n ON o.path = n.path WHERE o.digest IS DISTINCT FROM n.digest")
def i1(spark: SparkSession, d: str) -> DataFrame:
    return incremental.changes(*_snapshots(spark, d), "path", "digest")


@query("i4_replaced_files", "SELECT source, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM (SELECT source, doc_id FROM documents WHERE source NOT IN ('src1', 'src2', 'src3') UNION ALL SELECT source, doc_id + 1000000 FROM documents WHERE source IN ('src1', 'src2')) GROUP BY 1")
def i4(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "doc_id")
    fresh = docs.where("source IN ('src1', 'src2')").withColumn("doc_id", F.col("doc_id") + 1000000)
    gone = docs.where("source = 'src3'").select("source").distinct()
    return incremental.replaced(docs, fresh, "source", gone).groupBy("source").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("i6_cache_split", f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT count(*) FILTER (WHERE digest IN (SELECT digest FROM o)) AS hits, count(*) FILTER (WHERE digest NOT IN (SELECT digest FROM o)) AS misses FROM n")
def i6(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(spark, d)
    hits, misses = incremental.cache_split(new, old.select("digest").distinct(), "digest")
    return hits.select(F.lit(1).alias("h")).unionByName(misses.select(F.lit(0).alias("h"))).agg(F.count_if(F.col("h") == 1).alias("hits"), F.count_if(F.col("h") == 0).alias("misses"))


@query("i8_delta_update", f"""WITH o AS (SELECT digest, count(*) AS a FROM ({_OLD}) GROUP BY 1), n AS (SELECT digest, count(*) AS b FROM ({_NEW}) GROUP BY 1), x AS (SELECT coalesce(o.digest, n.digest) AS digest, coalesce(b, 0) - coalesce(a, 0) AS k FROM o FULL JOIN n ON o.digest = n.digest)
SELECT CASE WHEN k > 0 THEN 'added' ELSE 'removed' END AS change, sum(abs(k))::BIGINT AS copies FROM x WHERE k <> 0 GROUP BY 1""")
def i8(spark: SparkSession, d: str) -> DataFrame:
    return incremental.chunk_delta(*_snapshots(spark, d), "digest").groupBy("change").agg(F.sum("copies").alias("copies"))


@query("i10_overlay", """WITH f AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id, event_id FROM f WHERE n = 1 AND event_type <> 'click'""")
def i10(spark: SparkSession, d: str) -> DataFrame:
    feed = table(spark, d, "events").withColumn("op", F.when(F.col("event_type") == "click", "delete").otherwise("upsert"))
    return incremental.overlay(feed, "user_id", F.struct("ts", "event_id")).select("user_id", "event_id")


@query("j26_convergence", f"WITH i AS ({_OLD}), r AS ({_NEW}) SELECT coalesce(i.path, r.path) AS path, CASE WHEN i.path IS NULL THEN 'missing' WHEN r.path IS NULL THEN 'extra' ELSE 'changed' END AS status FROM i FULL JOIN r ON i.path = r.path WHERE i.digest IS DISTINCT FROM r.digest")
def j26(spark: SparkSession, d: str) -> DataFrame:
    return incremental.differences(*_snapshots(spark, d), "path", "digest")


@query("i14_freshness", "SELECT CASE WHEN value > 50 THEN 'stale' ELSE 'fresh' END AS state, count(*) AS n FROM events GROUP BY 1")
def i14(spark: SparkSession, d: str) -> DataFrame:
    return incremental.freshness(table(spark, d, "events"), F.col("value"), F.lit(50.0)).groupBy("state").agg(F.count("*").alias("n"))


@query("i18_latest_generation", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def i18(spark: SparkSession, d: str) -> DataFrame:
    return incremental.latest(table(spark, d, "orders"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey")


@query("p25_fingerprint")
def p25(spark: SparkSession, d: str) -> DataFrame:
    return incremental.fingerprint(table(spark, d, "documents").withColumn("path", F.col("doc_id").cast("string")), "path", "text")


@query("i13_edges_outside", "WITH r AS (SELECT DISTINCT l_partkey % 50 AS f, 2 AS a, 4 AS b FROM lineitem WHERE l_partkey % 50 < 10) SELECT l_partkey % 50 AS f, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM r WHERE f = l_partkey % 50 AND l_linenumber BETWEEN a AND b) GROUP BY 1")
def i13(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").selectExpr("l_partkey % 50 AS anchor_file", "l_linenumber AS anchor_line")
    r = e.where("anchor_file < 10").selectExpr("anchor_file AS file", "2 AS first", "4 AS last").distinct()
    return incremental.edges_outside(e, r).groupBy(F.col("anchor_file").alias("f")).agg(F.count("*").alias("n"))
