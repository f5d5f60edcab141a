"""Choosing and running retrieval plans: which views answer a query, and how their results are combined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import dense, fusion

#: tier -> (candidates, most candidates a reranker sees)
BUDGETS = {"fast": (32, None), "balanced": (100, 50), "thorough": (128, 80)}
#: Other names of the tiers.
ALIASES = {"cheap": "fast", "low": "fast", "default": "balanced", "quality": "thorough", "full": "thorough"}
HYBRID_WEIGHTS = {"dense": 0.6, "sparse": 0.4}


def tier_of(name: str | None) -> str:
    key = (name or "balanced").strip().lower()
    key = ALIASES.get(key, key)
    if key not in BUDGETS:
        raise ValueError(f"unknown budget {name}; choose from fast, balanced, thorough")
    return key


def plan_for(query: Column, views: Sequence[str], tier: str = "balanced") -> Column:
    """structural_graph, fast_lexical, semantic or hybrid_fusion, from the query's signals and the views at hand."""
    tier, has = tier_of(tier), set(views)
    if not has & {"sparse", "dense"}:
        raise ValueError("no retrieval view is available")
    signals = text.query_signals(query)
    sparse, dense = "sparse" in has, "dense" in has
    if tier == "fast":
        return F.when(signals["lexical"] | F.lit(not dense), "fast_lexical").otherwise("semantic") if sparse else F.lit("semantic")
    rest = "hybrid_fusion" if sparse and dense else "semantic" if dense else "fast_lexical"
    plan = F.when(signals["semantic"] & ~signals["lexical"] & F.lit(dense), "semantic").otherwise(rest)
    if sparse and "graph" in has:
        plan = F.when(signals["structural"], "structural_graph").otherwise(plan)
    return plan


def cascade(mask: DataFrame, vectors: DataFrame, queries: DataFrame, vec: str, key: str, k: int) -> DataFrame:
    """Vector ranking within each query's lexical candidates (query_id, key); queries: query_id, vector."""
    rows = mask.join(vectors.select(key, F.col(vec).alias("_v")), key).join(queries.select("query_id", F.col("vector").alias("_q")), "query_id")
    rows = rows.withColumn("score", dense.dot(F.col("_v"), F.col("_q")))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), key))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", key, "score", "rank")


def hybrid(branches: DataFrame, k: int, by: list[str], tier: str = "balanced") -> DataFrame:
    """Reciprocal rank fusion of the dense (branch 0) and sparse (branch 1) results of each query."""
    most, _ = BUDGETS[tier_of(tier)]
    weights = [HYBRID_WEIGHTS["dense"], HYBRID_WEIGHTS["sparse"]]
    return fusion.fuse(branches.where(F.col("rank") <= most), weights, k, fusion="rrf", by=by)
