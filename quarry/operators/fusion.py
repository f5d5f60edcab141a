"""Fusion of ranked branches, and what dedups and spreads a ranking.

A branch row has a key, a branch number and a rank from 1.  All operators are
grouped aggregates and windows by key, file or query; none gathers a branch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as T


def normalized_fusion(name: str | None) -> str:
    return {"rrf": "rrf", "reciprocal": "rrf"}.get((name or "weighted").lower(), "weighted")


def candidate_scores(score: Column, rank: Column) -> Column:
    """A missing or zero score becomes the reciprocal rank."""
    return F.when(F.coalesce(score, F.lit(0.0)) == 0, 1.0 / rank).otherwise(score)


def fuse(branches: DataFrame, weights: list[float] | None = None, k: int | None = None, *, fusion: str = "weighted", rrf_k: int = 60, by: list[str] | None = None, key: str = "key") -> DataFrame:
    """key, score, rank: summed weighted scores or reciprocal ranks; ties by first appearance.

    ``branches`` has key, branch (from 0), rank, score and, if it has one, content; the first non-empty content stays.
    """
    if rrf_k <= 0:
        raise ValueError("rrf_k must be positive")
    by = by or []
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("branch") + 1) if weights else F.lit(1.0)
    part = weight / (F.lit(rrf_k) + F.col("rank")) if normalized_fusion(fusion) == "rrf" else weight * candidate_scores(F.col("score"), F.col("rank"))
    first = F.min(F.struct("branch", "rank"))
    aggs = [F.round(F.sum(part), 9).alias("score"), first.alias("first")]
    if "content" in branches.columns:
        filled = F.when(F.col("content").rlike(r"\S"), F.struct("branch", "rank", "content"))
        aggs.append(F.min(filled)["content"].alias("content"))
    out = branches.groupBy(*by, key).agg(*aggs)
    out = out.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.col("score").desc(), "first"))).drop("first")
    return out if k is None else out.where(F.col("rank") <= k)


def fuse_files(branches: DataFrame, file: str, weights: list[float] | None = None, k: int | None = None, rrf_k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of files: each branch is first reduced to its files in order, then ranked anew."""
    first = branches.groupBy("branch", file).agg(F.min("rank").alias("rank"))
    anew = first.withColumn("rank", F.row_number().over(W.partitionBy("branch").orderBy("rank"))).withColumn("score", F.lit(0.0))
    return fuse(anew, weights, k, fusion="rrf", rrf_k=rrf_k, key=file)


def fuse_routes(routes: DataFrame, key: str = "key", constant: int = 60) -> DataFrame:
    """Reciprocal ranks with provenance; a route counts once a key, ties go to the better first rank, then the key."""
    once = routes.groupBy("route", key).agg(F.min("rank").alias("rank"))
    out = once.groupBy(key).agg(
        F.round(F.sum(1.0 / (F.lit(constant) + F.col("rank"))), 9).alias("score"), F.min("rank").alias("best"), F.array_sort(F.collect_set("route")).alias("routes")
    )
    return out.withColumn("rank", F.row_number().over(W.orderBy(F.col("score").desc(), "best", key)))


def interleave(branches: DataFrame) -> DataFrame:
    """Round robin over branches by rank."""
    return branches.withColumn("position", F.row_number().over(W.orderBy("rank", "branch")))


def diversify(ranked: DataFrame, file: str, k: int, most: int = 2) -> DataFrame:
    """At most ``most`` rows a file first; what was put off fills the rest."""
    nth = F.row_number().over(W.partitionBy(file).orderBy("rank"))
    out = ranked.withColumn("_late", nth > most)
    return out.withColumn("position", F.row_number().over(W.orderBy("_late", "rank"))).drop("_late").where(F.col("position") <= k)


def dedup(ranked: DataFrame, key: list[str]) -> DataFrame:
    """The first row of each key, with the first non-empty content of any of its rows."""
    own = W.partitionBy(*key)
    out = ranked.withColumn("_n", F.row_number().over(own.orderBy("rank")))
    if "content" in ranked.columns:
        filled = F.min(F.when(F.col("content").rlike(r"\S"), F.struct("rank", "content"))).over(own)["content"]
        out = out.withColumn("content", F.coalesce(filled, "content"))
    return out.where("_n = 1").drop("_n")


def filtered(ranked: DataFrame, predicates: list[Column], limit: int | None = None) -> DataFrame:
    """Rows that meet all predicates, in order, up to the limit."""
    out = ranked
    for p in predicates:
        out = out.where(p)
    return out if limit is None else out.orderBy("rank").limit(limit)


def has_span(file: str = "file", start: str = "start_line", end: str = "end_line") -> Column:
    return F.col(file).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull()


def has_content(content: str = "content") -> Column:
    return F.coalesce(F.col(content).rlike(r"\S"), F.lit(False))


#: Node types that are symbols.
SYMBOL_TYPES = ("symbol", "class", "function", "method", "field")


def is_symbol(type_: str = "type") -> Column:
    return F.coalesce(F.col(type_).isin(*SYMBOL_TYPES), F.lit(False))


def candidate_filters(require_span: bool = False, require_content: bool = False, symbol_only: bool = False, drop_tests: bool = False, include_exts: list[str] | None = None, exclude_globs: list[str] | None = None, file: str = "file") -> list[Column]:
    """The predicates that options ask for, cheap ones first; a row without a file passes the glob exclusion and no extension list."""
    out: list[Column] = []
    if require_span:
        out.append(has_span(file))
    if symbol_only:
        out.append(is_symbol())
    if include_exts:
        out.append(T.has_extension(F.col(file), include_exts))
    if exclude_globs:
        out.append(~T.matches_any(F.col(file), exclude_globs))
    if drop_tests:
        out.append(~T.is_test_path(F.col(file)))
    if require_content:
        out.append(has_content())
    return out


def run_stages(branches: list[DataFrame], weights: list[float] | None, k: int, *, fusion: str = "weighted", rrf_k: int = 60, by: list[str] | None = None, key: str = "key") -> DataFrame:
    """Retrieval branches (key, rank, score, by) as one ranking: a single branch as it is, several fused."""
    if not branches:
        raise ValueError("no retrieval stage")
    by = by or []
    if len(branches) == 1:
        return branches[0].where(F.col("rank") <= k).select(*by, key, "score", "rank")
    rows = None
    for i, b in enumerate(branches):
        part = b.select(*by, key, F.lit(i).alias("branch"), "rank", "score")
        rows = part if rows is None else rows.unionByName(part)
    return fuse(rows, weights, k, fusion=fusion, rrf_k=rrf_k, by=by, key=key).select(*by, key, "score", "rank")


def hybrid_lists(sparse: DataFrame, dense: DataFrame, key: list[str], weights: tuple[float, float] = (0.5, 0.5), k: int = 10) -> DataFrame:
    """Weighted fusion of two lists made elsewhere (key columns, rank, score); a candidate is its file, name and lines."""
    both = sparse.withColumn("branch", F.lit(0)).unionByName(dense.withColumn("branch", F.lit(1))).withColumn("key", F.struct(*key))
    out = fuse(both.select("key", "branch", "rank", "score"), list(weights), k)
    return out.select("key.*", "score", "rank")
