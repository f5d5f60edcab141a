"""Composite plans: retrieval joined with the graph, routes, projection and budgets, for a whole batch of questions.

Inputs: chunks (key, file, content and, where known, vid of the graph node), vectors (key, vector), a graph, and
questions (query_id, query and, where known, vector).  Every plan is a composition of operators; each question keeps its
own ranks, seeds and budgets by its query_id.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import dense, fusion, graph, impact, intervals, projection, routes, sparse

from . import planner


@dataclass
class Views:
    """What a repository has been indexed into; None where a view was not built."""

    chunks: DataFrame
    vectors: DataFrame | None = None
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    files: DataFrame | None = None
    postings: impact.View | None = None
    extra: dict = field(default_factory=dict)

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(n for n, v in (("sparse", self.chunks), ("dense", self.vectors), ("graph", self.edges)) if v is not None)


def lexical(views: Views, questions: DataFrame, k: int, drop_tests: bool = False) -> DataFrame:
    """query_id, key, score (0), rank by BM25."""
    tokens = T.lexical_tokens(F.col("content"))
    test = T.is_test_path(F.col("file")) if drop_tests else None
    out = sparse.search(views.chunks, questions, "key", "query_id", k, max(k, 128), tokens, T.lexical_tokens(F.col("query")), test, views.postings)
    return out.select("query_id", F.col("id").alias("key"), "score", "rank")


def semantic(views: Views, questions: DataFrame, k: int) -> DataFrame:
    """query_id, key, score, rank by vectors."""
    return dense.search_batch(views.vectors, questions.where("vector IS NOT NULL"), k, "vector", "key")


def identifiers(views: Views, questions: DataFrame, k: int = 20, most: int = 8) -> DataFrame:
    """query_id, key, score, rank: chunks that use one of the question's identifiers as a whole word, by how many of them, calls, then key.

    Questions with the same identifiers share one ranking, and chunks meet it by identifier: words of a chunk that no
    question asks for are never shuffled.
    """
    seeds = questions.select("query_id", F.explode(routes.symbol_seeds(F.col("query"), most)).alias("seed"))
    leaf = F.regexp_replace(F.element_at(F.split("seed", "[.:#/]+"), -1), r"\(\)$", "")
    asked = seeds.select("query_id", leaf.alias("word")).where(F.col("word").rlike("^[A-Za-z_][A-Za-z0-9_]*$"))
    asked = asked.groupBy("query_id").agg(F.array_sort(F.collect_set("word")).alias("asked"))
    sets = asked.select("asked").distinct().select("asked", F.explode("asked").alias("word"))
    words = views.chunks.select("key", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit("[A-Za-z0-9_]+"), F.lit(0)))).alias("word"))
    words = words.join(sets.select("word").distinct(), "word", "left_semi")
    met = words.join(sets, "word").groupBy("asked", "key").agg(F.count("*").alias("words"))
    rank = F.row_number().over(W.partitionBy("asked").orderBy(F.col("words").desc(), "key"))
    best = met.withColumn("rank", rank).where(F.col("rank") <= k)
    return asked.join(best, "asked").select("query_id", "key", F.lit(0.0).alias("score"), "rank")


def seeds_of(views: Views, found: DataFrame) -> DataFrame:
    """query_id, vid, rank, score: the graph nodes of found chunks."""
    own = views.chunks.where("vid IS NOT NULL").select("key", "vid")
    rows = found.join(own, "key")
    return rows.select("query_id", "vid", F.row_number().over(W.partitionBy("query_id").orderBy("rank")).alias("rank"), "score")


def region_by(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int, direction: str = "both", keep: Column | None = None) -> DataFrame:
    """query_id, vid, depth: every question's own region around its seeds."""
    walk = graph.checkpointed(graph.directed(edges, direction).distinct())
    seen = graph.checkpointed(seeds.select("query_id", "vid", F.lit(0).alias("depth")).distinct())
    edge = seen
    for level in range(1, hops + 1):
        nxt = edge.select("query_id", F.col("vid").alias("src")).join(walk, "src").select("query_id", F.col("dst").alias("vid")).distinct()
        edge = graph.checkpointed(nxt.join(seen, ["query_id", "vid"], "left_anti").withColumn("depth", F.lit(level)))
        if edge.isEmpty():
            break
        seen = graph.checkpointed(seen.unionByName(edge))
    out = seen.join(nodes, "vid")
    return (out if keep is None else out.where(keep)).select("query_id", "vid", "depth")


def neighbors_by(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, per_seed: int = 5, keep: Column | None = None, types: list[str] | None = None) -> DataFrame:
    """query_id, vid, seed_rank, n, score: one-hop neighbours of each question's seeds, in turn callees and callers, half the seed's score."""
    e = graph.of_types(edges, types)
    s = seeds.select("query_id", F.col("vid").alias("seed"), F.col("rank").alias("seed_rank"), F.col("score").alias("seed_score"))
    out = None
    for side, way in ((0, "forward"), (1, "backward")):
        hop = s.join(graph.directed(e, way).distinct(), F.col("seed") == F.col("src")).select("query_id", "seed", "seed_rank", "seed_score", F.col("dst").alias("vid"), F.lit(side).alias("side"))
        hop = hop.join(nodes, "vid")
        hop = hop if keep is None else hop.where(keep)
        hop = hop.withColumn("nth", F.row_number().over(W.partitionBy("query_id", "seed").orderBy("vid"))).select("query_id", "seed", "seed_rank", "seed_score", "vid", "side", "nth")
        out = hop if out is None else out.unionByName(hop)
    out = out.withColumn("n", F.row_number().over(W.partitionBy("query_id", "seed").orderBy("nth", "side"))).where(F.col("n") <= per_seed)
    return out.select("query_id", "vid", "seed_rank", "n", (F.col("seed_score") * 0.5).alias("score"))


def graph_seeded(views: Views, questions: DataFrame, seed_k: int = 5, hops: int = 2, k: int = 50, masked: bool = False) -> DataFrame:
    """BM25 seeds, their regions, and optionally vectors within them: query_id, vid (or key), rank."""
    seeds = seeds_of(views, lexical(views, questions, seed_k))
    region = region_by(views.nodes, views.edges, seeds, hops, keep=graph.usable_nodes())
    if not masked:
        rank = F.row_number().over(W.partitionBy("query_id").orderBy("vid"))
        return region.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "vid", "rank")
    mask = region.join(views.chunks.select("key", "vid"), "vid").select("query_id", "key").distinct()
    return planner.cascade(mask, views.vectors, questions, "vector", "key", k)


def graph_expanded(views: Views, questions: DataFrame, k: int = 10, seed_k: int = 20, per_seed: int = 5) -> DataFrame:
    """Vectors, one-hop neighbours, filters, dedup, rerank by vectors, and files of both rankings fused: query_id, file, score, rank."""
    found = semantic(views, questions, seed_k)
    near = neighbors_by(views.nodes, views.edges, seeds_of(views, found), per_seed, graph.usable_nodes(), ["reference"])
    chunk = views.chunks.select("key", "vid", "file").where("vid IS NOT NULL")
    more = near.join(chunk, "vid").select("query_id", "key", (F.lit(seed_k) + F.col("seed_rank") * per_seed + F.col("n")).alias("rank"))
    both = found.select("query_id", "key", "rank").unionByName(more)
    both = both.groupBy("query_id", "key").agg(F.min("rank").alias("rank"))
    again = planner.cascade(both, views.vectors, questions, "vector", "key", 10 * k)
    files = views.chunks.select("key", "file")
    branches = found.select("query_id", "key", F.lit(0).alias("branch"), "rank").unionByName(again.select("query_id", "key", F.lit(1).alias("branch"), "rank")).join(files, "key")
    first = branches.groupBy("query_id", "branch", "file").agg(F.min("rank").alias("rank"))
    anew = first.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "branch").orderBy("rank", "file"))).withColumn("score", F.lit(0.0))
    return fusion.fuse(anew, None, k, fusion="rrf", by=["query_id"], key="file").select("query_id", "file", "score", "rank")


def planned(views: Views, questions: DataFrame, tier: str = "balanced", k: int = 10) -> DataFrame:
    """query_id, key, plan, score, rank: each question by the plan its words ask for, over the views at hand.

    Questions of one plan run as one batch; structural ones start from BM25 seeds and rank their region by its chunks.
    """
    tier = planner.tier_of(tier)
    most, _ = planner.BUDGETS[tier]
    asked = graph.checkpointed(questions.withColumn("plan", planner.plan_for(F.col("query"), views.names, tier)))
    parts = []

    def of(plan: str) -> DataFrame:
        return asked.where(F.col("plan") == plan)

    if "sparse" in views.names:
        parts.append(lexical(views, of("fast_lexical"), most).withColumn("plan", F.lit("fast_lexical")))
    if "dense" in views.names:
        parts.append(semantic(views, of("semantic"), most).withColumn("plan", F.lit("semantic")))
    if {"sparse", "dense"} <= set(views.names):
        q = of("hybrid_fusion")
        weights = [planner.HYBRID_WEIGHTS["dense"], planner.HYBRID_WEIGHTS["sparse"]]
        parts.append(fusion.run_stages([semantic(views, q, most), lexical(views, q, most)], weights, most, fusion="rrf", by=["query_id"]).withColumn("plan", F.lit("hybrid_fusion")))
    if {"sparse", "graph"} <= set(views.names):
        q = of("structural_graph")
        seeds = lexical(views, q, 5)
        near = neighbors_by(views.nodes, views.edges, seeds_of(views, seeds), 10, graph.usable_nodes(), ["reference"])
        more = near.join(views.chunks.where("vid IS NOT NULL").select("key", "vid"), "vid").select("query_id", "key", "score", (F.lit(5) + F.col("seed_rank") * 10 + F.col("n")).alias("rank"))
        both = seeds.unionByName(more).groupBy("query_id", "key").agg(F.min("rank").alias("rank"), F.max("score").alias("score"))
        both = both.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank", "key")))
        parts.append(both.select("query_id", "key", "score", "rank").withColumn("plan", F.lit("structural_graph")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.where(F.col("rank") <= k).select("query_id", "key", "plan", "score", "rank")


def searched(views: Views, questions: DataFrame, tier: str = "balanced", k: int = 10, expand: int = 0, **budget) -> DataFrame:
    """The planner's results with their contents cut to a budget for each question; ``expand`` adds one-hop neighbours of the first ones."""
    found = planned(views, questions, tier, k)
    if expand and "graph" in views.names:
        near = neighbors_by(views.nodes, views.edges, seeds_of(views, found), expand, graph.usable_nodes(), ["reference"])
        more = near.join(views.chunks.where("vid IS NOT NULL").select("key", "vid"), "vid").select("query_id", "key", F.lit("expanded").alias("plan"), "score", (F.lit(k) + F.col("seed_rank") * expand + F.col("n")).alias("rank"))
        found = found.unionByName(more)
        first = F.row_number().over(W.partitionBy("query_id", "key").orderBy("rank"))
        found = found.withColumn("_n", first).where("_n = 1").drop("_n")
        found = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank", "key"))).where(F.col("rank") <= k + expand)
    rows = found.join(views.chunks.select("key", "file", "content"), "key").join(questions.select("query_id", "query"), "query_id")
    return projection.evidence(rows, ["query_id"], "rank", "query", **budget)


def repository_search(views: Views, questions: DataFrame, k: int = 10) -> DataFrame:
    """query_id, key, score, rank: BM25 and vectors with weight 1, exact identifiers with weight 2; supporting files left out of every branch."""
    kept = views.chunks.where(~T.is_supporting(F.col("file"))).select("key")
    clean = lambda rows: rows.join(kept, "key", "left_semi").withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))
    branches, weights = [clean(lexical(views, questions, 50))], [1.0]
    if "dense" in views.names:
        branches.append(clean(semantic(views, questions, 50)))
        weights.append(1.0)
    branches.append(clean(identifiers(views, questions, 50)))
    weights.append(2.0)
    return fusion.run_stages(branches, weights, k, fusion="rrf", by=["query_id"])


def composed_context(views: Views, questions: DataFrame, n_seeds: int = 5, per_seed: int = 4) -> DataFrame:
    """query_id, key, source, rank: identifier, vector and BM25 results in turn, the first of them as seeds, then callers and callees of each."""
    parts = [identifiers(views, questions, 20)] + ([semantic(views, questions, 20)] if "dense" in views.names else []) + [lexical(views, questions, 20)]
    rows = None
    for i, part in enumerate(parts):
        one = part.select("query_id", "key", F.lit(i).alias("branch"), "rank", "score")
        rows = one if rows is None else rows.unionByName(one)
    turn = rows.groupBy("query_id", "key").agg(F.min(F.struct("rank", "branch")).alias("t"))
    turn = turn.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("t", "key"))).where(F.col("rank") <= n_seeds)
    seeds = turn.select("query_id", "key", F.lit("seed").alias("source"), "rank")
    near = neighbors_by(views.nodes, views.edges, seeds_of(views, seeds.withColumn("score", F.lit(1.0))), per_seed, graph.usable_nodes(), ["reference"])
    more = near.join(views.chunks.where("vid IS NOT NULL").select("key", "vid"), "vid").select("query_id", "key", F.lit("neighbor").alias("source"), (F.lit(n_seeds) + F.col("seed_rank") * per_seed + F.col("n")).alias("rank"))
    both = seeds.unionByName(more)
    first = F.row_number().over(W.partitionBy("query_id", "key").orderBy("rank"))
    both = both.withColumn("_n", first).where("_n = 1").drop("_n")
    return both.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank", "key"))).select("query_id", "key", "source", "rank")


RETRIEVERS = {"bm25": lexical, "embedding": semantic, "identifier": identifiers}


def retrieved(views: Views, retriever: str, questions: DataFrame, k: int, seeds: int = 5) -> DataFrame:
    """Candidates by a retriever's name; ``graph`` is BM25 seeds with their neighbours."""
    if retriever == "graph":
        return composed_context(views, questions, seeds, max(1, k // max(1, seeds))).where(F.col("rank") <= k)
    if retriever not in RETRIEVERS:
        raise ValueError(f"unknown retriever {retriever}; known: {', '.join(sorted([*RETRIEVERS, 'graph']))}")
    return RETRIEVERS[retriever](views, questions, k)


def windows_around(found: DataFrame, n_lines: DataFrame, before: int = 4, after: int = 8, most: int = 200) -> DataFrame:
    """query_id, file, first, last: anchors (query_id, file, line, rank) as windows of lines, joined first-fit in rank order."""
    rows = found.join(n_lines, "file").withColumn("first", F.greatest(F.col("line") - before, F.lit(0)).cast("bigint")).withColumn("last", F.least(F.col("line") + after, F.col("n_lines") - 1).cast("bigint"))
    rows = rows.where("first <= last").withColumn("_file", F.concat_ws("\x01", F.col("query_id").cast("string"), "file"))
    out = intervals.first_fit_windows(rows.select(F.col("_file").alias("file"), "rank", "first", "last"), most=most)
    parts = F.split("file", "\x01")
    return out.select(parts[0].alias("query_id"), parts[1].alias("file"), "first", "last")


def explored(views: Views, questions: DataFrame, k: int = 10, radius: int = 1) -> dict[str, DataFrame]:
    """The parts of an exploration: results with excerpts, route anchors, dependencies of the seeds, and windows of source lines."""
    found = graph.checkpointed(searched(views, questions, k=k).drop("query"))
    asked = questions.select("query_id", routes.query_terms(F.col("query")).alias("asked"))
    seeds = seeds_of(views, found.withColumn("score", F.lit(1.0)))
    route = routes.route(views.nodes, views.edges, seeds.select("query_id", "vid", (F.col("rank") - 1).alias("seed_rank")), asked, k)
    depends = region_by(views.nodes, graph.of_types(views.edges, ["reference"]), seeds, radius)
    spans = views.nodes.where("file IS NOT NULL AND start_line IS NOT NULL")
    anchors = route.join(spans.select("vid", "file", F.col("start_line").alias("line")), "vid").select("query_id", "file", "line", "rank")
    n_lines = views.files.select(F.col("path").alias("file"), F.size(T.lines_of(F.col("text"))).alias("n_lines"))
    return {"results": found, "route": route, "dependencies": depends.where("depth > 0"), "windows": windows_around(anchors, n_lines)}
