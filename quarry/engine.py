"""The engine as an object: a repository's views, and the searches over them.

``Engine`` holds DataFrames and builds plans; methods return DataFrames, so calls
compose.  Searches are lazy; walks over the graph run a job for each level they
take, and batches of vectors one to size and one to send their queries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import dense, fusion, graph, impact, intervals, sparse
from quarry.plans import composite, planner
from quarry.skills import Tools
from quarry.sources import chunkers, repository


class Engine:
    """Views of one repository: chunks, and, where built, vectors, nodes and edges, occurrences."""

    def __init__(self, spark: SparkSession, chunks: DataFrame, vectors: DataFrame | None = None, nodes: DataFrame | None = None, edges: DataFrame | None = None, occurrences: DataFrame | None = None, files: DataFrame | None = None):
        self.spark, self.chunks, self.vectors, self.nodes, self.edges, self.occurrences, self.files = spark, chunks, vectors, nodes, edges, occurrences, files

    #: The kept lexical view that searches read, once ``open_lexical`` has named it.
    postings: impact.View | None = None

    def open_lexical(self, root: str) -> Engine:
        """Let searches read the postings that ``index`` wrote below a folder, instead of the chunks' texts."""
        self.postings = impact.load(self.spark, f"{root}/lexical")
        return self

    @classmethod
    def from_repository(cls, spark: SparkSession, root: str, embed=None) -> Engine:
        """Scan a folder of source files into chunks, a symbol graph and vectors.

        Files of known languages are cut into definitions, others at blank lines; ``embed`` maps a text column to a
        vector column, hashed tokens by default.
        """
        files = repository.scan(spark, root).where(~text.is_minified(F.col("text")))
        code = chunkers.chunk_files(files).select("file", F.col("name").alias("chunk"), "first", "last", "content", "node_id")
        plain = repository.text_chunks(files.where(chunkers.language_of(F.col("path")).isNull()).select(F.col("path").alias("file"), "text"))
        chunks = code.unionByName(plain.select("file", F.col("chunk").cast("string").alias("chunk"), "first", "last", "content", F.col("file").alias("node_id")))
        chunks = chunks.withColumn("chunk_id", F.xxhash64("file", "chunk", "first"))
        embed = embed or (lambda c: dense.hashed_embedding(text.lexical_tokens(c)))
        vectors = chunks.select("chunk_id", embed(F.col("content")).alias("vector"))
        nodes, edges = chunkers.code_graph(files)
        return cls(spark, chunks, vectors, nodes, edges, files=files)

    def tools(self) -> Tools:
        """The engine's functions with checked arguments."""
        return Tools(self.composite_views(), self.occurrences)

    def composite_views(self) -> composite.Views:
        """The views as composite plans take them: a chunk's node is the symbol of its id and first line."""
        chunks = self.chunks.withColumnRenamed("chunk_id", "key")
        if self.nodes is not None and "node_id" in self.chunks.columns:
            own = self.nodes.where("start_line IS NOT NULL").select(F.col("unified_name").alias("node_id"), F.col("start_line").alias("first"), "vid")
            chunks = chunks.join(own, ["node_id", "first"], "left")
        vectors = None if self.vectors is None else self.vectors.withColumnRenamed("chunk_id", "key")
        return composite.Views(chunks, vectors, self.nodes, self.edges, self.files)

    def index(self, root: str, version: int = 1) -> None:
        """Write all views below a folder."""
        repository.save_view(self.chunks, root, "chunks", version)
        repository.save_postings(self.chunks.withColumn("body", F.concat_ws(" ", "file", "content")), "chunk_id", text.lexical_tokens(F.col("body")), root, version)
        impact.build(self.chunks, "chunk_id", text.lexical_tokens(F.concat_ws(" ", "file", "content")), f"{root}/lexical")
        if self.vectors is not None:
            repository.save_vectors(self.vectors.select(F.col("chunk_id").alias("node_id"), "vector", F.lit("l2").alias("level")), root, version)
        if self.nodes is not None:
            repository.save_graph(self.nodes, self.edges, root)

    def search_with_context(self, questions: DataFrame, tier: str = "balanced", k: int = 10, expand: int = 3) -> DataFrame:
        """Planned results for questions (query_id, query, vector) with neighbours and bounded excerpts."""
        return composite.searched(self.composite_views(), questions, tier, k, expand)

    def predecessors(self, seeds: DataFrame, types: list[str] | None = None) -> DataFrame:
        return graph.predecessors(self.nodes, self.edges, seeds, types)

    @property
    def views(self) -> tuple[str, ...]:
        return tuple(n for n, v in (("sparse", self.chunks), ("dense", self.vectors), ("graph", self.edges)) if v is not None)

    def bm25(self, queries: DataFrame, k: int = 10, drop_tests: bool = False) -> DataFrame:
        """queries: query_id, query.  Ranked chunk ids per query."""
        asked = text.lexical_tokens(F.col("query"))
        body = text.lexical_tokens(F.concat_ws(" ", "file", "content"))
        test = text.is_test_path(F.col("file")) if drop_tests else None
        return sparse.search(self.chunks, queries, "chunk_id", "query_id", k, max(k, 128), body, asked, test, self.postings)

    def grep(self, pattern: str, *, glob: str | None = None, case_sensitive: bool = False) -> DataFrame:
        where = text.matches_any(F.col("file"), [glob]) if glob else None
        return sparse.grep(self.chunks, pattern, F.col("content"), case_sensitive=case_sensitive, where=where)

    def similar(self, vector: Sequence[float], k: int = 10, within: DataFrame | None = None) -> DataFrame:
        """Nearest vectors (chunk_id, vector); with ``within`` only those chunks compete."""
        if self.vectors is None:
            raise ValueError("no dense view")
        if within is not None:
            return dense.search_within(self.vectors, within, vector, k, "vector", "chunk_id")
        return dense.search(self.vectors, vector, k, "vector", "chunk_id").select("chunk_id", "score")

    def hybrid(self, queries: DataFrame, neighbours: DataFrame, k: int = 10, tier: str = "balanced") -> DataFrame:
        """Reciprocal rank fusion of BM25 with given dense results (query_id, chunk_id, rank, score)."""
        most, _ = planner.BUDGETS[planner.tier_of(tier)]
        one = neighbours.select("query_id", F.col("chunk_id").alias("key"), F.lit(0).alias("branch"), "rank", "score")
        two = self.bm25(queries, most).select("query_id", F.col("id").alias("key"), F.lit(1).alias("branch"), "rank", "score")
        return planner.hybrid(one.unionByName(two), k, ["query_id"], tier)

    def plan(self, queries: DataFrame, tier: str = "balanced") -> DataFrame:
        return queries.withColumn("plan", planner.plan_for(F.col("query"), self.views, tier))

    def impact(self, seeds: DataFrame, depth: int = 3, max_nodes: int | None = 100) -> DataFrame:
        return graph.impact(self.edges, seeds, depth, max_nodes)

    def dependencies(self, seeds: DataFrame, depth: int = 3, max_nodes: int | None = 100) -> DataFrame:
        return graph.dependencies(self.edges, seeds, depth, max_nodes)

    def expand(self, seeds: DataFrame, per_seed: int = 5) -> DataFrame:
        return graph.expand_seeds(self.nodes, self.edges, seeds, per_seed)

    def ranked_region(self, seeds: DataFrame, k: int = 50) -> DataFrame:
        """Nodes by personalised PageRank from the seeds, tests left out."""
        ranks = graph.pagerank(self.edges, self.nodes, seeds).join(self.nodes, "vid")
        return ranks.where(~text.is_test_file(F.col("file"))).orderBy(F.col("rank").desc(), "vid").limit(k)

    def definitions(self, points: DataFrame) -> DataFrame:
        return intervals.definitions(points, self.occurrences)

    def references(self, points: DataFrame, include_declaration: bool = True) -> DataFrame:
        return intervals.references(points, self.occurrences, include_declaration)

    def context(self, ranked: DataFrame, k: int = 10, per_file: int = 2) -> DataFrame:
        """Ranked chunks (chunk_id, rank) with their text, spread over files."""
        rows = ranked.join(self.chunks, "chunk_id")
        return fusion.diversify(rows, "file", k, per_file)
