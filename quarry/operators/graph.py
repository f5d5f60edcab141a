"""Graph operators on node and edge tables: adjacency, traversal, ranking, projections.

Nodes: vid, name, type, file, start_line, end_line.  Edges: src, dst, type,
anchor_file, anchor_line.  Iterations are loops of joins whose state is written
to the checkpoint folder every level, so lineage stays short and a lost
executor costs one level at most.
"""

from __future__ import annotations

import re
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as T

from . import ordered


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the folder that spark.checkpoint.dir names; a local one is set only where all runs on one machine."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint()


def shared_base(spark) -> str:
    """The folder all machines share, without a slash at its end."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = f"file:///tmp/checkpoints/{uuid.uuid4().hex}"
    return base.rstrip("/")


class Rounds:
    """States of an iteration as tables of the shared folder; a state goes when the one after its successor is written."""

    def __init__(self, spark):
        self.spark, self.folder, self.n = spark, f"{shared_base(spark)}/rounds-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.n}"
        df.write.mode("overwrite").parquet(path)
        if self.n >= 2:
            self._drop(f"{self.folder}/{self.n - 2}")
        self.n += 1
        return self.spark.read.schema(df.schema).parquet(path)

    def _drop(self, path: str) -> None:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One row per (src, dst, type, anchor); null anchors are equal."""
    return edges.dropDuplicates(["src", "dst", "type", "anchor_file", "anchor_line"])


def of_types(edges: DataFrame, types: list[str] | None) -> DataFrame:
    return edges.where(F.col("type").isin(types)) if types else edges


#: Edge types of each layer; None takes all.
LAYERS = {"all": None, "containment": ("contain",), "dependency": ("reference", "import", "type_use"), "reference": ("reference",), "import": ("import",), "type_use": ("type_use",)}


def of_layer(edges: DataFrame, layer: str) -> DataFrame:
    key = (layer or "").strip().lower()
    if key not in LAYERS:
        raise ValueError(f"unknown graph layer {layer}; supported: {', '.join(sorted(LAYERS))}")
    return edges if LAYERS[key] is None else edges.where(F.col("type").isin(*LAYERS[key]))


def selected(nodes: DataFrame, edges: DataFrame, paths: DataFrame, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, report): what belongs to the chosen paths (column ``path``), and the counts before and after."""
    kept = nodes.join(paths.select(path).distinct(), path, "left_semi")
    inner = induced(edges, kept)
    count = lambda df: df.agg(F.count("*")).scalar()
    report = nodes.sparkSession.range(1).select(count(nodes).alias("nodes_before"), count(kept).alias("nodes_after"), count(edges).alias("edges_before"), count(inner).alias("edges_after"))
    return kept, inner, report


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """Edges to walk along: forward, backward or both."""
    pairs = edges.select("src", "dst")
    if direction == "forward":
        return pairs
    back = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return back if direction == "backward" else pairs.union(back)


def successors(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, types: list[str] | None = None) -> DataFrame:
    """seed, vid of direct successors; with types each pair once, without them once per edge."""
    hop = seeds.select(F.col("vid").alias("src")).join(of_types(edges, types).select("src", "dst"), "src")
    out = hop.select(F.col("src").alias("seed"), F.col("dst").alias("vid"))
    out = out.distinct() if types else out
    return out.join(nodes.select("vid"), "vid").select("seed", "vid")


def predecessors(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, types: list[str] | None = None) -> DataFrame:
    return successors(nodes, reversed_edges(edges), seeds, types)


def bfs(edges: DataFrame, seeds: DataFrame, direction: str, depth: int) -> DataFrame:
    """vid, depth: everything reachable within ``depth`` steps, seeds at 0."""
    walk = directed(edges, direction).distinct()
    seen = checkpointed(seeds.select("vid", F.lit(0).alias("depth")).distinct())
    edge = seen
    for level in range(1, depth + 1):
        nxt = edge.select(F.col("vid").alias("src")).join(walk, "src").select(F.col("dst").alias("vid")).distinct()
        edge = checkpointed(nxt.join(seen, "vid", "left_anti").select("vid", F.lit(level).alias("depth")))
        if edge.isEmpty():
            break
        seen = checkpointed(seen.unionByName(edge))
    return seen


def impact(edges: DataFrame, seeds: DataFrame, depth: int = 3, max_nodes: int | None = None, type_: str = "reference", max_edges: int | None = None) -> DataFrame:
    """Who depends on the seeds, by distance; caps take smaller ids first."""
    return _capped(bounded(of_types(edges, [type_]), seeds, "backward", depth, max_edges), max_nodes)


def dependencies(edges: DataFrame, seeds: DataFrame, depth: int = 3, max_nodes: int | None = None, type_: str = "reference", max_edges: int | None = None) -> DataFrame:
    return _capped(bounded(of_types(edges, [type_]), seeds, "forward", depth, max_edges), max_nodes)


def neighborhood(edges: DataFrame, seeds: DataFrame, radius: int = 1, max_nodes: int | None = None, max_edges: int | None = None) -> DataFrame:
    return _capped(bounded(edges, seeds, "both", radius, max_edges), max_nodes)


def bounded(edges: DataFrame, seeds: DataFrame, direction: str, depth: int, max_edges: int | None) -> DataFrame:
    """``bfs`` that follows at most ``max_edges`` distinct edges, level by level in the order of the ids they join."""
    if max_edges is None:
        return bfs(edges, seeds, direction, depth)
    walk = directed(edges, direction).distinct()
    seen = checkpointed(seeds.select("vid", F.lit(0).alias("depth")).distinct())
    edge, left = seen, max(1, max_edges)
    for level in range(1, depth + 1):
        hop = checkpointed(edge.select(F.col("vid").alias("src")).join(walk, "src").orderBy("src", "dst").limit(left))
        left -= hop.count()
        edge = checkpointed(hop.select(F.col("dst").alias("vid")).distinct().join(seen, "vid", "left_anti").select("vid", F.lit(level).alias("depth")))
        if edge.isEmpty():
            break
        seen = checkpointed(seen.unionByName(edge))
        if left <= 0:
            break
    return seen


def _capped(reached: DataFrame, max_nodes: int | None) -> DataFrame:
    out = reached.where("depth > 0")
    return out if max_nodes is None else out.orderBy("depth", "vid").limit(max_nodes)


def region(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int = 2, types: list[str] | None = None, direction: str = "both", keep: Column | None = None) -> DataFrame:
    """Nodes within ``hops`` of any seed, by one search from all of them, with their distance.

    A search from seeds in turn that shares what it has seen reaches no node later than this one and may miss some.
    ``keep`` filters what is returned, not what is walked.
    """
    reached = bfs(of_types(edges, types), seeds.join(nodes.select("vid"), "vid", "left_semi"), direction, max(1, hops))
    out = nodes.join(reached, "vid")
    return out if keep is None else out.where(keep)


def usable_nodes(tests: bool = True) -> Column:
    """Nodes a region returns: lines known, more than one of them, and no test file."""
    spanned = F.col("start_line").isNotNull() & F.col("end_line").isNotNull() & (F.col("start_line") != F.col("end_line"))
    return spanned & ~T.is_test_file(F.coalesce("file", F.lit(""))) if tests else spanned


def ranked_region(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, k: int = 50, tests: bool = True, rounds: int = 20) -> DataFrame:
    """The k usable nodes of highest personalised PageRank from the seeds, over all edges."""
    ranks = pagerank(edges, nodes, seeds, rounds=rounds)
    return nodes.join(ranks, "vid").where(usable_nodes(tests)).orderBy(F.round("rank", 12).desc(), "vid").limit(k)


def expand_region(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, k: int = 50, hops: int = 2, direction: str = "both", use_ppr: bool = False) -> DataFrame:
    """vid, rank: a region around ranked seeds (vid, rank, score), by ranks or by hops; where it is empty, one-hop neighbours."""
    if use_ppr:
        rows = ranked_region(nodes, edges, seeds, k).select("vid", F.row_number().over(W.orderBy(F.round("rank", 12).desc(), "vid")).alias("rank"))
    else:
        rows = region(nodes, edges, seeds, hops, direction=direction, keep=usable_nodes()).orderBy("vid").limit(k)
        rows = rows.select("vid", F.row_number().over(W.orderBy("vid")).alias("rank"))
    rows = checkpointed(rows)
    if not rows.isEmpty():
        return rows
    n = max(1, seeds.count())
    near = expand_seeds(nodes, edges, seeds, max(1, k // n), direction=direction)
    return near.select("vid", F.row_number().over(W.orderBy("seed_rank", "n")).alias("rank")).where(F.col("rank") <= k)


def expand_candidates(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, seed_k: int | None, k: int, **options) -> DataFrame:
    """vid, source, rank: the first seeds, then what they expand to, each node once, at most k."""
    if k <= 0:
        raise ValueError("k must be positive")
    first = seeds if seed_k is None else seeds.where(F.col("rank") <= seed_k)
    more = expand_region(nodes, edges, first, k, **options)
    both = first.select("vid", F.lit(0).alias("tier"), "rank").unionByName(more.select("vid", F.lit(1).alias("tier"), "rank"))
    best = both.groupBy("vid").agg(F.min(F.struct("tier", "rank")).alias("r"))
    out = best.select("vid", F.when(F.col("r.tier") == 0, "seed").otherwise("expanded").alias("source"), F.row_number().over(W.orderBy("r", "vid")).alias("rank"))
    return out.where(F.col("rank") <= k)


def callers_and_callees(nodes: DataFrame, edges: DataFrame, asked: DataFrame, relation: str = "both", k: int = 40) -> DataFrame:
    """symbol, status, relation, vid, rank: neighbours of a symbol with one match; others get one row that says so.

    ``asked`` has symbol, vid and candidates, as a lookup gives them; callees come before callers.
    """
    if relation not in ("callers", "callees", "both"):
        raise ValueError("relation must be callers, callees or both")
    n = asked.select("symbol", "vid", F.coalesce("candidates", F.lit(0)).alias("candidates")).distinct()
    one = n.where("candidates = 1")
    pairs = edges.select("src", "dst")
    out = one.join(pairs, F.col("vid") == F.col("src")).select("symbol", F.lit("callee").alias("relation"), F.col("dst").alias("vid"))
    into = one.join(pairs, F.col("vid") == F.col("dst")).select("symbol", F.lit("caller").alias("relation"), F.col("src").alias("vid"))
    rows = out if relation == "callees" else into if relation == "callers" else out.unionByName(into)
    rows = rows.join(nodes.select("vid"), "vid", "left_semi").withColumn("rank", F.row_number().over(W.partitionBy("symbol").orderBy("relation", "vid"))).where(F.col("rank") <= k)
    rest = n.where("candidates <> 1").select("symbol", F.when(F.col("candidates") == 0, "not found").otherwise("ambiguous").alias("status")).distinct()
    rest = rest.select("symbol", "status", F.lit(None).cast("string").alias("relation"), F.lit(None).cast("bigint").alias("vid"), F.lit(0).alias("rank"))
    return rows.select("symbol", F.lit("found").alias("status"), "relation", "vid", "rank").unionByName(rest)


def trace(edges: DataFrame, start: int, goal: int, max_hops: int = 10) -> DataFrame:
    """hop, vid along the shortest way over all edges; no rows if it is longer than ``max_hops``."""
    path = shortest_path(edges, start, goal, max_hops)
    return path.select(F.posexplode("path").alias("hop", "vid"))


def tree_rows(nodes: DataFrame, edges: DataFrame, root: int, direction: str = "downstream", hops: int = 2, node_types: list[str] | None = None, edge_types: list[str] | None = None) -> DataFrame:
    """vid, level, parent, relation, key: a tree of relations from a root, containment before others; ``key`` orders its lines.

    A node is opened where it is first met, level by level, and shown again without what is below it.  Tests and other
    types are left out; -1 hops means 20.
    """
    hops = 20 if hops == -1 else hops
    kept = nodes.where(~T.is_test_file(F.coalesce("name", F.lit(""))))
    kept = kept if node_types is None else kept.where(F.col("type").isin(node_types))
    e = of_types(edges, edge_types).select("src", "dst", "type").distinct()
    steps = []
    if direction in ("downstream", "both"):
        steps.append(e.select(F.col("src").alias("from"), F.col("dst").alias("to"), "type", F.lit(0).alias("up")))
    if direction in ("upstream", "both"):
        steps.append(e.select(F.col("dst").alias("from"), F.col("src").alias("to"), F.concat("type", F.lit("-by")).alias("type"), F.lit(1).alias("up")))
    walk = steps[0] if len(steps) == 1 else steps[0].unionByName(steps[1])
    walk = checkpointed(walk.join(kept.select(F.col("vid").alias("to")), "to", "left_semi"))
    none = F.lit(None).cast("bigint")
    spark = nodes.sparkSession
    out = spark.range(1).select(F.lit(root).cast("bigint").alias("vid"), F.lit(0).alias("level"), none.alias("parent"), F.lit("").alias("relation"), F.array(F.lit(0)).alias("key"), F.lit(-1).alias("up"))
    out = checkpointed(out)
    edge = out
    for level in range(1, hops + 1):
        hop = edge.select(F.col("vid").alias("from"), F.col("key").alias("_key"), F.col("up").alias("_up")).join(walk, "from").where((F.col("_up") == -1) | (F.col("_up") == F.col("up")))
        place = F.row_number().over(W.partitionBy("_key").orderBy(~F.col("type").startswith("contain"), "up", "type", "to"))
        rows = hop.select(F.col("to").alias("vid"), F.lit(level).alias("level"), F.col("from").alias("parent"), F.col("type").alias("relation"), F.concat("_key", F.array(place)).alias("key"), "up")
        rows = checkpointed(rows)
        opened = out.select("vid").distinct()
        out = checkpointed(out.unionByName(rows))
        # Only the first line of a node that was not shown before is opened.
        first = F.row_number().over(W.partitionBy("vid").orderBy("key"))
        edge = checkpointed(rows.join(opened, "vid", "left_anti").withColumn("_n", first).where("_n = 1").drop("_n"))
        if edge.isEmpty():
            break
    return out.drop("up")


def files_touched(reached: DataFrame, nodes: DataFrame) -> DataFrame:
    return reached.join(nodes.select("vid", "file"), "vid").where(F.col("file").isNotNull()).groupBy("file").agg(F.min("depth").alias("depth"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("vid")
    return edges.join(ids.withColumnRenamed("vid", "src"), "src", "left_semi").join(ids.withColumnRenamed("vid", "dst"), "dst", "left_semi")


def shortest_path(edges: DataFrame, start: int, goal: int, max_hops: int = 10) -> DataFrame:
    """One row with the path, the smallest in id order among the shortest; none if longer than ``max_hops``."""
    walk = edges.select("src", "dst").distinct()
    spark = edges.sparkSession
    paths = spark.createDataFrame([(start, [start])], "vid bigint, path array<bigint>")
    seen = paths
    for _ in range(max_hops):
        if not paths.where(F.col("vid") == goal).isEmpty():
            break
        nxt = paths.withColumnRenamed("vid", "src").join(walk, "src").select(F.col("dst").alias("vid"), F.concat("path", F.array("dst")).alias("path"))
        nxt = nxt.groupBy("vid").agg(F.min("path").alias("path")).join(seen, "vid", "left_anti")
        paths = checkpointed(nxt)
        if paths.isEmpty():
            break
        seen = checkpointed(seen.unionByName(paths))
    return seen.where(F.col("vid") == goal).select("path", (F.size("path") - 1).alias("hops"))


def expand_seeds(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, per_seed: int = 5, keep: Column | None = None, direction: str = "both") -> DataFrame:
    """Neighbours of ranked seeds (vid, rank, score), successors and predecessors in turn, capped after the filter; half the seed's score.

    ``direction`` forward or backward takes one side alone.
    """
    s = seeds.select(F.col("vid").alias("seed"), F.col("rank").alias("seed_rank"), F.col("score").alias("seed_score"))
    out = None
    for side, way in ((0, "forward"), (1, "backward")):
        if direction not in ("both", way):
            continue
        hop = s.join(directed(edges, way).distinct(), F.col("seed") == F.col("src")).select("seed", "seed_rank", "seed_score", F.col("dst").alias("vid"), F.lit(side).alias("side"))
        hop = hop.join(nodes, "vid")
        hop = hop if keep is None else hop.where(keep)
        hop = hop.withColumn("nth", F.row_number().over(W.partitionBy("seed").orderBy("vid")))
        out = hop if out is None else out.unionByName(hop)
    out = out.withColumn("n", F.row_number().over(W.partitionBy("seed").orderBy("nth", "side"))).where(F.col("n") <= per_seed)
    return out.select("seed", "seed_rank", "n", "vid", (F.col("seed_score") * 0.5).alias("score"))


def range_query(nodes: DataFrame, edges: DataFrame, file: str, first: int, last: int) -> DataFrame:
    """What a line range touches: nodes in it, edges anchored in it, and edges into its nodes from elsewhere."""
    inside = nodes.where((F.col("file") == file) & (F.col("start_line") <= last) & (F.col("end_line") >= first)).select("vid")
    out = edges.where((F.col("anchor_file") == file) & F.col("anchor_line").between(first, last)).select(F.lit("outgoing").alias("kind"), "src", "dst", "anchor_line")
    into = edges.join(inside.withColumnRenamed("vid", "dst"), "dst", "left_semi").where("src <> dst").select(F.lit("incoming").alias("kind"), "src", "dst", "anchor_line")
    own = inside.select(F.lit("node").alias("kind"), F.col("vid").alias("src"), F.col("vid").alias("dst"), F.lit(None).cast(edges.schema["anchor_line"].dataType).alias("anchor_line"))
    return own.unionByName(out).unionByName(into)


def pagerank(edges: DataFrame, nodes: DataFrame, seeds: DataFrame | None = None, damping: float = 0.85, rounds: int = 20, weight: str | None = None) -> DataFrame:
    """vid, rank by a fixed number of power iterations; parallel edges count, dangling mass goes to the restart set.

    The restart is uniform over the seeds, over all nodes without seeds.  ``weight`` names a column that weighs edges.
    From few seeds the first WALKED iterations follow walks of each length (``_walked``); where all walks end before, that
    is the whole result.  Any other round is one aggregation by target; the dangling mass is a scalar subquery over its ranks.
    """
    spark = edges.sparkSession
    ids = nodes.select("vid").distinct()
    restart = ids if seeds is None else seeds.select("vid").distinct().join(ids, "vid", "left_semi")
    links = edges.select("src", "dst", (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w"))
    # By source last: the sums below need no further shuffle.
    links = links.join(ids.withColumnRenamed("vid", "dst"), "dst", "left_semi").join(ids.withColumnRenamed("vid", "src"), "src", "left_semi")
    pairs = links.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    total = pairs.groupBy("src").agg(F.sum("w").alias("total"))  # a hub's edges are summed map-side, never windowed
    weights = Rounds(spark).put(pairs.join(total, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")))
    n = restart.count()
    start = restart.select("vid", F.lit(1.0 / max(n, 1)).alias("rank"))
    done, rank = 0, start
    if n * FEW < ids.count():
        done, rank = _walked(weights, start, damping, rounds)
    if done == rounds:
        return ids.join(rank, "vid", "left").select("vid", F.coalesce("rank", F.lit(0.0)).alias("rank"))
    base = ids.join(start.withColumnRenamed("rank", "restart"), "vid", "left").select("vid", F.coalesce("restart", F.lit(0.0)).alias("restart"))
    base = base.join(weights.select(F.col("src").alias("vid")).distinct().withColumn("has", F.lit(True)), "vid", "left")
    rank = base.join(rank, "vid", "left").select("vid", "restart", F.coalesce("has", F.lit(False)).alias("has"), F.coalesce("rank", F.lit(0.0)).alias("rank"))
    rounds_ = Rounds(spark)
    rank = rounds_.put(rank)
    # Kept where the join needs them: rounds shuffle ranks and sums, not the edges.
    weights = weights.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "src").persist(StorageLevel.DISK_ONLY)
    for _ in range(done, rounds):
        lost = rank.where(~F.col("has")).agg(F.coalesce(F.sum("rank"), F.lit(0.0))).scalar()
        got = rank.join(weights, F.col("vid") == F.col("src")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = (1 - damping) * F.col("restart") + damping * (F.coalesce("got", F.lit(0.0)) + lost * F.col("restart"))
        rank = rounds_.put(rank.drop("rank").join(got, F.col("vid") == F.col("dst"), "left").select("vid", "restart", "has", new.alias("rank")))
    weights.unpersist()
    return rank.select("vid", "rank")


#: Walks of each length are followed where less than one node of FEW is a seed, up to WALKED steps.
FEW, WALKED = 16, 8


def _walked(weights: DataFrame, start: DataFrame, damping: float, rounds: int) -> tuple[int, DataFrame]:
    """(iterations done, their ranks): u(k) is the damped mass of walks of k steps from the restart, u(k + 1) = damping * A u(k).

    An iteration is x(t + 1) = c(t) u(0) + damping * A x(t), c(t) = 1 - damping + damping * (mass of x(t) that dangles).  So
    x(t) = u(t) + sum of c(t - 1 - k) u(k) over k < t, and what dangles of u(k) is its mass less that of u(k + 1) / damping.
    A walk's step reads the edges of its nodes only, and no step is left once u is empty: then all iterations are done.
    """
    spark = start.sparkSession
    mass = lambda df: df.agg(F.sum("rank").alias("m")).first()["m"] or 0.0
    walks = [Rounds(spark).put(start)]
    masses = [mass(walks[0])]
    while len(walks) <= min(rounds, WALKED) and masses[-1] > 0:
        step = walks[-1].join(weights, F.col("vid") == F.col("src")).groupBy(F.col("dst").alias("vid")).agg((damping * F.sum(F.col("rank") * F.col("share"))).alias("rank"))
        walks.append(Rounds(spark).put(step))
        masses.append(mass(walks[-1]))
    ended = masses[-1] == 0
    t = rounds if ended else len(walks) - 1
    dangles = [max(m - after / damping, 0.0) for m, after in zip(masses, masses[1:])]
    dangles += [0.0] * (t - len(dangles))
    c = []
    for at in range(t):
        c.append(1 - damping + damping * (dangles[at] + sum(c[at - 1 - k] * dangles[k] for k in range(at))))
    out = None
    for k, walk in enumerate(walks):
        part = walk.select("vid", (F.lit(c[t - 1 - k] if k < t else 1.0) * F.col("rank")).alias("rank")) if k <= t else None
        out = part if out is None else out if part is None else out.unionByName(part)
    return t, out.groupBy("vid").agg(F.sum("rank").alias("rank"))


def project_modules(nodes: DataFrame, edges: DataFrame, module: str, anchors: int = 12) -> DataFrame:
    """Module edges from symbol edges: weight is the number of distinct symbol pairs, with up to ``anchors`` places; loops are dropped.

    An edge's places are the smallest of the smallest of its symbol pairs, so no pair of modules gathers all of them.
    """
    m = nodes.select("vid", F.col(module).alias("m"))
    pairs = edges.where("type = 'reference'").join(m.select(F.col("vid").alias("src"), F.col("m").alias("source")), "src").join(m.select(F.col("vid").alias("dst"), F.col("m").alias("target")), "dst")
    pairs = pairs.where("source <> target").groupBy("source", "target", "src", "dst").agg(F.count("*").alias("n"), F.min("anchor_line").alias("anchor"))
    places = edges.where("type = 'reference' AND anchor_file IS NOT NULL").join(m.select(F.col("vid").alias("src"), F.col("m").alias("source")), "src").join(m.select(F.col("vid").alias("dst"), F.col("m").alias("target")), "dst")
    places = places.where("source <> target").select("source", "target", F.struct(F.col("anchor_file").alias("file"), (F.col("anchor_line") + 1).cast("bigint").alias("line")).alias("place")).distinct()
    nth = F.row_number().over(W.partitionBy("source", "target").orderBy("place"))
    places = places.withColumn("_n", nth).where(F.col("_n") <= anchors).groupBy("source", "target").agg(F.array_sort(F.collect_list("place")).alias("anchors"))
    out = pairs.groupBy("source", "target").agg(F.count("*").alias("weight"), F.min("anchor").alias("first_anchor"), F.sum("n").alias("references"))
    return out.join(places, ["source", "target"], "left")


def focus_modules(projection: DataFrame, focus: str, depth: int = 2, max_nodes: int = 60) -> DataFrame:
    """module, hops, place: modules around a focus, level by level, from each module its strongest neighbours first."""
    both = projection.select(F.col("source").alias("a"), F.col("target").alias("b"), "weight").unionByName(projection.select(F.col("target").alias("a"), F.col("source").alias("b"), "weight"))
    ties = checkpointed(both.groupBy("a", "b").agg(F.sum("weight").alias("w")))
    seen = checkpointed(projection.sparkSession.range(1).select(F.lit(focus).alias("module"), F.lit(0).alias("hops"), F.lit(1).cast("bigint").alias("place")))
    edge = seen
    for level in range(1, depth + 1):
        hop = edge.select(F.col("module").alias("a"), F.col("place").alias("_from")).join(ties, "a").join(seen.select(F.col("module").alias("b")), "b", "left_anti")
        first = hop.groupBy("b").agg(F.min(F.struct("_from", (-F.col("w")).alias("w"))).alias("r"))
        have = seen.agg(F.count("*")).scalar()
        new = first.select(F.col("b").alias("module"), F.lit(level).alias("hops"), (F.row_number().over(W.orderBy("r", "b")) + have).cast("bigint").alias("place")).where(F.col("place") <= max_nodes)
        edge = checkpointed(new)
        if edge.isEmpty():
            break
        seen = checkpointed(seen.unionByName(edge))
    return seen


def module_hops(projection: DataFrame, root: str) -> DataFrame:
    """module, hops: distance from a module over the projection's edges, whichever way they point."""
    e = projection.select(F.col("source").alias("src"), F.col("target").alias("dst"))
    seeds = projection.sparkSession.range(1).select(F.lit(root).alias("vid"))
    return bfs(e, seeds, "both", 64).select(F.col("vid").alias("module"), F.col("depth").alias("hops"))


def module_degree(projection: DataFrame) -> DataFrame:
    ends = projection.select(F.col("source").alias("module"), "weight").union(projection.select(F.col("target").alias("module"), "weight"))
    return ends.groupBy("module").agg(F.sum("weight").alias("degree"))


def rank_percentile(scores: DataFrame, score: str, tie: str) -> DataFrame:
    """(place from 0) / (n - 1), to four places; 1 for a single row."""
    n = scores.agg(F.count("*")).scalar()
    rows = ordered.places(scores, score, tie, "_place")
    return rows.withColumn("percentile", F.when(n > 1, F.round(F.col("_place") / (n - 1), 4)).otherwise(1.0)).drop("_place")


def layer_summary(edges: DataFrame) -> DataFrame:
    ends = edges.select("type", F.explode(F.array("src", "dst")).alias("vid")).groupBy("type").agg(F.countDistinct("vid").alias("nodes"))
    return edges.groupBy("type").agg(F.count("*").alias("edges")).join(ends, "type")


def resolve(nodes: DataFrame, asked: DataFrame, limit: int | None = None) -> DataFrame:
    """asked symbols -> nodes: exact name, then with ``()``, then the bare name; the best tier only, with its number of candidates.

    ``nodes`` has vid, name, bare; ``asked`` has symbol.
    """
    tiers = [("name", F.col("symbol")), ("name", F.concat("symbol", F.lit("()"))), ("bare", F.col("symbol"))]
    out = None
    for tier, (column, value) in enumerate(tiers):
        hit = asked.withColumn("_k", value).join(nodes.select("vid", F.col(column).alias("_k")), "_k").select("symbol", "vid", F.lit(tier).alias("tier"))
        out = hit if out is None else out.unionByName(hit)
    own = W.partitionBy("symbol")
    out = out.withColumn("best", F.min("tier").over(own)).where("tier = best").select("symbol", "vid", "tier").distinct()
    out = out.withColumn("candidates", F.count("*").over(own)).withColumn("rank", F.row_number().over(own.orderBy("vid")))
    return out if limit is None else out.where(F.col("rank") <= limit)


def display_labels(nodes: DataFrame, label: str, canonical: str) -> DataFrame:
    """A label where it is unique, the canonical name where it is not."""
    many = F.count("*").over(W.partitionBy(label)) > 1
    return nodes.withColumn("display", F.when(many, F.col(canonical)).otherwise(F.col(label)))


def label_communities(edges: DataFrame, nodes: DataFrame, rounds: int = 5) -> DataFrame:
    """vid, community by synchronous label propagation: the commonest neighbour label, the smallest among equals."""
    walk = checkpointed(directed(edges, "both").where("src <> dst"))
    labels = nodes.select("vid", F.col("vid").alias("community"))
    for _ in range(rounds):
        votes = walk.join(labels, F.col("dst") == F.col("vid")).groupBy("src", "community").agg(F.count("*").alias("n"))
        best = votes.groupBy("src").agg(F.max(F.struct("n", (-F.col("community")).alias("low"))).alias("b")).select(F.col("src").alias("vid"), (-F.col("b.low")).alias("new"))
        labels = checkpointed(labels.join(best, "vid", "left").select("vid", F.coalesce("new", "community").alias("community")))
    return labels


def ancestors(parents: DataFrame, depth: int = 16) -> DataFrame:
    """vid, ancestor, distance for a (vid, parent) table; a cycle ends at ``depth``."""
    hop = parents.where(F.col("parent").isNotNull()).select("vid", F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
    out, edge = hop, hop
    up = parents.select(F.col("vid").alias("ancestor"), F.col("parent").alias("_up")).where(F.col("_up").isNotNull())
    for d in range(2, depth + 1):
        edge = checkpointed(edge.join(up, "ancestor").select("vid", F.col("_up").alias("ancestor"), F.lit(d).alias("distance")))
        if edge.isEmpty():
            break
        out = out.unionByName(edge)
    return out.groupBy("vid", "ancestor").agg(F.min("distance").alias("distance"))
