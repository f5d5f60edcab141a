"""Vector retrieval in built-in array functions: flat search, masks, inverted lists, reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    gap = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)


def vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def scored(rows: DataFrame, query: Sequence[float], vec: str, metric: str = "ip") -> DataFrame:
    """Rows with their raw score; what is shown is rounded after ranking, never before."""
    q = vector(query)
    return rows.withColumn("score", dot(F.col(vec), q) if metric == "ip" else squared_l2(F.col(vec), q))


def order(metric: str, tie: str) -> list[Column]:
    return [F.col("score").desc() if metric == "ip" else F.col("score").asc(), F.col(tie).asc()]


def search(rows: DataFrame, query: Sequence[float], k: int, vec: str, tie: str, metric: str = "ip", threshold: float | None = None) -> DataFrame:
    """The k nearest rows; a threshold drops lower inner products or larger distances."""
    out = scored(rows, query, vec, metric)
    if threshold is not None:
        out = out.where(F.col("score") >= threshold if metric == "ip" else F.col("score") <= threshold)
    return out.orderBy(*order(metric, tie)).limit(k)


def with_content(found: DataFrame, contents: DataFrame, key: str) -> DataFrame:
    """Results with their text; a result without one stays."""
    return found.join(contents, key, "left")


def search_within(rows: DataFrame, mask: DataFrame, query: Sequence[float], k: int, vec: str, key: str, metric: str = "ip") -> DataFrame:
    """The mask first: only rows of the mask compete, the best vector of each key counts."""
    held = scored(rows.join(mask.select(key), key, "left_semi"), query, vec, metric)
    best = held.groupBy(key).agg((F.max if metric == "ip" else F.min)("score").alias("score"))
    return best.orderBy(*order(metric, key)).limit(k)


def search_then_mask(rows: DataFrame, mask: DataFrame, query: Sequence[float], k: int, vec: str, key: str, metric: str = "ip") -> DataFrame:
    """The cut first: of the k nearest rows those in the mask, so fewer may stay."""
    return search(rows, query, k, vec, key, metric).join(mask.select(key), key, "left_semi")


def hierarchical(files: DataFrame, rows: DataFrame, query: Sequence[float], k_files: int, k: int, vec: str, file: str, tie: str) -> DataFrame:
    """Rows of the best files: files ranked first, three times as many rows fetched, then kept by file."""
    top_files = search(files, query, k_files, vec, file).select(file)
    return search(rows, query, 3 * k, vec, tie).join(top_files, file, "left_semi").orderBy(*order("ip", tie)).limit(k)


#: Queries are broadcast up to this size; more are searched in several passes.
QUERY_BYTES = 32 << 20


def search_batch(rows: DataFrame, queries: DataFrame, k: int, vec: str, key: str, query_key: str = "query_id", query_vec: str = "vector", skip_self: bool = False) -> DataFrame:
    """query_id, key, score, rank: many queries (query_id, vector) at once by inner product, rows read once a pass.

    A task multiplies a batch of rows with all queries of the pass and hands on the k best of each, so what is shuffled
    grows with tasks and queries, not with their product of rows.
    """
    q = queries.select(F.col(query_key).alias("query_id"), F.col(query_vec).cast("array<double>").alias("q"))
    n, size = q.agg(F.count("*"), F.coalesce(F.sum(F.size("q") * 8 + 8), F.lit(0))).first()
    passes = max(1, -(-size // QUERY_BYTES))
    data = rows.select(F.col(key).alias("key"), F.col(vec).cast("array<double>").alias("v")).where(F.size("v") > 0)
    kind = rows.schema[key].dataType.simpleString()
    schema = f"query_id {queries.schema[query_key].dataType.simpleString()}, key {kind}, score double"
    out = None
    for p in range(passes):
        part = q.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p).collect()  # at most about QUERY_BYTES
        held = rows.sparkSession.sparkContext.broadcast(([r[0] for r in part], [r[1] for r in part]))
        found = data.mapInArrow(partial(_best_of, held=held, k=k, skip_self=skip_self), schema)
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "key"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("key").alias(key), "score", "rank")


def _best_of(batches: Iterator[pa.RecordBatch], held, k: int, skip_self: bool) -> Iterator[pa.RecordBatch]:
    ids, vectors = held.value
    by_size: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        by_size.setdefault(len(v or ()), []).append(i)
    matrices = {n: np.array([vectors[i] for i in at], float) for n, at in by_size.items() if n}
    for batch in batches:
        keys, column = batch.column(0).to_pylist(), batch.column(1)
        sizes = np.diff(column.offsets.to_numpy())
        flat = column.flatten().to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        q_out, k_out, s_out = [], [], []
        for n, m in matrices.items():
            at = np.flatnonzero(sizes == n)
            if not len(at):
                continue
            block = flat[ends[at][:, None] + np.arange(n)]
            # Products are summed in the order of components, as the array functions do.
            scores = np.zeros((len(m), len(at)))
            for c in range(n):
                scores += m[:, c : c + 1] * block[None, :, c]
            for row, i in zip(scores, by_size[n]):
                best = np.lexsort((at, -row))[: k + 1] if len(at) <= 4 * k else _top(row, k + 1)
                # Ties at the cut are kept; the last step settles them by key.
                least = row[best].min() if len(best) else 0.0
                for j in np.flatnonzero(row >= least):
                    name = keys[at[j]]
                    if not (skip_self and name == ids[i]) and np.isfinite(row[j]):
                        q_out.append(ids[i])
                        k_out.append(name)
                        s_out.append(float(row[j]))
        yield pa.RecordBatch.from_arrays([pa.array(q_out, pa.int64() if not q_out or isinstance(q_out[0], int) else None), pa.array(k_out, batch.schema.field(0).type), pa.array(s_out, pa.float64())], ["query_id", "key", "score"])


def _top(row: np.ndarray, k: int) -> np.ndarray:
    return np.argpartition(-row, min(k, len(row) - 1))[:k]


def hashed_embedding(tokens: Column, dim: int = 64) -> Column:
    """An offline stand-in for a text model: counts of tokens by md5 bucket, of unit length."""
    bucket = F.transform(tokens, lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint") % dim).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(bucket, lambda b: b == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(counts, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def rerank_by_content(candidates: DataFrame, embed, query: str, content: str, by: list[str], tie: str, metric: str = "ip", k: int | None = None) -> DataFrame:
    """Candidates by the embedding of their content; ``embed`` maps a text column to a vector column.

    Scores are inner products, or negative distances for l2; rows without content are dropped.
    """
    rows = candidates.where(F.coalesce(F.col(content).rlike(r"\S"), F.lit(False)))
    q, v = embed(F.col(query)), embed(F.col(content))
    score = dot(q, v) if metric == "ip" else -F.sqrt(squared_l2(q, v))
    out = rows.withColumn("score", score)
    out = out.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.col("score").desc(), tie)))
    return out if k is None else out.where(F.col("rank") <= k)


def yes_probability(yes: Column, no: Column) -> Column:
    """The share of yes in a softmax over the two logits of a pairwise scorer."""
    return 1 / (1 + F.exp(no - yes))


def rerank_by_scorer(candidates: DataFrame, scorer, by: list[str], rank: str, content: str = "content", k: int | None = None) -> DataFrame:
    """Candidates by a pluggable scorer (a function from DataFrame to DataFrame that adds ``pair_score``); those without content follow in their old order."""
    has = F.coalesce(F.col(content).rlike(r"\S"), F.lit(False))
    out = scorer(candidates.where(has)).unionByName(candidates.where(~has).withColumn("pair_score", F.lit(None).cast("double")))
    order_ = [F.col("pair_score").isNull(), F.col("pair_score").desc(), rank]
    out = out.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy(*order_))).drop(rank).withColumnRenamed("_rank", rank)
    return out if k is None else out.where(F.col(rank) <= k)


def listwise_windows(ranked: DataFrame, by: list[str], rank: str, size: int, step: int) -> DataFrame:
    """Ranked rows with each window (from 0) they stand in: starts every ``step`` rows, and one at the tail if rows are left."""
    own = W.partitionBy(*by)
    rows = ranked.withColumn("_n", F.count("*").over(own)).withColumn("_i", F.row_number().over(own.orderBy(rank)) - 1)
    # Only the windows that hold the row are listed: at most size / step of the regular ones.
    last = F.greatest(F.col("_n") - size, F.lit(0)).cast("int")
    low = (F.ceil(F.greatest(F.col("_i") - size + 1, F.lit(0)) / step) * step).cast("int")
    high = F.least(F.col("_i"), last).cast("int")
    starts = F.when(low <= high, F.sequence(low, F.greatest(low, high), F.lit(step))).otherwise(F.array().cast("array<int>"))
    tail = F.when((last <= F.col("_i")) & (F.col("_i") < last + size), F.array(last)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("window", F.explode(F.array_distinct(F.concat(starts, tail))))
    return rows.drop("_n", "_i")


def rerank_listwise(ranked: DataFrame, scores: DataFrame, by: list[str], key: str, rank: str, first_score: str) -> DataFrame:
    """by, key, score, rank: items by the mean of their window scores (by, window, key, score); unscored ones follow in their old order with their first score."""
    mean = scores.groupBy(*by, key).agg(F.avg("score").alias("_mean"))
    rows = ranked.join(mean, [*by, key], "left")
    order_ = [F.col("_mean").isNull(), F.col("_mean").desc(), rank]
    return rows.select(*by, key, F.coalesce("_mean", F.col(first_score)).alias("score"), F.row_number().over(W.partitionBy(*by).orderBy(*order_)).alias("rank"))


def fit_centres(rows: DataFrame, n_lists: int, vec: str, key: str, sample: int = 4096, rounds: int = 20) -> list[list[float]]:
    """At most ``n_lists`` centres by k-means on the ``sample`` rows of smallest key hash, however large the table; starts lie far apart, copies count once."""
    held = rows.where(F.col(vec).isNotNull()).orderBy(F.xxhash64(key), key).limit(sample).select(vec).collect()
    points = np.unique(np.array([r[0] for r in held], float), axis=0) if held else np.empty((0, 0))
    if not len(points):
        return []
    chosen = [points[0]]
    gap = ((points - chosen[0]) ** 2).sum(1)
    while len(chosen) < min(n_lists, len(points)):
        chosen.append(points[gap.argmax()])
        gap = np.minimum(gap, ((points - chosen[-1]) ** 2).sum(1))
    centres = np.array(chosen)
    for _ in range(rounds):
        cell = ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)
        moved = np.array([points[cell == i].mean(0) if (cell == i).any() else c for i, c in enumerate(centres)])
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres.tolist()


def inverted_lists(rows: DataFrame, centres: Sequence[Sequence[float]], vec: str) -> DataFrame:
    """Each row with the number of its nearest centre."""
    near = F.array(*[F.struct(squared_l2(F.col(vec), vector(c)).alias("d"), F.lit(i).alias("cell")) for i, c in enumerate(centres)])
    return rows.withColumn("cell", F.array_min(near)["cell"])


def probe(lists: DataFrame, centres: Sequence[Sequence[float]], query: Sequence[float], n_probe: int, k: int, vec: str, tie: str) -> DataFrame:
    """Approximate search: only the lists of the ``n_probe`` centres nearest to the query are read."""
    ranked = sorted(range(len(centres)), key=lambda i: sum((a - b) ** 2 for a, b in zip(centres[i], query)))
    return search(lists.where(F.col("cell").isin(ranked[:n_probe])), query, k, vec, tie)


def probe_until_sure(lists: DataFrame, centres: Sequence[Sequence[float]], query: Sequence[float], n_probe: int, k: int, vec: str, tie: str) -> DataFrame:
    """As ``probe``, then every list that may still hold one of the k largest inner products: recall is 1.

    A row of a list scores at most query . centre + |query| * the list's radius.
    """
    if not centres:
        return search(lists, query, k, vec, tie)
    ranked = sorted(range(len(centres)), key=lambda i: sum((a - b) ** 2 for a, b in zip(centres[i], query)))
    first = [r["score"] for r in search(lists.where(F.col("cell").isin(ranked[:n_probe])), query, k, vec, tie).select("score").collect()]
    least = min(first) if len(first) == k else -math.inf
    own = F.element_at(F.array(*[vector(c) for c in centres]), F.col("cell") + 1)
    radius = {r["cell"]: math.sqrt(r["r"]) for r in lists.where(F.col(vec).isNotNull()).groupBy("cell").agg(F.max(squared_l2(F.col(vec), own)).alias("r")).collect()}
    length = math.sqrt(sum(a * a for a in query))
    most = {i: sum(a * b for a, b in zip(centres[i], query)) + length * r for i, r in radius.items()}
    cells = ranked[:n_probe] + [i for i in ranked[n_probe:] if most.get(i, -math.inf) >= least - 1e-9]
    return search(lists.where(F.col("cell").isin(cells)), query, k, vec, tie)


def rerank_by_index(candidates: DataFrame, rows: DataFrame, query: Sequence[float], vec: str, key: str, rank: str, k: int | None = None) -> DataFrame:
    """Candidates by their indexed vectors; those without one follow in their old order."""
    out = candidates.drop("score").join(scored(rows, query, vec).select(key, "score"), key, "left")
    out = out.withColumn("rank", F.row_number().over(W.orderBy(F.col("score").isNull(), F.col("score").desc(), rank)))
    return out if k is None else out.where(F.col("rank") <= k)
