"""A kept view of vectors by cell, read by the cells that a batch of queries needs.

``build`` fits centres on a bounded sample (``dense.fit_centres``) and writes, below one folder,

* ``cells``: cell, centre, radius (the largest distance of one of its vectors to the centre), n: at most MOST_CELLS rows;
* ``blocks``: the vectors, BLOCK at most a row with their keys, one folder a cell, so that a search prunes by it.

``search`` asks the ``n_probe`` cells with the nearest centres first, then every further cell whose radius lets it hold
a vector that beats a query's k-th: a vector of a cell scores at most query . centre + |query| * radius.  So the rows
are those of a scan, and what is read depends on how well the cells part the vectors.

A large cell is cut by hash of key and source partition, so neither it nor the copies of one key meet in a task.

Defined cases: vectors null, empty or with null or non-finite components are in no cell and ask nothing; a vector of
another length than the centres raises an error; keys may repeat and each row counts; query ids are distinct; ties go
to the smaller key; an empty table gives a view that finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry import shipping

from . import dense
from .graph import checkpointed

#: Centres at most; with their vectors they are held by the driver and broadcast.
MOST_CELLS = 1024
#: Rows of which centres are fitted, at most.
SAMPLE = 16_384
#: Vectors of one packed row, of one writing task, and queries of one block.
BLOCK, TASK_ROWS, ASKED = 128, 65_536, 128
#: Probes up to this size are broadcast; larger ones meet the blocks by a shuffle on the cell.
PROBE_BYTES = 32 << 20

_CELLS = "cell int, centre array<double>, radius double, n bigint"


@dataclass(frozen=True)
class View:
    cells: DataFrame
    blocks: DataFrame
    key_type: T.DataType


def usable(vec: Column) -> Column:
    """Vectors that take part: no null, at least one component, all finite."""
    return vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))


def build(rows: DataFrame, key: str, vec: str, folder: str, n_cells: int | None = None) -> View:
    """Write the view of ``rows`` below ``folder``; about a quarter of the root of the rows is the number of cells."""
    spark = rows.sparkSession
    shipping.attach(spark)
    data = rows.select(F.col(key).alias("key"), F.col(vec).cast("array<double>").alias("v"))
    data = data.where(usable(F.col("v")))
    if n_cells is None:
        n_cells = max(1, int(data.count() ** 0.5) // 4)
    centres = dense.fit_centres(data, min(n_cells, MOST_CELLS), "v", "key", SAMPLE)
    held = spark.sparkContext.broadcast(np.array(centres, float))
    assigned = data.mapInArrow(partial(_assigned, held=held), T.StructType([*data.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("gap", T.DoubleType())]))
    stats = assigned.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("gap")).collect() if centres else []
    cells = spark.createDataFrame([(r["cell"], centres[r["cell"]], float(r["gap"]) ** 0.5, r["n"]) for r in stats], _CELLS)
    cells.coalesce(1).write.mode("overwrite").parquet(f"{folder}/cells")
    splits = spark.createDataFrame([(r["cell"], -(-r["n"] // TASK_ROWS)) for r in stats], "cell int, splits bigint")
    # The source partition spreads copies of one key; it is the same in every run of a task.
    split = F.pmod(F.xxhash64("key") + F.spark_partition_id(), F.col("splits"))
    parts = max(1, sum(-(-r["n"] // TASK_ROWS) for r in stats))
    placed = assigned.drop("gap").join(F.broadcast(splits), "cell").withColumn("split", split).repartition(parts, "cell", "split")
    packed = placed.sortWithinPartitions("cell").select("cell", "key", "v").mapInArrow(_packed, _block_schema(data.schema["key"].dataType))
    packed.write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/blocks")
    return load(spark, folder, data.schema["key"].dataType)


def load(spark: SparkSession, folder: str, key_type: T.DataType | None = None) -> View:
    """The view that ``build`` wrote; ``key_type`` is bigint unless given."""
    key_type = key_type or T.LongType()
    blocks = spark.read.schema(_block_schema(key_type)).parquet(f"{folder}/blocks")
    return View(spark.read.schema(_CELLS).parquet(f"{folder}/cells"), blocks, key_type)


def _block_schema(key_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("keys", T.ArrayType(key_type)), T.StructField("vectors", T.ArrayType(T.DoubleType())), T.StructField("cell", T.IntegerType())])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(column) and set(np.diff(column.offsets.to_numpy())) != {width}:
        raise ValueError(f"vectors of another length than {width}")
    return flat.reshape(len(column), width)


def _gaps(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, a row a point."""
    out = np.zeros((len(points), len(centres)))
    for c in range(points.shape[1]):
        out += (points[:, c : c + 1] - centres[None, :, c]) ** 2
    return out


def _assigned(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    centres = held.value
    for batch in batches:
        gaps = _gaps(_matrix(batch.column(1), centres.shape[1]), centres)
        cell = gaps.argmin(1).astype(np.int32) if len(gaps) else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(gaps[np.arange(len(cell)), cell])], ["key", "v", "cell", "gap"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one cell as rows of BLOCK vectors; a batch's runs end with it."""
    for batch in batches:
        cell = batch.column(0).to_numpy()
        edge = np.flatnonzero(np.diff(cell)) + 1
        starts = [s for a, b in zip([0, *edge], [*edge, len(cell)]) for s in range(a, b, BLOCK)]
        ends = np.array([*starts, len(cell)], dtype=np.int32)
        keys, vectors = batch.column(1), batch.column(2)
        keys = pa.ListArray.from_arrays(pa.array(ends), keys)
        at = vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
        vectors = pa.ListArray.from_arrays(pa.array(at[ends].astype(np.int32)), vectors.flatten())
        yield pa.RecordBatch.from_arrays([keys, vectors, pa.array(cell[ends[:-1]])], ["keys", "vectors", "cell"])


def _probed(batches: Iterator[pa.RecordBatch], held, n_probe: int, further: bool) -> Iterator[pa.RecordBatch]:
    """query_id, q, cell: the nearest cells of each query, or those beyond that may hold what reaches ``floor``."""
    ids, centres, radii = held.value
    for batch in batches:
        points = _matrix(batch.column(1), centres.shape[1])
        order = _gaps(points, centres).argsort(1, kind="stable")
        near = np.zeros((len(points), len(centres)), bool)
        np.put_along_axis(near, order[:, :n_probe], True, 1)
        if further:
            most = points @ centres.T + np.sqrt((points**2).sum(1))[:, None] * radii[None]
            floor = batch.column(2).to_numpy(zero_copy_only=False)[:, None]
            near = ~near & (most + 1e-9 * (1 + np.abs(most)) >= floor)
        row, cell = np.nonzero(near)
        taken = pa.array(row)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), pa.array(ids[cell])], ["query_id", "q", "cell"])


def _multiplied(batches: Iterator[pa.RecordBatch], k: int, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, flat, asked = batch.column(0), batch.column(1), batch.column(2)
        q_out, k_out, s_out = [], [], []
        for i in range(batch.num_rows):
            block = flat[i].values.to_numpy(zero_copy_only=False).reshape(-1, width)
            queries = asked[i].values
            names, points = queries.field(0), _matrix(queries.field(1), width)
            scores = np.zeros((len(points), len(block)))
            for c in range(width):  # in the order of components, as the array functions sum
                scores += points[:, c : c + 1] * block[None, :, c]
            if len(block) > k:
                # What equals the k-th stays; the last step settles ties by key.
                least = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
                q, at = np.nonzero(scores >= least[:, None])
            else:
                q, at = (x.reshape(-1) for x in np.indices(scores.shape))
            q_out.append(names.take(pa.array(q)))
            k_out.append(keys[i].values.take(pa.array(at)))
            s_out.append(pa.array(scores[q, at]))
        if q_out:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in (q_out, k_out, s_out)], ["query_id", "key", "score"])


def _best(view: View, probes: DataFrame, n: int, n_probe: int, width: int, k: int) -> DataFrame:
    """The k best rows of each query within the cells it asks; only those cells are read."""
    cells = sorted(r[0] for r in probes.select("cell").distinct().collect())  # at most MOST_CELLS
    block = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n // ASKED))))
    asked = probes.groupBy("cell", block.alias("_block")).agg(F.collect_list(F.struct("query_id", "q")).alias("asked")).drop("_block")
    if n * n_probe * (8 * width + 16) <= PROBE_BYTES:
        asked = F.broadcast(asked)
    pairs = view.blocks.where(F.col("cell").isin(cells)).join(asked, "cell").select("keys", "vectors", "asked")
    schema = T.StructType([T.StructField("query_id", probes.schema["query_id"].dataType), T.StructField("key", view.key_type), T.StructField("score", T.DoubleType())])
    found = pairs.mapInArrow(partial(_multiplied, k=k, width=width), schema)
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "key"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(view: View, queries: DataFrame, k: int, query_key: str = "query_id", query_vec: str = "vector", n_probe: int = 3) -> DataFrame:
    """query_id, key, score, rank: the min(k, n) largest inner products of each query."""
    if k < 1:
        raise ValueError("k must be positive")
    spark = queries.sparkSession
    shipping.attach(spark)
    q = queries.select(F.col(query_key).alias("query_id"), F.col(query_vec).cast("array<double>").alias("q"))
    q = q.where(usable(F.col("q")))
    held = view.cells.orderBy("cell").collect()
    n = q.count() if held else 0
    if not n:
        kind = T.StructType([q.schema["query_id"], T.StructField("key", view.key_type), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])
        return spark.createDataFrame([], kind)
    width = len(held[0]["centre"])
    known = spark.sparkContext.broadcast((np.array([r["cell"] for r in held], np.int32), np.array([r["centre"] for r in held]), np.array([r["radius"] for r in held])))
    n_probe = min(n_probe, len(held))
    schema = T.StructType([*q.schema.fields, T.StructField("cell", T.IntegerType())])
    first = checkpointed(_best(view, q.mapInArrow(partial(_probed, held=known, n_probe=n_probe, further=False), schema), n, n_probe, width, k))
    kth = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).otherwise(float("-inf")).alias("floor"))
    open_ = q.join(kth, "query_id", "left").select("query_id", "q", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    more = open_.mapInArrow(partial(_probed, held=known, n_probe=n_probe, further=True), schema)
    rest = _best(view, more, n, len(held), width, k)
    return _ranked(first.drop("rank").unionByName(rest.drop("rank")), k)
