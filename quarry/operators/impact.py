"""A kept lexical view with impact-ordered postings: BM25 top-k that opens only blocks that can matter.

``build`` writes, below one folder,

* ``lengths``: id, dl of every document;
* ``stats``: number and mean length of documents, floor of negative idf, numbers of shards and parts;
* ``terms``: term, df, idf;
* ``blocks``: by ``part`` (hash of the term), the postings of one term, one level of impact and one shard of
  documents, as arrays of ids and shares.  A share is a posting's score before idf and lies below K1 + 1; LEVELS
  equal stretches of that make the levels.  A shard holds about SHARD documents or TOKENS tokens, by hash of the id, so a
  term that every document holds is many blocks;
* ``levels``: term, level and the largest and least share and number of its postings: at most LEVELS rows a term.

``search`` reads no text.  Blocks of the asked terms and the weighted terms of the queries meet by shard, and a shard's
k best documents of each query are found there, so what is shuffled afterwards is k rows a query and shard.  Within a
shard a query's terms are taken by the most they can give.  As soon as the k-th best sum is above what all terms left
can give together, a document without a sum is out: only documents that can still reach the k-th are looked up in the
blocks left, and blocks whose largest share cannot bring one of them there are not opened.  Scores are exact.

Contributions are summed as whole multiples of 2 ** -40, so a sum does not depend on its order and equal documents
score equally; rows are ranked by that sum, then id, and scores are rounded for show alone.  Documents without
any of the terms score 0: every query gets min(k, n) rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.shipping import attach

K1, B, EPSILON = 1.5, 0.75, 0.25
LEVELS, SHARD, MOST_PARTS = 8, 1 << 14, 32
#: Tokens that a shard is planned for at most.
TOKENS = 1 << 22
#: Queries that meet a shard at a time.
QUERIES_AT_ONCE = 2048
UNIT = float(1 << 40)


#: Columns of the tables kept by part; a corpus without terms writes no file that would tell them.
TERMS = "term string, df bigint, idf double, part int"
LEVEL_ROWS = "term string, level int, most double, least double, n bigint, part int"
BLOCKS = "term string, level int, shard int, ids array<{}>, shares array<double>, most double, least double, n bigint, part int"


@dataclass(frozen=True)
class View:
    """The tables of a kept lexical view, and the one row of its ``stats``."""

    lengths: DataFrame
    terms: DataFrame
    levels: DataFrame
    blocks: DataFrame
    n: int
    floor: float
    shards: int
    parts: int


def hashed(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def contribution(weight: Column, share: Column) -> Column:
    """A posting's part of a score in whole units."""
    return F.round(weight * share * UNIT).cast("bigint")


def _counted(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]]:
    """(row, number of tokens, term, tf) of each posting of rows (id, tokens), for stretches of about ``most`` tokens."""
    tokens = batch.column(1)
    starts = tokens.offsets.to_numpy()
    sizes = np.diff(starts).astype(np.int64)
    cuts = np.flatnonzero(np.diff((starts[:-1] - starts[0]) // most, prepend=-1)).tolist() + [len(sizes)]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        words = tokens.slice(lo, hi - lo).flatten().dictionary_encode()
        vocabulary = max(len(words.dictionary), 1)
        row = np.repeat(np.arange(lo, hi), sizes[lo:hi])
        keys, tf = np.unique(row * vocabulary + words.indices.to_numpy().astype(np.int64), return_counts=True)
        rows, terms = keys // vocabulary, keys % vocabulary
        yield rows, sizes[rows], words.dictionary.take(pa.array(terms)).cast(pa.large_string()), tf.astype(np.int64)


def _blocked(table: pa.Table, mean: float) -> pa.Table:
    """term, level, shard, ids, shares, most, least, n: the blocks of the documents (id, tokens, shard) of one shard."""
    rows, sizes, terms, counts, first = [], [], [], [], 0
    for batch in table.select(["id", "tokens"]).to_batches():
        for row, size, term, tf in _counted(batch):
            rows.append(row + first)
            sizes.append(size)
            terms.append(term)
            counts.append(tf)
        first += len(batch)
    kind = table.schema.field("id").type
    names = ["term", "level", "shard", "ids", "shares", "most", "least", "n"]
    if not sum(map(len, rows)):
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(kind), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.int64()]
        return pa.table([pa.array([], k) for k in kinds], names)
    row, dl, tf = map(np.concatenate, (rows, sizes, counts))
    term = pa.chunked_array(terms).combine_chunks().dictionary_encode()
    share = tf * (K1 + 1) / (tf + K1 * (dl * B / mean + (1 - B)))
    level = np.minimum(np.floor(share * (LEVELS / (K1 + 1))), LEVELS - 1).astype(np.int64)
    ids = table.column("id").combine_chunks()
    place = np.empty(first, np.int64)
    place[pc.sort_indices(ids).to_numpy()] = np.arange(first)
    block = term.indices.to_numpy().astype(np.int64) * LEVELS + level
    order = np.argsort(block * first + place[row])
    row, share, block = row[order], share[order], block[order]
    starts = np.flatnonzero(np.diff(block, prepend=-1))
    ends = pa.array(np.append(starts, len(block)).astype(np.int32))
    code, level = np.divmod(block[starts], LEVELS)
    shard = table.column("shard")[0].as_py()
    columns = [
        term.dictionary.take(pa.array(code)).cast(pa.string()), pa.array(level.astype(np.int32)), pa.array(np.full(len(starts), shard, np.int32)),
        pa.ListArray.from_arrays(ends, ids.take(pa.array(row))), pa.ListArray.from_arrays(ends, pa.array(share)),
        pa.array(np.maximum.reduceat(share, starts)), pa.array(np.minimum.reduceat(share, starts)), pa.array(np.diff(np.append(starts, len(block)))),
    ]
    return pa.table(columns, names)


def build(docs: DataFrame, id_col: str, tokens: Column, folder: str) -> View:
    """Write the view of documents, whose ids are unique; one pass over the texts for their lengths and one for the postings.

    Texts are shuffled by shard, and a shard's postings are sorted into blocks where it lies: no posting is a row of its own.
    """
    spark = docs.sparkSession
    attach(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), tokens.alias("tokens"))
    rows.select("id", F.size("tokens").cast("bigint").alias("dl")).write.mode("overwrite").parquet(f"{folder}/lengths")
    lengths = spark.read.parquet(f"{folder}/lengths")
    n, mean, total = lengths.agg(F.count("*"), F.coalesce(F.avg("dl"), F.lit(0.0)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    shards = max(1, -(-n // SHARD), -(-total // TOKENS))
    parts = min(16 * shards, MOST_PARTS)
    kind = rows.schema["id"].dataType.simpleString()
    dealt = docs.withColumn("_shard", hashed(F.col(f"`{id_col}`"), shards)).repartition("_shard").sortWithinPartitions("_shard")
    dealt = dealt.select(F.col(f"`{id_col}`").alias("id"), tokens.alias("tokens"), F.col("_shard").alias("shard")).where("tokens is not null")
    made = "term string, level int, shard int, ids array<{}>, shares array<double>, most double, least double, n bigint".format(kind)
    blocks = dealt.groupBy("shard").applyInArrow(lambda rows: _blocked(rows, mean), made).withColumn("part", hashed(F.col("term"), parts))
    blocks.sortWithinPartitions("part", "term", "level").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/blocks")
    blocks = _table(spark, folder, "blocks", BLOCKS.format(lengths.schema["id"].dataType.simpleString()))
    levels = blocks.groupBy("part", "term", "level").agg(F.max("most").alias("most"), F.min("least").alias("least"), F.sum("n").alias("n"))
    levels.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/levels")
    df = F.sum("n").alias("df")
    idf = F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    _table(spark, folder, "levels", LEVEL_ROWS).groupBy("part", "term").agg(df).withColumn("idf", idf).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/terms")
    floor = _table(spark, folder, "terms", TERMS).agg(F.coalesce(F.avg("idf") * EPSILON, F.lit(0.0)).alias("floor"))
    floor.select(F.lit(n).cast("bigint").alias("n"), F.lit(mean).alias("mean"), "floor", F.lit(shards).alias("shards"), F.lit(parts).alias("parts")).write.mode("overwrite").parquet(f"{folder}/stats")
    return load(spark, folder)


def _table(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str) -> View:
    """The view that ``build`` left in a folder; its one row of numbers is read at once."""
    numbers = spark.read.parquet(f"{folder}/stats").select("n", "floor", "shards", "parts").first()
    lengths = spark.read.parquet(f"{folder}/lengths")
    kind = lengths.schema["id"].dataType.simpleString()
    return View(lengths, *[_table(spark, folder, *t) for t in (("terms", TERMS), ("levels", LEVEL_ROWS), ("blocks", BLOCKS.format(kind)))], *numbers)


def weights(view: View, asked: DataFrame) -> DataFrame:
    """query_id, part, term, w: a term's idf, floored, times how often the query asks it; terms of no document fall away."""
    idf = F.when(F.col("idf") < 0, F.lit(view.floor)).otherwise(F.col("idf"))
    return asked.join(view.terms, ["part", "term"]).select("query_id", "part", "term", (F.col("times") * idf).alias("w"))


def _units(weight: float, shares: np.ndarray) -> np.ndarray:
    return np.floor(weight * shares * UNIT + 0.5).astype(np.int64)


class Shard:
    """The opened blocks of one shard: per term its levels, highest first, as document places and shares."""

    def __init__(self, blocks: pa.Table):
        terms, levels = blocks.column("term").to_pylist(), blocks.column("level").to_numpy()
        ids, shares = (blocks.column(c).combine_chunks() for c in ("ids", "shares"))
        ends = ids.offsets.to_numpy()
        place = ids.flatten().dictionary_encode()
        self.documents = place.dictionary
        places, flat = place.indices.to_numpy().astype(np.int64), shares.flatten().to_numpy()
        self.blocks: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for n in np.argsort(-levels, kind="stable"):
            lo, hi = ends[n] - ends[0], ends[n + 1] - ends[0]
            order = np.argsort(places[lo:hi])
            self.blocks.setdefault(terms[n], []).append((places[lo:hi][order], flat[lo:hi][order]))
        self.most = {t: max(float(s.max()) for _, s in held) for t, held in self.blocks.items()}

    def best(self, terms: list[tuple[str, float]], k: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and sums of the documents that may be among the k best (all that hold a term, if k is None)."""
        terms = sorted(((int(_units(w, np.float64(self.most[t]))), t, w) for t, w in terms if t in self.blocks), reverse=True)
        left = sum(top for top, _, _ in terms)
        sums = np.zeros(len(self.documents), dtype=np.int64)
        held = np.zeros(len(self.documents), dtype=bool)
        chosen = None
        for top, term, w in terms:
            if chosen is None and k is not None and len(sums) > k and held.any():
                reached = int(np.partition(sums, -k)[-k])
                if reached > left:
                    chosen = np.flatnonzero(sums + left >= reached)
            if chosen is not None:
                # Documents that the terms left can no longer bring up to the k-th go; so do blocks that help none of those.
                reached = int(np.partition(sums[chosen], -k)[-k])
                chosen = chosen[sums[chosen] + left >= reached]
            left -= top
            for places, shares in self.blocks[term]:
                if chosen is None:
                    sums[places] += _units(w, shares)
                    held[places] = True
                else:
                    at = np.minimum(np.searchsorted(places, chosen), len(places) - 1)
                    met = places[at] == chosen
                    sums[chosen[met]] += _units(w, shares[at[met]])
        found = np.flatnonzero(held) if chosen is None else chosen
        if k is not None and len(found) > k:
            least = np.partition(sums[found], -k)[-k]
            found = found[sums[found] >= least]  # ties stay: ids decide among them
        return found, sums[found]


def _scored(key: tuple, blocks: pa.Table, weighted: pa.Table, k: int | None) -> pa.Table:
    """query_id, id, units of one shard and group of queries."""
    kind = weighted.schema.field("query_id").type
    empty = blocks.schema.field("ids").type.value_type
    out: list[pa.Table] = []
    if blocks.num_rows and weighted.num_rows:
        shard = Shard(blocks)
        asked: dict[object, list[tuple[str, float]]] = {}
        for q, term, w in zip(*[weighted.column(c).to_pylist() for c in ("query_id", "term", "w")]):
            asked.setdefault(q, []).append((term, w))
        for q, terms in asked.items():
            places, units = shard.best(terms, k)
            order = np.argsort(-units, kind="stable")
            columns = [pa.array([q] * len(order), kind), shard.documents.take(pa.array(places[order])), pa.array(units[order], pa.int64())]
            out.append(pa.table(columns, ["query_id", "id", "units"]))
    return pa.concat_tables(out) if out else pa.table([pa.array([], kind), pa.array([], empty), pa.array([], pa.int64())], ["query_id", "id", "units"])


def search(view: View, queries: DataFrame, query_col: str, k: int, query_tokens: Column) -> DataFrame:
    """query_id, id, score, rank: the min(k, n) best documents of each query.  Queries are counted at once."""
    attach(queries.sparkSession)
    queries = queries.select(F.col(f"`{query_col}`").alias("query_id"), query_tokens.alias("tokens"))
    groups = max(1, -(-queries.count() // QUERIES_AT_ONCE))
    asked = queries.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    weighted = weights(view, asked.withColumn("part", hashed(F.col("term"), view.parts)))
    blocks = view.blocks.join(weighted.select("part", "term").distinct(), ["part", "term"], "left_semi").select("shard", "term", "level", "ids", "shares")
    each = F.sequence(F.lit(0), F.lit(groups - 1))
    blocks = blocks.withColumn("group", F.explode(each)) if groups > 1 else blocks.withColumn("group", F.lit(0))
    weighted = weighted.select("query_id", "term", "w", hashed(F.col("query_id"), groups).alias("group"))
    weighted = weighted.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(view.shards - 1))))
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("id", view.lengths.schema["id"].dataType), T.StructField("units", T.LongType())])
    # With negative weights no sum bounds another: every match is handed on (such a corpus is tiny).
    step = partial(_scored, k=k if view.floor >= 0 else None)
    scored = blocks.groupBy("shard", "group").cogroup(weighted.groupBy("shard", "group")).applyInArrow(lambda key, a, b: step(key, a, b), schema)
    return ranked(scored, queries, view.lengths, F.lit(view.floor), k)


def ranked(scored: DataFrame, queries: DataFrame, documents: DataFrame, floor: Column, k: int) -> DataFrame:
    """query_id, id, score, rank of (query_id, id, units): the k best, documents that hold no term with 0, in the order of their ids.

    Where no weight is negative, a query with fewer than k matches finds its others among the first 2 * k ids.  Only a
    corpus whose mean idf is negative has negative weights; it is tiny, and all its ids are looked at.
    """
    ids = documents.select("id").where("id is not null")
    first = ids.orderBy("id").limit(2 * k).union(ids.where(floor < 0)).agg(F.array_sort(F.collect_set("id"))).scalar()
    rest = queries.select("query_id").distinct().select("query_id", F.explode(first).alias("id"), F.lit(0).cast("bigint").alias("units"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("units").desc(), "id"))
    rows = scored.unionByName(rest).groupBy("query_id", "id").agg(F.sum("units").alias("units"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", F.round(F.col("units") / UNIT, 6).alias("score"), "rank")
