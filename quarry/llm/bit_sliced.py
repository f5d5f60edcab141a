"""Exact top-k inner products with a bit-sliced index.

Vectors are quantised to integers.  A block of rows holds, per dimension, one
bitmap per bit of the shifted value; the ``DROP`` lowest bits are left out of
the index.  A query's scores over the block are built by bitmap arithmetic:
each set bit of a query component adds that dimension's slices, shifted, into
the slices of the sum.  The slices of the sum are then read from the most
significant down to find the k-th highest indexed score; every row that the
left-out bits could still bring to it is a boundary row and is scored exactly.
Ties go to the smaller id, so results do not depend on how rows are dealt out.

The index is built once: each row block is one row that holds its ids, its
exact values and its slices, kept in the shared folder (``build``).  Query
blocks are streamed against it (``search``): ``BROADCAST_BYTES`` of them at a time are broadcast and the index is read where it
lies, once per such round; neither is ever copied for the other.  Each pair of
blocks keeps k rows a query, and the best of those are taken by query and group
of blocks before the last step, so no task sees all rows of a query.

Scores are exact: where a sum could leave 62 bits, a block counts in Python's
integers, and scores travel as two limbs of 64 bits.

Defined cases: vectors that are null, empty, or hold null or non-finite
components take no part; components beyond +-2 ** 47 count as that, since they
leave the limbs; a score beyond 64 bits ranks by its true value and is shown as
the largest or smallest 64-bit integer; vectors of another length than the
query's do not score with it; repeated candidates are candidates each; a query
that repeats with one id and one vector is one query; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared

ROWS_A_BLOCK = 8192
QUERIES_A_BLOCK = 1024
QUERIES_AT_ONCE = 32
GROUPS = 64
#: Lowest bits of a component that the index leaves out.
DROP = 4
#: Components beyond this, scaled, count as this: sums of up to 4,096 products of two fit 127 bits, the two limbs of a score.
MOST_VALUE = 1 << 57
BROADCAST_BYTES = 64 << 20
U64 = np.uint64


class BitSlices:
    """Slices of a block's rows: per dimension and bit, a bitmap over the rows."""

    def __init__(self, values: np.ndarray, drop: int = DROP):
        self.values, self.n, self.drop = values, len(values), drop
        self.low = values.min(axis=0)
        self.shifted = (values - self.low) >> drop
        self.bits = [int(x).bit_length() for x in self.shifted.max(axis=0)]
        self.words = -(-self.n // 64)
        self.slices = [[self._bitmap((self.shifted[:, d] >> b) & 1) for b in range(bits)] for d, bits in enumerate(self.bits)]

    def _bitmap(self, bit: np.ndarray) -> np.ndarray:
        packed = np.zeros(self.words * 8, dtype=np.uint8)
        got = np.packbits(bit.astype(bool), bitorder="little")
        packed[: len(got)] = got
        return packed.view(U64)

    def sums(self, queries: np.ndarray) -> list[np.ndarray]:
        """Slices of sum(|q| * y) per query: y is the shifted value, counted from the top where q is negative.

        That is q.shifted plus a constant of the query, so it orders rows alike.
        """
        waiting: dict[int, list[np.ndarray]] = {}
        size = np.abs(queries)
        ones = ~U64(0)
        top = int(size.max()).bit_length() if size.size else 0
        for d, slices in enumerate(self.slices):
            if not slices:
                continue
            flip = np.where(queries[:, d] < 0, ones, U64(0))[:, None]
            turned = [s[None, :] ^ flip for s in slices]
            for c in range(top):
                has = (size[:, d] >> c) & 1
                if not has.any():
                    continue
                mask = np.where(has == 1, ones, U64(0))[:, None]
                for b, s in enumerate(turned):
                    self._add(waiting, b + c, s & mask)
        out, weight = [], 0
        while any(w >= weight for w in waiting):
            held = waiting.pop(weight, [])
            while len(held) > 1:  # two bitmaps of one weight: sum stays, carry moves up
                x, y = held.pop(), held.pop()
                carry = x & y
                if carry.any():
                    waiting.setdefault(weight + 1, []).append(carry)
                held.append(x ^ y)
            out.append(held[0] if held else np.zeros((len(queries), self.words), dtype=U64))
            weight += 1
        return out

    @staticmethod
    def _add(waiting: dict[int, list[np.ndarray]], weight: int, x: np.ndarray) -> None:
        """Carry-save: three bitmaps of one weight become one of it and one of the next."""
        while True:
            held = waiting.setdefault(weight, [])
            held.append(x)
            if len(held) < 3:
                return
            a, b, c = held
            ab = a ^ b
            waiting[weight] = [ab ^ c]
            x, weight = (a & b) | (c & ab), weight + 1
            if not x.any():
                return

    def wide(self, queries: np.ndarray) -> bool:
        """Whether a sum, or a sum of shifted values, could leave 62 bits."""
        if not self.values.size or not queries.size:
            return False
        most = max(int(np.abs(self.values).max()), int(self.shifted.max()) << self.drop, 1 << self.drop)
        return most * int(np.abs(queries).max()) * self.values.shape[1] >= 1 << 62

    def candidates(self, queries: np.ndarray, k: int) -> list[np.ndarray]:
        """Per query, the rows whose exact score may be among the k highest."""
        slices = self.sums(queries)
        number = object if self.wide(queries) else np.int64
        count = len(queries)
        live = np.zeros(self.words * 64, dtype=bool)
        live[: self.n] = True
        everyone = np.packbits(live, bitorder="little").view(U64)
        # From the most significant slice down: the k-th highest indexed sum, bit by bit.
        chosen = np.zeros((count, self.words), dtype=U64)
        even = np.tile(everyone, (count, 1))
        bound = np.zeros(count, dtype=number)
        for weight in range(len(slices) - 1, -1, -1):
            with_bit = even & slices[weight]
            enough = np.bitwise_count(chosen | with_bit).sum(axis=1) >= k
            bound += np.where(enough, number(1 << weight) if number is np.int64 else np.array(1 << weight, dtype=object), 0)
            pick = enough[:, None]
            chosen = np.where(pick, chosen, chosen | with_bit)
            even = np.where(pick, with_bit, even & ~slices[weight])
        # Left-out bits change q.x by an amount between -slack * sum|q<0| and slack * sum|q>0|.
        slack = (1 << self.drop) - 1
        reach = slack * np.abs(queries).astype(number).sum(axis=1)
        least = np.maximum(bound - (reach >> self.drop) - 1, 0)
        # Rows with an indexed sum of at least ``least``, again from the top slice down.
        above = np.zeros((count, self.words), dtype=U64)
        even = np.tile(everyone, (count, 1))
        for weight in range(len(slices) - 1, -1, -1):
            want = (((least >> weight) & 1) == 1).astype(bool)[:, None]
            above = np.where(want, above, above | (even & slices[weight]))
            even = np.where(want, even & slices[weight], even & ~slices[weight])
        flat = np.unpackbits((above | even).view(np.uint8), axis=1, bitorder="little")
        return [np.flatnonzero(row) for row in flat]

    def top(self, queries: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query number, row ids, exact scores) of the k best rows but the query's own, ties to smaller ids; wide scores are Python's integers."""
        wide = self.wide(queries)
        repeats = int(np.unique(ids, return_counts=True)[1].max())
        picks = self.candidates(queries, k + repeats)  # room for the query's own rows
        for i, rows in enumerate(picks):
            rows = rows[ids[rows] != own[i]]
            if wide:
                score = self.values[rows].astype(object) @ queries[i].astype(object)
                best = np.array(sorted(range(len(rows)), key=lambda n: (-score[n], ids[rows[n]]))[:k], dtype=np.int64)
            else:
                score = self.values[rows] @ queries[i]
                best = np.lexsort((ids[rows], -score))[:k]
            yield i, ids[rows][best], score[best]

    def packed(self) -> tuple[bytes, bytes]:
        """The slices' frame (drop, lows, bits) and their bitmaps, one after another."""
        frame = np.array([self.drop, *self.low.tolist(), *self.bits], dtype=np.int64).tobytes()
        return frame, b"".join(s.tobytes() for slices in self.slices for s in slices)

    @classmethod
    def opened(cls, values: np.ndarray, frame: bytes, bitmaps: bytes) -> BitSlices:
        """Slices as ``packed`` left them, without building them again."""
        self = cls.__new__(cls)
        head = np.frombuffer(frame, np.int64)
        dim = (len(head) - 1) // 2
        self.values, self.n, self.drop, self.low = values, len(values), int(head[0]), head[1 : dim + 1]
        self.shifted = (values - self.low) >> self.drop
        self.bits, self.words = head[dim + 1 :].tolist(), -(-len(values) // 64)
        flat = np.frombuffer(bitmaps, U64).reshape(-1, self.words)
        ends = np.cumsum(self.bits)
        self.slices = [list(flat[e - b : e]) for b, e in zip(self.bits, ends)]
        return self


def _vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids, ascending, and their vectors."""
    column = table.column("v").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ids = table.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], flat.reshape(len(column), -1).astype(np.int64)[order]


INDEX = "dim int, block int, ids binary, vectors binary, frame binary, slices binary"
QUERIES = "dim int, qb int, ids binary, vectors binary"


def _ints(values: np.ndarray) -> bytes:
    """Vectors in four bytes a component where that holds them all, else in eight."""
    return values.astype("<i4" if not values.size or np.abs(values).max() < 1 << 31 else "<i8").tobytes()


def _from_ints(data: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<i4" if len(data) == 4 * rows * dim else "<i8").reshape(rows, dim).astype(np.int64)


def _limbs(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores as (high, low) pairs of signed 64-bit integers that order alike: score = high * 2 ** 64 + low + 2 ** 63."""
    if score.dtype != object:
        return score >> 63, (score.view(U64) ^ U64(1 << 63)).view(np.int64)
    return np.array([int(x) >> 64 for x in score], dtype=np.int64), np.array([(int(x) & ((1 << 64) - 1)) - (1 << 63) for x in score], dtype=np.int64)


def _indexed(table: pa.Table) -> pa.Table:
    ids, values = _vectors(table)
    frame, slices = BitSlices(values).packed()
    row = [table.column("dim")[0].as_py(), table.column("block")[0].as_py(), ids.astype("<i8").tobytes(), _ints(values), frame, slices]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array([x], k) for x, k in zip(row, kinds)], ["dim", "block", "ids", "vectors", "frame", "slices"])


def _grouped(table: pa.Table) -> pa.Table:
    ids, values = _vectors(table)
    row = [table.column("dim")[0].as_py(), table.column("block")[0].as_py(), ids.astype("<i8").tobytes(), _ints(values)]
    return pa.table([pa.array([x], k) for x, k in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["dim", "qb", "ids", "vectors"])


def _quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    v = F.col(f"`{vector_col}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    bounded = lambda x: F.floor(F.least(F.greatest(x.cast("double") * F.lit(float(scale)), F.lit(float(-MOST_VALUE))), F.lit(float(MOST_VALUE)))).cast("bigint")
    kept = df.where((F.size(v) > 0) & finite & F.col(f"`{id_col}`").isNotNull())
    return kept.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.transform(v, bounded).alias("v"), F.size(v).alias("dim"))


def _blocks(rows: DataFrame, n: int) -> DataFrame:
    return rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).select("id", "v", "dim", "block")


def build(rows: DataFrame, folder: str, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """The index of a table, kept below ``folder``: one row per block of about ``ROWS_A_BLOCK`` rows."""
    shared.attach(rows.sparkSession)
    r = shared.stored(_quantised(rows, id_col, vector_col, scale), folder, "rows")
    n = max(1, -(-r.count() // ROWS_A_BLOCK))
    return shared.stored(_blocks(r, n).groupBy("dim", "block").applyInArrow(_indexed, INDEX), folder, "index")


def _found(index: tuple, queries: tuple, k: int) -> list[tuple[np.ndarray, ...]]:
    """(query ids, row ids, high and low limbs of scores) of one pair of blocks."""
    dim, ids, vectors, frame, slices = index
    own, ids = np.frombuffer(queries[0], "<i8"), np.frombuffer(ids, "<i8")
    q = _from_ints(queries[1], len(own), dim)
    held = BitSlices.opened(_from_ints(vectors, len(ids), dim), frame, slices)
    out = []
    for lo in range(0, len(q), QUERIES_AT_ONCE):
        for i, found, score in held.top(q[lo : lo + QUERIES_AT_ONCE], ids, own[lo : lo + QUERIES_AT_ONCE], k):
            out.append((np.full(len(found), own[lo + i]), found, *_limbs(score)))
    return out


def _searched(batches: Iterator[pa.RecordBatch], k: int, broadcast) -> Iterator[pa.RecordBatch]:
    """Index blocks against the query blocks that are broadcast."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = tuple(batch.column(c)[i].as_py() for c in range(batch.num_columns))
            for queries in [q[1:] for q in broadcast.value if q[0] == row[0]]:
                got = _found(row, queries, k)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*got)], ["query_id", "vec_id", "high", "low"])


FOUND = "query_id bigint, vec_id bigint, high bigint, low bigint"


def search(index: DataFrame, queries: DataFrame, folder: str, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score of the k highest scores of each query in an index; a row does not find its own id.

    Queries that take one round are searched when the result is read; those of several are searched at once, round by round.
    """
    spark = index.sparkSession
    shared.attach(spark)
    q = shared.stored(_quantised(queries, id_col, vector_col, scale).distinct(), folder, "queries")
    n_queries, n_bytes = q.agg(F.count("*"), F.coalesce(F.sum(F.col("dim") * 8 + 8), F.lit(0))).first()
    rounds = max(1, -(-n_bytes // max(broadcast_bytes, 1)))
    n_blocks = max(1, -(-n_queries // QUERIES_A_BLOCK), min(rounds, n_queries))
    rounds = min(rounds, n_blocks)
    blocks = shared.stored(_blocks(q, n_blocks).groupBy("dim", "block").applyInArrow(_grouped, QUERIES), folder, "query-blocks")
    rows = index.select("dim", "ids", "vectors", "frame", "slices").repartition(max(1, index.count()))  # blocks are few and heavy: each goes to a task of its own
    for n in range(rounds):
        mine = blocks.where(F.pmod("qb", F.lit(rounds)) == n).select("dim", "ids", "vectors")
        held = spark.sparkContext.broadcast([tuple(r) for r in mine.collect()])  # about broadcast_bytes
        best = rows.mapInArrow(partial(_searched, k=k, broadcast=held), FOUND)
        if rounds > 1:
            best.write.mode("overwrite").parquet(f"{folder}/found/round={n}")
            held.destroy()
    if rounds > 1:
        best = spark.read.schema(FOUND).parquet(f"{folder}/found").drop("round")
    order = [F.col("high").desc(), F.col("low").desc(), F.col("vec_id").asc()]
    # Each block pair gives k rows a query; the best of a group of blocks are taken before those of all.
    few = W.partitionBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(GROUPS))).orderBy(*order)
    best = best.withColumn("rank", F.row_number().over(few)).where(F.col("rank") <= k).drop("rank")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    low = F.col("low").bitwiseXOR(F.lit(-(1 << 63)))
    score = F.when(F.shiftright(low, 63) == F.col("high"), low).when(F.col("high") < 0, F.lit(-(1 << 63))).otherwise(F.lit((1 << 63) - 1))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))


def top_k(queries: DataFrame, rows: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products over all rows but its own."""
    folder = shared.shared_folder(rows.sparkSession)
    index = build(rows, folder, id_col, vector_col, scale)
    return search(index, queries, folder, k, id_col, vector_col, scale, broadcast_bytes)
