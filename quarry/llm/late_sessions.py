"""Sessions of late events, kept as a log of versions: a fold over arrays inside the JVM.

Events come in batches.  After each batch a user's events so far form sessions
(neighbours in time at most ``gap`` apart); a session that holds an event of the
batch is a new version and retracts the standing sessions it contains.

The fold runs per user and island.  An island is a run of the user's events of
all batches without a gap, so no session of any batch reaches beyond it, and a
user with any number of events is many small folds:

1. events become cells: per user, batch and stretch of ``gap`` seconds their
   count, sum, first and last second (all events of one stretch always share a
   session), with partial aggregation, so repeated events cost one row a task;
   the cells are written to the shared folder, and the rest reads only them;
2. a cell begins an island unless the stretch before it ends within ``gap``.
   That is seen inside windows of ``SPAN`` stretches, each with a copy of the
   last stretch before it; an island's beginning is carried over windows level by level,
   so no task sees more than ``SPAN`` rows of one user on any level;
3. per island, the sorted batches are folded with ``aggregate``: standing
   sessions near the batch and its cells are merged in time order, and
   ``filter`` and ``transform`` part standing from retracted versions.

One fold holds a session's cells: at most one row per stretch and batch.

Defined cases: events without user, time or batch take no part; repeated rows
count again; ties in time share a session; a null weight adds nothing; an empty
table gives an empty log; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Stretches in one window, and how often windows are gathered into larger ones: enough for 10 ** 5 years of seconds.
SPAN, LEVELS = 512, 3
_KEPT = ("batch", "start_s", "end_s", "n_events", "n_new", "n_retracted", "h_sum")
_VERSION = (*_KEPT, "retracted_batch", "retracted_start_s")
_PIECE = ("lo", "hi", "n", "h", "new", "old")


def _stretch(x: Column, width: int) -> Column:
    """floor(x / width) of whole numbers, exactly."""
    w = F.lit(width).cast("long")
    return F.call_function("div", x - F.pmod(x, w), w)


def cells(events: DataFrame, gap: int) -> DataFrame:
    """user, batch, cell with lo, hi, n and h: what the events of one stretch and batch come to."""
    held = events.where("user is not null and second is not null and batch is not null")
    return held.groupBy("user", "batch", _stretch(F.col("second"), gap).alias("cell")).agg(
        F.min("second").alias("lo"), F.max("second").alias("hi"), F.count("*").alias("n"), F.coalesce(F.sum("weight"), F.lit(0)).cast("long").alias("h")
    )


def _carried(summary: DataFrame, levels: int = LEVELS) -> DataFrame:
    """user, chunk, before: the largest ``last`` of the user's earlier chunks; ``last`` grows with the chunk."""
    if not levels:
        earlier = Window.partitionBy("user").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        return summary.select("user", "chunk", F.max("last").over(earlier).alias("before"))
    summary = summary.withColumn("above", _stretch(F.col("chunk"), SPAN))
    earlier = Window.partitionBy("user", "above").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    inside = summary.withColumn("inside", F.max("last").over(earlier))
    upper = summary.groupBy("user", "above").agg(F.max("last").alias("last")).withColumnRenamed("above", "chunk")
    over = _carried(upper, levels - 1).withColumnRenamed("chunk", "above").withColumnRenamed("before", "over")
    return inside.join(over, ["user", "above"], "left").select("user", "chunk", F.coalesce("inside", "over").alias("before"))


def islands(table: DataFrame, gap: int) -> DataFrame:
    """The cells with ``island``: the first cell of the run without a gap that they belong to."""
    chunk = _stretch(F.col("cell"), SPAN)
    last = F.pmod(F.col("cell"), F.lit(SPAN)) == SPAN - 1
    rows = table.withColumn("chunk", F.explode(F.when(last, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))))
    by_chunk = Window.partitionBy("user", "chunk")
    before = by_chunk.orderBy("cell").rangeBetween(-1, -1)
    same = by_chunk.orderBy("cell").rangeBetween(0, 0)
    begins = F.coalesce(F.min("lo").over(same) - F.max("hi").over(before) > gap, F.lit(True))
    rows = rows.withColumn("begin", F.when(begins, F.col("cell"))).where(F.col("chunk") == chunk)  # the copies have told their end
    rows = rows.withColumn("begin", F.max("begin").over(by_chunk.orderBy("cell").rangeBetween(Window.unboundedPreceding, 0)))
    carried = _carried(rows.groupBy("user", "chunk").agg(F.max("begin").alias("last")))
    return rows.join(carried, ["user", "chunk"]).withColumn("island", F.coalesce("begin", "before")).drop("chunk", "begin", "before")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _record(names: tuple[str, ...], *values: Column) -> Column:
    return F.struct(*[v.cast("long").alias(name) for name, v in zip(names, values)])


def _no_records(names: tuple[str, ...]) -> Column:
    return F.expr(f"cast(array() as array<struct<{', '.join(f'{name}: bigint' for name in names)}>>)")


def _merged(pieces: Column, gap: int) -> Column:
    """Pieces in time order, joined where they are at most ``gap`` apart."""

    def joined(done: Column, x: Column) -> Column:
        top = F.get(done, F.size(done) - 1)
        both = _record(_PIECE, top["lo"], F.greatest(top["hi"], x["hi"]), *[top[k] + x[k] for k in ("n", "h", "new", "old")])
        near = F.coalesce(x["lo"] - top["hi"] <= gap, F.lit(False))
        return F.when(near, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(both))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(pieces), _no_records(_PIECE), joined)


def _step(state: Column, batch: Column, pieces: Column, gap: int) -> Column:
    """One batch: the standing versions and the log after it."""
    first, last = F.array_min(F.transform(pieces, lambda p: p["lo"])), F.array_max(F.transform(pieces, lambda p: p["hi"]))
    zero, none = F.lit(0), F.lit(None)

    def parted(reach: Column) -> Column:
        is_near = lambda s: (s["end_s"] >= reach["first"] - gap) & (s["start_s"] <= reach["last"] + gap)
        standing = state["standing"]
        near, far = F.filter(standing, is_near), F.filter(standing, lambda s: ~is_near(s))
        return _let(F.struct(near.alias("near"), far.alias("far")), told)

    def told(parts: Column) -> Column:
        old = F.transform(parts["near"], lambda s: _record(_PIECE, s["start_s"], s["end_s"], s["n_events"], s["h_sum"], zero, F.lit(1)))
        new = F.transform(pieces, lambda p: _record(_PIECE, p["lo"], p["hi"], p["n"], p["h"], p["n"], zero))
        fresh = F.filter(_merged(F.concat(old, new), gap), lambda c: c["new"] > 0)
        return _let(fresh, lambda made: after(parts, made))

    def after(parts: Column, made: Column) -> Column:
        covers = lambda s: lambda c: (c["lo"] <= s["start_s"]) & (s["start_s"] <= c["hi"])
        untouched = F.filter(parts["near"], lambda s: ~F.exists(made, covers(s)))
        gone = F.filter(parts["near"], lambda s: F.exists(made, covers(s)))
        retract = lambda s: _record(_VERSION, *[s[k] for k in _KEPT], batch, F.get(F.filter(made, covers(s)), F.lit(0))["lo"])
        versions = F.transform(made, lambda c: _record(_VERSION, batch, c["lo"], c["hi"], c["n"], c["new"], c["old"], c["h"], none, none))
        return F.struct(F.concat(parts["far"], untouched, versions).alias("standing"), F.concat(state["log"], F.transform(gone, retract)).alias("log"))

    return _let(F.struct(first.alias("first"), last.alias("last")), parted)


def versions(events: DataFrame, user_col: str = "user", second_col: str = "second", batch_col: str = "batch", weight_col: str = "weight", gap: int = 420, folder: str | None = None) -> DataFrame:
    """The version log: one row per session version with what it came from and what retracted it (null if it stands)."""
    numbers = {"second": second_col, "batch": batch_col, "weight": weight_col}
    named = events.select(F.col(f"`{user_col}`").alias("user"), *[F.col(f"`{c}`").cast("long").alias(name) for name, c in numbers.items()])
    table = shared.stored(cells(named, gap), folder or shared.shared_folder(events.sparkSession), "cells")
    placed = islands(table, gap).repartition("user", "island")
    batches = placed.groupBy("user", "island", "batch").agg(F.collect_list(F.struct("lo", "hi", "n", "h")).alias("pieces"))
    folds = batches.groupBy("user", "island").agg(F.array_sort(F.collect_list(F.struct("batch", "pieces"))).alias("batches"))
    start = F.struct(_no_records(_VERSION).alias("standing"), _no_records(_VERSION).alias("log"))
    log = F.aggregate("batches", start, lambda state, b: _step(state, b["batch"], b["pieces"], gap), lambda state: F.concat(state["log"], state["standing"]))
    return folds.select("user", F.inline(log))


def conversation_events(turns: DataFrame) -> DataFrame:
    """Turns as events: user, second, batch and weight from checksums of conversation and turn; rows without either take no part."""
    turns = turns.where("turn is not null and conv_id is not null")
    c = F.crc32(F.col("conv_id").cast("string"))
    h = F.crc32(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), c.alias("c"), h.alias("h"))
    user = 2 * F.shiftright("conv_id", 3) + F.col("c") % 2
    second = F.shiftright("c", 1) % 7200 + 300 * F.col("turn") + F.col("h") % 600
    group = F.expr("h div 600")
    rows = rows.select(user.alias("user"), second.alias("second"), group.alias("group"), F.col("h").alias("weight"))
    batch = _stretch(F.col("second"), 3600) + F.when(F.col("group") % 3 == 0, F.col("group") % 4).otherwise(F.lit(0))
    return rows.select("user", "second", batch.alias("batch"), "weight")
