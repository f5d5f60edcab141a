"""Mixing sources to target weights by weighted fair queueing.

Every document of a source is served in a fixed shuffled order, up to ``most``
times over.  A turn's virtual finish time is the words its source has served up
to the turn's end, divided by the source's target.  The turns of all sources
are range-sorted by that time, running sums are taken over the ranges and
within each, and the order is cut where the words reach the total budget; what
lies before the cut is the mix.

``cut="words"`` splits the turn that a source is serving at virtual time 1 (its
target) into a part before and a part after, and the turn at the cut itself;
so a source's words equal its target but for a few words a source.
``cut="documents"`` keeps every turn whole; the one at the cut is in the mix if
at least half of it lies before.

Targets: weights by the source's place in code point order (null last), as
shares of all words; none above ``most`` times its source's words, the excess
going to the others by weight until none is above.

No task gets a whole source: its documents fall into about sqrt(rows) ranges
of the shuffle key, ranges are summed first, and running sums are taken over
the sums and then within each range; the global order is treated likewise.  The
shuffle key holds the text too, so rows without id, or of one id, spread.  Rows
equal in id, source and text are one counted row until their turns are made,
in blocks of COPIES each; rows without words get no turns.

Defined cases: null and empty texts have no words and are never taken; null is
a source of its own; rows equal in id, source and text are interchangeable;
empty tables give empty results.  Other columns travel in one struct.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared, words

#: Up to so many sources their targets are broadcast (about 100 bytes each); beyond, they are joined by shuffle.
BROADCAST_SOURCES = 50_000
#: Equal rows are listed by blocks of so many, which spread over tasks.
COPIES = 1024
#: The virtual time of turns of a source without target.
NEVER = 1e300


def word_counts(column: pa.Array) -> np.ndarray:
    out = np.zeros(len(column), dtype=np.int64)
    for lo, hi, data, offsets in words.text_chunks(column):
        out[lo:hi] = np.diff(words.word_spans(data, offsets)[2])
    return out


def _key(doc_id: Column, source: Column, text: Column) -> Column:
    """The shuffle key: md5 over id, source and text."""
    whose = F.when(source.isNull(), "").otherwise(F.concat(F.lit("s"), source))
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), whose, F.lit("|"), F.md5(F.coalesce(text, F.lit("")))))


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        last = batch.num_columns - 1
        names = [batch.schema.field(i).name for i in range(last)]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(last)], pa.array(word_counts(batch.column(last)))], [*names, "size"])


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, key, size (words)."""
    shared.attach(docs.sparkSession)
    doc_id, source, text = F.col(f"`{id_col}`"), F.col(f"`{source_col}`"), F.col(f"`{text_col}`")
    rows = docs.select(doc_id.alias("doc_id"), source.alias("source"), _key(doc_id, source, text).alias("key"), text.alias("text"))
    return rows.mapInArrow(_sized, T.StructType([*rows.schema.fields[:-1], T.StructField("size", T.LongType())]))


def targets(rows: DataFrame, weights: Sequence[float], share: float = 1.0, most: int = 3) -> DataFrame:
    """source, source_size, target: one row per source.  The windows hold one row per source, never documents."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    each = sums.withColumn("weight", weight).withColumn("cap", (F.lit(most) * F.col("source_size")).cast("double"))
    each = each.withColumn("budget", F.sum("source_size").over(W.partitionBy()) * F.lit(float(share)))
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_cap.rowsBetween(W.currentRow, W.unboundedFollowing))
    each = each.withColumn("level", (F.col("budget") - full) / open_weight)
    fits = F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))
    each = each.withColumn("level", F.min(fits).over(W.partitionBy())["level"])
    target = F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("cap")), F.col("cap"))
    return each.select("source", "source_size", target.alias("target"))


def _running(rows: DataFrame, value: str, by: list[str], part: str, order: list, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows before, in the order of ``part`` and then ``order``, for each ``by``.

    Parts are summed first, so a task gets the sums or one part's rows.
    """
    sums = rows.groupBy(*by, part).agg(F.sum(value).alias("_sum"))
    ahead = F.sum("_sum").over(W.partitionBy(*by).orderBy(part).rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select(*[F.col(c).alias(f"_{c}") for c in by], F.col(part).alias("_part"), F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    own = W.partitionBy(*by, part).orderBy(*order)
    upto = F.sum(value).over(own.rowsBetween(W.unboundedPreceding, W.currentRow))
    out = rows.withColumn("_upto", upto)
    same = F.col(part) == F.col("_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return out.join(sums, same).withColumn(name, F.col("_ahead") + F.col("_upto") - F.col(value)).drop("_upto", "_ahead", "_part", *[f"_{c}" for c in by])


def _copies(groups: DataFrame, most: int) -> DataFrame:
    """Each counted row as ``copies`` rows, numbered by ``copy`` from 0; ``most`` is the largest count."""
    block, last = F.col("_block"), F.col("copies") - 1
    out = groups.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / COPIES).cast("long"))))
    if most > COPIES:
        out = out.repartition("source", "key", "_block")
    own = F.sequence(block * COPIES, F.least(last, block * COPIES + COPIES - 1))
    return out.withColumn("copy", F.explode(own)).drop("_block")


def _grouped(rows: DataFrame, folder: str) -> tuple[DataFrame, int]:
    """The stored rows of ``sized``, equal ones counted in ``copies``, and the largest count."""
    groups = shared.stored(rows.groupBy("doc_id", "source", "key", "size").agg(F.count("*").alias("copies")), folder, "sizes")
    return groups, groups.agg(F.coalesce(F.max("copies"), F.lit(0))).first()[0]


def _goals(groups: DataFrame, weights: Sequence[float], share: float, most: int, folder: str) -> DataFrame:
    whole = groups.select("source", (F.col("size") * F.col("copies")).alias("size"))
    return shared.stored(targets(whole, weights, share, most), folder, "targets").withColumnRenamed("source", "g")


def _with_goals(rows: DataFrame, goals: DataFrame, n_sources: int) -> DataFrame:
    return rows.join(F.broadcast(goals) if n_sources <= BROADCAST_SOURCES else goals, F.col("source").eqNullSafe(F.col("g"))).drop("g")


def _turns(groups: DataFrame, largest: int, goals: DataFrame, n_sources: int, share: float, most: int, cut: str) -> DataFrame:
    """The turns of all rows with words: those of ``groups`` with ``copy``, ``finish`` (virtual time), ``words`` and ``taken``."""
    if cut not in ("words", "documents"):
        raise ValueError(f"unknown cut {cut}")
    n_rows, total = groups.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum(F.col("size") * F.col("copies")), F.lit(0))).first()
    ranges, budget = max(1, int(n_rows**0.5)), int(total * share)
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    keyed = groups.where("size > 0").withColumn("range", F.floor(place * F.lit(ranges) / F.lit(1 << 32)).cast("long")).withColumn("_whole", F.col("size") * F.col("copies"))
    run = _running(keyed, "_whole", ["source"], "range", ["key", "doc_id", "size"], "before").drop("_whole", "range")
    run = _copies(_with_goals(run, goals, n_sources), largest).withColumn("before", F.col("before") + F.col("copy") * F.col("size"))
    turns = run.withColumn("start", F.explode(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda p: F.col("before") + p * F.col("source_size"))))
    end, goal = F.col("start") + F.col("size"), F.floor("target").cast("long")
    part = lambda a, b: F.struct(a.alias("start"), (b - a).alias("words"), F.when(F.col("target") > 0, b / F.col("target")).otherwise(NEVER).alias("finish"))
    whole = F.array(part(F.col("start"), end))
    if cut == "words":
        whole = F.when((F.col("start") < goal) & (goal < end), F.array(part(F.col("start"), goal), part(goal, end))).otherwise(whole)
    turns = turns.withColumn("turn", F.explode(whole)).drop("start").select("*", "turn.*").drop("turn", "before")
    # Finish times run evenly through a source's words, so equal spans of time hold about as many rows.
    turns = turns.withColumn("span", F.floor(F.least("finish", F.lit(1e6)) * ranges).cast("long"))
    turns = _running(turns, "words", [], "span", ["finish", F.col("source").asc_nulls_last(), "start", "key"], "ahead")
    taken = F.greatest(F.least(F.lit(budget) - F.col("ahead"), "words"), F.lit(0)).cast("long")
    if cut == "documents":
        taken = F.when(2 * taken >= F.col("words"), F.col("words")).otherwise(F.lit(0)).cast("long")
    return turns.withColumn("taken", taken)


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: int = 3, cut: str = "words", folder: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per row of ``docs``."""
    folder = folder or shared.shared_folder(docs.sparkSession)
    groups, largest = _grouped(sized(docs, id_col, text_col, source_col), folder)
    goals = _goals(groups, weights, share, most, folder)
    n_sources = goals.count()
    turns = _turns(groups, largest, goals, n_sources, share, most, cut)
    served = turns.groupBy("key", "copy", "source", "doc_id", "size", "source_size", "target").agg(F.sum("taken").alias("taken"))
    without = _copies(_with_goals(groups.where("size = 0"), goals, n_sources), largest).withColumn("taken", F.lit(0).cast("long"))
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    return served.select(columns).unionByName(without.select(columns))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: int = 3, folder: str | None = None) -> DataFrame:
    """The mix itself: whole rows of ``docs`` in order of virtual finish time, range-sorted over all sources.

    A document taken several times stands there several times.  Of rows equal in id, source and text one
    stands for all their turns.  Texts move twice: to their turns, and into order.
    """
    folder = folder or shared.shared_folder(docs.sparkSession)
    groups, largest = _grouped(sized(docs, id_col, text_col, source_col), folder)
    goals = _goals(groups, weights, share, most, folder)
    turns = _turns(groups, largest, goals, goals.count(), share, most, "documents").where("taken > 0").select("key", F.col("finish").alias("_time"))
    full = docs.select(_key(F.col(f"`{id_col}`"), F.col(f"`{source_col}`"), F.col(f"`{text_col}`")).alias("key"), F.struct("*").alias("_row"))
    if largest > 1:
        # The limit of one a key applies before the shuffle too, so copies do not travel.
        full = full.withColumn("_nth", F.row_number().over(W.partitionBy("key").orderBy("key"))).where("_nth = 1").drop("_nth")
    once = full.join(turns, "key")
    return once.orderBy("_time", F.col(f"_row.`{source_col}`").asc_nulls_last(), "key").select("_row.*")
