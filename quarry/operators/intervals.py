"""Interval operators: overlaps, points in intervals, balanced splits, windows of lines.

Interval joins are equi-joins on the file, and on a bucket of the line where a
file may hold many intervals, with the bounds as a residual condition.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry import shipping

BUCKET = 64


def overlap_join(a: DataFrame, b: DataFrame, by: list[str], start_a: str, end_a: str, start_b: str, end_b: str, bucket: int = BUCKET) -> DataFrame:
    """Pairs of intervals of one key that share a point; both sides are cut into buckets so a long key spreads."""
    cut = lambda s, e: F.sequence(F.floor(F.col(s) / bucket), F.floor(F.col(e) / bucket))
    left = a.where(F.col(start_a) <= F.col(end_a)).withColumn("_bucket", F.explode(cut(start_a, end_a)))
    right = b.where(F.col(start_b) <= F.col(end_b)).withColumn("_bucket", F.explode(cut(start_b, end_b)))
    meet = (F.col(start_a) <= F.col(end_b)) & (F.col(start_b) <= F.col(end_a))
    once = F.col("_bucket") == F.greatest(F.floor(F.col(start_a) / bucket), F.floor(F.col(start_b) / bucket))
    return left.join(right, [*by, "_bucket"]).where(meet & once).drop("_bucket")


def points_in_intervals(points: DataFrame, spans: DataFrame, by: list[str], point: str, start: str, end: str, order: list[Column], bucket: int = BUCKET) -> DataFrame:
    """Every distinct point (all columns) with the first interval, in the given ascending order, that holds it.

    Of equal intervals only the first matters, and equal positions have one answer, so each distinct position meets
    each distinct interval of its bucket once, however many points ask.
    """
    columns = [c for c in spans.columns if c not in by]
    spans = spans.where(F.col(start) <= F.col(end)).select(*by, F.col(start).alias("_s"), F.col(end).alias("_e"), F.struct(*columns).alias("_span"), F.struct(*order).alias("_order"))
    spans = spans.groupBy(*by, "_s", "_e").agg(F.min_by("_span", "_order").alias("_span"), F.min("_order").alias("_order"))
    spans = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_s") / bucket), F.floor(F.col("_e") / bucket))))
    places = points.select(*by, point).distinct().withColumn("_bucket", F.floor(F.col(point) / bucket))
    held = places.join(spans, [*by, "_bucket"]).where(F.col(point).between(F.col("_s"), F.col("_e")))
    first = held.groupBy(*by, point).agg(F.min_by("_span", "_order").alias("_span"))
    return points.distinct().join(first, [*by, point]).select(*points.columns, *[F.col(f"_span.`{c}`") for c in columns])


def balanced_split(chunks: DataFrame, start: str, end: str, limit: int) -> DataFrame:
    """Chunks longer than the limit in ceil(n / limit) pieces; the first n mod pieces get one line more."""
    total = F.col(end) - F.col(start) + 1
    out = chunks.withColumn("_n", total).withColumn("_p", F.greatest(F.ceil(F.col("_n") / limit), F.lit(1)).cast("int"))
    out = out.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("_p") - 1)))
    base, extra = F.expr("_n div _p"), F.expr("_n % _p")
    first = F.col(start) + F.col("piece") * base + F.least(F.col("piece"), extra)
    size = base + F.when(F.col("piece") < extra, 1).otherwise(0)
    return out.withColumn("piece_start", first.cast("bigint")).withColumn("piece_end", (first + size - 1).cast("bigint")).drop("_n", "_p")


def definitions(points: DataFrame, occurrences: DataFrame, k: int = 8) -> DataFrame:
    """Definitions of the symbol at each (query_id, file, line, character): narrowest occurrence, then the same symbol.

    Symbols that start with ``local `` belong to their file.
    """
    return _related(points, occurrences, F.col("roles").bitwiseAND(1) == 1, k)


def references(points: DataFrame, occurrences: DataFrame, include_declaration: bool = True, k: int = 40) -> DataFrame:
    return _related(points, occurrences, F.lit(True) if include_declaration else F.col("roles").bitwiseAND(1) == 0, k)


def at_position(points: DataFrame, occurrences: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """query_id, file and symbol of the narrowest occurrence that holds a query's position (end exclusive within a line).

    Distinct positions and distinct ranges meet by file and bucket of lines, so a file with many of both is spread.
    """
    ends = ["start_line", "start_char", "end_line", "end_char"]
    o = occurrences.where("start_line <= end_line").groupBy("file", *ends).agg(F.min("symbol").alias("symbol"))
    o = o.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start_line") / bucket), F.floor(F.col("end_line") / bucket))))
    p = points.select("file", "line", "character").distinct().withColumn("_bucket", F.floor(F.col("line") / bucket))
    after = (F.col("start_line") < F.col("line")) | ((F.col("start_line") == F.col("line")) & (F.col("start_char") <= F.col("character")))
    before = (F.col("line") < F.col("end_line")) | ((F.col("line") == F.col("end_line")) & (F.col("character") < F.col("end_char")))
    narrow = F.struct((F.col("end_line") - F.col("start_line")).alias("lines"), (F.col("end_char") - F.col("start_char")).alias("width"), "start_line", "start_char", "symbol")
    held = p.join(o, ["file", "_bucket"]).where(after & before).groupBy("file", "line", "character").agg(F.min(narrow).alias("_held"))
    asked = points.select("query_id", "file", "line", "character").join(held, ["file", "line", "character"])
    return asked.groupBy("query_id").agg(F.min(F.struct("_held", "file")).alias("_f")).select("query_id", "_f.file", "_f._held.symbol")


def _related(points: DataFrame, occurrences: DataFrame, keep: Column, k: int) -> DataFrame:
    """The first places of each symbol are ranked once and joined to the queries that found it."""
    scope = F.when(F.col("symbol").startswith("local "), F.col("file")).otherwise(F.lit(""))
    place = ["file", "start_line", "start_char", "end_line", "end_char"]
    others = occurrences.where(keep).select("symbol", scope.alias("scope"), *place).distinct()
    others = others.withColumn("rank", F.row_number().over(W.partitionBy("symbol", "scope").orderBy(*place))).where(F.col("rank") <= max(1, k))
    found = at_position(points, occurrences).select("query_id", "symbol", scope.alias("scope"))
    return found.join(others, ["symbol", "scope"]).select("query_id", *place, "symbol", "rank")


def islands(rows: DataFrame, by: list[str], start: str, end: str, gap: int) -> DataFrame:
    """Intervals of a key merged where at most ``gap`` points lie between them."""
    order = W.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(F.coalesce(F.col(start) > reach + gap, F.lit(True)), 1).otherwise(0)
    out = rows.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return out.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_island")


#: Lines of a stretch; a file's spans are looked at stretch by stretch when islands are cut.
STRETCH = 4096


def with_island(spans: DataFrame, gap: int, first: str = "first", last: str = "last", by: str = "file", stretch: int = STRETCH) -> DataFrame:
    """Adds ``island``: spans of a file share one unless more than ``gap`` points lie between them, over any number of spans between.

    No task sees all spans of a file.  A span reaches into one stretch or more; per stretch, where the spans that begin
    earlier end is a running maximum over stretches.  A span begins an island if it starts beyond what all spans before it
    reach; the number of an island is its first point.  Spans without first or last point, or that end before they
    begin, are islands of their own.
    """
    whole = spans.withColumn("_ok", F.coalesce(F.col(first) <= F.col(last), F.lit(False)))
    part = F.call_function("div", F.col(first).cast("bigint") - F.pmod(F.col(first).cast("bigint"), F.lit(stretch)), F.lit(stretch).cast("bigint"))
    distinct = whole.where("_ok").groupBy(by, F.col(first).alias("_first"), part.alias("_part")).agg(F.max(last).alias("_reach"))
    ends = distinct.groupBy(by, "_part").agg(F.max("_reach").alias("_end"))
    before = W.partitionBy(by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(by, "_part", F.max("_end").over(before).alias("_before"))
    order = W.partitionBy(by, "_part").orderBy("_first")
    reach = F.max("_reach").over(order.rowsBetween(W.unboundedPreceding, -1))
    placed = distinct.join(ends, [by, "_part"]).withColumn("_reached", F.greatest(reach, "_before"))
    begins = F.when(F.coalesce(F.col("_first") > F.col("_reached") + gap + 1, F.lit(True)), F.col("_first"))
    placed = placed.withColumn("_begin", F.max(begins).over(order))
    starts = placed.groupBy(by, "_part").agg(F.max("_begin").alias("_last"))
    starts = starts.select(by, "_part", F.max("_last").over(before).alias("_carried"))
    placed = placed.join(starts, [by, "_part"]).select(by, F.col("_first").alias(first), F.coalesce("_begin", "_carried").alias("island"))
    out = whole.join(placed, [by, first], "left")
    return out.withColumn("island", F.when(F.col("_ok"), F.col("island"))).drop("_ok")


def first_fit_windows(anchors: DataFrame, gap: int = 8, most: int = 200, stretch: int = STRETCH) -> DataFrame:
    """file, first, last: anchors (file, rank, first, last) join, in rank order, the first window they fit into.

    Anchors with more than ``gap`` points between them never share a window, nor do windows of different islands ever meet,
    so each island of a file is folded alone; its windows are kept in the order in which they began, and an anchor looks
    only at those that begin near it.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        windows: list[list[int]] = []
        near: dict[int, set[int]] = {}  # numbers of windows by the stretches of ``most`` points that they may take anchors from
        for first, last in pdf.sort_values(["rank", "first", "last"])[["first", "last"]].itertuples(index=False):
            found = sorted(near.get(first // most, ()))
            for n in found:
                w = windows[n]
                low, high = min(w[0], first), max(w[1], last)
                if first <= w[1] + gap and last >= w[0] - gap and high - low + 1 <= most:
                    w[0], w[1] = low, high
                    break
            else:
                n = len(windows)
                windows.append([first, last])
            for k in range((windows[n][0] - most) // most, (windows[n][1] + gap) // most + 1):
                near.setdefault(k, set()).add(n)
        return pd.DataFrame({"file": pdf["file"].iloc[0], "first": [w[0] for w in windows], "last": [w[1] for w in windows]})

    anchors = anchors.where("first is not null and last is not null")
    return with_island(anchors, gap, stretch=stretch).groupBy("file", "island").applyInPandas(fit, "file string, first bigint, last bigint")


def distinct_spans(spans: DataFrame, by: list[str] | None = None, stretch: int = STRETCH) -> DataFrame:
    """Spans (file, rank, first, last) that overlap no span kept before them, for each file (or each ``by``).

    Spans of different islands do not overlap, so each island is folded alone: those of one span stay as they are, others
    pass through Python sorted by island and rank, many islands a batch.  Kept spans are disjoint: a new one is compared
    with its two neighbours.
    """
    by = by or ["file"]
    shipping.attach(spans.sparkSession)
    keys = [*by, "island"]
    rows = with_island(spans.withColumn("_group", F.struct(*by)), -1, by="_group", stretch=stretch).drop("_group")
    rows = rows.withColumn("_n", F.count("*").over(W.partitionBy(*keys)))
    alone = rows.where("_n = 1 AND first <= last")  # a span that ends before it begins may still be refused by its like
    many = rows.where("NOT (_n = 1 AND coalesce(first <= last, false))").select(F.struct(*keys).alias("_key"), "rank", "first", "last", F.struct(*spans.columns).alias("_row"))
    many = many.withColumn("_key", F.to_json("_key", {"ignoreNullFields": "false"})).repartition("_key").sortWithinPartitions("_key", "rank")
    schema = T.StructType([T.StructField("_row", many.schema["_row"].dataType)])
    kept = many.mapInArrow(_kept_spans, schema).select("_row.*")
    return alone.select(*spans.columns).unionByName(kept)


def _kept_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that overlap none kept before them of their key; rows come sorted by key and rank."""
    key, firsts, lasts = None, [], []
    for batch in batches:
        kept = []
        for i, (own, first, last) in enumerate(zip(batch["_key"].to_pylist(), batch["first"].to_pylist(), batch["last"].to_pylist())):
            if own != key:
                key, firsts, lasts = own, [], []
            if first is not None and last is not None:
                at = bisect.bisect_right(firsts, last)
                if at and lasts[at - 1] >= first:
                    continue
                firsts.insert(at, first)
                lasts.insert(at, last)
            kept.append(i)
        yield pa.RecordBatch.from_arrays([batch["_row"].take(pa.array(kept, pa.int64()))], ["_row"])


def chunk_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Plain text in chunks at blank lines: (file, chunk, first, last, content)."""
    for pdf in batches:
        rows = []
        for file, text in zip(pdf["file"], pdf["text"]):
            lines, begin, chunk = (text or "").split("\n"), None, 0
            for i, line in enumerate([*lines, ""]):
                if line.strip() and begin is None:
                    begin = i
                elif not line.strip() and begin is not None:
                    rows.append((file, chunk, begin, i - 1, "\n".join(lines[begin:i])))
                    begin, chunk = None, chunk + 1
        yield pd.DataFrame(rows, columns=["file", "chunk", "first", "last", "content"])
