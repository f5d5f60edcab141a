"""Fact tables: definition indexes, edge resolution, merging, comparison, containment."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import canonical

from . import ordered
from .graph import checkpointed


def definition_index(symbols: DataFrame, moniker: str, symbol: str) -> DataFrame:
    """moniker, n, symbol: the symbol only where it is the only one."""
    out = symbols.groupBy(moniker).agg(F.count("*").alias("n"), F.min(symbol).alias("_one"))
    return out.select(moniker, "n", F.when(F.col("n") == 1, F.col("_one")).alias(symbol))


def resolve_edges(edges: DataFrame, symbols: DataFrame, moniker: str, symbol: str) -> DataFrame:
    """Edges with ``target`` set where their moniker names one symbol."""
    unique = definition_index(symbols, moniker, symbol).where("n = 1").select(moniker, F.col(symbol).alias("target"))
    return edges.join(unique, moniker, "left").withColumn("provenance", F.when(F.col("target").isNull(), "unresolved").otherwise("exact"))


def rule_edges(rules: DataFrame, symbols: DataFrame, kind: str, confidence: float = 0.9) -> DataFrame:
    """New edges from rules (source_moniker, target_moniker) whose both ends name one symbol each."""
    u = definition_index(symbols, "moniker", "symbol").where("n = 1")
    one = u.select(F.col("moniker").alias("source_moniker"), F.col("symbol").alias("source"))
    two = u.select(F.col("moniker").alias("target_moniker"), F.col("symbol").alias("target"))
    return rules.join(one, "source_moniker").join(two, "target_moniker").select("source", "target", F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"))


def set_difference(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Rows only in one of two tables, marked missing or extra."""
    return reference.subtract(candidate).withColumn("side", F.lit("missing")).unionByName(candidate.subtract(reference).withColumn("side", F.lit("extra")))


def conflicts(facts: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Keys that facts describe in more than one way."""
    return facts.groupBy(key).agg(F.countDistinct(*values).alias("variants")).where("variants > 1")


def merge_nodes(one: DataFrame, two: DataFrame, key: str, rank: str) -> DataFrame:
    """The union of two node tables; of a node the row of highest rank (a definition before a reference) stays."""
    both = one.unionByName(two)
    best = F.row_number().over(W.partitionBy(key).orderBy(F.col(rank).desc()))
    return both.withColumn("_n", best).where("_n = 1").drop("_n")


def infer_parents(symbols: DataFrame, containers: DataFrame) -> DataFrame:
    """vid, parent: the longest container label of the file that is a dotted prefix of the symbol's and whose lines hold it."""
    s = symbols.select("vid", "file", "label", F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("label", r"\.")) - 1, F.lit(1))), lambda n: F.array_join(F.slice(F.split("label", r"\."), 1, n), "."))
    p = s.select("vid", "file", "label", "s", "e", F.explode(prefixes).alias("prefix")).where("prefix <> label")
    c = containers.select("file", F.col("label").alias("prefix"), F.col("start_line").alias("cs"), F.col("end_line").alias("ce"))
    held = p.join(c, ["file", "prefix"]).where("cs <= s AND e <= ce").groupBy("vid").agg(F.max(F.struct(F.length("prefix"), "prefix"))["prefix"].alias("parent"))
    return s.select("vid").join(held, "vid", "left")


def batches(facts: DataFrame, file: str, columns: list[str], most: int = 10_000) -> DataFrame:
    """file, part, symbols, digest: runs of ``most`` facts of a file in the order of ``columns`` (the first a number).

    Places within a file come from sums over ranges of the first column, so no task holds a file.  The digest is that of
    the canonical JSON of file, part and symbols: equal facts give equal batches, whatever the order they came in.
    """
    rows = ordered.with_range(facts.select(file, *columns), columns[0], "_range")
    rows = rows.withColumn("_range", F.when(F.col(columns[0]).isNull(), -1).otherwise(F.col("_range")))
    rows = rows.withColumn("_file", F.struct(file))  # a null file joins itself
    rows = ordered.sum_before(rows, F.lit(1), ["_file"], "_range", [F.col(c) for c in columns], "_nth")
    rows = rows.withColumn("part", F.floor(F.col("_nth") / most).cast("bigint"))
    out = rows.groupBy(file, "part").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("symbols"))
    whole = F.struct(file, "part", "symbols")
    return out.withColumn("digest", canonical.digest(whole, out.select(whole.alias("x")).schema["x"].dataType))


Pass = Callable[[DataFrame, DataFrame], DataFrame]


def exact_pass(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """id, target, confidence: open edges whose moniker names one symbol."""
    unique = definition_index(symbols, "moniker", "symbol").where("n = 1").select("moniker", F.col("symbol").alias("target"))
    return edges.join(unique, "moniker").select("id", "target", F.lit(1.0).alias("confidence"))


def same_file_pass(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Open edges whose moniker names one symbol of the edge's own file."""
    own = symbols.groupBy("file", "moniker").agg(F.count("*").alias("n"), F.min("symbol").alias("target")).where("n = 1")
    return edges.join(own, ["file", "moniker"]).select("id", "target", F.lit(0.9).alias("confidence"))


def resolve_in_passes(edges: DataFrame, symbols: DataFrame, passes: Sequence[tuple[str, Pass]]) -> tuple[DataFrame, DataFrame]:
    """Resolved edges and a report, by passes in order: what a pass resolves is closed to those after it.

    ``edges`` has id (distinct), moniker and file; a pass takes the open edges and the symbols and returns id, target and
    confidence, at most one row an edge (of several the smallest target stays).  Edges gain target, confidence and pass,
    all null where none resolves them.  The report has pass, place, seen (open edges before it) and resolved, counted by
    ``observe`` in the job that writes the pass, so nothing is counted twice.
    """
    open_, done, report = edges, None, []
    for place, (name, one) in enumerate(passes):
        got = one(open_, symbols).groupBy("id").agg(F.min(F.struct("target", "confidence")).alias("_t"))
        seen = Observation()
        marked = open_.join(got, "id", "left").withColumn("pass", F.when(F.col("_t").isNotNull(), F.lit(name)))
        marked = checkpointed(marked.observe(seen, F.count("*").alias("seen"), F.count("pass").alias("resolved")))
        counts = seen.get
        report.append((name, place, counts["seen"], counts["resolved"]))
        closed = marked.where("pass is not null").select(*edges.columns, "_t.target", "_t.confidence", "pass")
        done = closed if done is None else done.unionByName(closed)
        open_ = marked.where("pass is null").select(*edges.columns)
    null = lambda c, kind: F.lit(None).cast(kind).alias(c)
    rest = open_.select("*", null("target", symbols.schema["symbol"].dataType), null("confidence", "double"), null("pass", "string"))
    resolved = rest if done is None else done.unionByName(rest)
    return resolved, edges.sparkSession.createDataFrame(report, "pass string, place int, seen bigint, resolved bigint")
