"""Retrieval-quality metrics: set metrics at cutoffs, span overlap, line-budget gains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as T

from . import intervals


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def set_metrics(predictions: Column, targets: Column) -> list[Column]:
    """hits, precision, recall, accuracy: precision divides by the list as given; accuracy means all targets were found."""
    wanted = F.array_distinct(targets)
    hits = F.size(F.array_intersect(predictions, wanted))
    return [
        hits.alias("hits"),
        ratio(hits, F.greatest(F.size(predictions), F.lit(1))).alias("precision"),
        ratio(hits, F.size(wanted)).alias("recall"),
        F.when((F.size(wanted) > 0) & (hits == F.size(wanted)), 1.0).otherwise(0.0).alias("accuracy"),
    ]


def at_cutoffs(ranked: DataFrame, targets: DataFrame, by: list[str], item: str, rank: str, ks: list[int]) -> DataFrame:
    """Set metrics of each query's first k items for every k.  Nothing is gathered per query: items are counted."""
    cut = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    truth = targets.select(*by, item).distinct()
    sizes = truth.groupBy(*by).agg(F.count("*").alias("n_targets"))
    kept = ranked.where(F.col(rank) <= max(ks)).join(truth.withColumn("hit", F.col(item)), [*by, item], "left")
    rows = kept.select(*by, item, rank, "hit", cut).where(F.col(rank) <= F.col("k"))
    out = rows.groupBy(*by, "k").agg(F.count("*").alias("n"), F.countDistinct("hit").alias("hits")).join(sizes, by, "left")
    n = F.coalesce("n_targets", F.lit(0))
    return out.select(
        *by, "k", "hits", F.round(ratio(F.col("hits"), F.greatest("n", F.lit(1))), 6).alias("precision"), F.round(ratio(F.col("hits"), n), 6).alias("recall"),
        F.when((n > 0) & (F.col("hits") == n), 1.0).otherwise(0.0).alias("accuracy"),
    )


def averaged(metrics: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    return metrics.groupBy(*by).agg(*[F.round(F.avg(v), 6).alias(v) for v in values], F.count("*").alias("n"))


def block_metrics(spans: DataFrame, blocks: DataFrame, by: list[str]) -> DataFrame:
    """Per query: predicted spans and true blocks that overlap, as precision and recall.  Both have file, first, last."""
    s = spans.select(*by, "file", F.col("first").alias("s1"), F.col("last").alias("e1"))
    b = blocks.select(*by, "file", F.col("first").alias("s2"), F.col("last").alias("e2"))
    meet = s.join(b, [*by, "file"]).where("s1 <= e2 AND s2 <= e1")
    hits = meet.groupBy(*by).agg(F.countDistinct("file", "s1", "e1").alias("span_hits"), F.countDistinct("file", "s2", "e2").alias("block_hits"))
    n = s.groupBy(*by).agg(F.count("*").alias("spans")).join(b.groupBy(*by).agg(F.count("*").alias("blocks")), by, "full")
    out = n.join(hits, by, "left").fillna(0)
    return out.select(*by, "spans", "blocks", ratio(F.col("span_hits"), F.col("spans")).alias("precision"), ratio(F.col("block_hits"), F.col("blocks")).alias("recall"))


def resolved(first: Column, last: Column, n_lines: Column) -> tuple[Column, Column]:
    """First and last line of a region, null if it has none.

    An end of -1 is the file's end and a negative start counts from there; both need the file's length, and only such
    regions are clamped to it.
    """
    from_end = (last == -1) | (first < 0)
    known = from_end & (n_lines >= 1)
    inside = lambda c: F.greatest(F.least(c, n_lines), F.lit(1))
    plain = ~from_end & (last >= 1)
    start = F.when(known, inside(F.when(first < 0, n_lines + first + 1).otherwise(first))).when(plain, F.greatest(first, F.lit(1)))
    end = F.when(known, inside(F.when(last == -1, n_lines).otherwise(last))).when(plain, last)
    return start, end


def covered(rows: DataFrame, spans: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """``rows`` and, for each name, how many distinct points of those spans lie from a row's ``first`` to its ``last``; 0 where it has none.

    Both have ``by``, first and last.  Spans are merged, then rows and spans lie in order of place: the points up to a place
    are a running sum, less what the last span begun there has beyond it.  So the cost follows the number of rows and spans,
    not their lengths, and nothing is compared pair by pair.
    """
    both = rows.withColumns({"_row": F.lit(True), "_upto": F.col("last").cast("bigint"), "_ahead": F.col("first").cast("bigint") - 1})
    for name, df in spans.items():
        held = intervals.islands(df.select(*by, F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last")).where("first <= last").dropna(subset=by), by, "first", "last", 0)
        held = held.select(*by, F.col("first").alias("_upto"), F.col("first").alias("_ahead"), (F.col("last") - F.col("first") + 1).alias(f"_n_{name}"), F.col("last").alias(f"_end_{name}"))
        both = both.unionByName(held, allowMissingColumns=True)

    def points(name: str, place: str) -> Column:
        order = W.partitionBy(*by).orderBy(place)
        beyond = F.coalesce(F.max(f"_end_{name}").over(order) - F.col(place), F.lit(0))
        return F.coalesce(F.sum(f"_n_{name}").over(order), F.lit(0)) - F.greatest(beyond, F.lit(0))

    both = both.withColumns({f"_to_{name}": points(name, "_upto") for name in spans}).withColumns({f"_from_{name}": points(name, "_ahead") for name in spans})
    some = F.col("first") <= F.col("last")
    return both.where("_row").select(*rows.columns, *[F.when(some, F.col(f"_to_{name}") - F.col(f"_from_{name}")).otherwise(0).alias(name) for name in spans])


def _spans_of(core: DataFrame, by: list[str]) -> DataFrame:
    """by, file, first, last, of spans or of single lines (``line``)."""
    return core.select(*by, "file", *([F.col("line").alias(x) for x in ("first", "last")] if "line" in core.columns else ["first", "last"]))


def region_gains(regions: DataFrame, core: DataFrame, main_files: DataFrame, by: list[str], rank: str) -> DataFrame:
    """by, rank, gain, lines: a region's core lines, 1.5 each in a main file, and its size; 0 and 0 where it has no lines.

    Regions: by, rank, file, first, last (resolved or null); core: by, file and first, last or line; main_files: by, file.
    """
    return _gained(covered(regions, {"_core": _spans_of(core, by)}, [*by, "file"]), main_files, by, rank).select(*by, rank, "gain", "lines")


def _gained(rows: DataFrame, main_files: DataFrame, by: list[str], rank: str) -> DataFrame:
    """Adds gain and lines to regions that know their ``_core`` lines; regions of one rank share their hits."""
    hits = F.sum("_core").over(W.partitionBy(*by, rank))
    rows = rows.withColumn("_hits", hits).join(main_files.select(*by, "file").distinct().withColumn("_main", F.lit(1.5)), [*by, "file"], "left")
    lines = F.coalesce(F.greatest(F.col("last") - F.col("first") + 1, F.lit(0)), F.lit(0))
    return rows.withColumn("gain", F.col("_hits") * F.coalesce("_main", F.lit(1.0))).withColumn("lines", lines)


def dcg(gains: DataFrame, by: list[str], rank: str, gain: str, lines: str, budget: int) -> DataFrame:
    """Discounted gain up to the first region that exceeds the line budget; the first region always counts."""
    order = W.partitionBy(*by).orderBy(rank)
    run = F.sum(lines).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = gains.withColumn("_i", F.row_number().over(order)).withColumn("_run", run).where((F.col("_run") <= budget) | (F.col("_i") == 1))
    return rows.groupBy(*by).agg(F.sum(F.col(gain) / F.log2(F.col("_i") + 1)).alias("dcg"))


def ndcg(gains: DataFrame, by: list[str], rank: str, gain: str, lines: str, budget: int) -> DataFrame:
    """DCG over that of the regions by gain per line, at most 1."""
    dense = F.row_number().over(W.partitionBy(*by).orderBy((F.col(gain) / F.greatest(F.col(lines), F.lit(1))).desc(), rank))
    ideal = dcg(gains.withColumn("_ideal", dense), by, "_ideal", gain, lines, budget).withColumnRenamed("dcg", "best")
    out = dcg(gains, by, rank, gain, lines, budget).join(ideal, by)
    return out.select(*by, F.round(F.least(ratio(F.col("dcg"), F.col("best")), F.lit(1.0)), 6).alias("ndcg"))


def recall_at_lines(regions: DataFrame, core: DataFrame, by: list[str], rank: str, budget: int) -> DataFrame:
    """Core lines among the first ``budget`` lines of the regions in order, lines read twice counted twice.

    Core: by, file and first, last or line.  Only where regions of one rank exceed the budget together are lines listed, at
    most ``budget`` of each.
    """
    place, core = [*by, "file"], _spans_of(core, by)
    rows = regions.where("first <= last").select(*by, "file", rank, F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"))
    rows = rows.withColumn("_n", F.col("last") - F.col("first") + 1)
    equal = W.partitionBy(*by, rank)
    rows = rows.withColumn("_upto", F.sum("_n").over(W.partitionBy(*by).orderBy(rank))).withColumn("_own", F.sum("_n").over(equal)).withColumn("_equals", F.count("*").over(equal))
    rows = rows.withColumn("_left", budget - (F.col("_upto") - F.col("_own"))).where("_left > 0")
    shared = (F.col("_own") > F.col("_left")) & (F.col("_equals") > 1)
    whole = rows.where(~shared).select(*place, "first", F.least(F.col("last"), F.col("first") + F.col("_left") - 1).alias("last"))
    line = F.explode(F.sequence("first", F.least(F.col("last"), F.col("first") + F.col("_left") - 1))).alias("line")
    listed = rows.where(shared).select(*place, rank, "_left", "first", line)
    listed = listed.withColumn("_nth", F.row_number().over(equal.orderBy("line", "file", "first"))).where("_nth <= _left")
    read = intervals.islands(whole.unionByName(listed.select(*place, F.col("line").alias("first"), F.col("line").alias("last"))), place, "first", "last", 0)
    hit = covered(read, {"_hits": core}, place).groupBy(*by).agg(F.sum("_hits").alias("hits"))
    n = intervals.islands(core, place, "first", "last", 0).groupBy(*by).agg(F.sum(F.when(F.col("file").isNotNull(), F.col("last") - F.col("first") + 1)).alias("n"))
    return n.join(hit, by, "left").select(*by, F.round(ratio(F.coalesce("hits", F.lit(0)), F.coalesce("n", F.lit(0))), 6).alias("recall"))


def first_useful(regions: DataFrame, hit: Column, by: list[str], rank: str) -> DataFrame:
    """1 - i / n for the first useful region i from 0, else 0."""
    out = regions.groupBy(*by).agg(F.count("*").alias("n"), F.min(F.when(hit, F.col(rank))).alias("i"))
    return out.select(*by, F.coalesce(1 - (F.col("i") - 1) / F.col("n"), F.lit(0.0)).alias("first_useful"))


def predictions(nodes: DataFrame, by: list[str], rank: str) -> tuple[DataFrame, DataFrame]:
    """(files, symbols) a ranking predicts: files of node ids once each in order, and every symbol that has a name."""
    file = T.normalized_path(F.substring_index("node_id", ":", 1))
    files = nodes.where(F.coalesce("node_id", F.lit("")) != "").select(*by, rank, file.alias("item")).where("item IS NOT NULL")
    files = files.groupBy(*by, "item").agg(F.min(rank).alias("_first"))
    files = files.select(*by, "item", F.row_number().over(W.partitionBy(*by).orderBy("_first")).alias("rank"))
    symbol = T.normalized_symbol(F.col("node_id"))
    symbols = nodes.where(F.col("node_id").contains(":")).select(*by, rank, symbol.alias("item")).where("item IS NOT NULL")
    return files, symbols.select(*by, "item", F.row_number().over(W.partitionBy(*by).orderBy(rank)).alias("rank"))


def node_spans(nodes: DataFrame, by: list[str], by_score: bool = True) -> DataFrame:
    """by, file, first, last (from 1), rank: the spans of retrieved nodes, by falling score; the id's file before the path."""
    file = F.when(F.col("node_id").contains(":"), F.substring_index("node_id", ":", 1)).otherwise(F.col("file"))
    rows = nodes.select(*by, T.normalized_path(file).alias("file"), (F.col("start_line") + 1).alias("first"), (F.col("end_line") + 1).alias("last"), F.coalesce("score", F.lit(0.0)).alias("score"), F.col("rank").alias("_rank"))
    rows = rows.where("file IS NOT NULL AND first IS NOT NULL AND last >= first AND first >= 1")
    order = [F.col("score").desc(), "_rank"] if by_score else ["_rank"]
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).drop("_rank", "score")


def answer_spans(answers: DataFrame, by: list[str], answer: str) -> DataFrame:
    """by, file, first, last, rank: ``file:first-last`` places of an answer's ``Locations:`` lines, in order."""
    lines = F.array_join(F.regexp_extract_all(answer, F.lit(r"(?im)^[ \t*_]*Locations[*_]*:[*_]*[ \t]*(.+)$"), F.lit(1)), " ")
    token = r"[\w./+\-]+\.\w+:[0-9]+(?:-[0-9]+)?"
    rows = answers.select(*by, F.posexplode(F.regexp_extract_all(lines, F.lit(token), F.lit(0))).alias("rank", "t"))
    first = F.regexp_extract("t", r":([0-9]+)", 1).cast("bigint")
    last = F.coalesce(F.regexp_extract("t", r"-([0-9]+)$", 1).try_cast("bigint"), first)
    out = rows.select(*by, T.normalized_path(F.substring_index("t", ":", 1)).alias("file"), first.alias("first"), last.alias("last"), (F.col("rank") + 1).alias("rank"))
    return out.where("file IS NOT NULL AND first >= 1 AND last >= first")


def blocks_at(spans: DataFrame, blocks: DataFrame, by: list[str], ks: list[int]) -> DataFrame:
    """by, k, hits, precision, recall, accuracy of the first k spans that overlap none before them; no blocks: all 0.

    ``spans`` are those of ``intervals.distinct_spans`` (rank order kept); a block is recalled, and a span on target, if
    the two share a line.
    """
    s = spans.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy("rank"))).where(F.col("_n") <= max(ks)).select(*by, "_n", "file", F.col("first").alias("_s1"), F.col("last").alias("_e1"))
    b = blocks.select(*by, "file", F.col("first").alias("_s2"), F.col("last").alias("_e2"), F.monotonically_increasing_id().alias("_b"))
    met = s.join(b, [*by, "file"]).where("_s1 <= _e2 AND _s2 <= _e1")
    cut = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    hits = met.select(*by, "_n", "_b", cut).where("_n <= k").groupBy(*by, "k").agg(F.countDistinct("_b").alias("hits"), F.countDistinct("_n").alias("_on"))
    n = s.select(*by, "_n", cut).where("_n <= k").groupBy(*by, "k").agg(F.count("*").alias("_spans"))
    true = blocks.groupBy(*by).agg(F.count("*").alias("_blocks"))
    every = s.select(*by).union(blocks.select(*by)).distinct().select(*by, cut)
    out = every.join(n, [*by, "k"], "left").join(hits, [*by, "k"], "left").join(true, by, "left").fillna(0, ["_spans", "hits", "_on", "_blocks"])
    some = F.col("_blocks") > 0
    return out.select(
        *by, "k", "hits", F.when(some, F.round(F.col("_on") / F.greatest("_spans", F.lit(1)), 6)).otherwise(0.0).alias("precision"),
        F.when(some, F.round(F.col("hits") / F.col("_blocks"), 6)).otherwise(0.0).alias("recall"), F.when(some & (F.col("hits") == F.col("_blocks")), 1.0).otherwise(0.0).alias("accuracy"),
    )


def region_report(regions: DataFrame, core: DataFrame, optional: DataFrame, main_files: DataFrame, n_lines: DataFrame, by: list[str], budgets: tuple[int, ...] = (100, 300, 500)) -> DataFrame:
    """The region metrics of each group: lines, files, regions, weighted coverage, and nDCG and recall under line budgets.

    regions: by, rank, file, first, last; core and optional: by, file, first, last; main_files: by, file; n_lines: file,
    n_lines.  Regions may end at -1 or start before 0 (see ``resolved``); one without lines counts as a region, not as
    lines.  Lines are counted by their spans (see ``covered``), never listed.
    """
    def settled(rows: DataFrame) -> DataFrame:
        rows = rows.join(n_lines, "file", "left")
        first, last = resolved(F.col("first"), F.col("last"), F.col("n_lines"))
        return rows.withColumns({"_f": first, "_l": last}).drop("first", "last", "n_lines").withColumnsRenamed({"_f": "first", "_l": "last"})

    def merged(rows: DataFrame) -> DataFrame:
        return intervals.islands(rows.where("first <= last"), place, "first", "last", 0)

    def size_of(spans: DataFrame, name: str) -> DataFrame:
        return spans.groupBy(*by).agg(F.sum(F.col("last") - F.col("first") + 1).alias(name))

    place = [*by, "file"]
    r, c, o = settled(regions), settled(core), settled(optional)
    spans = {"_core": _spans_of(c, by), "_target": _spans_of(c, by).unionByName(_spans_of(o, by)), "_opt": _spans_of(o, by)}
    pred = covered(merged(r), spans, place).groupBy(*by).agg(
        F.sum(F.col("last") - F.col("first") + 1).alias("p"), F.sum("_core").alias("pc"), F.sum("_target").alias("pu"), F.sum("_opt").alias("po"),
    )
    sums = pred.join(size_of(merged(c), "c"), by, "full").join(size_of(merged(o), "o"), by, "full").fillna(0)
    kinds = {"v": r, "cf": c, "of": o}
    files = None
    for kind, rows in kinds.items():
        one = rows.select(*by, "file", F.when(F.col("file").isNull(), F.lit(kind)).alias("_alone"), *[F.lit(int(x == kind)).alias(x) for x in kinds])
        files = one if files is None else files.unionByName(one)
    files = files.groupBy(*by, "file", "_alone").agg(*[F.max(x).alias(x) for x in kinds])
    files = files.groupBy(*by).agg(F.sum("v").alias("v"), F.sum("cf").alias("cf"), F.sum(F.col("v") * F.col("cf")).alias("vc"), F.sum(F.col("v") * (1 - F.greatest("cf", "of"))).alias("noise"))
    # A region of known lines meets a target if one of its lines is one of the target's.
    order = W.partitionBy(*by).orderBy("rank")
    dense = W.partitionBy(*by).orderBy((F.col("gain") / F.greatest(F.col("lines"), F.lit(1))).desc(), "rank")
    upto = (W.unboundedPreceding, W.currentRow)
    own = _gained(covered(r, {x: spans[x] for x in ("_core", "_target")}, place), main_files, by, "rank") if budgets else covered(r, {x: spans[x] for x in ("_core", "_target")}, place)
    n = [F.count("*").alias("regions"), F.countDistinct(F.when(F.col("_target") > 0, F.col("rank"))).alias("on_target"), F.min(F.when(F.col("_core") > 0, F.col("rank"))).alias("_useful")]
    if budgets:
        own = own.withColumn("_i", F.row_number().over(order)).withColumn("_run", F.sum("lines").over(order.rowsBetween(*upto))).withColumn("_j", F.row_number().over(dense)).withColumn("_best", F.sum("lines").over(dense.rowsBetween(*upto)))
        total = lambda i, run, budget: F.sum(F.when((F.col(run) <= budget) | (F.col(i) == 1), F.col("gain") / F.log2(F.col(i) + 1)))
        n += [F.round(F.least(ratio(total("_i", "_run", b), total("_j", "_best", b)), F.lit(1.0)), 6).alias(f"ndcg_at_{b}") for b in budgets]
    n = own.groupBy(*by).agg(*n)
    parts = covered(c.where("first <= last"), {"_p": _spans_of(r, by)}, place)
    parts = parts.join(main_files.select(*by, "file").distinct().withColumn("_w", F.lit(3.0)), place, "left").withColumn("_w", F.coalesce("_w", F.lit(2.0)))
    share = F.col("_p") / (F.col("last") - F.col("first") + 1)
    cover = parts.groupBy(*by).agg(F.sum((F.col("_p") > 0).cast("bigint")).alias("met"), ratio(F.sum(F.col("_w") * share), F.sum("_w")).alias("weighted_core_coverage"))
    targets = c.groupBy(*by).agg(F.count("*").alias("targets"))
    out = sums.join(files, by, "full").join(n, by, "full").join(targets, by, "left").join(cover, by, "left")
    for budget in budgets:
        part = recall_at_lines(r, merged(c), by, "rank", budget)
        out = out.join(part.withColumnRenamed("recall", f"recall_at_{budget}"), by, "left")
    out = out.fillna(0, [x for x in out.columns if x != "_useful"])
    place_of = r.select(*by, F.col("rank").alias("_useful"), (F.row_number().over(order) - 1).alias("_first"))
    out = out.join(place_of, [*by, "_useful"], "left")
    steps = [(None, f"{x}_at_{budget}") for budget in budgets for x in ("ndcg", "recall")]
    precision, recall = ratio(F.col("pc"), F.col("p")), ratio(F.col("pc"), F.col("c"))
    six = lambda c, name: F.round(c, 6).alias(name)
    return out.select(
        *by, six(precision, "precision"), six(recall, "recall"), six(ratio(2.0 * precision * recall, precision + recall), "f1_score"),
        six(ratio(F.col("vc"), F.col("cf")), "hit_file_rate"), six(ratio(F.col("noise"), F.col("v")), "noise_file_rate"),
        six(ratio(F.col("met"), F.col("targets")), "hit_region_rate"), six(ratio(F.col("regions") - F.col("on_target"), F.col("regions")), "noise_region_rate"),
        six(F.col("weighted_core_coverage"), "weighted_core_coverage"), six(ratio(F.col("pu"), F.col("p")), "context_efficiency"), six(ratio(F.col("po"), F.col("o")), "optional_coverage"),
        *[name for _, name in steps], six(F.when(F.col("c") > 0, F.coalesce(1 - F.col("_first") / F.col("regions"), F.lit(0.0))).otherwise(0.0), "first_useful_hit"),
    )


def localization(predicted: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """by, scope, match, precision: whether all gold items (by, scope, item) were named, and the share of named ones that are gold (1 if none)."""
    p = predicted.select(*by, "scope", "item").distinct().withColumn("_p", F.lit(1))
    g = gold.select(*by, "scope", "item").distinct().withColumn("_g", F.lit(1))
    rows = p.join(g, [*by, "scope", "item"], "full").fillna(0, ["_p", "_g"])
    rows = rows.groupBy(*by, "scope").agg(F.sum("_p").alias("p"), F.sum("_g").alias("g"), F.sum(F.col("_p") * F.col("_g")).alias("both"))
    return rows.select(*by, "scope", (F.col("both") == F.col("g")).alias("match"), F.when(F.col("p") > 0, F.round(F.col("both") / F.col("p"), 6)).otherwise(1.0).alias("precision"))


def localization_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("scope").agg(F.count("*").alias("n"), F.count_if("match").alias("matches"), F.round(F.avg(F.col("match").cast("double")), 6).alias("match_rate"), F.round(F.avg("precision"), 6).alias("precision_mean"))


def flattened(results: DataFrame, items: str, k: int | None = None) -> DataFrame:
    """Rows with ``rank`` (from 1) and ``item`` for each entry of a ranked list, at most k a row."""
    kept = F.col(items) if k is None else F.slice(items, 1, k)
    rest = [c for c in results.columns if c != items]
    out = results.select(*rest, F.posexplode(kept).alias("_pos", "item"))
    return out.select(*rest, (F.col("_pos") + 1).alias("rank"), "item")
