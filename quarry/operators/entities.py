"""Named entities of a repository: lookup, containment, adjacency, reading and navigation.

An entity is a graph node with vid, name, unified_name, type, file, start_line
and end_line (from 0, inclusive).  All lookups take a table of questions and
answer them in one plan; what one question may not do (match nothing, match
several) is a column of the answer, not an error in a loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as T

from . import graph, intervals, projection, routes

SYMBOL_TYPES = ("symbol", "class", "function", "method", "field")


def alias_key(value: Column) -> Column:
    """A name as it is looked up: quotes and call parentheses off, ``::`` and ``#`` as dots."""
    plain = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), "^[`'\"]+|[`'\"]+$", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\(\)(?=\.|$)", ""), "::|#", ".")
    return F.regexp_replace(plain, r"^[.:]+|[.:]+$", "")


def qualified_name(display: Column, file: Column) -> Column:
    """The name within its file."""
    head = F.concat(F.coalesce(file, F.lit("")), F.lit(":"))
    rest = F.when((F.coalesce(file, F.lit("")) != "") & display.startswith(head), F.substring(display, F.length(head) + 1, F.length(display))).otherwise(
        F.when(display.rlike(r"^[^:]*[/\\.][^:]*:[^:]"), F.regexp_replace(display, "^[^:]*:", "")).otherwise(display)
    )
    return alias_key(rest)


def entity_table(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with qualified and simple name, parent (smallest container) and, for members, the class name."""
    q = F.when(F.col("type").isin("file", "directory"), F.lit("")).otherwise(qualified_name(F.coalesce("unified_name", "name"), F.col("file")))
    out = nodes.withColumn("qualified", q).withColumn("simple", F.element_at(F.split("qualified", r"\."), -1))
    held = edges.where("type = 'contain'").groupBy(F.col("dst").alias("vid")).agg(F.min("src").alias("parent"))
    above = out.select(F.col("vid").alias("parent"), F.when(F.col("type") == "class", F.col("simple")).alias("_class"))
    out = out.join(held, "vid", "left").join(above, "parent", "left")
    parts = F.split("qualified", r"\.")
    own = F.when((F.col("type") == "method") & (F.size(parts) > 1), F.try_element_at(parts, F.lit(-2)))
    return out.withColumn("class_name", F.coalesce("_class", own)).drop("_class")


def aliases(entities: DataFrame) -> DataFrame:
    """key, vid: every name an entity goes by: canonical, display, qualified, simple, and its file for a file."""
    names = F.array(F.col("name"), F.coalesce("unified_name", "name"), F.col("qualified"), F.col("simple"))
    rows = entities.select("vid", F.explode(F.array_distinct(F.transform(names, alias_key))).alias("key"))
    return rows.where("key <> ''").distinct()


def find(entities: DataFrame, asked: DataFrame, fuzzy: bool = False) -> DataFrame:
    """query, vid, tier, n: entities by name; asked has query and optionally file, kind, class_name as filters.

    Tiers: an alias; ``file::name`` or ``file:name`` with the file as a filter; with ``fuzzy`` an alias that holds the
    name.  The first tier with a match counts, filters apply to its matches.
    """
    for c in ("file", "kind", "class_name"):
        if c not in asked.columns:
            asked = asked.withColumn(c, F.lit(None).cast("string"))
    names = aliases(entities)
    plain = F.regexp_replace(F.trim("query"), "^[`'\"]+|[`'\"]+$", "")
    q = asked.select("query", F.col("file").alias("_file"), F.col("kind").alias("_kind"), F.col("class_name").alias("_class"), plain.alias("_plain"))
    exact = q.withColumn("key", alias_key(F.col("_plain"))).withColumn("_tier", F.lit(0))
    split = lambda sep, tier: q.where(F.col("_plain").contains(sep)).withColumn("key", alias_key(F.regexp_replace("_plain", f"^.*?{sep}", ""))).withColumn("_file", F.coalesce("_file", F.substring_index("_plain", sep, 1))).withColumn("_tier", F.lit(tier))
    looked = exact.unionByName(split("::", 1)).unionByName(split(":", 2).where(F.substring_index("_plain", ":", 1).rlike(r"[/\\.]")))
    hit = looked.join(names, "key")
    if fuzzy:
        # Names are few beside texts, and only those no exact tier found are compared with all aliases' distinct keys.
        open_ = q.join(hit.select("query").distinct(), "query", "left_anti").withColumn("_low", F.lower(alias_key(F.col("_plain")))).where("_low <> ''")
        keys = names.select("key").distinct().withColumn("_lower", F.lower("key"))
        near = keys.join(open_, F.col("_lower").contains(F.col("_low"))).withColumn("_tier", F.lit(3)).drop("_lower", "_low")
        hit = hit.unionByName(near.join(names, "key").select(*hit.columns))
    first = F.min("_tier").over(W.partitionBy("query"))
    hit = hit.withColumn("_first", first).where("_tier = _first")
    rows = hit.join(entities.select("vid", "file", "type", "class_name"), "vid")
    same_file = F.col("_file").isNull() | (F.col("file") == F.regexp_replace(T.posix(F.col("_file")), "^/+|/+$", "")) | F.col("file").endswith(F.concat(F.lit("/"), T.posix(F.col("_file"))))
    rows = rows.where(same_file & (F.col("_kind").isNull() | (F.col("type") == F.col("_kind"))) & (F.col("_class").isNull() | F.col("class_name").eqNullSafe(F.col("_class"))))
    rows = rows.groupBy("query", "vid").agg(F.min("_tier").alias("tier"))
    return rows.withColumn("n", F.count("*").over(W.partitionBy("query")))


def match_files(files: DataFrame, pattern: str | None) -> DataFrame:
    """Paths a pattern selects: all without one, the very path without wildcards, else whole-path or tail matches."""
    if not pattern:
        return files.select("path").distinct()
    raw = pattern.strip().replace("\\", "/")
    if not any(c in raw for c in "*?[]"):
        plain = raw.removeprefix("./")
        return files.where(F.col("path") == plain).select("path").distinct()
    globs = [raw, raw[3:]] if raw.startswith("**/") else [raw]
    hit = T.matches_any(F.col("path"), globs)
    for g in globs:  # a relative pattern may also match the path's last parts, part by part
        parts = "/".join(T.glob_pattern(p)[1:-1].replace(".*", "[^/]*") for p in g.split("/"))
        hit = hit | F.col("path").rlike(f"(^|/){parts}$")
    return files.where(hit).select("path").distinct()


def find_files(files: DataFrame, asked: DataFrame) -> DataFrame:
    """query, path, n: the path itself, else paths that end in it."""
    q = asked.select("query", F.regexp_replace(F.regexp_replace(T.posix(F.trim("query")), "^/+|/+$", ""), r"^(\./)+", "").alias("_q")).where("_q <> ''")
    leaf = F.element_at(F.split("_q", "/"), -1)
    paths = files.select("path").distinct().withColumn("_leaf", F.element_at(F.split("path", "/"), -1))
    met = q.withColumn("_leaf", leaf).join(paths, "_leaf")
    exact = F.max((F.col("path") == F.col("_q")).cast("int")).over(W.partitionBy("query"))
    met = met.withColumn("_exact", exact).where((F.col("_exact") == 0) | (F.col("path") == F.col("_q")))
    return met.select("query", "path").distinct().withColumn("n", F.count("*").over(W.partitionBy("query")))


def adjacent(nodes: DataFrame, edges: DataFrame, starts: DataFrame, direction: str = "downstream", edge_types: Sequence[str] | None = None) -> DataFrame:
    """vid, src, dst, type: the distinct relations of each start (vid), both ends known."""
    if direction not in ("downstream", "upstream", "both"):
        raise ValueError("direction must be downstream, upstream or both")
    known = nodes.select("vid")
    e = graph.of_types(edges, list(edge_types) if edge_types else None).select("src", "dst", "type").distinct()
    e = e.join(known.withColumnRenamed("vid", "src"), "src", "left_semi").join(known.withColumnRenamed("vid", "dst"), "dst", "left_semi")
    out = None
    for end in {"downstream": ["src"], "upstream": ["dst"], "both": ["src", "dst"]}[direction]:
        part = e.join(starts.select(F.col("vid").alias(end)).distinct(), end, "left_semi").withColumn("vid", F.col(end))
        out = part if out is None else out.unionByName(part)
    return out.select("vid", "src", "dst", "type").distinct()


def neighbors(nodes: DataFrame, edges: DataFrame, starts: DataFrame, direction: str = "forward", node_types: Sequence[str] | None = None, edge_types: Sequence[str] | None = None, ignore_tests: bool = True, budget: int | None = None) -> DataFrame:
    """vid, neighbor, direction, type, anchor_file, anchor_line: incident edges of each start after filters.

    ``budget`` bounds how many incident edges of a start are looked at before the filters, in the order of edges.
    """
    cols = ["type", "anchor_file", "anchor_line"]
    s = starts.select("vid").distinct()
    out = edges.join(s.withColumnRenamed("vid", "src"), "src", "left_semi").select(F.col("src").alias("vid"), F.col("dst").alias("neighbor"), F.lit("forward").alias("direction"), *cols)
    into = edges.join(s.withColumnRenamed("vid", "dst"), "dst", "left_semi").select(F.col("dst").alias("vid"), F.col("src").alias("neighbor"), F.lit("backward").alias("direction"), *cols)
    rows = out if direction == "forward" else into if direction == "backward" else out.unionByName(into.where("vid <> neighbor"))
    if budget is not None:
        nth = F.row_number().over(W.partitionBy("vid").orderBy("neighbor", "direction", "type", "anchor_file", "anchor_line"))
        rows = rows.withColumn("_n", nth).where(F.col("_n") <= budget).drop("_n")
    kept = nodes if node_types is None else nodes.where(F.col("type").isin(list(node_types)))
    if ignore_tests:
        defined = F.col("file").isNotNull() & F.col("start_line").isNotNull()
        kept = kept.where(~T.is_test_file(F.coalesce("name", F.lit(""))) & ~(defined & T.is_test_file(F.coalesce("file", F.lit("")))))
    if edge_types:
        rows = rows.where(F.col("type").isin(list(edge_types)))
    return rows.join(kept.select(F.col("vid").alias("neighbor")), "neighbor", "left_semi").select("vid", "neighbor", "direction", *cols)


def traverse(nodes: DataFrame, edges: DataFrame, starts: DataFrame, direction: str = "downstream", depth: int = 2, edge_types: Sequence[str] | None = None, kinds: Sequence[str] | None = None, max_nodes: int | None = 80) -> DataFrame:
    """start, vid, level, src, dst, type: a breadth-first walk from each start, each node by its first relation.

    Depth -1 walks on until nothing is new.  Nodes of other kinds are not entered.  Relations come in the order of
    type, source and target; the cap takes nodes level by level in that order.
    """
    if depth < -1:
        raise ValueError("depth must be -1 or a non-negative integer")
    shape = "start bigint, vid bigint, level int, src bigint, dst bigint, type string"
    spark = nodes.sparkSession
    first = starts.select(F.col("vid").alias("start"), F.col("vid"), F.lit(0).alias("level"), F.lit(None).cast("bigint").alias("src"), F.lit(None).cast("bigint").alias("dst"), F.lit(None).cast("string").alias("type"))
    if depth == 0 or (max_nodes is not None and max_nodes <= 1):
        return spark.createDataFrame([], shape)
    allowed = nodes if kinds is None else nodes.where(F.col("type").isin(list(kinds)))
    e = graph.of_types(edges, list(edge_types) if edge_types else None).select("src", "dst", "type").distinct()
    e = e.join(nodes.select(F.col("vid").alias("src")), "src", "left_semi").join(nodes.select(F.col("vid").alias("dst")), "dst", "left_semi")
    steps = [] if direction == "upstream" else [e.select(F.col("src").alias("from"), F.col("dst").alias("to"), "src", "dst", "type")]
    if direction != "downstream":
        steps.append(e.select(F.col("dst").alias("from"), F.col("src").alias("to"), "src", "dst", "type"))
    walk = steps[0] if len(steps) == 1 else steps[0].unionByName(steps[1])
    walk = graph.checkpointed(walk.join(allowed.select(F.col("vid").alias("to")), "to", "left_semi"))
    seen = graph.checkpointed(first)
    edge, level = seen, 0
    while depth == -1 or level < depth:
        level += 1
        # The first relation to a node is the first by the place of the node it comes from, then by its own order.
        hop = edge.select("start", F.col("vid").alias("from"), F.col("_place") if "_place" in edge.columns else F.lit(0).alias("_place")).join(walk, "from")
        new = hop.groupBy("start", F.col("to").alias("vid")).agg(F.min(F.struct("_place", "type", "src", "dst")).alias("r"))
        new = new.join(seen.select("start", "vid"), ["start", "vid"], "left_anti")
        place = F.row_number().over(W.partitionBy("start").orderBy("r", "vid"))
        new = new.select("start", "vid", F.lit(level).alias("level"), "r.src", "r.dst", "r.type", place.alias("_place"))
        if max_nodes is not None:
            have = seen.groupBy("start").agg(F.count("*").alias("_have"))
            new = new.join(have, "start").where(F.col("_have") + F.col("_place") <= max_nodes).drop("_have")
        edge = graph.checkpointed(new)
        if edge.isEmpty():
            break
        seen = graph.checkpointed(seen.unionByName(edge.drop("_place")))
    return seen.where("level > 0")


def distances(edges: DataFrame, pairs: DataFrame, most: int | None = 32, kinds: DataFrame | None = None) -> DataFrame:
    """first, second, distance: the shorter directed way between two nodes, whichever direction; -1 if there is none.

    ``pairs`` holds vids; a null one (a name that is unknown or ambiguous) gives -1.  Walks go out from both ends of a pair
    in turn, one layer each, and end where the layers of a pair meet: a way of n steps has a node n / 2 steps from either
    end.  So a pair costs two walks of half the length, and pairs that are settled walk no further; a pair is settled too
    when one of its ends reaches nothing new.  ``most`` bounds the steps, None does not.  ``kinds`` (vid, type) spares walks:
    a way between nodes is a way between their types, so pairs whose types have none do not walk.
    """
    walk = graph.checkpointed(edges.select("src", "dst").distinct())
    both = pairs.where("first IS NOT NULL AND second IS NOT NULL").select("first", "second").distinct()
    open_ = graph.checkpointed(both.union(both.select("second", "first")).toDF("start", "goal").distinct())
    found = open_.where("start = goal").withColumn("d", F.lit(0))
    open_ = open_.where("start <> goal")
    if kinds is not None:
        open_ = graph.checkpointed(_of_linked_types(walk, open_, kinds))
    layer, seen = {}, {}
    for end in ("start", "goal"):
        layer[end] = seen[end] = graph.checkpointed(open_.select(end, F.col(end).alias("vid")).distinct())
    level = 0
    while (most is None or level < most) and not open_.isEmpty():
        level += 1
        end, at, to = ("start", "src", "dst") if level % 2 else ("goal", "dst", "src")
        held = layer[end].join(open_.select(end).distinct(), end, "left_semi").select(end, F.col("vid").alias(at))
        nxt = held.join(walk, at).select(end, F.col(to).alias("vid")).distinct()
        layer[end] = graph.checkpointed(nxt.join(seen[end], [end, "vid"], "left_anti"))
        seen[end] = seen[end].unionByName(layer[end])
        met = open_.join(layer["start"], "start").join(layer["goal"], ["goal", "vid"]).select("start", "goal").distinct()
        met = graph.checkpointed(met.withColumn("d", F.lit(level)))
        found = found.unionByName(met)
        done = met.select("start", "goal").union(met.select("goal", "start"))  # the other direction cannot be shorter any more
        open_ = open_.join(done, ["start", "goal"], "left_anti").join(layer[end].select(end).distinct(), end, "left_semi")
        open_ = graph.checkpointed(open_.select("start", "goal"))
        if level % 16 < 2 and level > 1:  # long ways: plans stay short
            found, seen[end] = graph.checkpointed(found), graph.checkpointed(seen[end].join(open_.select(end).distinct(), end, "left_semi"))
    ways = found.union(found.select("goal", "start", "d")).toDF("first", "second", "_d").groupBy("first", "second").agg(F.min("_d").alias("_d"))
    return pairs.join(ways, ["first", "second"], "left").withColumn("distance", F.coalesce("_d", F.lit(-1))).drop("_d")


def _of_linked_types(walk: DataFrame, asked: DataFrame, kinds: DataFrame) -> DataFrame:
    """The pairs (start, goal) between whose types edges lead; nodes that ``kinds`` does not name have one type of their own."""
    of = kinds.groupBy("vid").agg(F.min("type").alias("type"))
    typed = lambda df, key, name: df.join(of.toDF(key, name), key, "left")
    steps = typed(typed(walk, "src", "_a"), "dst", "_b").select("_a", "_b").distinct().collect()  # at most a row for two types
    ways = {(r["_a"], r["_b"]) for r in steps}
    while longer := {(a, d) for a, b in ways for c, d in ways if b == c} - ways:
        ways |= longer
    linked = asked.sparkSession.createDataFrame(sorted(ways, key=str), "_a string, _b string")
    rows = typed(typed(asked, "start", "_x"), "goal", "_y")
    return rows.join(F.broadcast(linked), F.col("_x").eqNullSafe(F.col("_a")) & F.col("_y").eqNullSafe(F.col("_b")), "left_semi").select("start", "goal")


def children(entities: DataFrame, edges: DataFrame, starts: DataFrame, kinds: Sequence[str] | None = None) -> DataFrame:
    """vid, child: what a node contains, in the order of file, lines and name (``place``)."""
    held = edges.where("type = 'contain'").select(F.col("src").alias("vid"), F.col("dst").alias("child")).distinct().join(starts.select("vid").distinct(), "vid", "left_semi")
    known = entities if kinds is None else entities.where(F.col("type").isin(list(kinds)))
    rows = held.join(known.select(F.col("vid").alias("child"), "file", "start_line", "name"), "child")
    place = F.row_number().over(W.partitionBy("vid").orderBy("file", "start_line", "name", "child"))
    return rows.withColumn("place", place).select("vid", "child", "place")


def in_file(entities: DataFrame, file: str, kinds: Sequence[str] | None = None) -> DataFrame:
    rows = entities.where(F.col("file") == file)
    rows = rows if kinds is None else rows.where(F.col("type").isin(list(kinds)))
    return rows.orderBy("start_line", "end_line", "name", "vid")


def file_tree(files: DataFrame, max_depth: int | None = None, root: str = "") -> DataFrame:
    """path, depth, is_file, line: every directory and file below ``root`` with its line of a drawn tree, in drawing order (``place``).

    Siblings without children come first, then by name.  A line needs to know, for each ancestor, whether it is the
    last of its siblings; that is joined level by level, so no task holds the tree.
    """
    paths = files.select(F.col("path")).distinct()
    if root:
        paths = paths.where(F.col("path").startswith(root.rstrip("/") + "/")).select(F.substring("path", F.lit(len(root.rstrip("/")) + 2), F.length("path")).alias("path"))
    parts = F.split("path", "/")
    rows = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("path"), n.alias("depth"), (n == F.size(parts)).alias("leaf")))).alias("n")).select("n.*")
    rows = rows.groupBy("path", "depth").agg(F.min("leaf").alias("is_file"))
    parent = F.when(F.col("depth") > 1, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    rows = rows.withColumn("parent", parent).withColumn("label", F.element_at(F.split("path", "/"), -1))
    own = W.partitionBy("parent")
    rows = rows.withColumn("nth", F.row_number().over(own.orderBy(~F.col("is_file"), "label"))).withColumn("last", F.col("nth") == F.count("*").over(own))
    deepest = max_depth if max_depth is not None and max_depth >= 0 else (rows.agg(F.max("depth")).first()[0] or 0)
    rows = rows.where(F.col("depth") <= deepest)
    done = rows.where("depth = 1").withColumn("indent", F.lit("")).withColumn("key", F.array("nth"))
    level = done
    for d in range(2, deepest + 1):
        above = level.select(F.col("path").alias("parent"), F.concat("indent", F.when(F.col("last"), "    ").otherwise("|   ")).alias("indent"), F.col("key").alias("_key"))
        level = rows.where(F.col("depth") == d).join(above, "parent").withColumn("key", F.concat("_key", F.array("nth"))).drop("_key")
        done = done.unionByName(level)
    line = F.concat("indent", F.when(F.col("last"), "`-- ").otherwise("|-- "), "label")
    return done.select("path", "depth", "is_file", line.alias("line"), "key")


def skeletons(entities: DataFrame, edges: DataFrame, starts: DataFrame, files: DataFrame) -> DataFrame:
    """vid, skeleton: the first source line of an entity and, indented, of its children; names where a line is blank."""
    own = starts.select("vid").join(entities.where("type <> 'file'").select("vid"), "vid").select("vid", F.col("vid").alias("child"), F.lit(0).alias("place"))
    rows = own.unionByName(children(entities, edges, starts)).join(entities.select(F.col("vid").alias("child"), "file", "start_line", "qualified", "simple"), "child")
    rows = rows.where("file IS NOT NULL AND start_line IS NOT NULL").withColumn("end_line", F.col("start_line"))
    rows = projection.read_spans(rows, files)
    sign = F.trim(F.regexp_replace(F.coalesce("content", F.lit("")), r"^\s+|\s+$", ""))
    sign = F.when(sign == "", F.when(F.col("qualified") != "", F.col("qualified")).otherwise(F.col("simple"))).otherwise(sign)
    rows = rows.withColumn("sign", F.when(F.col("place") > 0, F.concat(F.lit("    "), sign)).otherwise(sign))
    return rows.groupBy("vid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "sign"))), lambda x: x["sign"]), "\n").alias("skeleton"))


def read_range(content: Column, start: Column, end: Column) -> Column:
    """struct(content, first, last): lines start to end, from 0, both optional; an empty text or range gives ""."""
    lines = F.when(F.coalesce(content, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(content, "\n$", ""), "\n"))
    n = F.size(lines)
    first = F.greatest(F.coalesce(start, F.lit(0)), F.lit(0))
    last = F.least(F.coalesce(end, n - 1), n - 1)
    held = F.when(first <= last, F.array_join(F.slice(lines, (first + 1).cast("int"), (last - first + 1).cast("int")), "\n")).otherwise("")
    return F.struct(F.when(n == 0, "").otherwise(held).alias("content"), F.when(n == 0, 0).otherwise(first).cast("bigint").alias("first"), F.when(n == 0, 0).when(first <= last, last).otherwise(first).cast("bigint").alias("last"))


def fragment_lines(files: DataFrame, asked: DataFrame) -> DataFrame:
    """query, file, line: where (from 0) a source fragment begins in its file; null if it is not there."""
    rows = asked.join(files.select(F.col("path").alias("file"), "text"), "file", "left")
    at = F.position("fragment", "text")
    line = F.when(at > 0, F.length(F.regexp_replace(F.left("text", at - 1), "[^\n]", "")))
    return rows.select("query", "file", line.alias("line"))


def containing(points: DataFrame, entities: DataFrame) -> DataFrame:
    """Every point (file, line) with the narrowest symbol that holds it: span, then later start, then name."""
    spans = entities.where(F.col("type").isin(*SYMBOL_TYPES) & F.col("start_line").isNotNull() & F.col("end_line").isNotNull())
    order = [F.col("end_line") - F.col("start_line"), -F.col("start_line"), F.col("name"), F.col("vid")]
    return intervals.points_in_intervals(points, spans, ["file"], "line", "start_line", "end_line", order)


def import_lines(files: DataFrame) -> DataFrame:
    """path, imports: the import lines of each file, in order."""
    hit = lambda t: t.startswith("import") | (t.startswith("from") & t.contains("import"))
    return files.select("path", F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), hit).alias("imports"))


def located(entities: DataFrame, asked: DataFrame) -> DataFrame:
    """query, kind, name, first, last (from 1): a class, method or function of a file by kind and name; the first in source order.

    ``asked`` has query, file, kind (class or function) and name; a dotted function is a method of the class before the
    dot, else a plain function of that name.
    """
    e = entities.select("file", "type", "simple", "class_name", "start_line", "end_line")
    met = asked.withColumnRenamed("name", "_name").join(e, "file")
    dotted = F.col("_name").contains(".")
    leaf, head = F.element_at(F.split("_name", r"\."), -1), F.regexp_replace("_name", r"\.[^.]*$", "")
    is_class = (F.col("kind") == "class") & (F.col("type") == "class") & (F.col("simple") == F.col("_name"))
    is_method = (F.col("kind") == "function") & dotted & (F.col("type") == "method") & (F.col("simple") == leaf) & (F.col("class_name") == head)
    is_function = (F.col("kind") == "function") & (F.col("type") == "function") & (F.col("simple") == F.col("_name"))
    tier = F.when(is_class, 0).when(is_method, 0).when(is_function, 1)
    found = met.withColumn("_tier", tier).where("_tier IS NOT NULL")
    found = found.withColumn("_n", F.row_number().over(W.partitionBy("query").orderBy("_tier", "start_line", "end_line"))).where("_n = 1")
    return found.select("query", F.col("type").alias("kind"), F.col("_name").alias("name"), (F.col("start_line") + 1).alias("first"), (F.col("end_line") + 1).alias("last"))


def nth_occurrence(occurrences: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, file, line, character: the place of occurrence ``index`` (from 0) of a name in a file, in source order."""
    name = routes.bare(F.regexp_replace("symbol", "^local ", ""))
    rows = asked.select("query_id", F.col("file"), F.col("name").alias("_name"), "index").join(occurrences.withColumn("_name", name), ["file", "_name"])
    nth = F.row_number().over(W.partitionBy("query_id").orderBy("start_line", "start_char", "end_line", "end_char", "symbol")) - 1
    rows = rows.withColumn("_n", nth).where(F.col("_n") == F.col("index"))
    return rows.select("query_id", "file", F.col("start_line").alias("line"), F.col("start_char").alias("character"))


def jump(occurrences: DataFrame, asked: DataFrame, k: int = 8) -> DataFrame:
    """Definitions of the n-th occurrence of a name on a file."""
    return intervals.definitions(nth_occurrence(occurrences, asked), occurrences, k)


def graph_definitions(nodes: DataFrame, edges: DataFrame, points: DataFrame, k: int = 8) -> DataFrame:
    """query_id, vid, rank: definitions at a (file, line): targets of edges anchored there, else symbols that span the line.

    Targets need a definition of their own; narrower spans come first.
    """
    defined = nodes.where("file IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL").select("vid", "file", "start_line", "end_line")
    out = points.join(edges.where("type = 'reference'").select(F.col("anchor_file").alias("file"), F.col("anchor_line").alias("line"), F.col("dst").alias("vid")), ["file", "line"]).select("query_id", "vid", F.lit(0).alias("tier"))
    cut = points.withColumn("_e", F.col("line"))
    spans = intervals.overlap_join(cut.withColumnRenamed("line", "_s"), defined, ["file"], "_s", "_e", "start_line", "end_line").select("query_id", "vid", F.lit(1).alias("tier"))
    both = out.unionByName(spans).join(defined, "vid").distinct()
    both = both.withColumn("_best", F.min("tier").over(W.partitionBy("query_id"))).where("tier = _best")
    order = [F.when(F.col("tier") == 1, F.col("end_line") - F.col("start_line")).otherwise(F.lit(0)), "start_line", "file", "vid"]
    return both.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= max(1, k)).select("query_id", "vid", "rank")


def graph_references(nodes: DataFrame, edges: DataFrame, targets: DataFrame, include_declaration: bool = True, k: int = 40) -> DataFrame:
    """query_id, kind, file, line, vid, rank: the declaration of each target (query_id, vid), then the places that refer to it."""
    t = targets.select("query_id", F.col("vid").alias("target")).distinct()
    refs = edges.where("type = 'reference'").join(t, F.col("dst") == F.col("target")).select("query_id", F.lit("reference").alias("kind"), F.col("anchor_file").alias("file"), F.col("anchor_line").alias("line"), F.col("src").alias("vid"))
    rows = refs.distinct()
    if include_declaration:
        own = t.join(nodes.where("file IS NOT NULL AND start_line IS NOT NULL"), F.col("target") == F.col("vid"))
        rows = own.select("query_id", F.lit("definition").alias("kind"), "file", F.col("start_line").cast("bigint").alias("line"), "vid").unionByName(rows)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("kind") != "definition", "file", "line", "vid"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= max(1, k))


def changed_symbols(before: DataFrame, after: DataFrame, ranges: DataFrame) -> DataFrame:
    """id, change: symbols (id, file, start_line, end_line, content) added, deleted or modified between two states.

    Only files with changed ranges (file, first, last) count.  A symbol is modified if its number of lines differs, or
    if a changed range meets it and its content differs.
    """
    files = ranges.select("file").distinct()
    b = before.join(files, "file", "left_semi").select("id", F.col("file").alias("bf"), F.col("start_line").alias("bs"), F.col("end_line").alias("be"), F.col("content").alias("bc"))
    a = after.join(files, "file", "left_semi")
    spans = a.select("id", "file", "start_line", "end_line")
    met = intervals.overlap_join(spans, ranges, ["file"], "start_line", "end_line", "first", "last").select("id").distinct().withColumn("_met", F.lit(True))
    both = b.join(a, "id", "full").join(met, "id", "left")
    longer = (F.col("be") - F.col("bs")) != (F.col("end_line") - F.col("start_line"))
    edited = F.coalesce("_met", F.lit(False)) & ~F.col("bc").eqNullSafe(F.col("content"))
    change = F.when(F.col("bf").isNull(), "added").when(F.col("file").isNull(), "deleted").when(longer | edited, "modified")
    return both.select("id", change.alias("change")).where("change IS NOT NULL")


def nearest_vertices(citations: DataFrame, nodes: DataFrame, most: int = 2) -> DataFrame:
    """cite, vid, tier: the vertex a citation (file, line) means: one that starts there (0), else the nearest start within ``most`` lines (1).

    Citations and starts meet by line, each start offered to the few lines around it, so a file's citations are not
    compared with all its symbols.
    """
    n = nodes.where("file IS NOT NULL AND start_line IS NOT NULL").select("vid", "file", F.col("start_line").cast("bigint").alias("start_line"))
    offered = n.withColumn("line", F.explode(F.sequence(F.col("start_line") - most, F.col("start_line") + most)))
    met = citations.withColumn("line", F.col("line").cast("bigint")).join(offered, ["file", "line"])
    gap = F.abs(F.col("start_line") - F.col("line"))
    key = F.struct(F.when(gap == 0, 0).otherwise(1).alias("tier"), gap.alias("gap"), "vid")
    return met.groupBy("cite").agg(F.min(key).alias("r")).select("cite", "r.vid", "r.tier")


def span_index(nodes: DataFrame) -> DataFrame:
    """file, leaf, first, last (from 1): the span of each simple name of a file; the first vertex wins, its name before its display name."""
    own = nodes.where("file IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL")
    names = F.explode(F.array(F.struct(F.lit(0).alias("nth"), F.col("name").alias("label")), F.struct(F.lit(1).alias("nth"), F.col("unified_name").alias("label")))).alias("n")
    rows = own.select("vid", "file", "start_line", "end_line", names).select("vid", "file", "start_line", "end_line", "n.nth", routes.bare(F.regexp_replace("n.label", "/", ".")).alias("leaf")).where("leaf <> ''")
    best = F.min(F.struct("vid", "nth", "start_line", "end_line"))
    return rows.groupBy("file", "leaf").agg(best.alias("r")).select("file", "leaf", (F.col("r.start_line") + 1).alias("first"), (F.col("r.end_line") + 1).alias("last"))


def resolve_tiers(nodes: DataFrame, asked: DataFrame, limit: int | None = None) -> DataFrame:
    """symbol, vid, tier, candidates, rank: names a caller may use for a node; the best tier only.

    Tiers: canonical name; full display name; that with ``()``; bare name; a display name that holds the bare name
    (without regard to case); a canonical name that ends in the symbol or whose last part is the symbol's.
    """
    n = nodes.select("vid", "name", F.col("unified_name").alias("shown")).withColumn("bare", routes.bare(F.col("shown")))
    q = asked.select(F.col("symbol"), F.regexp_replace(F.trim("symbol"), "^[`'\"]+|[`'\"]+$", "").alias("_s")).where("_s <> ''").distinct()
    q = q.withColumn("_bare", routes.bare(F.col("_s")))
    tiers = [("name", F.col("_s")), ("shown", F.col("_s")), ("shown", F.concat("_s", F.lit("()"))), ("bare", F.col("_bare"))]
    out = None
    for tier, (column, value) in enumerate(tiers):
        hit = q.withColumn("_k", value).join(n.select("vid", F.col(column).alias("_k")), "_k").select("symbol", "vid", F.lit(tier).alias("tier"))
        out = hit if out is None else out.unionByName(hit)
    open_ = q.join(out.select("symbol").distinct(), "symbol", "left_anti")
    held = open_.where("_bare <> ''").join(n, F.lower("shown").contains(F.lower("_bare"))).select("symbol", "vid", F.lit(4).alias("tier"))
    open_ = open_.join(held.select("symbol").distinct(), "symbol", "left_anti")
    leaf = lambda c: F.element_at(F.split(c, r"\."), -1)
    ends = open_.join(n, n["name"].endswith(F.concat(F.lit("."), F.col("_s"))) | (leaf(F.col("name")) == F.element_at(F.split("_s", "[.:]"), -1))).select("symbol", "vid", F.lit(5).alias("tier"))
    out = out.unionByName(held).unionByName(ends).distinct()
    own = W.partitionBy("symbol")
    out = out.withColumn("_best", F.min("tier").over(own)).where("tier = _best").drop("_best")
    out = out.withColumn("candidates", F.count("*").over(own)).withColumn("rank", F.row_number().over(own.orderBy("vid")))
    return out if limit is None else out.where(F.col("rank") <= limit)


def resolve_seeds(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seeds (seed, node_id, node_name, file) with the one node they mean (vid): by id, by name, by file and name; null if none is unique."""
    tries = [F.col("node_id"), F.col("node_name"), F.concat("file", F.lit(":"), "node_name")]
    asked = seeds.select("seed", F.posexplode(F.array(*tries)).alias("nth", "symbol")).where("symbol IS NOT NULL AND symbol <> ''")
    found = resolve_tiers(nodes, asked.select("symbol").distinct()).where("candidates = 1").select("symbol", "vid")
    best = asked.join(found, "symbol").groupBy("seed").agg(F.min(F.struct("nth", "vid")).alias("r")).select("seed", "r.vid")
    return seeds.join(best, "seed", "left")


def range_by_symbol(nodes: DataFrame, edges: DataFrame, asked: DataFrame) -> DataFrame:
    """symbol, kind, src, dst, anchor_line: what the lines of a symbol touch, each symbol by its unique match."""
    own = resolve_tiers(nodes, asked).where("candidates = 1").select("symbol", "vid").join(nodes.select("vid", "file", "start_line", "end_line"), "vid").where("file IS NOT NULL AND start_line IS NOT NULL")
    spans = own.select("symbol", "file", F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    inside = intervals.overlap_join(spans, nodes.select("vid", "file", "start_line", "end_line"), ["file"], "s", "e", "start_line", "end_line").select("symbol", "vid").distinct()
    none = F.lit(None).cast("bigint")
    nodes_ = inside.select("symbol", F.lit("node").alias("kind"), F.col("vid").alias("src"), F.col("vid").alias("dst"), none.alias("anchor_line"))
    e = edges.where("anchor_file IS NOT NULL AND anchor_line IS NOT NULL").select("src", "dst", F.col("anchor_file").alias("file"), F.col("anchor_line").cast("bigint").alias("anchor_line")).withColumn("_end", F.col("anchor_line"))
    out = intervals.overlap_join(e, spans, ["file"], "anchor_line", "_end", "s", "e").select("symbol", F.lit("outgoing").alias("kind"), "src", "dst", "anchor_line")
    into = edges.join(inside.withColumnRenamed("vid", "dst"), "dst").where("src <> dst").select("symbol", F.lit("incoming").alias("kind"), "src", "dst", F.col("anchor_line").cast("bigint").alias("anchor_line"))
    return nodes_.unionByName(out).unionByName(into)


def outgoing(edges: DataFrame, symbols: DataFrame, limit: int = 256) -> DataFrame:
    """source, moniker, target, rank: a snapshot's outgoing edges with monikers resolved where they name one symbol, at most ``limit`` a source."""
    unique = symbols.groupBy("moniker").agg(F.count("*").alias("_n"), F.min("symbol").alias("_one")).where("_n = 1").select("moniker", "_one")
    nth = F.row_number().over(W.partitionBy("source").orderBy("moniker", "target"))
    rows = edges.withColumn("rank", nth).where(F.col("rank") <= limit).join(unique, "moniker", "left")
    return rows.select("source", "moniker", F.coalesce("target", "_one").alias("target"), "rank")


def verified(claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """claim, known: whether a claimed file or file:symbol stands in the graph."""
    files = nodes.where("file IS NOT NULL").select(F.col("file").alias("claim"))
    symbols = nodes.where("file IS NOT NULL").select(F.concat("file", F.lit(":"), routes.bare(F.col("unified_name"))).alias("claim"))
    known = files.union(symbols).distinct().withColumn("known", F.lit(True))
    return claims.join(known, "claim", "left").withColumn("known", F.coalesce("known", F.lit(False)))
