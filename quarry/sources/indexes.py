"""Symbol indexes: decoded index texts, symbol trees, and the graphs they make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import intervals

#: Kinds of symbols in a document's tree that become nodes, and their type (fixed values of the protocol).
NODE_TYPES = {2: "class", 3: "class", 5: "class", 6: "method", 7: "field", 8: "field", 9: "method", 10: "class", 11: "class", 12: "function", 13: "field", 14: "field", 22: "class", 23: "class", 25: "function"}


def index_documents(texts: DataFrame, value: str = "value") -> DataFrame:
    """file, body: the documents of decoded index texts; a document is the text from its ``documents {`` line to the next block at the margin."""
    blocks = F.filter(F.split(value, r"(?m)^(?=[A-Za-z_]+ \{)"), lambda b: b.startswith("documents {"))
    rows = texts.select(F.explode(blocks).alias("body"))
    file = F.regexp_extract("body", r"(?m)^\s*relative_path:\s*\"((?:[^\"\\]|\\.)*)\"", 1)
    return rows.select(T.posix(file).alias("file"), "body").where("file <> ''")


def index_occurrences(texts: DataFrame, value: str = "value", path_filter=None) -> DataFrame:
    """file, start_line, start_char, end_line, end_char, roles, symbol of every occurrence in decoded index texts.

    A range of three numbers stays on one line; other counts and occurrences without symbol are skipped; missing roles
    are 0.
    """
    docs = index_documents(texts, value)
    if path_filter is not None:
        docs = docs.where(path_filter(F.col("file")))
    occ = F.explode(F.regexp_extract_all("body", F.lit(r"(?s)occurrences \{(.*?)\n  \}"), F.lit(1))).alias("o")
    rows = docs.select("file", occ)
    r = F.transform(F.regexp_extract_all("o", F.lit(r"(?m)^\s*range:\s*(-?[0-9]+)"), F.lit(1)), lambda x: x.cast("int"))
    symbol = F.regexp_replace(F.regexp_extract("o", r"(?m)^\s*symbol:\s*\"((?:[^\"\\]|\\.)*)\"", 1), r"\\(.)", "$1")
    roles = F.coalesce(F.regexp_extract("o", r"(?m)^\s*symbol_roles:\s*([0-9]+)", 1).try_cast("int"), F.lit(0))
    rows = rows.select("file", r.alias("r"), roles.alias("roles"), symbol.alias("symbol")).where(F.size("r").isin(3, 4) & (F.col("symbol") != ""))
    short = F.size("r") == 3
    return rows.select("file", F.get("r", F.lit(0)).alias("start_line"), F.get("r", F.lit(1)).alias("start_char"), F.when(short, F.get("r", F.lit(0))).otherwise(F.get("r", F.lit(2))).alias("end_line"), F.when(short, F.get("r", F.lit(2))).otherwise(F.get("r", F.lit(3))).alias("end_char"), "roles", "symbol")


def graph_from_occurrences(occurrences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of an occurrence table: a node per symbol with a definition, an edge from the definition a use stands in.

    A definition reaches to the line before the file's next one.  Local symbols are left out.  Uses outside of any
    definition go from their file.
    """
    from pyspark.sql import Window as W

    vid = lambda *c: F.shiftrightunsigned(F.xxhash64(*c), 1)
    shared = occurrences.where(~F.col("symbol").startswith("local "))
    first = F.row_number().over(W.partitionBy("symbol").orderBy("file", "start_line", "start_char"))
    defs = shared.where(F.col("roles").bitwiseAND(1) == 1).withColumn("_n", first).where("_n = 1")
    after = F.lead("start_line").over(W.partitionBy("file").orderBy("start_line", "start_char"))
    defs = defs.withColumn("_next", after)
    last = F.greatest(F.coalesce(F.col("_next") - 1, F.lit(1 << 30)), F.col("end_line")).cast("bigint")
    label = F.regexp_extract("symbol", r"([A-Za-z_]\w*)[^\w]*$", 1)
    kind = F.when(F.col("symbol").rlike(r"#[A-Za-z_]\w*\(.*\)\.$"), "method").when(F.col("symbol").rlike(r"\(.*\)\.$"), "function").when(F.col("symbol").endswith("#"), "class").when(F.col("symbol").endswith("/"), "symbol").otherwise("field")
    nodes = defs.select(vid("symbol").alias("vid"), F.col("symbol").alias("name"), F.concat("file", F.lit(":"), label).alias("unified_name"), kind.alias("type"), "file", F.col("start_line").cast("bigint").alias("start_line"), last.alias("end_line"))
    files = occurrences.select("file").distinct()
    none = F.lit(None)
    file_nodes = files.select(vid("file").alias("vid"), F.col("file").alias("name"), F.col("file").alias("unified_name"), F.lit("file").alias("type"), none.cast("string").alias("file"), none.cast("bigint").alias("start_line"), none.cast("bigint").alias("end_line"))
    uses = shared.where(F.col("roles").bitwiseAND(1) == 0).select("symbol", "file", F.col("start_line").cast("bigint").alias("line")).distinct().join(nodes.select(F.col("name").alias("symbol"), F.col("vid").alias("dst")), "symbol")
    order = [F.col("end_line") - F.col("start_line"), -F.col("start_line"), F.col("vid")]
    spans = nodes.select("vid", "file", "start_line", "end_line").withColumn("end_line", F.least("end_line", F.col("start_line") + 100_000))
    placed = intervals.points_in_intervals(uses, spans, ["file"], "line", "start_line", "end_line", order, bucket=1 << 20).select("symbol", "file", "line", F.col("vid").alias("_in"))
    uses = uses.join(placed, ["symbol", "file", "line"], "left")
    refs = uses.select(F.coalesce("_in", vid("file")).alias("src"), "dst", F.lit("reference").alias("type"), F.col("file").alias("anchor_file"), F.col("line").alias("anchor_line")).where("src <> dst")
    contain = nodes.select(vid("file").alias("src"), F.col("vid").alias("dst"), F.lit("contain").alias("type"), none.cast("string").alias("anchor_file"), none.cast("bigint").alias("anchor_line"))
    return nodes.unionByName(file_nodes), contain.unionByName(refs.distinct())


def symbol_rows(trees: DataFrame, file: str, symbols: str, levels: int = 6) -> DataFrame:
    """file, name, kind, first, last, path, depth: the symbols of nested trees (JSON arrays of name, kind, range, children).

    One explode a level, as deep as ``levels``; a parent's name comes before its children's in ``path``.
    """
    span = "range: struct<start: struct<line: int>, `end`: struct<line: int>>"

    def schema(n: int) -> str:
        return f"struct<name: string, kind: int, {span}" + (f", children: array<{schema(n - 1)}>" if n > 1 else "") + ">"

    rows = trees.select(F.col(file).alias("file"), F.explode(F.from_json(symbols, f"array<{schema(levels)}>")).alias("s")).withColumn("up", F.array().cast("array<string>"))
    out = None
    for n in range(levels, 0, -1):
        part = rows.select("file", "s.name", "s.kind", F.col("s.range.start.line").cast("bigint").alias("first"), F.coalesce("s.range.end.line", "s.range.start.line").cast("bigint").alias("last"), F.concat("up", F.array("s.name")).alias("path"))
        out = part if out is None else out.unionByName(part)
        if n > 1:
            rows = rows.select("file", F.explode("s.children").alias("c"), F.concat("up", F.array("s.name")).alias("up")).withColumnRenamed("c", "s")
    return out.withColumn("depth", F.size("path"))


def graph_from_trees(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of symbol rows: directories, files and the symbols of known kinds, with what contains them.

    A symbol hangs on its nearest ancestor that is a node; functions' and methods' own variables are left out.
    """
    vid = lambda *c: F.shiftrightunsigned(F.xxhash64(*c), 1)
    known = F.create_map(*[F.lit(v) for pair in NODE_TYPES.items() for v in pair])
    r = rows.withColumn("type", F.try_element_at(known, F.col("kind"))).withColumn("_key", F.array_join("path", "."))
    callers = r.where("type IN ('function', 'method')").select("file", F.col("_key").alias("_up"), F.lit(1).alias("_local")).distinct()
    r = r.withColumn("_up", F.array_join(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))), ".")).join(callers, ["file", "_up"], "left")
    r = r.where("type IS NOT NULL AND NOT (type = 'field' AND _local IS NOT NULL)")
    unified = F.concat("file", F.lit(":"), "_key", F.when(F.col("type").isin("function", "method"), F.lit("()")).otherwise(F.lit("")))
    name = F.concat(unified, F.lit(":"), F.col("first").cast("string"))
    none = F.lit(None)
    symbols = r.select(vid(name).alias("vid"), name.alias("name"), unified.alias("unified_name"), "type", "file", F.col("first").alias("start_line"), F.col("last").alias("end_line"), "path")
    prefixes = lambda n: F.array_join(F.slice("path", 1, n), ".")
    up = symbols.select("vid", "file", F.explode(F.filter(F.sequence(F.lit(0), F.size("path") - 1), lambda n: n > 0)).alias("n"), "path").select("vid", "file", "n", prefixes(F.col("n")).alias("_key"))
    owners = symbols.select("file", F.array_join("path", ".").alias("_key"), F.col("vid").alias("owner"))
    mother = up.join(owners, ["file", "_key"]).groupBy("vid").agg(F.max(F.struct("n", "owner")).alias("m")).select("vid", "m.owner")
    empty = lambda: (none.cast("string").alias("anchor_file"), none.cast("bigint").alias("anchor_line"))
    contain = symbols.select("vid", "file").join(mother, "vid", "left").select(F.coalesce("owner", vid("file")).alias("src"), F.col("vid").alias("dst"), F.lit("contain").alias("type"), *empty())
    files = rows.select("file").distinct()
    parts = F.split("file", "/")
    dirs = files.where(F.size(parts) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("dir")).distinct()
    box = lambda kind, c: (vid(c).alias("vid"), F.col(c).alias("name"), F.col(c).alias("unified_name"), F.lit(kind).alias("type"), none.cast("string").alias("file"), none.cast("bigint").alias("start_line"), none.cast("bigint").alias("end_line"))
    nodes = symbols.drop("path").unionByName(files.select(*box("file", "file"))).unionByName(dirs.select(*box("directory", "dir")))
    above = lambda c: F.regexp_extract(c, "^(.*)/[^/]*$", 1)
    edges = contain.unionByName(files.where(above("file") != "").select(vid(above("file")).alias("src"), vid("file").alias("dst"), F.lit("contain").alias("type"), *empty()))
    return nodes, edges.unionByName(dirs.where(above("dir") != "").select(vid(above("dir")).alias("src"), vid("dir").alias("dst"), F.lit("contain").alias("type"), *empty()))


def supplemented(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph with file, symbol and containment rows for source files it lacks, from their syntax."""
    from . import chunkers

    have = nodes.select(F.coalesce("file", "name").alias("path")).distinct()
    lost = files.join(have, "path", "left_anti")
    more, contains = chunkers.code_graph(lost)
    return nodes.unionByName(more), edges.unionByName(contains.where("type = 'contain'"))


def occurrence_facts(occurrences: DataFrame) -> DataFrame:
    """file, symbols, occurrences: one fact row a file: its definitions and how often each of its symbols stands there."""
    d = F.col("roles").bitwiseAND(1) == 1
    each = occurrences.groupBy("file", "symbol").agg(F.count("*").alias("n"), F.max(d.cast("int")).alias("defined"), F.min(F.struct("start_line", "start_char")).alias("first"))
    return each.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("symbol", "n", "defined", "first"))).alias("symbols"), F.sum("n").alias("occurrences"))
