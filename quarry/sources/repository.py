"""Reading repositories: files under a visibility rule, languages, chunks, indexes, cells, sinks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators.intervals import chunk_lines

#: Directories no scan enters, and the largest file that is read.
IGNORED = (".git", ".hg", ".svn", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", "target", ".tox", ".mypy_cache")
MOST_BYTES = 10 * 1024 * 1024


def visible(path: Column, ignored: Sequence[str] = IGNORED, excluded: Iterable[str] = ()) -> Column:
    """No segment of the path is an ignored directory, and no excluded subtree holds it."""
    plain = text.posix(path)
    ok = ~F.exists(F.split(plain, "/"), lambda p: p.isin(*ignored))
    for tree in excluded:
        ok = ok & ~(plain == tree) & ~plain.startswith(tree.rstrip("/") + "/")
    return ok


def scan(spark: SparkSession, root: str, ignored: Sequence[str] = IGNORED, excluded: Iterable[str] = ()) -> DataFrame:
    """path (relative), length, text of the visible files of at most MOST_BYTES below a root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    relative = F.regexp_replace("path", f"^[a-z]*:/*{base}/", "")
    rows = files.where(F.col("length") <= MOST_BYTES).select(relative.alias("path"), "length", "content")
    return rows.where(visible(F.col("path"), ignored, excluded)).select("path", "length", F.decode("content", "UTF-8").alias("text"))


def main_language(files: DataFrame, by: str, path: Column, languages: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """The first language, in order of priority, any of whose extensions is present."""
    place = F.lit(None).cast("int")
    for i, (_, extensions) in reversed(list(enumerate(languages))):
        place = F.when(text.has_extension(path, extensions), F.lit(i)).otherwise(place)
    names = F.array(*[F.lit(name) for name, _ in languages])
    out = files.select(by, place.alias("p")).where(F.col("p").isNotNull()).groupBy(by).agg(F.min("p").alias("p"))
    return out.select(by, F.element_at(names, F.col("p") + 1).alias("language"))


def statistics(files: DataFrame, path: Column, size: Column) -> DataFrame:
    return files.groupBy(text.extension(path).alias("extension")).agg(F.count("*").alias("n_files"), F.sum(size).alias("bytes"))


def text_chunks(files: DataFrame) -> DataFrame:
    """file, chunk, first, last, content: plain text cut at blank lines; ``files`` has file and text."""
    return files.select("file", "text").mapInPandas(chunk_lines, "file string, chunk bigint, first bigint, last bigint, content string")


def cells(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Evaluation cells in JSON files below a folder; files of another shape are skipped."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("multiLine", True).option("mode", "DROPMALFORMED").json(root)
    return rows.where(F.col("cell_id").isNotNull())


def save_view(df: DataFrame, root: str, name: str, version: int, partition: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(f"{root}/{name}/v{version}")


def load_view(spark: SparkSession, root: str, name: str, version: int, schema: str | None = None) -> DataFrame:
    """A saved view of the expected version; another version fails as a missing path."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{root}/{name}/v{version}")


def count_visible(files: DataFrame, path: Column, **policy) -> DataFrame:
    return files.where(visible(path, **policy)).agg(F.count("*").alias("n_files"))


def discovered(files: DataFrame, path: Column, body: Column, languages: dict[str, str], most_bytes: int = MOST_BYTES, drop_tests: bool = False, drop_minified: bool = True, line_limit: int = 10_000) -> DataFrame:
    """Visible source files of known languages (extension -> language) that are small enough, with their ``language``; tests and minified ones left out if asked."""
    known = F.create_map(*[F.lit(v) for pair in languages.items() for v in pair])
    rows = files.where(visible(path)).withColumn("language", F.try_element_at(known, text.extension(path))).where("language IS NOT NULL")
    if drop_tests:
        rows = rows.where(~text.is_test_path(path))
    rows = rows.where(F.octet_length(body) <= most_bytes)
    return rows.where(~text.is_minified(body, line_limit)) if drop_minified else rows


#: What a README says that does not describe its project.
README_SKIP = r"\b(install|download|getting started|to get started|usage|build from source|clone|npm i\b|pip install|cargo add|see (the )?docs|documentation|these steps|version information|for example|e\.g\.)\b"
README_PREFIXES = ("all detailed ", "note:", "open ", "run ", "see ", "this command ", "this example ", "tip:", "warning:", "you can choose ", "$ ")
README_NOISE = (
    r"^\s*\.\.\s", r"\|\w+\|\s*(image|replace)::", r":target:|:alt:|:scale:", r"\b(?:href|src|alt|width|height|style)\s*=\s*[\"']", r"&#x[0-9a-fA-F]+;|&amp;|&quot;",
    r"\bwe(?:'re| are)\s+(?:excited|thrilled|pleased|happy)\b", r"\bannounc(?:e|es|ed|ing|ement)\b", r"\b(?:now available|tickets are|registration is)\b",
    r"^this\s+(?:document|readme|file|page|repository)\s+(?:serves|is|contains)", r"^and\s+many\s+more\s+people\b", r"\b(?:mailing list|reported bugs|helped organize|special thanks)\b",
    r"^(?:license|copyright|authors?|maintainers?|credits)\s*:", r"\b(?:sponsor|sponsors|donate|open collective|backers|dependency tree)\b",
)


def readme_summary(body: Column, limit: int = 160) -> Column:
    """The first descriptive paragraph of a README, cut at ``limit``; "" if there is none.

    Fenced code, quotes, lists, tables, rules, images and link lines end a paragraph and are no part of one.
    """
    plain = F.regexp_replace(F.coalesce(body, F.lit("")), r"(?s)(?m)^\s*```.*?(?:^\s*```[^\n]*$|\Z)", "\n\n")
    lines = F.transform(F.split(plain, r"\r?\n"), F.trim)
    broken = lambda t: t.rlike(r"^(#|>|<|---|===|\||- |\* |!\[|\[)")
    clean = lambda t: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\[([^\]]+)\]\([^)]*\)", "$1"), r"\[([^\]]+)\]\[[^\]]*\]", "$1"), r"[*_`]", ""), r"<[^>]+>", ""))
    marked = F.transform(lines, lambda t: F.when((t == "") | broken(t), F.lit("\x01")).otherwise(clean(t)))
    paragraphs = F.transform(F.split(F.array_join(marked, "\n"), "\x01"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    bad = lambda p: p.endswith(":") | (F.size(F.split(p, r"\s+")) < 6) | p.rlike("(?i)" + README_SKIP)

    def noisy(p: Column) -> Column:
        hit = F.lit(False)
        for pattern in README_NOISE:
            hit = hit | p.rlike("(?i)" + pattern)
        head = F.regexp_replace(F.lower(p), r"^[^a-z0-9$]+", "")
        for prefix in README_PREFIXES:
            hit = hit | head.startswith(prefix)
        return hit

    best = F.try_element_at(F.filter(paragraphs, lambda p: ~bad(p) & ~noisy(p)), F.lit(1))
    return F.coalesce(F.when(F.length(best) > limit, F.concat(F.left(best, F.lit(limit)), F.lit("…"))).otherwise(best), F.lit(""))


def entry_points(files: DataFrame, most: int = 24) -> DataFrame:
    """repo, path, kind, label, rank: what a repository's manifests declare, the most authoritative first, each path once.

    ``files`` has repo, path (relative) and text.  package.json: source, exports, module, main, bin; pyproject.toml:
    scripts and the package; Cargo.toml: bin and lib paths and the conventional targets; go.mod: main.go and cmd/*.
    """
    here = files.select("repo", F.regexp_replace("path", r"^\./", "").alias("path"))
    body = lambda name: files.where(F.regexp_replace("path", r"^\./", "") == name).select("repo", "text")
    field = lambda key: F.get_json_object("text", f"$.{key}")
    found = []

    def declared(rows: DataFrame, tier: int, targets: Column, kind: str, label: Column) -> None:
        """targets: an array of paths in order."""
        found.append(rows.select("repo", F.lit(tier).alias("tier"), F.posexplode(F.array_compact(targets)).alias("nth", "path"), F.lit(kind).alias("kind"), label.alias("label")))

    package = body("package.json")
    name = F.coalesce(field("name"), F.lit("package"))
    exports = F.regexp_extract_all(F.coalesce(field("exports"), F.lit("")), F.lit(r"\"?(\./[^\"]+)\"?"), F.lit(1))
    binaries = F.coalesce(F.map_values(F.from_json(field("bin"), "map<string,string>")), F.array().cast("array<string>"))
    declared(package, 0, F.array(field("source")), "package", name)
    declared(package, 1, exports, "subpath", name)
    declared(package, 2, F.array(field("module"), field("main")), "package", name)
    declared(package, 3, F.concat(F.array(F.when(~field("bin").startswith("{"), field("bin"))), binaries), "binary", name)
    python = body("pyproject.toml")
    project = F.coalesce(F.nullif(F.regexp_extract("text", r"(?m)^\[project\][^\[]*?^name\s*=\s*[\"']([^\"']+)", 1), F.lit("")), F.lit("package"))
    scripts = F.regexp_extract("text", r"(?ms)^\[project\.scripts\]\s*\n(.*?)(?=^\[|\Z)", 1)
    modules = F.transform(F.regexp_extract_all(scripts, F.lit(r"=\s*[\"']([\w.]+):"), F.lit(1)), lambda m: F.replace(m, F.lit("."), F.lit("/")))
    both = F.flatten(F.transform(modules, lambda m: F.array(F.concat(m, F.lit(".py")), F.concat(F.lit("src/"), m, F.lit(".py")), F.concat(m, F.lit("/__init__.py")), F.concat(F.lit("src/"), m, F.lit("/__init__.py")))))
    flat = F.replace(project, F.lit("-"), F.lit("_"))
    declared(python, 4, both, "script", project)
    declared(python, 5, F.array(F.concat(flat, F.lit("/__init__.py")), F.concat(F.lit("src/"), flat, F.lit("/__init__.py"))), "package", project)
    cargo = body("Cargo.toml")
    crate = F.coalesce(F.nullif(F.regexp_extract("text", r"(?ms)^\[package\].*?^name\s*=\s*\"([^\"]+)", 1), F.lit("")), F.lit("crate"))
    declared(cargo, 6, F.regexp_extract_all("text", F.lit(r"(?ms)^\[\[bin\]\].*?^path\s*=\s*\"([^\"]+)"), F.lit(1)), "binary", crate)
    declared(cargo, 7, F.regexp_extract_all("text", F.lit(r"(?ms)^\[lib\].*?^path\s*=\s*\"([^\"]+)"), F.lit(1)), "library", crate)
    declared(cargo, 8, F.array(F.lit("src/main.rs")), "binary", crate)
    declared(cargo, 9, F.array(F.lit("src/lib.rs")), "library", crate)
    go = body("go.mod").select("repo").distinct().join(here, "repo").where(F.col("path").rlike(r"^(cmd/[^/]+/)?main\.go$"))
    rows = found[0]
    for part in found[1:]:
        rows = rows.unionByName(part)
    rows = rows.withColumn("path", F.regexp_replace("path", r"^\./", "")).unionByName(go.select("repo", F.when(F.col("path") == "main.go", 10).otherwise(11).alias("tier"), F.lit(0).alias("nth"), "path", F.lit("binary").alias("kind"), F.coalesce(F.nullif(F.regexp_extract("path", r"^cmd/([^/]+)/", 1), F.lit("")), "repo").alias("label")))
    rows = rows.join(here, ["repo", "path"], "left_semi")
    first = rows.groupBy("repo", "path").agg(F.min(F.struct("tier", "nth", "kind", "label")).alias("e"))
    rank = F.row_number().over(W.partitionBy("repo").orderBy("e.tier", "e.nth", "path"))
    return first.select("repo", "path", "e.kind", "e.label", rank.alias("rank")).where(F.col("rank") <= most)


def json_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A local dataset: JSON lines or JSON arrays below a path."""
    reader = spark.read.option("recursiveFileLookup", True).option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def save_by_language(df: DataFrame, root: str, language: str = "lang") -> None:
    """Parquet with a folder a language."""
    df.write.mode("overwrite").partitionBy(language).parquet(root)


def export_bundle(tables: dict[str, DataFrame], root: str) -> None:
    """A static bundle: each table as JSON lines in its own folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{root}/{name}")


GRAPH_VERSION = 5
NODE_SCHEMA = "vid bigint, name string, unified_name string, type string, file string, start_line bigint, end_line bigint"
EDGE_SCHEMA = "src bigint, dst bigint, type string, anchor_file string, anchor_line bigint"


def save_graph(nodes: DataFrame, edges: DataFrame, root: str, version: int = GRAPH_VERSION) -> None:
    save_view(nodes.select(*[c.split()[0] for c in NODE_SCHEMA.split(", ")]), root, "nodes", version)
    save_view(edges.select(*[c.split()[0] for c in EDGE_SCHEMA.split(", ")]), root, "edges", version)


def load_graph(spark: SparkSession, root: str, version: int = GRAPH_VERSION) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the version this engine writes; a graph of another version is not there."""
    return load_view(spark, root, "nodes", version, NODE_SCHEMA), load_view(spark, root, "edges", version, EDGE_SCHEMA)


def save_postings(docs: DataFrame, id_col: str, tokens: Column, root: str, version: int) -> None:
    """A lexical view: documents with their length, postings, and document frequencies, so a search tokenises nothing again."""
    from quarry.operators import sparse

    rows = docs.withColumn("dl", F.size(tokens))
    save_view(rows, root, "docs", version)
    post = sparse.postings(docs, id_col, tokens)
    save_view(post, root, "postings", version)
    save_view(load_view(docs.sparkSession, root, "postings", version).groupBy("term").agg(F.count("*").alias("df")), root, "terms", version)


def save_vectors(vectors: DataFrame, root: str, version: int, level: str = "level") -> None:
    """A dense view, a folder a level, rows numbered within their level in the order of their id."""
    rows = vectors.withColumn("row", F.row_number().over(W.partitionBy(level).orderBy("node_id")) - 1)
    save_view(rows, root, "vectors", version, level)


def load_vectors(spark: SparkSession, root: str, version: int, level: str) -> DataFrame:
    """A level's vectors; rows whose numbers do not run from 0 fail when the result is evaluated."""
    rows = load_view(spark, root, "vectors", version).where(F.col("level") == level)
    ok = rows.agg((F.count("*") == F.countDistinct("row")) & (F.coalesce(F.max("row"), F.lit(-1)) == F.count("*") - 1)).scalar()
    return rows.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("row numbers of the dense view are broken")).cast("boolean")))
