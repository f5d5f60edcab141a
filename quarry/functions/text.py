"""Column functions over identifiers, paths, patches and prose.

All are built-in expressions, so they stay inside the JVM and can be pushed
into scans and filters.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directory names that hold tests, and words without content.
TEST_DIRS = ("test", "tests", "testing", "spec", "specs", "__tests__")
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "into", "is", "it", "of", "on", "or", "that", "the", "then", "this", "through", "to", "with")
SOURCE_EXTENSIONS = (
    ".py", ".pyx", ".go", ".rs", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", ".c", ".h", ".cc", ".cpp", ".hpp", ".cxx",
    ".java", ".rb", ".php", ".cs", ".kt", ".kts", ".swift", ".scala", ".lua", ".m", ".mm",
)
DECLARATION_SUFFIXES = (".d.ts", ".d.cts", ".d.mts", ".pyi", ".pxd")


def lexical_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; a call's ``()`` is dropped first."""
    plain = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\(\)", ""))
    return F.filter(F.split(plain, "[^a-z0-9]+"), lambda t: t != "")


def camel_parts(token: Column) -> Column:
    """Lower-case parts of a CamelCase, snake_case or kebab-case token, in order."""
    split = F.regexp_extract_all(F.coalesce(token, F.lit("")), F.lit("([A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+)"), F.lit(1))
    return F.transform(split, F.lower)


def path_tokens(path: Column) -> Column:
    """Parts longer than one character of all path segments, without the file's extension."""
    plain = F.regexp_replace(F.coalesce(path, F.lit("")), r"\.[A-Za-z0-9]+$", "")
    return F.filter(camel_parts(F.regexp_replace(plain, r"[\\/]+", "_")), lambda t: F.length(t) > 1)


def posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def normalized_path(path: Column) -> Column:
    """Repository-relative POSIX path: null if empty, absolute, or above the root."""
    plain = F.trim(posix(path))
    parts = F.filter(F.split(plain, "/"), lambda p: (p != "") & (p != "."))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("above"))

    def step(state: Column, part: Column) -> Column:
        kept, above = state["kept"], state["above"]
        up = part == ".."
        popped = F.when(F.size(kept) > 0, F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(kept)
        return F.struct(F.when(up, popped).otherwise(F.concat(kept, F.array(part))).alias("kept"), (above | (up & (F.size(kept) == 0))).alias("above"))

    done = F.aggregate(parts, start, step)
    bad = plain.isNull() | (plain == "") | plain.startswith("/") | plain.rlike("^[A-Za-z]:") | done["above"] | (F.size(done["kept"]) == 0)
    return F.when(~bad, F.array_join(done["kept"], "/"))


def normalized_symbol(value: Column) -> Column:
    """``file:Symbol`` with a normalised file; a bare symbol stays."""
    file = normalized_path(F.substring_index(value, ":", 1))
    rest = F.regexp_replace(value, "^[^:]*:", "")
    return F.when((value == "") | value.rlike("^[A-Za-z]:"), None).when(~value.contains(":"), value).when(file.isNotNull(), F.concat(file, F.lit(":"), rest))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.element_at(F.split(posix(path), "/"), -1), r"[^.](\.[^.]+)$", 1))


def has_extension(path: Column, allowed: Iterable[str]) -> Column:
    """In the allow-list, whatever the case; an empty list allows all, a null path is refused by any other."""
    wanted = [e.lower() if e.startswith(".") else f".{e.lower()}" for e in allowed if e]
    return F.coalesce(extension(path).isin(wanted), F.lit(False)) if wanted else F.lit(True)


def glob_pattern(glob: str) -> str:
    """A glob in which ``*`` crosses ``/``, as a pattern for whole paths."""
    out = ""
    for c in glob:
        out += ".*" if c == "*" else "." if c == "?" else c if c in "[]" else "\\" + c if not c.isalnum() and c not in "/_" else c
    return f"^{out}$".replace("[!", "[^")


def matches_any(path: Column, globs: Iterable[str]) -> Column:
    hit = F.lit(False)
    for g in globs:
        if g:
            hit = hit | F.coalesce(posix(path).rlike(glob_pattern(g)), F.lit(False))
    return hit


def is_test_path(path: Column) -> Column:
    """Test or spec file by directory or by name (retrieval rule)."""
    plain = posix(path)
    low = F.lower(plain)
    parts = F.filter(F.split(low, "/"), lambda p: p != "")
    name, raw = F.element_at(parts, -1), F.element_at(F.split(plain, "/"), -1)
    stem, raw_stem = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_replace(raw, r"\.[^.]*$", "")
    by_dir = F.exists(parts, lambda p: p.isin(*TEST_DIRS))
    by_name = name.rlike(r"^test_|_tests?\.py$|\.test\.|\.spec\.") | stem.rlike("[_-](test|tests|spec)$") | raw_stem.rlike("(Test|Tests|Spec)$")
    return F.coalesce(by_dir | by_name, F.lit(False))


def is_test_file(path: Column) -> Column:
    """Test file by the graph's rule: other directories, any name that starts with ``test``."""
    low = F.lower(posix(F.substring_index(path, ":", 1)))
    parts = F.filter(F.split(low, "/"), lambda p: p != "")
    name = F.element_at(parts, -1)
    by_dir = F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.isin("test", "tests", "spec", "specs", "__tests__"))
    return F.coalesce(by_dir | name.rlike(r"^test|_test\.[a-z]+$|\.(test|spec)\."), F.lit(False))


def is_source_file(path: Column) -> Column:
    name = F.element_at(F.split(F.lower(posix(F.substring_index(path, ":", 1))), "/"), -1)
    return F.coalesce(F.concat(F.lit("."), F.substring_index(name, ".", -1)).isin(*SOURCE_EXTENSIONS) & name.contains("."), F.lit(False))


def is_declaration_file(path: Column) -> Column:
    name = F.element_at(F.split(F.lower(posix(F.substring_index(path, ":", 1))), "/"), -1)
    hit = F.lit(False)
    for s in DECLARATION_SUFFIXES:
        hit = hit | name.endswith(s)
    return F.coalesce(hit, F.lit(False))


#: Where generated files lie and how they end, and what supports evidence rather than being it.
GENERATED_DIRS = ("dist", "build", "out", "node_modules", "vendor")
GENERATED_SUFFIXES = (".min.js", ".d.ts", ".d.cts", ".d.mts", ".map", ".snap")
SUPPORT_DIRS = ("doc", "docs", "documentation", "example", "examples", "benchmark", "benchmarks", "scripts")
DOCUMENT_SUFFIXES = (".md", ".mdx", ".rst", ".txt", ".adoc")


def _path_parts(path: Column) -> Column:
    return F.filter(F.split(F.lower(posix(F.substring_index(path, ":", 1))), "/"), lambda p: p != "")


def _in_dirs(parts: Column, names: Iterable[str]) -> Column:
    return F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.isin(*names))


def is_generated_file(path: Column) -> Column:
    """A build product or a copy of real source, by its directory or its ending."""
    parts = _path_parts(path)
    name = F.try_element_at(parts, F.lit(-1))
    return F.coalesce(_in_dirs(parts, GENERATED_DIRS) | functools.reduce(lambda a, b: a | b, [name.endswith(s) for s in GENERATED_SUFFIXES]), F.lit(False))


def is_supporting(path: Column) -> Column:
    """Tests, generated files, documents and what lies beside the source: good to corroborate, not to answer."""
    parts = _path_parts(path)
    name = F.try_element_at(parts, F.lit(-1))
    document = functools.reduce(lambda a, b: a | b, [name.endswith(s) for s in DOCUMENT_SUFFIXES])
    return F.coalesce(is_test_file(path) | is_generated_file(path) | _in_dirs(parts, SUPPORT_DIRS) | document, F.lit(False))


def path_allowed(path: Column, target: str | None = None, exclude: Iterable[str] = (), target_ancestors: bool = False, ignored: Iterable[str] = ()) -> Column:
    """Below the target directory (or, if asked, above it), in no ignored directory and matched by no exclusion; ``x/**`` also excludes x."""
    plain = F.regexp_replace(posix(path), r"^(\./)+", "")
    ok = plain != ""
    if target:
        own = target.strip("/")
        inside = (plain == own) | plain.startswith(own + "/")
        ok = ok & (inside | F.lit(own).startswith(F.concat(plain, F.lit("/"))) if target_ancestors else inside)
    if ignored:
        ok = ok & ~F.exists(F.split(plain, "/"), lambda p: p.isin(*ignored))
    for g in exclude:
        hit = plain.rlike(glob_pattern(g))
        if g.endswith("/**"):
            hit = hit | (plain == g[:-3]) | plain.startswith(g[:-2])
        ok = ok & ~hit
    return F.coalesce(ok, F.lit(False))


def file_class(path: Column) -> Column:
    return F.when(is_declaration_file(path), "declaration").when(is_generated_file(path), "generated").when(is_test_path(path), "test").when(is_source_file(path), "source").otherwise("other")


def bare_symbol(symbol: Column) -> Column:
    """The last name of a qualified symbol, without call parentheses."""
    last = F.element_at(F.split(symbol, r"[.:#/]+"), -1)
    return F.regexp_replace(last, r"\(\)$", "")


def module_of(path: Column, by: str = "directory") -> Column:
    return path if by == "file" else F.regexp_replace(F.when(path.contains("/"), path).otherwise(F.concat(F.lit("./"), path)), "/[^/]*$", "")


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def numbered(lines: Column, first: Column) -> Column:
    """Lines with their numbers, right-aligned to the last number's width, in one text."""
    width = F.length((first + F.size(lines) - 1).cast("string"))
    return F.array_join(F.transform(lines, lambda t, i: F.concat(F.lpad((first + i).cast("string"), width, " "), F.lit(" | "), t)), "\n")


def line_window(text: Column, first: int, last: int | None = None, most: int = 200, chars: int = 16000) -> Column:
    """Lines first to last, counted from 1, at most ``most`` lines and ``chars`` characters."""
    size = most if last is None else max(0, min(most, last - first + 1))
    return F.substring(F.array_join(F.slice(lines_of(text), max(1, first), size), "\n"), 1, chars)


def longest_line(text: Column) -> Column:
    return F.array_max(F.transform(lines_of(text), F.length))


def is_minified(text: Column, limit: int = 10000) -> Column:
    return longest_line(text) > limit


def patch_hunks(patch: Column) -> Column:
    """New-side ranges of a unified diff: array of (file, first, last); empty hunks are left out.

    A deleted file's hunks count for its old path.
    """
    start = F.struct(
        F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("file"),
        F.array().cast("array<struct<file:string,first:int,last:int>>").alias("out"),
    )
    head = r"^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)(?:,([0-9]+))? @@"

    def step(s: Column, line: Column) -> Column:
        old, file = line.startswith("--- a/"), line.startswith("+++ ")
        named = F.when(line.startswith("+++ b/"), F.substring(line, 7, 1 << 20)).otherwise(s["old"])
        first = F.regexp_extract(line, head, 1).try_cast("int")
        count = F.coalesce(F.regexp_extract(line, head, 2).try_cast("int"), F.lit(1))
        hunk = line.rlike(head) & s["file"].isNotNull() & (count > 0)
        row = F.struct(s["file"].alias("file"), first.alias("first"), (first + count - 1).alias("last"))
        return F.struct(
            F.when(old, F.substring(line, 7, 1 << 20)).otherwise(s["old"]).alias("old"),
            F.when(file, named).otherwise(s["file"]).alias("file"),
            F.when(hunk, F.concat(s["out"], F.array(row))).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(lines_of(patch), start, step)["out"]


def changed_loc(patch: Column) -> Column:
    """Added and deleted lines of a patch, headers aside."""
    return F.size(F.filter(lines_of(patch), lambda t: t.rlike("^[+-]") & ~t.rlike(r"^(\+\+\+|---)")))


def prose_terms(text: Column) -> Column:
    """Distinct content words: citation marks and markdown dropped, no stop words, two characters at least."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"\[((?:E|R)[0-9]+)\](?:\([^)]*\))?", " ")
    plain = F.regexp_replace(F.lower(plain), r"[`*_\[\]()#>/-]", " ")
    words = F.filter(F.split(plain, "[^a-z0-9]+"), lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))
    return F.array_distinct(words)


def base_form(term: Column) -> Column:
    """A word without light inflection."""
    n = F.length(term)
    return (
        F.when(term.endswith("ies") & (n > 4), F.concat(F.regexp_replace(term, "ies$", ""), F.lit("y")))
        .when(term.endswith("ing") & (n > 6), F.regexp_replace(term, "ing$", ""))
        .when(term.endswith("ed") & (n > 5), F.regexp_replace(term, "ed$", ""))
        .when(term.endswith("s") & ~term.endswith("ss") & (n > 4), F.regexp_replace(term, "s$", ""))
        .otherwise(term)
    )


def redundancy_terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(prose_terms(text), lambda t: ~t.isin("also", "function", "method")), base_form))


#: What marks a question as structural, lexical or semantic.
STRUCTURAL_PATTERNS = (
    r"\bwho\s+calls\b",
    r"\b(callers?|callees?)\b",
    r"\b(call\s+graph|dependency|dependencies)\b",
    r"\b(impact|blast\s+radius|reachable|references?)\b",
    r"\b(definitions?|usages?)\s+of\b",
    r"\b(inherits?|subclasses?|overrides?)\b",
    r"\b(data\s+flow|control\s+flow)\b",
)
LEXICAL_PATTERNS = (
    r"`[^`]+`",
    r"\b[A-Za-z_][A-Za-z0-9_]*\([^)]*\)",
    r"\b[A-Za-z_][A-Za-z0-9_]*\.[A-Za-z_][A-Za-z0-9_]*\b",
    r"\b[A-Za-z_][A-Za-z0-9_]*::[A-Za-z_][A-Za-z0-9_]*\b",
    r"\b[A-Za-z]+_[A-Za-z0-9_]+\b",
    r"\b[A-Z][A-Za-z0-9]*(Error|Exception|Factory|Manager|Service)\b",
    r"[\w./-]+\.(py|js|ts|go|rs|java|cpp|c|h|hpp|rb|php|kt|scala)\b",
)
SEMANTIC_WORDS = r"\b(how|why|what|when|where|explain|behavior|logic|flow|handle|support)\b"


def query_signals(query: Column) -> Column:
    """struct(structural, lexical, semantic): independent flags.

    Ten words or a question word make a query semantic; one that is neither that nor lexical counts as lexical if it
    has one to four words.
    """
    q = F.coalesce(query, F.lit(""))
    any_of = lambda patterns, flag: functools.reduce(lambda a, b: a | b, [q.rlike(flag + p) for p in patterns])
    n = F.size(F.regexp_extract_all(q, F.lit("[A-Za-z0-9_]+"), F.lit(0)))
    lexical = any_of(LEXICAL_PATTERNS, "")
    semantic = q.rlike("(?i)" + SEMANTIC_WORDS) | (n >= 10)
    return F.struct(any_of(STRUCTURAL_PATTERNS, "(?i)").alias("structural"), (lexical | (~semantic & n.between(1, 4))).alias("lexical"), semantic.alias("semantic"))
