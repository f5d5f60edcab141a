"""Definitions of source files by language, and chunks made from them.

A chunker is a description of a language: how a line begins a definition, how
comments and strings look, and how a body ends (braces, ``end`` words or
indentation).  One scanner reads all of them, a file at a time inside
``mapInPandas``, so a plug-in adds a ``Language`` and nothing else.  The scanner
knows no grammar: it sees definitions at the top level and members one level
below a type, which is what chunks are made of.

Chunk rows: file, kind, name, first, last (lines from 0), content, node_id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import intervals


@dataclass(frozen=True)
class Language:
    """extensions; (kind, pattern) of lines that begin a definition, the name as group ``name`` and an owner as ``owner``; ends: brace, indent or word; spans: (opening, closing, backslash escapes) of strings and comments that may hold lines."""

    name: str
    extensions: tuple[str, ...]
    starts: tuple[tuple[str, str], ...]
    ends: str = "brace"
    comment: str = "//"
    quotes: str = "\"'"
    spans: tuple[tuple[str, str, bool], ...] = ()
    containers: frozenset[str] = field(default_factory=lambda: frozenset({"class", "struct", "interface", "trait", "impl", "module", "object", "enum", "namespace"}))


_ID = r"(?P<name>[A-Za-z_]\w*)"
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|async|override|virtual|open|inline|suspend|data|export|default|declare|extern|unsafe|new|readonly|fileprivate|mutating|case|implicit|lazy|const|synchronized|native)\s+)*"
_C_TYPE = r"(?:[A-Za-z_][\w:<>,\[\]?&*. ]*?[\s*&]+)"
_CALL = r"\s*\([^;{]*(?:\{.*)?$"

LANGUAGES: tuple[Language, ...] = (
    Language("python", (".py", ".pyx", ".pyi"), (("class", rf"class\s+{_ID}"), ("function", rf"(?:async\s+)?def\s+{_ID}")), "indent", "#", spans=(('"""', '"""', True), ("'''", "'''", True))),
    Language("go", (".go",), (("method", rf"func\s+\(\s*\w*\s*\*?(?P<owner>\w+)[^)]*\)\s*{_ID}"), ("function", rf"func\s+{_ID}"), ("struct", rf"type\s+{_ID}\s+struct\b"), ("interface", rf"type\s+{_ID}\s+interface\b"), ("type", rf"type\s+{_ID}\s+\S")), quotes='"', spans=(("`", "`", False),)),
    Language("rust", (".rs",), (("function", rf"(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+\"[^\"]*\"\s+)*fn\s+{_ID}"), ("struct", rf"(?:pub(?:\([^)]*\))?\s+)?struct\s+{_ID}"), ("enum", rf"(?:pub(?:\([^)]*\))?\s+)?enum\s+{_ID}"), ("trait", rf"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+{_ID}"), ("impl", r"(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(?P<name>\w+)"), ("module", rf"(?:pub\s+)?mod\s+{_ID}\s*\{{")), quotes="", spans=(('r#"', '"#', False), ('"', '"', True))),
    Language("cpp", (".cpp", ".cxx", ".cc", ".c", ".hpp", ".h", ".hxx"), (("class", rf"(?:template\s*<.*>\s*)?class\s+{_ID}[^;]*$"), ("struct", rf"(?:typedef\s+)?(?:template\s*<.*>\s*)?struct\s+{_ID}[^;(]*$"), ("enum", rf"enum\s+(?:class\s+)?{_ID}[^;(]*$"), ("namespace", rf"namespace\s+{_ID}"), ("method", rf"{_C_TYPE}?(?P<owner>\w+)::~?{_ID}{_CALL}"), ("function", rf"(?!(?:return|else|if|for|while|switch|typedef|using)\b){_C_TYPE}{_ID}{_CALL}")), spans=(('R"(', ')"', False),)),
    Language("csharp", (".cs",), (("class", rf"{_MODS}(?:class|record)\s+{_ID}"), ("struct", rf"{_MODS}struct\s+{_ID}"), ("interface", rf"{_MODS}interface\s+{_ID}"), ("enum", rf"{_MODS}enum\s+{_ID}"), ("namespace", rf"namespace\s+(?P<name>[\w.]+)"), ("function", rf"(?!(?:return|else|if|for|foreach|while|switch|using|new|throw)\b){_MODS}{_C_TYPE}{_ID}(?:<[^>]*>)?{_CALL}")), spans=(('"""', '"""', False), ('@"', '"', False))),
    Language("java", (".java",), (("class", rf"{_MODS}(?:class|record)\s+{_ID}"), ("interface", rf"{_MODS}@?interface\s+{_ID}"), ("enum", rf"{_MODS}enum\s+{_ID}"), ("function", rf"(?!(?:return|else|if|for|while|switch|new|throw)\b){_MODS}(?:<[^>]*>\s*)?{_C_TYPE}{_ID}{_CALL}")), spans=(('"""', '"""', True),)),
    Language("javascript", (".js", ".jsx", ".mjs"), (("class", rf"(?:export\s+)?(?:default\s+)?class\s+{_ID}"), ("function", rf"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{_ID}"), ("function", rf"(?:export\s+)?(?:const|let|var)\s+{_ID}\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>"), ("method", rf"(?!(?:if|for|while|switch|return|function|catch)\b)(?:static\s+)?(?:async\s+)?(?:get\s+|set\s+)?\*?#?{_ID}\s*\([^)]*\)\s*\{{")), quotes="\"'", spans=(("`", "`", True),)),
    Language("typescript", (".ts", ".tsx", ".mts", ".cts"), (("class", rf"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?class\s+{_ID}"), ("interface", rf"(?:export\s+)?(?:declare\s+)?interface\s+{_ID}"), ("enum", rf"(?:export\s+)?(?:const\s+)?enum\s+{_ID}"), ("type", rf"(?:export\s+)?type\s+{_ID}\s*(?:<[^=]*>)?\s*="), ("function", rf"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{_ID}"), ("function", rf"(?:export\s+)?(?:const|let|var)\s+{_ID}[^=]*=\s*(?:async\s*)?(?:\([^)]*\)[^=]*|\w+)\s*=>"), ("method", rf"(?!(?:if|for|while|switch|return|function|catch)\b){_MODS}(?:get\s+|set\s+)?#?{_ID}\s*(?:<[^>]*>)?\([^)]*\)[^;]*\{{")), quotes="\"'", spans=(("`", "`", True),)),
    Language("kotlin", (".kt", ".kts"), (("class", rf"{_MODS}(?:enum\s+)?class\s+{_ID}"), ("interface", rf"{_MODS}(?:fun\s+)?interface\s+{_ID}"), ("object", rf"{_MODS}(?:companion\s+)?object\s+{_ID}"), ("function", rf"{_MODS}fun\s+(?:<[^>]*>\s*)?(?:[\w<>?]+\.)?{_ID}")), spans=(('"""', '"""', False),)),
    Language("lua", (".lua", ".luau"), (("method", rf"(?:local\s+)?function\s+(?P<owner>\w+)[.:]{_ID}"), ("function", rf"(?:local\s+)?function\s+{_ID}"), ("function", rf"(?:local\s+)?{_ID}\s*=\s*function\b")), "word", "--", spans=(("--[[", "]]", False), ("[[", "]]", False))),
    Language("php", (".php", ".phtml"), (("class", rf"{_MODS}class\s+{_ID}"), ("interface", rf"interface\s+{_ID}"), ("trait", rf"trait\s+{_ID}"), ("function", rf"{_MODS}function\s+&?{_ID}")), quotes="", spans=(("'", "'", True), ('"', '"', True))),
    Language("ruby", (".rb",), (("class", r"class\s+(?P<name>[A-Z][\w:]*)"), ("module", r"module\s+(?P<name>[A-Z][\w:]*)"), ("function", r"def\s+(?:self\.)?(?P<name>[A-Za-z_]\w*[?!=]?)")), "word", "#", quotes="'", spans=(('"', '"', True),)),
    Language("scala", (".scala", ".sc"), (("class", rf"{_MODS}class\s+{_ID}"), ("object", rf"{_MODS}object\s+{_ID}"), ("trait", rf"{_MODS}trait\s+{_ID}"), ("function", rf"{_MODS}def\s+{_ID}")), spans=(('"""', '"""', False),)),
    Language("swift", (".swift",), (("class", rf"{_MODS}class\s+{_ID}"), ("struct", rf"{_MODS}struct\s+{_ID}"), ("enum", rf"{_MODS}(?:indirect\s+)?enum\s+{_ID}"), ("interface", rf"{_MODS}protocol\s+{_ID}"), ("class", rf"{_MODS}extension\s+{_ID}"), ("function", rf"{_MODS}func\s+{_ID}")), spans=(('"""', '"""', True),)),
)
BY_NAME = {x.name: x for x in LANGUAGES}


def register(language: Language) -> None:
    """Add a language, or replace the one of that name."""
    global LANGUAGES
    LANGUAGES = (*(x for x in LANGUAGES if x.name != language.name), language)
    BY_NAME[language.name] = language


def extension_languages() -> dict[str, str]:
    """Extension -> language, earlier languages first."""
    return {e: x.name for x in reversed(LANGUAGES) for e in x.extensions}


def language_of(path: Column) -> Column:
    """The language of a file by its extension; null for others."""
    known = F.create_map(*[F.lit(v) for pair in extension_languages().items() for v in pair])
    return F.try_element_at(known, T.extension(path))


@cache
def _opaque(language: Language) -> re.Pattern:
    """Comments and strings of a language, the longest opening first; what is not closed runs to the end of the line, or of the text if it may hold lines."""
    esc = re.escape
    parts = []
    for left, right, escapes in language.spans:
        inner = rf"(?:\\[\s\S]|(?!{esc(right)})[\s\S])*" if escapes else rf"(?:(?!{esc(right)})[\s\S])*"
        parts.append((left, rf"{esc(left)}{inner}(?:{esc(right)}|\Z)"))
    parts.append((language.comment, rf"{esc(language.comment)}[^\n]*"))
    if language.comment == "//":
        parts.append(("/*", r"/\*[\s\S]*?(?:\*/|\Z)"))
    for q in language.quotes:
        # After a letter an apostrophe belongs to a word or a number, unless the letters are a string's prefix.
        before = r"(?:(?<![^\W_])|(?<=\b[rbfuRBFU])|(?<=\b[rbfuRBFU][rbfRBF]))" if q == "'" else ""
        parts.append((q, rf"{before}{q}(?:\\[\s\S]|[^{q}\\\n])*(?:{q}|(?=\n)|\Z)"))
    return re.compile("|".join(p for _, p in sorted(parts, key=lambda x: -len(x[0]))))


def _bare_lines(text: str, language: Language) -> tuple[list[str], frozenset[int]]:
    """Lines without strings and comments, so that only code is counted, and the lines that begin inside one."""
    out, within, at, line = [], set(), 0, 0
    for m in _opaque(language).finditer(text):
        out.append(text[at : m.start()])
        line += out[-1].count("\n")
        held = m.group().count("\n")
        within.update(range(line + 1, line + held + 1))
        line += held
        out.append("\n" * held)
        at = m.end()
    return ("".join(out) + text[at:]).split("\n"), frozenset(within)


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def _end(bare: list[str], lines: list[str], within: frozenset[int], at: int, language: Language) -> int:
    """The last line of the definition that begins at a line; lines that begin inside a string or comment end none."""
    if language.ends == "indent":
        own, last, depth = _indent(lines[at]), at, 0
        for i in range(at, len(lines)):
            if i > at and depth <= 0 and i not in within and lines[i].strip() and _indent(lines[i]) <= own and not lines[i].lstrip().startswith((")", "]", "}", language.comment)):
                break
            depth += sum(bare[i].count(c) for c in "([{") - sum(bare[i].count(c) for c in ")]}")
            if lines[i].strip():
                last = i
        return last
    if language.ends == "word":
        own = _indent(lines[at])
        if re.search(r"\bend\b", bare[at]):
            return at
        for i in range(at + 1, len(lines)):
            if i not in within and lines[i].strip() and _indent(lines[i]) <= own and re.match(r"\s*end\b", bare[i]):
                return i
        return len(lines) - 1
    depth, opened = 0, False
    for i in range(at, len(lines)):
        for c in bare[i]:
            if c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth -= 1
                if opened and depth == 0:
                    return i
            elif c == ";" and not opened and depth == 0:
                return i
        if not opened and i > at and i not in within and not bare[i].strip():
            return i - 1
    return len(lines) - 1


def definitions(text: str, language: Language) -> list[tuple[str, str, int, int, str]]:
    """(kind, name, first, last, owner) of a file's top-level definitions and of the members of its types, in source order."""
    lines = text.split("\n")
    bare, within = _bare_lines(text, language)
    starts = [(kind, re.compile(r"\s*" + p)) for kind, p in language.starts]
    out: list[tuple[str, str, int, int, str]] = []

    def scan(at: int, stop: int, owner: str, level: int) -> None:
        i = at
        while i < stop:
            hit = next(((k, m) for k, p in starts if (m := p.match(bare[i] if language.ends != "word" else lines[i]))), None) if bare[i].strip() and i not in within else None
            if hit is None:
                # A body that belongs to nothing known is passed over.
                i = max(i, _end(bare, lines, within, i, language)) + 1 if language.ends == "brace" and "{" in bare[i] and "}" not in bare[i] else i + 1
                continue
            kind, m = hit
            own = m.groupdict().get("owner") or owner
            name, last = m["name"], min(_end(bare, lines, within, i, language), stop - 1)
            first = i
            while first > at and lines[first - 1].lstrip().startswith("@") and language.ends != "word":
                first -= 1
            if kind == "function" and own:
                kind = "method"
            elif kind == "method" and not own:
                kind = "function"
            if kind != "namespace":
                out.append((kind, f"{own}.{name}" if own else name, first, last, own))
            if kind in language.containers and level < 2 and last > i:
                inner = i + 1
                wide = kind in ("namespace", "module")  # holds types as the file does
                scan(inner, last if language.ends != "indent" else last + 1, owner if wide else name, level if wide else level + 1)
            i = last + 1

    scan(0, len(lines), "", 1)
    return out


def _signature(lines: list[str], first: int, last: int, language: Language) -> str:
    """The lines of a definition up to its body."""
    out = []
    for i in range(first, last + 1):
        line = lines[i]
        out.append(line)
        plain = line.rstrip()
        if line.lstrip().startswith("@"):
            continue
        if plain.endswith((":", "{", ";", "}")) or language.ends == "word":
            break
    return re.sub(r"\s*\{\s*$", "", "\n".join(out).rstrip())


def chunked(text: str, path: str, language: Language, skeleton: bool = False) -> list[tuple[str, str, int, int, str, str]]:
    """(kind, name, first, last, content, node_id): header, definitions and epilogue of a file in order.

    Members stand for their type; text between definitions is not a chunk; a blank header or epilogue is none.  With
    ``skeleton`` the file is one chunk of its signatures, members indented.
    """
    lines = text.split("\n")
    found = definitions(text, language)
    if skeleton:
        body = [("    " if owner and kind == "method" else "") + _signature(lines, a, b, language).strip() for kind, _, a, b, owner in found]
        return [("file", path.rsplit("/", 1)[-1], 0, len(lines) - 1, "\n".join(body) if body else text, path)]
    # A container that holds other definitions is represented by them.
    leaves = [(kind, name, a, b) for i, (kind, name, a, b, _) in enumerate(found) if not (kind in language.containers and i + 1 < len(found) and found[i + 1][2] <= b)]
    out = []
    cut = lambda a, b: "\n".join(lines[a : b + 1])
    if leaves and cut(0, leaves[0][2] - 1).strip() and leaves[0][2] > 0:
        out.append(("header", "header", 0, leaves[0][2] - 1, cut(0, leaves[0][2] - 1), path))
    for kind, name, a, b in leaves:
        call = "()" if kind in ("function", "method") else ""
        out.append((kind, name, a, b, cut(a, b), f"{path}:{name}{call}"))
    at = leaves[-1][3] + 1 if leaves else 0
    if at < len(lines) and cut(at, len(lines) - 1).strip():
        out.append(("epilogue", "epilogue", at, len(lines) - 1, cut(at, len(lines) - 1), path))
    return out


CHUNKS = "file string, language string, kind string, name string, first bigint, last bigint, content string, node_id string"


def _chunk_files(batches: Iterator[pd.DataFrame], skeleton: bool, languages: dict[str, Language]) -> Iterator[pd.DataFrame]:
    columns = [f.split()[0] for f in CHUNKS.split(", ")]
    for pdf in batches:
        rows = []
        for path, name, text in zip(pdf["file"], pdf["language"], pdf["text"]):
            if text:
                rows += [(path, name, *chunk) for chunk in chunked(text, path, languages[name], skeleton)]
        yield pd.DataFrame(rows, columns=columns)


def chunk_files(files: DataFrame, skeleton: bool = False, line_limit: int | None = None) -> DataFrame:
    """Chunks of files (path, text) in a known language; longer ones than ``line_limit`` lines in balanced pieces under one node id."""
    rows = files.select(F.col("path").alias("file"), language_of(F.col("path")).alias("language"), "text").where("language IS NOT NULL")
    out = rows.mapInPandas(partial(_chunk_files, skeleton=skeleton, languages=dict(BY_NAME)), CHUNKS)
    if line_limit is None or skeleton:
        return out
    out = intervals.balanced_split(out, "first", "last", line_limit)
    start = (F.col("piece_start") - F.col("first") + 1).cast("int")
    piece = F.array_join(F.slice(F.split("content", "\n"), start, (F.col("piece_end") - F.col("piece_start") + 1).cast("int")), "\n")
    return out.withColumn("content", piece).withColumn("first", F.col("piece_start")).withColumn("last", F.col("piece_end")).drop("piece", "piece_start", "piece_end")


def file_bounds(definitions_: DataFrame, n_lines: DataFrame) -> DataFrame:
    """file, header_last, epilogue_first: what lies before a file's first definition and after its last; null where nothing does."""
    b = definitions_.groupBy("file").agg(F.min("first").alias("_a"), F.max("last").alias("_b")).join(n_lines, "file")
    return b.select("file", F.when(F.col("_a") > 0, F.col("_a") - 1).alias("header_last"), F.when(F.col("_b") < F.col("n_lines") - 1, F.col("_b") + 1).alias("epilogue_first"))


def code_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of files (path, text): files, definitions, containment, and references of names that one definition has.

    A reference goes from the definition a name stands in to the one definition of that name, with its line as anchor.
    """
    chunks = chunk_files(files).where("kind NOT IN ('header', 'epilogue', 'file')")
    vid = lambda *c: F.shiftrightunsigned(F.xxhash64(*c), 1)
    symbol_type = F.when(F.col("kind").isin("function", "method"), F.col("kind")).otherwise("class")
    none = F.lit(None)
    symbols = chunks.select(vid("node_id", "first").alias("vid"), F.concat("node_id", F.lit(":"), F.col("first").cast("string")).alias("name"), F.col("node_id").alias("unified_name"), symbol_type.alias("type"), "file", F.col("first").alias("start_line"), F.col("last").alias("end_line"))
    f = files.select(F.col("path").alias("file"))
    file_nodes = f.select(vid("file").alias("vid"), F.col("file").alias("name"), F.col("file").alias("unified_name"), F.lit("file").alias("type"), none.cast("string").alias("file"), none.cast("bigint").alias("start_line"), none.cast("bigint").alias("end_line"))
    contain = symbols.select(vid("file").alias("src"), F.col("vid").alias("dst"), F.lit("contain").alias("type"), none.cast("string").alias("anchor_file"), none.cast("bigint").alias("anchor_line"))
    leaf = F.regexp_replace(F.element_at(F.split("unified_name", "[:.]"), -1), r"\(\)$", "")
    unique = symbols.groupBy(leaf.alias("leaf")).agg(F.count("*").alias("n"), F.min("vid").alias("dst")).where("n = 1").select("leaf", "dst")
    used = chunks.select(vid("node_id", "first").alias("src"), "file", "first", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    used = used.select("src", "file", (F.col("first") + F.col("at")).alias("anchor_line"), F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"\b[A-Za-z_]\w*\b"), F.lit(0)))).alias("leaf"))
    refs = used.join(unique, "leaf").where("src <> dst").select("src", "dst", F.lit("reference").alias("type"), F.col("file").alias("anchor_file"), "anchor_line")
    return symbols.unionByName(file_nodes), contain.unionByName(refs)


def first_chunk(chunks: DataFrame) -> DataFrame:
    """Chunks without repeats of (node_id, first, last); the first in file order stays."""
    n = F.row_number().over(W.partitionBy("node_id", "first", "last").orderBy("file", "name"))
    return chunks.withColumn("_n", n).where("_n = 1").drop("_n")
