"""Routes through a symbol graph: query terms, seeds, roles and scores of candidates.

Nodes have vid, name (canonical), unified_name, type, file, start_line and
end_line.  Everything is a column expression or a join on names and edges, so
a whole batch of questions is answered by one plan.
"""

from __future__ import annotations

import functools
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words without meaning for a route, what else a question's word asks for, and what words tell of a role.
ROUTE_STOPWORDS = (
    "and", "arg", "args", "bool", "case", "class", "ctx", "data", "dict", "else", "err", "error", "false", "file", "func", "int", "kwargs",
    "list", "none", "null", "object", "return", "self", "str", "string", "true", "type",
)
SYNONYMS = {
    "cached": ("cache",),
    "caching": ("cache",),
    "directory": ("dir", "location", "path"),
    "directories": ("dir", "location", "path"),
    "fetch": ("download", "retrieve"),
    "fetches": ("download", "retrieve"),
    "fetching": ("download", "retrieve"),
    "location": ("path",),
    "locations": ("path",),
    "placeholder": ("replace", "replacer", "replacement", "template"),
    "placeholders": ("replace", "replacer", "replacement", "template"),
    "property": ("provider", "value"),
    "properties": ("provider", "value"),
    "retrieval": ("retrieve", "download", "cache"),
    "retrieve": ("download", "cache"),
    "retrieves": ("download", "cache"),
    "retrieving": ("download", "cache"),
    "resolution": ("resolve", "resolver", "replace", "replacer"),
    "resolved": ("resolve", "resolver", "replace", "replacer"),
    "substitution": ("replace", "replacer", "replacement"),
    "substitute": ("replace", "replacer", "replacement"),
    "token": ("replace", "replacer", "replacement", "template"),
    "tokens": ("replace", "replacer", "replacement", "template"),
    "variable": ("replace", "replacer", "replacement"),
    "variables": ("replace", "replacer", "replacement"),
}
BRIDGE_TERMS = (
    "adapter", "build", "builder", "download", "factory", "fetch", "make", "new", "open", "replace", "replacement", "resolver", "retrieve", "template",
)
PROVIDER_TERMS = ("cache", "config", "default", "directory", "env", "location", "path", "provider", "property", "setting", "url", "value")
ENDPOINT_TERMS = ("apply", "check", "detect", "handle", "handler", "main", "process", "run", "validate")
SUFFIXES = ("ing", "ers", "er", "ments", "ment", "es", "s")
SEED_STOPWORDS = ("BUG", "TODO", "FIXME", "NOTE", "XXX", "HACK", "WARNING", "ERROR")
DOMAIN_HINTS = ("com", "dev", "docs", "github", "html", "http", "https", "io", "net", "org", "readthedocs", "sh", "www")
SEED_TYPES = ("class", "field", "function", "method")
ROLE_RANK = {"endpoint": 0, "bridge": 1, "provider": 2, "type": 3, "support": 4}
ROLE_BONUS = {"endpoint": 4.0, "bridge": 3.0, "provider": 2.0, "type": 1.0, "support": 0.0}


def _words(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def route_terms(text: Column) -> Column:
    """Distinct lower-case parts of the identifiers in a text: three letters or more, no stop words, also without common endings."""
    names = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    parts = F.filter(F.flatten(F.transform(names, lambda w: F.split(w, "_+"))), lambda p: p != "")

    def pieces(part: Column) -> Column:
        found = F.regexp_extract_all(part, F.lit("[A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|$)|[0-9]+"), F.lit(0))
        return F.transform(F.when(F.size(found) > 0, found).otherwise(F.array(part)), F.lower)

    words = F.filter(F.flatten(F.transform(parts, pieces)), lambda w: (F.length(w) >= 3) & ~w.isin(*ROUTE_STOPWORDS))

    def forms(word: Column) -> Column:
        cut = [F.when(word.endswith(s) & (F.length(word) > len(s) + 2), F.left(word, F.length(word) - len(s))) for s in SUFFIXES]
        return F.array_compact(F.array(word, *cut))

    return F.array_distinct(F.flatten(F.transform(words, forms)))


def query_terms(query: Column) -> Column:
    """Route terms of a question with what its words also ask for."""
    terms = route_terms(query)
    known = F.create_map(*chain.from_iterable((F.lit(k), _words(v)) for k, v in SYNONYMS.items()))
    more = F.flatten(F.transform(terms, lambda t: F.coalesce(F.try_element_at(known, t), F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(terms, more))


def bare(symbol: Column) -> Column:
    """The last name of a qualified symbol, without call parentheses."""
    return F.trim(F.regexp_replace(F.element_at(F.split(symbol, "[:.#]"), -1), "[()]+$", ""))


def symbol_seeds(text: Column, limit: int = 8) -> Column:
    """Names that a task text holds: quoted ones first, then tokens that look like code; distinct without regard to case."""
    quoted = F.transform(F.regexp_extract_all(text, F.lit("`([^`\n]{2,100})`"), F.lit(1)), lambda s: F.regexp_replace(F.trim(s), "^[`'\"]+|[`'\"]+$", ""))
    token = F.regexp_extract_all(text, F.lit(r"[A-Za-z_][A-Za-z0-9_]{2,}(?:\.[A-Za-z_][A-Za-z0-9_]{2,})*"), F.lit(0))
    codeish = r"_|[a-z][A-Z]|[0-9][A-Z]|[A-Za-z_][A-Za-z0-9_]*\.[A-Za-z_]"
    shout = lambda t: (F.upper(t) == t) & t.rlike("[A-Z]") & (F.length(t) >= 3)
    token = F.filter(token, lambda t: ~F.upper(t).isin(*SEED_STOPWORDS) & (t.rlike(codeish) | shout(t)))
    seeds = F.filter(F.concat(quoted, token), lambda s: s != "")
    low = F.transform(seeds, F.lower)
    first = F.filter(seeds, lambda s, i: F.array_position(low, F.lower(s)) == i + 1)
    return F.slice(first, 1, max(1, limit))


def is_specific_seed(seed: Column) -> Column:
    """Whether a seed is specific enough to start a route without further checks."""
    text = F.regexp_replace(F.trim(F.coalesce(seed, F.lit(""))), "^[`'\"]+|[`'\"]+$", "")
    call = text.rlike(r"^[A-Za-z_][A-Za-z0-9_]*(?:[.:#][A-Za-z_][A-Za-z0-9_]*)*\(\)$")
    shaped = (text != "") & ~text.rlike(r"\s|[\"'`\[\]{}]") & F.when(text.rlike("[()]"), call).otherwise(~text.contains("://") & ~text.contains("@"))
    check = F.regexp_replace(text, r"\(\)$", "")
    mixed = lambda s: s.rlike("[A-Za-z]") & s.rlike("[0-9]") & (F.lower(s) != s)
    shout = lambda s: s.rlike("[A-Z]") & (F.upper(s) == s) & (F.length(s) >= 3)
    own = lambda s: s.contains("_") | s.rlike("[a-z][A-Z]") | shout(s) | mixed(s)
    domain = F.exists(F.split(F.lower(check), "[./]"), lambda p: p.isin(*DOMAIN_HINTS))
    dotted = ~domain & F.exists(F.split(check, r"\."), own)
    named = check.contains("_") | text.rlike("[a-z][A-Z]") | shout(text) | mixed(text)
    return shaped & F.when(check.rlike("/|::|#"), True).when(check.contains("."), dotted).otherwise(named)


def role(type_: Column, label: Column, terms: Column, asked: Column, lines: Column) -> Column:
    """type, provider, bridge, endpoint or support: by kind, then by name and words, then by size."""
    leaf, overlap = F.lower(bare(label)), F.arrays_overlap(terms, asked)
    has = lambda values: F.arrays_overlap(terms, _words(values))
    return (
        F.when(type_.isin("class", "field"), "type")
        .when(leaf.rlike("^(get|default)") | (has(PROVIDER_TERMS) & overlap), "provider")
        .when(leaf.rlike("^(new|make|build)") | (has(BRIDGE_TERMS) & overlap), "bridge")
        .when(type_.isin("function", "method") & ((lines > 1) | has(ENDPOINT_TERMS)), "endpoint")
        .otherwise("support")
    )


def _by_role(role_: Column, values: dict) -> Column:
    return functools.reduce(lambda c, kv: c.when(role_ == kv[0], kv[1]), values.items(), F)


def candidate_score(terms: Column, asked: Column, seed_rank: Column, direct: Column, role_: Column) -> Column:
    """5 a shared word, up to 8 for an early seed or 3 for a neighbour, and a bonus for the role."""
    return 5.0 * F.size(F.array_intersect(terms, asked)) + F.when(direct, F.greatest(8 - seed_rank, F.lit(0)).cast("double")).otherwise(3.0) + _by_role(role_, ROLE_BONUS)


def described(nodes: DataFrame) -> DataFrame:
    """Nodes with the words of their file and names (``terms``), of their names alone (``name_terms``), and their lines."""
    label = F.coalesce(F.col("unified_name"), F.col("name"))
    own = F.concat_ws(" ", label, "name")
    size = F.greatest(F.coalesce(F.col("end_line"), F.col("start_line"), F.lit(0)) - F.coalesce("start_line", F.lit(0)) + 1, F.lit(0))
    return nodes.select("vid", "name", "type", label.alias("label"), route_terms(F.concat_ws(" ", F.coalesce("file", F.lit("")), own)).alias("terms"), route_terms(own).alias("name_terms"), size.alias("lines"))


def query_seeds(nodes: DataFrame, queries: DataFrame, limit: int = 12, least: int = 2) -> DataFrame:
    """query_id, vid, overlap, score, rank: nodes that share at least ``least`` words with a question, by score.

    Questions and nodes meet by shared words, so only nodes with one of them are compared.  A node's place among the
    question's matches, in vid order, counts like a seed's.
    """
    typed = nodes.where(F.col("type").isin(*SEED_TYPES))
    asked = queries.select("query_id", "asked", F.explode("asked").alias("word"))
    words = typed.select("vid", F.explode("name_terms").alias("word"))
    met = words.join(asked.select("query_id", "word"), "word").groupBy("query_id", "vid").agg(F.count("*").alias("overlap")).where(F.col("overlap") >= least)
    rows = met.join(queries.select("query_id", "asked"), "query_id").join(typed, "vid")
    rows = rows.withColumn("role", role(F.col("type"), F.col("label"), F.col("terms"), F.col("asked"), F.col("lines")))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("vid")) - 1
    rows = rows.withColumn("place", place)
    score = candidate_score(F.col("terms"), F.col("asked"), F.col("place"), F.lit(True), F.col("role")) + 6.0 * F.col("overlap")
    rows = rows.withColumn("score", score)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "label", "vid"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "vid", "overlap", "role", "score", "rank")


def route(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, queries: DataFrame, k: int = 12, include_neighbors: bool = True) -> DataFrame:
    """query_id, vid, role, source, score, rank: route anchors of each question.

    ``seeds`` has query_id, vid and seed_rank (from 0); ``queries`` has query_id and asked (query terms).  Neighbours of
    a seed come in if their role or words fit.  Order: seeds before neighbours, score, role, place, label; a node stays
    once a question.
    """
    d = described(nodes)
    base = seeds.join(queries.select("query_id", "asked"), "query_id")
    rows = base.select("query_id", "asked", "vid", "seed_rank", F.lit(0).alias("side"), F.col("vid").alias("via"))
    if include_neighbors:
        pairs = edges.select("src", "dst").distinct()
        out = base.join(pairs, F.col("vid") == F.col("src")).select("query_id", "asked", F.col("dst").alias("vid"), "seed_rank", F.lit(1).alias("side"), F.col("src").alias("via"))
        into = base.join(pairs, F.col("vid") == F.col("dst")).select("query_id", "asked", F.col("src").alias("vid"), "seed_rank", F.lit(2).alias("side"), F.col("dst").alias("via"))
        rows = rows.unionByName(out).unionByName(into)
    rows = rows.join(d, "vid").withColumn("role", role(F.col("type"), F.col("label"), F.col("terms"), F.col("asked"), F.col("lines")))
    fits = F.when(F.size("asked") == 0, F.col("role").isin("endpoint", "bridge"))
    fits = fits.otherwise((F.col("role") != "support") & (F.arrays_overlap("terms", "asked") | F.col("role").isin("endpoint", "bridge")))
    rows = rows.where((F.col("side") == 0) | fits)
    # A neighbour's place counts the candidates before it.
    nth = F.row_number().over(W.partitionBy("query_id").orderBy("seed_rank", "via", "side", "vid")) - 1
    rows = rows.withColumn("place", F.when(F.col("side") == 0, F.col("seed_rank")).otherwise(F.col("seed_rank") + nth))
    rows = rows.withColumn("score", candidate_score(F.col("terms"), F.col("asked"), F.col("seed_rank"), F.col("side") == 0, F.col("role")))
    order = [F.least("side", F.lit(1)), F.col("score").desc(), _by_role(F.col("role"), ROLE_RANK), "place", "label"]
    first = F.row_number().over(W.partitionBy("query_id", "vid").orderBy(*order))
    rows = rows.withColumn("_first", first).where("_first = 1")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    source = F.when(F.col("side") == 0, "seed").otherwise("neighbor")
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "vid", "role", source.alias("source"), "score", "rank")
