"""Drafts of what may follow a context: continuations found in a corpus or in the context itself, and their fusion.

Corpus rows have doc and tokens (an array of ids); contexts have ctx and
tokens.  Matches are found by joins on short runs of tokens and extended by
array comparison; only positions whose run a context asks for are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _positions(size: Column, width: int) -> Column:
    return F.when(size >= width, F.sequence(F.lit(0), size - width)).otherwise(F.array().cast("array<int>"))


def _common_end(a: Column, b: Column) -> Column:
    """How many of the last entries of two arrays are equal."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(F.reverse(a), 1, n), F.slice(F.reverse(b), 1, n), lambda x, y: x == y)
    miss = F.array_position(same, False)
    return F.when(miss == 0, n).otherwise(miss - 1).cast("int")


def ngram_continuations(corpus: DataFrame, contexts: DataFrame, key_len: int = 4, max_candidates: int = 16, k: int = 3, max_tokens: int = 16) -> DataFrame:
    """ctx, rank, match, tokens: what followed the context's last ``key_len`` tokens elsewhere, longest agreement first.

    The newest ``max_candidates`` positions (by doc, then place) count; ties go to the older; a continuation stays in
    its document and is not empty.
    """
    if key_len < 1:
        raise ValueError("key_len must be positive")
    asked = contexts.where(F.size("tokens") >= key_len).select("ctx", F.col("tokens").alias("c"), F.slice("tokens", -key_len, key_len).alias("key"))
    # A context has one key, so its newest positions are those of the key: they are found once a key, however many ask.
    grams = corpus.select("doc", F.col("tokens").alias("d"), F.explode(_positions(F.size("tokens"), key_len)).alias("pos"))
    grams = grams.select("doc", "pos", F.slice("d", F.col("pos") + 1, key_len).alias("key")).join(asked.select("key").distinct(), "key", "left_semi")
    newest = F.row_number().over(W.partitionBy("key").orderBy(F.col("doc").desc(), F.col("pos").desc()))
    met = grams.withColumn("_n", newest).where(F.col("_n") <= max_candidates).drop("_n")
    # Of a document only what a context can agree with, and what follows, travels on.
    longest = asked.agg(F.coalesce(F.max(F.size("c")) - key_len, F.lit(0))).scalar()
    before = F.slice("d", F.greatest(F.col("pos") - longest, F.lit(0)) + 1, F.least(F.col("pos"), longest))
    met = met.join(corpus.select("doc", F.col("tokens").alias("d")), "doc")
    met = met.select("key", "doc", "pos", before.alias("_before"), F.slice("d", F.col("pos") + key_len + 1, max_tokens).alias("tokens")).where(F.size("tokens") > 0)
    met = met.join(asked, "key")
    met = met.withColumn("match", F.lit(key_len) + _common_end(F.slice("c", 1, F.size("c") - key_len), F.col("_before")))
    rank = F.row_number().over(W.partitionBy("ctx").orderBy(F.col("match").desc(), "doc", "pos"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("ctx", "rank", "match", "tokens")


def longest_suffix(corpus: DataFrame, contexts: DataFrame, min_match: int = 2, most: int = 64, max_tokens: int = 16) -> DataFrame:
    """ctx, match, tokens: the continuation of the newest place where the longest suffix of the context (at most ``most``) stands.

    Places are found by whole suffixes, so a context never meets the places of a shorter one.
    """
    if min_match < 1:
        raise ValueError("min_match must be positive")
    asked = contexts.where(F.size("tokens") >= min_match)
    reach = F.greatest(F.lit(min_match), F.least(F.size("tokens"), F.lit(most)))
    # A whole context found has no longer suffix to look for; only the others ask with all their suffixes.
    whole = asked.select("ctx", "tokens", reach.alias("match"))
    found = _newest(corpus, whole, min_match)
    others = whole.join(found, "ctx", "left_anti").select("ctx", "tokens", F.explode(F.sequence(F.lit(min_match), F.col("match"))).alias("match"))
    best = _newest(corpus, others, min_match).unionByName(found)
    best = best.join(corpus.select("doc", F.col("tokens").alias("d")), "doc").withColumn("tokens", F.slice("d", F.col("pos") + min_match + 1, max_tokens))
    return best.where(F.size("tokens") > 0).select("ctx", F.least("match", F.lit(most)).alias("match"), "tokens")


def _newest(corpus: DataFrame, asked: DataFrame, min_match: int) -> DataFrame:
    """ctx, match, doc, pos: the newest place of the longest of the suffixes asked (ctx, tokens, match) that stand in the corpus.

    A key's newest place is found once, however many contexts ask for it.  ``pos`` is where the last ``min_match`` tokens begin.
    """
    keys = asked.select("ctx", "match", F.slice("tokens", -F.col("match"), F.col("match")).alias("key"))
    lengths = F.broadcast(keys.agg(F.collect_set("match").alias("lengths")))
    grams = corpus.crossJoin(lengths).select("doc", "tokens", "lengths", F.explode(_positions(F.size("tokens"), min_match)).alias("pos"))
    grams = grams.select("doc", "pos", "tokens", F.explode("lengths").alias("n")).where(F.col("n") <= F.col("pos") + min_match)
    grams = grams.select("doc", "pos", F.slice("tokens", F.col("pos") + min_match + 1 - F.col("n"), F.col("n")).alias("key"))
    places = grams.join(keys.select("key").distinct().hint("shuffle_hash"), "key", "left_semi").groupBy("key").agg(F.max(F.struct("doc", "pos")).alias("at"))
    met = keys.join(places, "key").groupBy("ctx").agg(F.max(F.struct("match", "at")).alias("best"))
    return met.select("ctx", "best.match", "best.at.doc", "best.at.pos")


def copied(contexts: DataFrame, min_match: int = 2, max_match: int = 32, max_tokens: int = 16) -> DataFrame:
    """ctx, match, tokens: what followed the newest earlier occurrence of the context's longest repeated suffix."""
    rows = contexts.where(F.size("tokens") > min_match).select("ctx", "tokens", F.slice("tokens", -min_match, min_match).alias("_key"))
    rows = rows.withColumn("pos", F.explode(_positions(F.size("tokens") - 1, min_match))).where(F.slice("tokens", F.col("pos") + 1, min_match) == F.col("_key"))
    match = F.least(F.lit(min_match) + _common_end(F.slice("tokens", 1, F.size("tokens") - min_match), F.slice("tokens", 1, F.col("pos"))), F.lit(max_match))
    rows = rows.withColumn("match", match)
    best = F.row_number().over(W.partitionBy("ctx").orderBy(F.col("match").desc(), F.col("pos").desc()))
    rows = rows.withColumn("_n", best).where("_n = 1")
    return rows.select("ctx", "match", F.slice("tokens", F.col("pos") + min_match + 1, max_tokens).alias("tokens")).where(F.size("tokens") > 0)


def suffix_drafts(corpus: DataFrame, contexts: DataFrame, min_match: int = 2, max_tokens: int = 16) -> DataFrame:
    """ctx, match, tokens: the longer of the corpus' and the context's own continuation; ties go to the context."""
    own = copied(contexts, min_match, 1 << 20, max_tokens).withColumn("_own", F.lit(1))
    both = longest_suffix(corpus, contexts, min_match, 1 << 20, max_tokens).withColumn("_own", F.lit(0)).unionByName(own)
    best = F.row_number().over(W.partitionBy("ctx").orderBy(F.col("match").desc(), F.col("_own").desc()))
    return both.withColumn("_n", best).where("_n = 1").select("ctx", "match", "tokens")


def fused_drafts(branches: DataFrame, max_tokens: int | None = None) -> DataFrame:
    """ctx, path, token, depth, source: draft branches (ctx, tree, source, tokens) as one tree; shared beginnings are one node.

    A node's source is that of the first tree with it.  With a budget the tree is cut level by level, earlier trees first.
    """
    rows = branches.select("ctx", "tree", "source", "tokens", F.explode(F.when(F.size("tokens") > 0, F.sequence(F.lit(1), F.size("tokens"))).otherwise(F.array().cast("array<int>"))).alias("depth"))
    nodes = rows.select("ctx", F.slice("tokens", 1, F.col("depth")).alias("path"), "depth", "tree", "source")
    nodes = nodes.groupBy("ctx", "path", "depth").agg(F.min(F.struct("tree", "source")).alias("first"))
    if max_tokens is not None:
        nth = F.row_number().over(W.partitionBy("ctx").orderBy("depth", "first.tree", "path"))
        nodes = nodes.withColumn("_n", nth).where(F.col("_n") <= max_tokens)
    return nodes.select("ctx", "path", F.element_at("path", -1).alias("token"), "depth", F.col("first.source").alias("source"))
