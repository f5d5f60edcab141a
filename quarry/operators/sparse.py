"""Lexical retrieval: BM25 over postings, grep, identifier occurrences, trigram search.

Postings are one aggregation over exploded tokens; a query batch is one join on
terms, so the corpus is read once for all queries, and only documents that hold
a query term reach the ranking window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import text, trigrams
from quarry.shipping import attach

from . import impact
from .impact import B, EPSILON, K1


def postings(docs: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """id, term, tf, dl."""
    rows = docs.select(F.col(id_col).alias("id"), tokens.alias("tokens"))
    rows = rows.select("id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    return rows.groupBy("id", "term", "dl").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, id_col: str, query_col: str, k: int, doc_tokens: Column, query_tokens: Column) -> DataFrame:
    """query_id, id, score, rank: Okapi scores of the min(k, n) best documents of each query, from the texts themselves.

    A term's negative idf is replaced by EPSILON times the mean idf of all terms; a term asked twice counts twice; a
    document without any of the terms scores 0.  Repeated searches of one corpus read a kept view (``impact``), which
    ranks alike.
    Document frequencies are counted map-side over each text's distinct terms; only asked terms reach the shuffle of
    term frequencies.  The corpus' size and means are scalar subqueries, so no job runs before the result is asked for.
    """
    rows = docs.select(F.col(id_col).alias("id"), doc_tokens.alias("tokens"))
    n = rows.agg(F.count("*").cast("double")).scalar()
    mean = rows.agg(F.avg(F.size("tokens"))).scalar()
    df = rows.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = df.withColumn("idf", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = idf.agg(F.avg("idf") * EPSILON).scalar()
    asked = queries.select(F.col(query_col).alias("query_id"), F.explode(query_tokens).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    terms = asked.select("term").distinct()
    weight = idf.join(terms, "term", "left_semi").select("term", F.when(F.col("idf") < 0, floor).otherwise(F.col("idf")).alias("idf"))
    held = rows.select("id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).join(terms, "term", "left_semi")
    held = held.groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))
    share = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / mean))
    held = held.select("term", "id", share.alias("share"))
    hits = held.join(asked.join(weight, "term"), "term")
    scored = hits.groupBy("query_id", "id").agg(F.sum(impact.contribution(F.col("times") * F.col("idf"), F.col("share"))).alias("units"))
    return impact.ranked(scored, queries.select(F.col(query_col).alias("query_id")), rows, floor, k)


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, id_col: str, query_col: str, k: int, max_k: int, doc_tokens: Column, query_tokens: Column, is_test: Column | None = None, view: impact.View | None = None) -> DataFrame:
    """BM25 candidates, then the test filter, then the cut: fewer than k rows may stay.  ``score`` is 0, the true one is ``bm25``.

    With a kept view of the documents no text is tokenised.
    """
    if view is not None:
        rows = impact.search(view, queries, query_col, max_k, query_tokens)
    else:
        rows = bm25(docs, queries, id_col, query_col, max_k, doc_tokens, query_tokens)
    rows = rows.withColumnRenamed("score", "bm25")
    if is_test is not None:
        rows = rows.join(docs.where(~is_test).select(F.col(id_col).alias("id")), "id")
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= k)
    return rows.select("query_id", "id", F.lit(0.0).alias("score"), "bm25", "rank")


def first_chunks(chunks: DataFrame, key: list[str], order: str) -> DataFrame:
    """Chunks without repeats of a key; the first in order stays."""
    return chunks.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(order))).where("_n = 1").drop("_n")


def graph_documents(nodes: DataFrame) -> DataFrame:
    """vid, text: what a lexical index of a graph holds: a symbol's display name, a file's or directory's name."""
    box = F.col("type").isin("file", "directory")
    return nodes.select("vid", F.when(box, F.col("name")).otherwise(F.coalesce("unified_name", "name")).alias("text"))


def grep(nodes: DataFrame, pattern: str, content: Column, *, use_regex: bool = True, case_sensitive: bool = False, where: Column | None = None, max_chars: int | None = None) -> DataFrame:
    """Rows whose text matches, or its first ``max_chars`` characters; pre-filters come first so they reach the scan."""
    rows = nodes if where is None else nodes.where(where)
    body = content if max_chars is None else F.substring(content, 1, max_chars)
    if use_regex:
        return rows.where(body.rlike(pattern if case_sensitive else f"(?i){pattern}"))
    return rows.where(body.contains(pattern) if case_sensitive else F.lower(body).contains(pattern.lower()))


def identifier_of(symbol: str) -> str:
    """The last name of a qualified symbol without call parentheses; "" if that is no identifier."""
    last = re.split(r"[.:#/]+", symbol.strip().removesuffix("()"))[-1]
    return last if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", last) else ""


def occurrences(chunks: DataFrame, identifier: str, content: Column, name: Column, order: Column, k: int = 20, context: list[str] | None = None) -> DataFrame:
    """Chunks that use an identifier as a whole word, the declaring one left out: by context terms, then calls, then order.

    A symbol that ends in no identifier has no occurrences.
    """
    identifier = identifier_of(identifier)
    if not identifier:
        return chunks.withColumn("calls", F.lit(0)).withColumn("context", F.lit(0)).limit(0)
    word = rf"(?<![A-Za-z0-9_]){identifier}(?![A-Za-z0-9_])"
    rows = chunks.where(content.rlike(word) & (text.bare_symbol(name) != identifier))
    calls = F.regexp_count(content, F.lit(rf"(?<![A-Za-z0-9_]){identifier}\s*\("))
    common = F.size(F.array_intersect(text.lexical_tokens(content), F.array(*[F.lit(c) for c in context]))) if context else F.lit(0)
    return rows.withColumn("calls", calls).withColumn("context", common).orderBy(F.col("context").desc(), F.col("calls").desc(), order).limit(k)


def grams(value: Column) -> Column:
    """Distinct lower-case trigrams, cut in one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(value), F.lit("(?s)(?=(.{3}))"), F.lit(1)))


def trigram_index(docs: DataFrame, id_col: str, content: Column) -> DataFrame:
    """gram, id: which documents hold a trigram.  Made once per corpus and stored; searches read the grams they need."""
    return docs.select(F.explode(grams(content)).alias("gram"), F.col(id_col).alias("id"))


def parsed_query(query: str) -> dict:
    """A search text: ``file:`` expressions, ``case:yes``, ``regex:`` atoms, and substrings, all of which must hold."""
    out: dict = {"files": [], "regex": [], "plain": [], "case": False}
    for atom in re.findall(r'(?:[a-z]+:)?"[^"]*"|\S+', query):
        kind, _, rest = atom.partition(":")
        value = rest.strip('"')
        if kind == "file" and value:
            out["files"].append(value)
        elif kind == "regex" and value:
            out["regex"].append(value)
        elif kind == "case":
            out["case"] = value == "yes"
        else:
            out["plain"].append(atom.strip('"'))
    return out


def _listed(batches: Iterator[pa.RecordBatch], most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) as (gram, ids), for stretches of texts of about ``most`` characters together."""
    for batch in batches:
        ids, texts = batch.columns
        held, size = [], 0
        for n, t in enumerate(texts.to_pylist()):
            if t is not None and len(t) > 2:
                held.append((n, np.frombuffer(t.encode("utf-32-le"), "<u4").astype(np.int64)))
                size += len(t)
            if held and (size >= most or n + 1 == len(texts)):
                key = np.concatenate([c[:-2] << 42 | c[1:-1] << 21 | c[2:] for _, c in held])
                row = np.repeat([n for n, _ in held], [len(c) - 2 for _, c in held])
                order = np.lexsort((row, key))
                key, row = key[order], row[order]
                new = np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])]
                key, row = key[new], row[new]
                starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                points = np.stack([key[starts] >> 42, key[starts] >> 21 & 0x1FFFFF, key[starts] & 0x1FFFFF], axis=1).astype("<u4")
                flat = points.tobytes().decode("utf-32-le")
                grams = pa.array([flat[i : i + 3] for i in range(0, len(flat), 3)], pa.string())
                ends = pa.array(np.r_[starts, len(key)].astype(np.int32))
                yield pa.RecordBatch.from_arrays([grams, pa.ListArray.from_arrays(ends, ids.take(pa.array(row)))], ["gram", "ids"])
                held, size = [], 0


def keep_trigrams(docs: DataFrame, id_col: str, content: Column, folder: str) -> DataFrame:
    """The trigram index written below a folder, ordered by gram in each file, so a search reads the row groups of its grams.

    Texts are cut once; what is shuffled and sorted is one row a gram and stretch of texts.
    """
    spark = docs.sparkSession
    attach(spark)
    index = trigram_index(docs, id_col, content).schema
    rows = docs.select(F.col(id_col).alias("id"), F.lower(content).alias("text"))
    lists = T.StructType([T.StructField("gram", T.StringType()), T.StructField("ids", T.ArrayType(index["id"].dataType))])
    held = rows.mapInArrow(_listed, lists).repartition("gram").sortWithinPartitions("gram")
    held.select("gram", F.explode("ids").alias("id")).write.mode("overwrite").parquet(folder)
    return spark.read.schema(index).parquet(folder)


def candidates(index: DataFrame, plans: list[trigrams.Plan]) -> DataFrame | None:
    """id of the documents whose trigrams meet all conditions; None if these say nothing.  An id's row holds asked grams only."""
    plan = trigrams.joined("and", plans)
    if plan is True:
        return None
    grams = sorted(trigrams.grams_of(plan))
    held = index.where(F.col("gram").isin(grams)).groupBy("id").agg(F.collect_set("gram").alias("held"))
    return held.where(trigrams.holds(plan, F.col("held"))).select("id")


def trigram_search(docs: DataFrame, query: str, id_col: str, content: Column, path: Column | None = None, index: DataFrame | None = None) -> DataFrame:
    """Documents in which every atom of the query holds.

    With an index, documents whose trigrams rule an atom out are never read; the atoms themselves decide.
    Without one the texts are scanned once.
    """
    q = parsed_query(query)
    fold = (lambda c: c) if q["case"] else F.lower
    out = docs
    for f in q["files"]:
        out = out.where(path.rlike(f)) if path is not None else out.limit(0)
    if index is not None:
        plain = [trigrams.of_texts(frozenset([t.lower()])) for t in q["plain"] if t.isascii()]
        found = candidates(index, [*plain, *map(trigrams.plan_of, q["regex"])])
        if found is not None:
            out = out.join(found.select(F.col("id").alias(id_col)), id_col, "left_semi")
    for t in q["plain"]:
        out = out.where(fold(content).contains(t if q["case"] else t.lower()))
    for p in q["regex"]:
        out = out.where(content.rlike(p if q["case"] else f"(?i){p}"))
    return out
