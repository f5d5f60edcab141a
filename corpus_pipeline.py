"""A corpus pipeline over ``documents``: quality, near copies, repeated passages, mixture, tokens.

Each stage takes the table its predecessor wrote and returns the next one; all
but the last return the columns of ``documents``.  A stage's result must be
written before the next stage is called: that one deletes its tables.  A stage works on every row
it gets.  Null texts and empty tables pass through each stage as its operator
says; extra columns are kept until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, mixing, ngram_join, quality, shared, substring
from quarry.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str, folder: str | None = None) -> DataFrame:
    """Documents that fail the policy go."""
    return quality.keep_good(docs, "v1")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, folder: str | None = None) -> DataFrame:
    """Of each group of documents linked by similarity one stays, that of the smallest id (null last); equal rows of one id and text stay once.

    Rows are known by id and text, so another text of a repeated id is a document of its own.
    """
    key = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"), 1)
    folder = folder or shared.shared_folder(spark)
    linked = ngram_join.join(docs.select(key.alias("_key"), "text"), "_key", folder=folder).select(F.col("doc_id").alias("_key"), "n_shingles", "component_id")
    linked = shared.stored(linked, folder, "groups")
    ids = docs.select(key.alias("_key"), "doc_id").distinct()
    groups = shared.stored(linked.distinct().join(ids, "_key"), folder, "ids-of-groups")
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key"))["_key"].alias("first"))
    gone = groups.join(first, "component_id").where("_key <> first").select("_key").distinct()
    rows = docs.withColumn("_key", key)
    kept = rows.join(gone, "_key", "left_anti")
    # Rows without id and without shingles are not linked to anything, equal or not.
    again = linked.groupBy("_key").agg(F.count("*").alias("n"), F.max("n_shingles").alias("m")).where("n > 1")
    again = again.join(ids, "_key").where("doc_id is not null or m > 0").select("_key").distinct()
    if not again.isEmpty():
        once = kept.join(again, "_key", "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(again, "_key", "left_anti").unionByName(once)
    return kept.select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str, folder: str | None = None) -> DataFrame:
    """Words in windows of 35 that start elsewhere too go; the rest of such a text is joined by single spaces, other texts stay as they are."""
    out = substring.dedup(docs, carry="_row", texts=True, folder=folder)
    lost = F.col("n_removed") > 0
    made = {"text": F.col("kept_text"), "n_chars": F.when(lost, F.char_length("kept_text").cast("long")).otherwise(F.col("_row.n_chars"))}
    return out.select(*[(made[c] if c in made else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str, folder: str | None = None) -> DataFrame:
    """Documents in the order of the mix, as often as it takes them."""
    return mixing.mix(docs, folder=folder)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str, folder: str | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text of every document of the mix."""
    return bpe.encode(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: SQL can express neither the merges of BPE nor the components of links.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared.shared_folder(spark)
    for k, (name, stage) in enumerate(STAGES):
        own = f"{folder}/{k}-{name}-tables"
        docs = stage(spark, docs, sf_dir, folder=own)
        if k < len(STAGES) - 1:
            docs = shared.stored(docs, folder, f"{k}-{name}")
            shared.dropped(spark, own)
            if k:
                shared.dropped(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
