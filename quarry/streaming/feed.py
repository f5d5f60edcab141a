"""A change feed as a stream, kept in step with the table it describes.

The batch engine maintains views by deltas; this is the same maintenance under
Structured Streaming.  Each micro-batch is folded to one change per key and
written as a delta of its own, named by the batch number, so a repeated batch
writes the same delta again and the state is never rewritten; ``current`` overlays
the deltas and ``compacted`` merges old ones into one.  Windowed counts take a
watermark, which bounds how late a change may be and how much state they keep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.incremental import overlay


def read_feed(spark: SparkSession, path: str, schema: str, time: str = "ts", late: str | None = None) -> DataFrame:
    """A feed of Parquet files; ``late`` sets the watermark that windowed counts need."""
    rows = spark.readStream.schema(schema).parquet(path)
    return rows if late is None else rows.withWatermark(time, late)


def activity(feed: DataFrame, time: str, by: str, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Changes per window and kind."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return feed.groupBy(window.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def folded(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last change of each key; deletes stay as rows, so a late upsert does not revive a key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")


def maintain(feed: DataFrame, state: str, checkpoint: str, key: str, order: list[str]) -> StreamingQuery:
    """Write the feed's changes as deltas below ``state``, one a micro-batch."""

    def apply(batch: DataFrame, number: int) -> None:
        folded(batch, key, order).write.mode("overwrite").parquet(f"{state}/batch={number}")

    return feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deltas(spark: SparkSession, state: str, version: int | None = None) -> DataFrame:
    """All deltas up to a batch, the newest by default."""
    rows = spark.read.option("basePath", state).parquet(f"{state}/batch=*")
    return (rows if version is None else rows.where(F.col("batch") <= version)).drop("batch")


def current(spark: SparkSession, state: str, version: int | None, key: str, order: list[str], op: str) -> DataFrame:
    """The table after a batch: each key's last change, unless that deletes it."""
    return overlay(deltas(spark, state, version), key, F.struct(*order), op)


def compacted(spark: SparkSession, state: str, target: str, version: int, key: str, order: list[str]) -> None:
    """The deltas up to a batch as one, in a folder that can take the later ones."""
    folded(deltas(spark, state, version), key, order).write.mode("overwrite").parquet(f"{target}/batch={version}")
