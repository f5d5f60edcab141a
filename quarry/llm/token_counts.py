"""Token counts by scanning flat token files for end-of-document ids.

A token file is a run of fixed-width little-endian ids without index; documents
end with a separator id.  Files of any size are read by byte ranges (``read_files``):
small ones whole, others block by block, each block a row of its own wherever
it lies, so no task holds a file.  A block's scan is one vectorised comparison: it yields the
block's length, its first and last separator and the lengths between
separators.  A document may begin many blocks before it ends, so per file a
prefix scan over the blocks, running length and running last separator, gives
every block the start of the document it begins in.  The scan has two levels,
runs of ``RUN`` blocks and blocks within a run, over numbers alone; the lengths
between separators stay with their block.

``write_files`` makes such files from documents in a shared folder, a few MB to
a file, with the documents' ids beside them.

Defined cases: an empty file has no documents; ids after the last separator
form a last document that has no end; two separators in a row enclose a
document of 0 tokens; an incomplete id at a file's end is left out; null and
empty texts have 0 tokens; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared, words

BLOCK_BYTES = 1 << 20
#: Files made by ``write_files`` hold about so much; files up to ``WHOLE_BYTES`` are read as one row.
FILE_BYTES = 16 << 20
WHOLE_BYTES = 64 << 20
#: Blocks of one run of the prefix scan.
RUN = 1024
BLOCKS = "file string, block bigint, payload binary, names array<string>"
SCANNED = "file string, block bigint, n bigint, first bigint, last bigint, inner array<bigint>, names array<string>"

#: The splitting pattern that belongs to the public byte-level BPE ranks (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_READY: dict[int, object] = {}


def _encoding(ranks: bytes):
    import tiktoken

    key = hash(ranks)
    if key not in _READY:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _READY[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _READY[key]


def _block(file: str, number: int, payload: bytes, names: list) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.binary(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((file, number, payload, names), kinds)], ["file", "block", "payload", "names"])


def _flat(batches: Iterator[pa.RecordBatch], ranks, eod: int, dtype: str, block_bytes: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """A task's documents as one flat file, in blocks; names: the documents that end in a block.  ``whole`` cuts after documents only."""
    encoding, file = _encoding(ranks.value), f"part-{TaskContext.get().partitionId():05d}"
    end = np.array([eod], dtype=dtype).tobytes()
    held, names, number = bytearray(), [], 0
    ends: list[int] = []
    for batch in batches:
        texts = batch.column(1).fill_null("")
        for lo, hi, _, _ in words.text_chunks(texts):
            ids = batch.column(0)[lo:hi].to_pylist()
            for name, text in zip(ids, texts[lo:hi].to_pylist()):
                held += np.array(encoding.encode_ordinary(text), dtype=dtype).tobytes() + end
                names.append(name)
                ends.append(len(held))
            while len(held) >= block_bytes:
                done = len(ends) if whole else int(np.searchsorted(ends, block_bytes, side="right"))
                cut = len(held) if whole else block_bytes
                yield _block(file, number, bytes(held[:cut]), names[:done])
                del held[:cut], names[:done], ends[:done]
                ends = [e - cut for e in ends]
                number += 1
    if held:
        yield _block(file, number, bytes(held), names)


def flat_blocks(docs: DataFrame, ranks_path: str, eod: int = 50256, dtype: str = "<u2", id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, whole: bool = False) -> DataFrame:
    """Documents as flat token files, one per partition, in blocks of ``block_bytes``."""
    spark = docs.sparkSession
    shared.attach(spark)
    with open(ranks_path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())  # the vocabulary: of a fixed size
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(partial(_flat, ranks=ranks, eod=eod, dtype=dtype, block_bytes=block_bytes, whole=whole), BLOCKS)


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks that end with a document as the rows of two kinds of files: ids, and the names of the documents they are of."""
    for batch in batches:
        for file, number, payload, names in zip(*[batch.column(c).to_pylist() for c in range(4)]):
            rows = [("tokens", payload), ("names", json.dumps(names).encode())]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([f"{file}-{number}"] * 2), pa.array([v for _, v in rows], pa.binary())], ["kind", "file", "value"])


def write_files(docs: DataFrame, ranks_path: str, folder: str, eod: int = 50256, dtype: str = "<u2", id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """(path of the token files, file and names of each): the documents as flat token files below ``folder``.

    One job writes the ids and, in files of their own, the documents' names, so both always agree.  Spark's text writer
    writes a file's bytes as they are and ends them with one byte, an incomplete id.
    """
    spark = docs.sparkSession
    made = flat_blocks(docs, ranks_path, eod, dtype, id_col, text_col, FILE_BYTES, whole=True).mapInArrow(_filed, "kind string, file string, value binary")
    path = f"{folder}/flat"
    made.select("kind", "file", F.col("value").cast("string").alias("value")).write.mode("overwrite").partitionBy("kind", "file").text(path)
    # A table without rows writes no folder of names.
    found = spark.read.schema("value string, kind string, file string").text(path, wholetext=True).where("kind = 'names'")
    return f"{path}/kind=tokens", found.select("file", F.from_json("value", "array<string>").alias("names"))


def _cut(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = memoryview(content.as_buffer())
            for at in range(0, len(data), block_bytes):
                yield _block(path, at // block_bytes, bytes(data[at : at + block_bytes]), [])


def _ranged(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows (path, block) with the bytes of the block; the last one of a file is shorter."""
    from pyarrow import fs

    for batch in batches:
        for path, number in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            store, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
            with store.open_input_file(name) as f:
                yield _block(path, number, f.read_at(block_bytes, number * block_bytes), [])


def read_files(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES, width: int = 2, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """Token files below a path, of any size and number, as blocks numbered from each file's beginning.

    Files beyond ``whole_bytes`` are opened by their path in the tasks, so they must lie where pyarrow reads (local and
    shared folders, object stores, HDFS); smaller ones are read by Spark itself.
    """
    shared.attach(spark)
    block_bytes = max(width, block_bytes - block_bytes % width)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(path)
    small = rows.where(F.col("length") <= whole_bytes).select("path", "content").mapInArrow(partial(_cut, block_bytes=block_bytes), BLOCKS)
    numbers = F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("length") - 1, F.lit(block_bytes).cast("long")))
    ranges = rows.where(F.col("length") > whole_bytes).select("path", F.explode(numbers).alias("block"))
    return small.unionByName(ranges.repartition("path", "block").mapInArrow(partial(_ranged, block_bytes=block_bytes), BLOCKS))


def _scanned(batches: Iterator[pa.RecordBatch], eod: int, dtype: str) -> Iterator[pa.RecordBatch]:
    width = np.dtype(dtype).itemsize
    for batch in batches:
        n, first, last, inner = [], [], [], []
        for payload in batch.column(2):
            raw = payload.as_buffer()
            ids = np.frombuffer(raw, dtype=dtype, count=raw.size // width)
            at = np.flatnonzero(ids == eod)
            n.append(len(ids))
            first.append(int(at[0]) if len(at) else None)
            last.append(int(at[-1]) if len(at) else None)
            inner.append(np.diff(at) - 1)
        made = [pa.array(x, pa.int64()) for x in (n, first, last)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made, pa.array(inner, pa.list_(pa.int64())), batch.column(3)], ["file", "block", "n", "first", "last", "inner", "names"])


def count(blocks: DataFrame, eod: int = 50256, dtype: str = "<u2", folder: str | None = None) -> DataFrame:
    """file, doc_no, name, n_tokens: one row per document; name is null where the blocks hold no names."""
    spark = blocks.sparkSession
    shared.attach(spark)
    rows = shared.stored(blocks.mapInArrow(partial(_scanned, eod=eod, dtype=dtype), SCANNED), folder or shared.shared_folder(spark), "scanned")
    rows = rows.withColumn("run", F.floor(F.col("block") / RUN))
    n_docs = F.size("inner") + F.when(F.col("first").isNotNull(), 1).otherwise(0)
    # Blocks within their run.
    run = W.partitionBy("file", "run").orderBy("block")
    before = run.rowsBetween(W.unboundedPreceding, -1)
    small = rows.select("file", "run", "block", "n", "last", n_docs.alias("held"))
    small = small.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)))
    small = small.withColumn("ended", F.max(F.col("at") + F.col("last")).over(before)).withColumn("docs", F.coalesce(F.sum("held").over(before), F.lit(0)))
    # Runs within their file.
    runs = small.groupBy("file", "run").agg(F.sum("n").alias("n"), F.max(F.col("at") + F.col("last")).alias("last"), F.sum("held").alias("held"), F.max("block").alias("end"))
    file = W.partitionBy("file")
    earlier = file.orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("run_at", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    runs = runs.withColumn("run_ended", F.max(F.col("run_at") + F.col("last")).over(earlier)).withColumn("run_docs", F.coalesce(F.sum("held").over(earlier), F.lit(0)))
    runs = runs.withColumn("end", F.max("end").over(file)).select("file", "run", "run_at", "run_ended", "run_docs", "end")
    place = small.select("file", "run", "block", "at", "ended", "docs").join(runs, ["file", "run"])
    ended = F.coalesce(F.greatest(F.col("run_at") + F.col("ended"), F.col("run_ended")), F.lit(-1))
    place = place.select("file", "block", (F.col("run_at") + F.col("at")).alias("at"), ended.alias("ended"), (F.col("run_docs") + F.col("docs")).alias("docs"), (F.col("block") == F.col("end")).alias("final"))
    rows = rows.drop("run").join(place, ["file", "block"])
    begun = F.array(F.col("at") + F.col("first") - F.col("ended") - 1)
    whole = F.when(F.col("first").isNotNull(), F.concat(begun, "inner")).otherwise(F.array().cast("array<bigint>"))
    rest = F.col("at") + F.col("n") - 1 - F.greatest("ended", F.coalesce(F.col("at") + F.col("last"), F.lit(-1)))
    whole = F.when(F.col("final") & (rest > 0), F.concat(whole, F.array(rest))).otherwise(whole)
    out = rows.select("file", "docs", "names", F.posexplode(whole).alias("k", "n_tokens"))
    return out.select("file", (F.col("docs") + F.col("k")).alias("doc_no"), F.get("names", F.col("k")).alias("name"), "n_tokens")


def document_counts(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", eod: int = 50256, dtype: str = "<u2") -> DataFrame:
    """doc_id, n_tokens: documents written as token files, and those scanned; ids come back in the type they had."""
    spark = docs.sparkSession
    folder = shared.shared_folder(spark)
    kind = docs.schema[id_col].dataType
    path, names = write_files(docs, ranks_path, folder, eod, dtype, id_col, text_col)
    if not shared.exists(spark, path):  # no documents, no files
        return docs.limit(0).select(F.col(f"`{id_col}`").alias("doc_id"), F.lit(0).cast("bigint").alias("n_tokens"))
    found = count(read_files(spark, path, width=np.dtype(dtype).itemsize), eod, dtype, folder)
    own = found.select(F.regexp_extract("file", "file=([^/]+)/", 1).alias("file"), F.col("doc_no").cast("int").alias("doc_no"), "n_tokens")
    each = names.select("file", F.posexplode("names").alias("doc_no", "doc_id"))
    return each.join(own, ["file", "doc_no"]).select(F.col("doc_id").cast(kind).alias("doc_id"), "n_tokens")
