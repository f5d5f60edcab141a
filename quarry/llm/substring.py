"""Substring deduplication by difference-cover anchors.

A window of ``width`` words is removed where its word sequence starts anywhere
else too.  Hashing every window would send one record per word.  Instead only
anchors are sent: shorter windows that start at the positions of a difference
cover modulo a period.  For any two starts of an equal window, some offset
below the period takes both to cover positions, and an anchor of width -
period + 1 words fits there, so equal windows always share an anchor.  Anchors
that occur once are dropped; around the others the match is extended: only
windows that hold a repeated anchor are hashed in full (96 bits) and compared.

Defined cases: null and empty texts have no words; a table's repeated rows are
other places of the same windows, so both lose them; texts of fewer words than
``width`` lose nothing; empty tables give empty results.  Kept words are joined
by one space.  Only the id and text columns are used; others are carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import packets, shared, words

#: Perfect difference sets: every residue modulo the period is a difference of two members.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 57: (0, 1, 3, 13, 32, 36, 43, 52)}


def cover_for(width: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of at least a third of the window."""
    fits = [p for p in COVERS if 3 * (width - p + 1) >= width]
    return (max(fits), COVERS[max(fits)]) if fits else (1, (0,))


def _parsed(block: bytes) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A packet's table, its word hashes, and each row's first word number."""
    table = packets.opened(block)
    hashes, sizes = [], []
    for _, _, data, offsets in words.text_chunks(table.column(table.num_columns - 1)):
        starts, ends, rows = words.word_spans(data, offsets)
        hashes.append(words.word_hashes(data, starts, ends))
        sizes.append(np.diff(rows))
    joined = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    rows = np.concatenate(([0], np.cumsum(np.concatenate(sizes) if sizes else []))).astype(np.int64)
    return table, joined, rows


def _place_in_row(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word: its place in its row, and the words from it to the row's end."""
    sizes = np.diff(rows)
    at = np.arange(rows[-1]) - np.repeat(rows[:-1], sizes)
    return at, np.repeat(sizes, sizes) - at


def _anchors(batches: Iterator[pa.RecordBatch], width: int, n_buckets: int) -> Iterator[pa.RecordBatch]:
    period, cover = cover_for(width)
    length = width - period + 1
    chosen = np.zeros(period, dtype=bool)
    chosen[list(cover)] = True
    for batch in batches:
        for packet, block in zip(batch.column(0).to_pylist(), batch.column(1)):
            _, hashes, rows = _parsed(block.as_py())
            at, left = _place_in_row(rows)
            pick = np.flatnonzero(chosen[at % period] & (left >= length) & (at + left >= width))
            key = words.window_hashes(hashes, length)[pick] if len(pick) else np.zeros(0, np.uint64)
            yield from packets.records(packets.sent(packet, key, np.zeros(len(key), np.uint32), pick, n_buckets)).to_batches()


def _extended(packed: pa.Table, answers: pa.Table, width: int, n_buckets: int) -> pa.Table:
    """Full windows around the repeated anchors of one packet."""
    period, _ = cover_for(width)
    found = packets.places(answers).astype(np.int64)
    if not len(found) or not packed.num_rows:
        return packets.records([])
    _, hashes, rows = _parsed(packed.column("block")[0].as_py())
    at, left = _place_in_row(rows)
    marks = np.zeros(len(hashes) + 1, dtype=np.int32)
    np.add.at(marks, found - np.minimum(at[found], period - 1), 1)
    np.add.at(marks, found + 1, -1)
    pick = np.flatnonzero((np.cumsum(marks[:-1]) > 0) & (left >= width))
    if not len(pick):
        return packets.records([])
    key = words.window_hashes(hashes, width)[pick]
    check = (words.window_hashes(words.mix(hashes + words.BASE), width)[pick] >> np.uint64(32)).astype(np.uint32)
    return packets.records(packets.sent(packed.column("packet")[0].as_py(), key, check, pick, n_buckets))


def _removed(packed: pa.Table, answers: pa.Table, width: int, texts: bool) -> pa.Table:
    """Take the repeated windows of one packet out of its rows."""
    table, hashes, rows = _parsed(packed.column("block")[0].as_py())
    found = packets.places(answers).astype(np.int64)
    marks = np.zeros(len(hashes) + width + 1, dtype=np.int32)
    np.add.at(marks, found, 1)
    np.add.at(marks, found + width, -1)
    keep = np.cumsum(marks)[: len(hashes)] == 0
    lost = np.concatenate(([0], np.cumsum(~keep)))
    n_removed = lost[rows[1:]] - lost[rows[:-1]]
    kept, digest = [], []
    for i, text in enumerate(table.column(table.num_columns - 1)):
        parts = (text.as_py() or "").encode().split()
        if n_removed[i]:
            parts = compress(parts, keep[rows[i] : rows[i + 1]].tolist())
        joined = b" ".join(parts)
        digest.append(hashlib.sha256(joined).hexdigest())
        if texts:
            kept.append(joined.decode() if n_removed[i] else text.as_py())
    out = {table.column_names[i]: table.column(i) for i in range(table.num_columns - 1)}
    out |= {"n_words": pa.array(np.diff(rows)), "n_removed": pa.array(n_removed), "kept_sha256": pa.array(digest, pa.string())}
    if texts:
        out["kept_text"] = pa.array(kept, pa.string())
    return pa.table(out)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35, carry: str | None = None, texts: bool = False, folder: str | None = None) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 per row; ``texts`` adds kept_text (the text itself where n_removed is 0), ``carry`` a struct of all input columns but the text."""
    spark = docs.sparkSession
    shared.attach(spark)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    kept = [F.col(f"`{id_col}`").alias("doc_id")] + ([F.struct(*rest).alias(carry)] if carry else [])
    rows = docs.select(*kept, F.col(f"`{text_col}`").alias("text"))
    n_buckets, _ = shared.buckets_for(rows, "text")
    packed = packets.packets(rows, folder or shared.shared_folder(spark))
    anchors = packed.mapInArrow(partial(_anchors, width=width, n_buckets=n_buckets), packets.RECORDS)
    windows = packets.with_answers(packed, packets.repeated(anchors), partial(_extended, width=width, n_buckets=n_buckets), packets.RECORDS)
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    fields += [T.StructField("kept_text", T.StringType())] if texts else []
    schema = T.StructType([*rows.schema.fields[:-1], *fields])
    return packets.with_answers(packed, packets.repeated(windows), partial(_removed, width=width, texts=texts), schema)
