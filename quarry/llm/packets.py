"""Documents in packets, and a shuffle of packed hashes between packets.

A packet is a run of rows of about ``PACKET_BYTES`` of text, kept as one
compressed Arrow block in the shared folder.  Operators that must know which
hashes occur elsewhere send, per packet and hash range, one packed block of
(hash, place) records; a range's task answers each packet with the places whose
hash it has seen more than once.  A hash that a packet holds several times is
sent once, marked, so a passage found in a third of all rows costs each range
at most one record per packet.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import shared

PACKET_BYTES = 6 << 20
RECORDS = "bucket int, packet bigint, answer boolean, block binary"
ANSWERS = "packet bigint, block binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0

    def packed() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        name = int.from_bytes(os.urandom(8), "little") >> 1
        return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["packet", "block"])

    for batch in batches:
        text = batch.column(batch.num_columns - 1)
        lengths = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths) + size
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(ends, PACKET_BYTES)) + 1
            end = min(max(end, at + 1), batch.num_rows)
            held.append(batch.slice(at, end - at))
            size = int(ends[end - 1])
            if size >= PACKET_BYTES:
                yield packed()
                held.clear()
                ends -= size
                size = 0
            at = end
    if held:
        yield packed()


def packets(rows: DataFrame, folder: str, name: str = "packets") -> DataFrame:
    """Write rows, whose last column is their text, as packets; read back as (packet, block)."""
    return shared.stored(rows.mapInArrow(_cut, "packet bigint, block binary"), folder, name)


def opened(block: bytes) -> pa.Table:
    with pa.ipc.open_stream(block) as source:
        return source.read_all().combine_chunks()


def sent(packet: int, key: np.ndarray, check: np.ndarray, place: np.ndarray, n_buckets: int) -> list[tuple]:
    """Records of one packet: its hashes by range, and, as an answer, the places of hashes it holds several times itself."""
    out: list[tuple] = []
    if not len(key):
        return out
    order = np.lexsort((check, key)) if check.any() else np.argsort(key, kind="stable")
    key, check, place = key[order], check[order], place[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(key)))
    several = np.repeat(count > 1, count)
    if several.any():
        out.append((packet % n_buckets, packet, True, shared.pack(shared.ordered(np.sort(place[several]).astype(np.uint32)))))
    key, check, place, many = key[first], check[first], place[first].astype(np.uint32), (count > 1).astype(np.uint8)
    place[many == 1] = 0
    bucket = ((key >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
    cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=np.uint64(1 << 40))), len(key))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        block = shared.pack(shared.ordered(key[lo:hi]), check[lo:hi], place[lo:hi], many[lo:hi])
        out.append((int(bucket[lo]), packet, False, block))
    return out


def records(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
    return pa.table([pa.array([r[k] for r in rows], kinds[k]) for k in range(4)], ["bucket", "packet", "answer", "block"])


def _answered(table: pa.Table) -> pa.Table:
    """One hash range: tell each packet which of its records are not alone."""
    out_packet, out_block = [], []
    keys, checks, places, manys, owners, names = [], [], [], [], [], []
    for packet, answer, block in zip(*[table.column(c).to_pylist() for c in ("packet", "answer", "block")]):
        if answer:
            out_packet.append(packet)
            out_block.append(block)
            continue
        key, check, place, many = shared.unpack(block, np.uint64, np.uint32, np.uint32, np.uint8)
        keys.append(np.cumsum(key, dtype=np.uint64))
        checks.append(check)
        places.append(place)
        manys.append(many)
        owners.append(np.full(len(key), len(names), dtype=np.int32))
        names.append(packet)
    if keys:
        key, check, place, many, owner = map(np.concatenate, (keys, checks, places, manys, owners))
        order = np.lexsort((check, key)) if check.any() else np.argsort(key, kind="stable")
        key, check = key[order], check[order]
        same = (key[1:] == key[:-1]) & (check[1:] == check[:-1])
        hit = np.zeros(len(key), dtype=bool)
        hit[1:] |= same
        hit[:-1] |= same
        picked = order[hit]
        picked = picked[many[picked] == 0]
        picked = picked[np.lexsort((place[picked], owner[picked]))]
        cuts = np.searchsorted(owner[picked], np.arange(len(names) + 1))
        for i, name in enumerate(names):
            if cuts[i] < cuts[i + 1]:
                out_packet.append(name)
                out_block.append(shared.pack(shared.ordered(place[picked[cuts[i] : cuts[i + 1]]])))
    return pa.table([pa.array(out_packet, pa.int64()), pa.array(out_block, pa.binary())], ["packet", "block"])


def repeated(sent_records: DataFrame) -> DataFrame:
    """(packet, block of places) for every record whose hash occurs more than once over all packets."""
    return sent_records.groupBy("bucket").applyInArrow(_answered, ANSWERS)


def places(answers: pa.Table) -> np.ndarray:
    """All places answered to one packet, sorted."""
    parts = [np.cumsum(shared.unpack(b, np.uint32)[0], dtype=np.uint32) for b in answers.column("block").to_pylist()]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint32)


def with_answers(packed: DataFrame, answers: DataFrame, step: Callable[[pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
    """Run ``step`` on each packet together with its answers."""
    return packed.groupBy("packet").cogroup(answers.groupBy("packet")).applyInArrow(step, schema)
