"""Vectorised word kernels over UTF-8 buffers.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  Those bytes
never occur inside a multi-byte UTF-8 sequence, so a byte scan splits exactly
as the character pattern ``[^\\x20\\x09-\\x0D]+`` does.  All hashes are the
same in every process: they come from fixed integer mixing, not from Python's
``hash``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
STEP = U64(0xD1342543DE82EF95)
#: Whole documents are gathered into chunks of about this many bytes.
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (xor-shift and multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _byte_values(fold: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=U64) * BASE)
    if fold:
        values[0x41:0x5B] = values[0x61:0x7B]
    values[SPACE] = 0
    return values


_VALUES = {fold: _byte_values(fold) for fold in (False, True)}
_POWERS = np.multiply.accumulate(np.full(4096, BASE, dtype=U64))


def powers(n: int) -> np.ndarray:
    return _POWERS if n <= len(_POWERS) else np.multiply.accumulate(np.full(n, BASE, dtype=U64))


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of whole rows: (first row, end row, bytes, row offsets).

    Null counts as empty text.  A row longer than ``limit`` makes a run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        lo, hi = offsets[at], offsets[end]
        yield at, end, data[lo:hi], offsets[at : end + 1] - lo
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and each row's first word number (rows + 1 entries)."""
    inside = ~SPACE[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    starts[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(first, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes; ``fold`` first lower-cases A-Z."""
    out = np.empty(len(starts), dtype=U64)
    values = _VALUES[fold]
    at = 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK_BYTES, side="right")))
        base = starts[at]
        s = starts[at:end] - base
        piece = values[data[base : ends[end - 1]]]
        place = np.arange(len(piece)) - np.repeat(s, np.diff(np.append(s, len(piece))))
        longest = int((ends[at:end] - starts[at:end]).max())
        table = powers(longest)
        piece *= table[np.minimum(place, len(table) - 1)]
        lengths = (ends[at:end] - starts[at:end]).astype(U64)
        out[at:end] = mix(np.add.reduceat(piece, s) + lengths * STEP)
        at = end
    return out


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive entries, by doubling; len(words) - width + 1 results."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    total, done, factor = None, 0, U64(1)
    block, size, step = words, 1, STEP  # block[i]: hash of words[i : i + size]; step: STEP ** size
    rest = width
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                part = block[done : done + n] * factor
                total = part if total is None else total + part
                done, factor = done + size, factor * step
            rest >>= 1
            if rest:
                block = block[: len(block) - size] + block[size:] * step
                size, step = 2 * size, step * step
    return mix(total)


def row_hashes(words: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's word sequence, from its word hashes and first word numbers."""
    n = len(rows) - 1
    sizes = np.diff(rows)
    out = mix(sizes.astype(U64) + U64(0x51ED27))
    full = np.flatnonzero(sizes)
    if len(full):
        starts = rows[:-1][full]
        longest = int(sizes.max())
        place = np.arange(len(words)) - np.repeat(starts, sizes[full])
        out[full] ^= np.add.reduceat(mix(words + STEP) * powers(longest)[place], starts)
    return mix(out) if n else out
