"""Fill-in-middle transformation by bit-parallel arithmetic on big integers.

A text is one bit per code point in a Python integer, lowest bit first:
``bytes.translate`` maps code points to their class, one shift and a few boolean
operations mark where tokens start, ``bit_count`` gives their number, and the
n-th start is found by halving the integer and counting the lower half.  Every
step is linear in the text's bits; no token list is made.

A token is ``[A-Za-z]+`` or any other single code point.

Defined cases: a null text counts as empty (plain, nothing to move); a null id
is hashed as an empty string; repeated rows of one id get equal results; very
long texts are transformed whole; an empty table gives an empty table; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared, words

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: Of a hundred: texts that are transformed, and of these the ones with the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
SEED = 1
_LETTERS = bytes(0x31 if chr(b).isascii() and chr(b).isalpha() else 0x30 for b in range(256))


def starts_of(text: str) -> int:
    """Bit i is set where a token starts at code point i."""
    if not text:
        return 0
    classes = text.encode("latin-1", "replace").translate(_LETTERS)  # one byte a code point; others than Latin-1 become "?"
    letters = int(classes[::-1], 2)
    inner = letters & (letters << 1)
    return ((1 << len(classes)) - 1) ^ inner


def select(bits: int, rank: int, width: int) -> int:
    """Place of the set bit with ``rank`` set bits below it, by recursive halving; ``bits`` has more than ``rank``."""
    at = 0
    while width > 1:
        half = width // 2
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            bits, width = low, half
        else:
            bits, width, rank, at = bits >> half, width - half, rank - below, at + half
    return at


def drawn(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four 32-bit numbers of a document."""
    name = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(name[k : k + 8], 16) for k in range(0, 32, 8)]


def cut(text: str, doc_id: int | None, seed: int = SEED) -> tuple[int, str, int | None, int | None]:
    """Number of tokens, form, and the code points at which prefix and middle end (None if plain)."""
    starts = starts_of(text)
    n = starts.bit_count()
    h1, h2, h3, h4 = drawn(doc_id, seed)
    if not text or any(m in text for m in MARKS) or h3 % 100 >= TRANSFORMED:
        return n, "plain", None, None
    ends = [len(text) if k == n else select(starts, k, len(text)) for k in sorted((h1 % (n + 1), h2 % (n + 1)))]
    return n, "spm" if h4 % 100 < SUFFIX_FIRST else "psm", ends[0], ends[1]


def arranged(text: str, form: str, first: int | None, second: int | None) -> str:
    if form == "plain":
        return text
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if form == "psm":
        return "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    return "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))


def restored(output: str, form: str) -> str:
    """The text that an output of this form was made from; it holds each mark once, as the text held none."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE, 1)
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, two = head[len(first) :].split(second, 1)
    return one + middle + two if form == "psm" else two + middle + one


_FIELDS = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output_sha256", T.StringType()), ("restored_sha256", T.StringType())]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _transformed(batches: Iterator[pa.RecordBatch], seed: int, texts: bool) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.large_string()]
    names = [*[f for f, _ in _FIELDS], "output"][: 6 + texts]
    for batch in batches:
        column = batch.column(batch.num_columns - 1).fill_null("")
        ids = batch.column(0)
        for lo, hi, _, _ in words.text_chunks(column):
            rows = []
            for doc_id, text in zip(ids[lo:hi].to_pylist(), column[lo:hi].to_pylist()):
                n, form, first, second = cut(text, doc_id, seed)
                output = arranged(text, form, first, second)
                lengths = (None, None) if form == "plain" else (first, second - first)
                rows.append((n, form, *lengths, _sha(output), _sha(restored(output, form)), output))
            made = [pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))]
            rest = [batch.column(i)[lo:hi] for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*rest, *made], [*[batch.schema.field(i).name for i in range(batch.num_columns - 1)], *names])


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None, texts: bool = False, seed: int = SEED) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and digests of output and restored text; ``texts`` adds the output itself, ``carry`` all columns in a struct."""
    shared.attach(docs.sparkSession)
    kept = [F.col(f"`{id_col}`").alias("doc_id")] + ([F.struct("*").alias(carry)] if carry else [])
    rows = docs.select(*kept, F.col(f"`{text_col}`").alias("text"))
    fields = [T.StructField(f, kind) for f, kind in _FIELDS] + ([T.StructField("output", T.StringType())] if texts else [])
    schema = T.StructType([*rows.schema.fields[:-1], *fields])
    return rows.mapInArrow(partial(_transformed, seed=seed, texts=texts), schema)
