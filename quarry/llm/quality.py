"""Quality rules as a bitmask ledger.

``ledger`` reads every text once and stores, per document, the measurements
and one failure bit per rule.  Policies are versioned bit masks: applying one,
comparing several, or asking what a rule costs (``ablations``) is bitwise
arithmetic over the ledger and never reads a text again.

Defined cases: null and empty texts have no words and fail ``too_few_words``;
rows are independent, so repeated rows get equal results, null ids stay null,
and an empty table gives an empty ledger.  Only the named id and text columns
are read; other columns, whatever their names, travel in one struct (``carry``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared, words

WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")

#: Bit number and failing condition of each rule, over the measurements.
RULES: dict[str, tuple[int, str]] = {
    "too_few_words": (0, "n_words < 10"),
    "repeated_windows": (1, "100 * n_repeat_words > 20 * n_words"),
    "symbol_ratio": (2, "100 * n_symbols > 25 * n_words"),
    "shouting": (3, "100 * n_upper > 50 * word_chars"),
    "duplicate_lines": (4, "n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines"),
    "long_words": (5, "word_chars > 40 * n_words"),
}


def mask_of(*rules: str) -> int:
    return sum(1 << RULES[r][0] for r in rules)


#: Versioned policies: a document is kept if it fails none of the policy's rules.
POLICIES: dict[str, int] = {
    "base": mask_of("too_few_words", "repeated_windows"),
    "v1": mask_of("too_few_words", "repeated_windows", "symbol_ratio", "shouting"),
    "strict": mask_of(*RULES),
}

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(windows: np.ndarray) -> int:
    """Words covered by a window that occurs at least twice in the row."""
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    if len(counts) == len(windows):
        return 0
    at = np.flatnonzero(counts[inverse] > 1)
    return int(WINDOW + np.minimum(np.diff(at), WINDOW).sum())


def _lines(text: str) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier line."""
    seen: set[str] = set()
    n = again = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            n += 1
            again += line in seen
            seen.add(line)
    return n, again


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """All measurements of every row of a text column."""
    out = {m: np.zeros(len(column), dtype=np.int64) for m in MEASURES}
    texts = column.fill_null("")
    for lo, hi, data, offsets in words.text_chunks(column):
        starts, ends, rows = words.word_spans(data, offsets)
        out["n_words"][lo:hi] = np.diff(rows)
        out["word_chars"][lo:hi] = _per_row(~words.SPACE[data] & ((data & 0xC0) != 0x80), offsets)
        out["n_symbols"][lo:hi] = _per_row(_SYMBOL[data], offsets)
        upper = (data >= 0x41) & (data <= 0x5A)
        upper[1:] |= (data[:-1] == 0xC3) & (data[1:] <= 0x9E) & (data[1:] >= 0x80) & (data[1:] != 0x97)
        out["n_upper"][lo:hi] = _per_row(upper, offsets)
        hashes = words.word_hashes(data, starts, ends)
        windows = words.window_hashes(hashes, WINDOW)
        for i in range(hi - lo):
            if rows[i + 1] - rows[i] > WINDOW:
                out["n_repeat_words"][lo + i] = _repeated(windows[rows[i] : rows[i + 1] - WINDOW + 1])
    for i in range(len(column)):
        out["n_lines"][i], out["n_dup_lines"][i] = _lines(texts[i].as_py())
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        m = measure(batch.column(batch.num_columns - 1))
        rest = [batch.column(i) for i in range(batch.num_columns - 1)]
        names = [batch.schema.field(i).name for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*rest, *[pa.array(m[k]) for k in MEASURES]], [*names, *MEASURES])


def failures() -> Column:
    """The failure bits, from the measurement columns."""
    bits = [F.when(F.expr(rule), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, rule in RULES.values()]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return total.cast("int").alias("failures")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
    """id, measurements and failure bits per row; ``carry`` names a struct with all input columns to keep."""
    shared.attach(docs.sparkSession)
    kept = [F.col(f"`{id_col}`").alias("doc_id")] + ([F.struct("*").alias(carry)] if carry else [])
    rows = docs.select(*kept, F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([*rows.schema.fields[:-1], *[T.StructField(m, T.LongType()) for m in MEASURES]])
    measured = rows.mapInArrow(_measured, schema)
    return measured.select("*", failures())


def store(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger written to a folder and read again: policies and ablations then read numbers, never texts."""
    return shared.stored(ledger(docs, id_col, text_col), folder, "ledger")


def passes(policy: str | int) -> Column:
    """True where a ledger row fails none of a policy's rules."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    return F.col("failures").bitwiseAND(F.lit(mask)) == 0


def ablations(table: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of a policy: rows failing it, rows failing nothing else, and rows kept without the rule; from a ledger, best a stored one.

    One pass counts each distinct bit pattern (at most 2 ** rules of them); the rest is arithmetic on those.
    """
    mask = POLICIES[policy]
    patterns = table.groupBy("failures").agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << b).alias("bit")) for r, (b, _) in RULES.items() if mask & (1 << b)])
    each = patterns.select("failures", "n", F.explode(rules).alias("r")).select("failures", "n", "r.*")
    held = F.col("failures").bitwiseAND(F.lit(mask))
    without = F.col("failures").bitwiseAND(F.lit(mask).bitwiseXOR(F.col("bit")))
    return each.groupBy("rule").agg(
        F.sum(F.when(held.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(held == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_only"),
        F.sum(F.when(without == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def keep_good(docs: DataFrame, policy: str = "v1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with their own columns."""
    return ledger(docs, id_col, text_col, carry="_row").where(passes(policy)).select("_row.*")
