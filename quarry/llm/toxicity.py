"""Toxicity by multiple-instance learning.

Only documents are labelled; sentences are their instances.  A sentence's
probability is a logistic function of its features, a document's is the
noisy-or of its sentences, 1 - prod(1 - p), and the weights are fitted to the
document labels through it.  The same sentence scores then locate what is
offensive in a document.

Features of a sentence are hashes of its lower-cased words and of their first
4, 5 and 6 bytes, kept as full 64-bit keys, so unknown words never share a
weight with known ones.  The classifier is fitted on a bounded sample of the
labelled documents (``SAMPLE_ROWS`` ids of each label and ``SAMPLE_BYTES`` of text
in all, half for each label, in the order of a hash of the id); every document
is scored in whole.  A feature takes part if it stands in ``LEAST_DOCS`` toxic
documents of the sample and is ``LEAST_RATIO`` (in log odds) likelier there; at
most the ``MOST_FEATURES`` most telling ones do, which bounds what is broadcast.

Defined cases: null and empty texts have no sentence and score 0; labels that
are null or whose document is missing teach nothing; several labels of one
document count as their maximum; of several texts of one id the one of smallest
hash teaches, once; without both labels the model has no features
and a low constant; repeated rows score alike; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared, words

SAMPLE_ROWS = 2500
SAMPLE_BYTES = 12 << 20
MOST_FEATURES = 20_000
LEAST_DOCS, LEAST_RATIO = 3, 2.0
PREFIXES = (4, 5, 6)
U64 = np.uint64

#: Bytes of words: ASCII letters and digits, and all of multi-byte characters.
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?\n"]] = True
_VALUE = words.mix((np.arange(1, 257, dtype=U64)) * words.STEP)
_VALUE[0x41:0x5B] = _VALUE[0x61:0x7B]
_VALUE[~_INSIDE] = 0


@dataclass
class Model:
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -6.0


def sentence_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature keys, their sentence numbers, the row of each sentence, and each sentence's first byte.

    A sentence is a run of text up to a stop character, with at least one word.
    """
    inside = _INSIDE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    start[cuts] = inside[cuts]
    starts = np.flatnonzero(start)
    none = np.zeros(0, dtype=np.int64)
    if not len(starts):
        return np.zeros(0, U64), none, none, none
    stops = np.cumsum(_STOP[data], dtype=np.int64)
    row = np.searchsorted(offsets, starts, side="right") - 1
    part = stops[starts] + row * (int(stops[-1]) + 1)
    fresh = np.append(True, part[1:] != part[:-1])
    sentence = np.cumsum(fresh) - 1
    longest = int(np.diff(np.append(starts, len(data))).max())
    table = words.powers(min(longest, 4096))
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data)))) if starts[0] == 0 else None
    if place is None:
        place = np.arange(len(data)) - np.concatenate((np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.append(starts, len(data))))))
    held = _VALUE[data] * table[np.minimum(place, len(table) - 1)]
    size = np.add.reduceat(inside.astype(np.int64), starts)
    keys = [words.mix(np.add.reduceat(held, starts) + size.astype(U64))]
    numbers = [sentence]
    for p in PREFIXES:
        long = size > p
        if long.any():
            head = np.add.reduceat(np.where(place < p, held, U64(0)), starts)[long]
            keys.append(words.mix(head + U64(1000 + p)))
            numbers.append(sentence[long])
    return np.concatenate(keys), np.concatenate(numbers), row[fresh], starts[fresh]


def _sentence_scores(model: Model, keys: np.ndarray, number: np.ndarray, n: int) -> np.ndarray:
    """Log-odds of each sentence."""
    z = np.full(n, model.bias)
    if len(model.keys) and len(keys):
        at = np.minimum(np.searchsorted(model.keys, keys), len(model.keys) - 1)
        hit = model.keys[at] == keys
        # A feature counts once a sentence.
        pairs = np.unique(np.stack((number[hit], at[hit])), axis=1) if hit.any() else np.zeros((2, 0), np.int64)
        z += np.bincount(pairs[0], weights=model.weights[pairs[1]], minlength=n)
    return z


def document_scores(model: Model, column: pa.Array) -> np.ndarray:
    """Noisy-or over the sentences of every row."""
    out = np.zeros(len(column))
    for lo, hi, data, offsets in words.text_chunks(column):
        keys, number, row, _ = sentence_features(data, offsets)
        z = _sentence_scores(model, keys, number, len(row))
        clean = np.bincount(row, weights=-np.logaddexp(0, z), minlength=hi - lo)
        out[lo:hi] = -np.expm1(clean)
    return np.clip(out, 0.0, 1.0)


def fit(texts: list[str], toxic: list[int], rounds: int = 200, rate: float = 0.3, shrink: float = 5e-5) -> Model:
    """Fit sentence weights to document labels through the noisy-or, by Adam on the whole sample."""
    y = np.array(toxic, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return Model()
    keys, number, row = [], [], []
    for lo, _, data, offsets in words.text_chunks(pa.array(texts, pa.string())):
        k, s, r, _ = sentence_features(data, offsets)
        keys.append(k)
        number.append(s + sum(len(x) for x in row))
        row.append(r + lo)
    key, sentence, row = np.concatenate(keys), np.concatenate(number), np.concatenate(row)
    # Documents of each label that hold a feature.
    order = np.lexsort((row[sentence], key))
    k, d = key[order], row[sentence][order]
    once = np.append(True, (k[1:] != k[:-1]) | (d[1:] != d[:-1]))
    k, d = k[once], d[once]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    held = np.diff(np.append(first, len(k)))
    bad = np.add.reduceat(y[d], first)
    good = held - bad
    ratio = np.log((bad + 0.1) / (y.sum() + 0.2)) - np.log((good + 0.1) / ((1 - y).sum() + 0.2))
    chosen = np.flatnonzero((bad >= LEAST_DOCS) & (ratio > LEAST_RATIO))
    chosen = chosen[np.argsort(-(bad * ratio)[chosen], kind="stable")][:MOST_FEATURES]
    model = Model(np.sort(k[first][chosen]))
    at = np.minimum(np.searchsorted(model.keys, key), len(model.keys) - 1) if len(model.keys) else np.zeros(0, np.int64)
    hit = model.keys[at] == key if len(model.keys) else np.zeros(0, bool)
    if not hit.any():
        return Model()
    pairs = np.unique(np.stack((sentence[hit], at[hit])), axis=1)
    n, f = len(row), len(model.keys)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, b = 0.4 * ratio[chosen][np.argsort(k[first][chosen])], -6.0  # start from how much likelier a feature is in toxic documents
    m, v = np.zeros(f + 1), np.zeros(f + 1)
    for t in range(1, rounds + 1):
        z = b + np.bincount(pairs[0], weights=w[pairs[1]], minlength=n)
        p = 1 / (1 + np.exp(-z))
        log_clean = np.minimum(np.bincount(row, weights=-np.logaddexp(0, z), minlength=len(y)), -1e-12)
        pull = np.where(y == 1, -1 / np.expm1(-log_clean), 1.0) * weight
        gz = p * pull[row]
        grad = np.append(np.bincount(pairs[1], weights=gz[pairs[0]], minlength=f) + shrink, gz.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = np.maximum(w - step[:-1], 0.0), b - 0.2 * step[-1]
    model.weights, model.bias = w, float(min(b, -4.0))
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on a bounded sample of the labelled documents: at most SAMPLE_ROWS a label and SAMPLE_BYTES of text."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    picked = known.withColumn("order", F.md5(F.col("id").cast("string")))
    ids = [r for y in (0, 1) for r in picked.where(F.col("y") == y).orderBy("order").limit(SAMPLE_ROWS).collect()]
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("id", known.schema["id"].dataType), T.StructField("y", T.IntegerType()), T.StructField("order", T.StringType())])
    few = F.broadcast(spark.createDataFrame([(r["id"], int(r["y"]), r["order"]) for r in ids], schema))  # at most 2 * SAMPLE_ROWS rows
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).join(few, "id")
    # One text an id, so there are at most as many rows as ids, however often a document repeats.
    texts = texts.select("order", "y", "text", F.xxhash64("text").alias("hash"))
    sizes = texts.groupBy("order", "y").agg(F.min(F.struct("hash", F.octet_length("text").alias("size"))).alias("t")).select("order", "y", "t.*").collect()
    room = {0: SAMPLE_BYTES // 2, 1: SAMPLE_BYTES // 2}
    take = []
    for r in sorted(sizes, key=lambda r: r["order"]):
        if r["size"] <= room[r["y"]]:
            room[r["y"]] -= r["size"]
            take.append((r["order"], r["hash"]))
    if not take:
        return Model()
    take = F.broadcast(spark.createDataFrame(take, "order string, hash bigint"))
    got = texts.join(take, ["order", "hash"]).groupBy("order").agg(F.min("y").alias("y"), F.min("text").alias("text")).collect()
    got.sort(key=lambda r: r["order"])
    return fit([r["text"] for r in got], [r["y"] for r in got])


def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = document_scores(model.value, batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score: one row per row of ``docs``."""
    shared.attach(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most 16 bytes times MOST_FEATURES
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(partial(_scored, model=held), T.StructType([rows.schema.fields[0], T.StructField("score", T.DoubleType())]))


def _located(batches: Iterator[pa.RecordBatch], model, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, out = batch.column(0), {"row": [], "at": [], "score": [], "sentence": []}
        for lo, _, data, offsets in words.text_chunks(batch.column(1)):
            keys, number, row, start = sentence_features(data, offsets)
            p = 1 / (1 + np.exp(-_sentence_scores(model.value, keys, number, len(row))))
            for s in np.flatnonzero(p >= least):
                limit = offsets[row[s] + 1] if s + 1 == len(row) or row[s + 1] != row[s] else start[s + 1]
                raw = bytes(data[start[s] : limit]).decode("utf-8", "replace").strip()
                out["row"].append(lo + int(row[s]))
                out["at"].append(int(start[s] - offsets[row[s]]))
                out["score"].append(float(p[s]))
                out["sentence"].append(raw)
        taken = ids.take(pa.array(out["row"], pa.int64()))
        yield pa.RecordBatch.from_arrays([taken, pa.array(out["at"], pa.int64()), pa.array(out["score"], pa.float64()), pa.array(out["sentence"], pa.string())], ["doc_id", "byte", "score", "sentence"])


def locate(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The offending sentences: doc_id, first byte, score, sentence."""
    shared.attach(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    fields = [T.StructField("byte", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("sentence", T.StringType())]
    return rows.mapInArrow(partial(_located, model=held, least=least), T.StructType([rows.schema.fields[0], *fields]))
