"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Reads a ``tokenizer.json`` whose model is BPE with an end-of-word suffix, whose
normaliser is NFC, white space folding and lower-casing, and which splits by a
pattern and maps bytes to printable characters.  A word's symbols are the
leaves of a segment tree; a leaf holds the rank of the pair it starts, the
root the leftmost pair of lowest rank.  Each merge updates at most three
leaves, so a word of n symbols takes O(n log n), however long it is.  Short
words that are new to a worker are merged side by side: one array holds the
trees of all words of like length, and each step takes every root at once.

Defined cases: null and empty texts have no tokens; rows are independent, so
repeated rows get equal results; empty tables give empty results; the whole
text is encoded, whatever its length.  Only the named columns are read, others
travel in one struct (``carry``).
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared, words

_NONE = 1 << 62
#: White space as the file's ``\s`` means it; Python's own class has more characters.
_WHITE = r"\t-\r \x85\xa0  -     　"
#: Words kept ready per worker; the table starts anew when it is full.
CACHE_WORDS = 300_000


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class PairTree:
    """Minimum tree: ``root()`` is the leftmost leaf of lowest rank."""

    def __init__(self, ranks: list[int]):
        self.size = 1 << max(0, (len(ranks) - 1).bit_length())
        leaves = [_NONE if r < 0 else (r << 32) | i for i, r in enumerate(ranks)]
        self.node = [_NONE] * self.size + leaves + [_NONE] * (self.size - len(leaves))
        for i in range(self.size - 1, 0, -1):
            self.node[i] = min(self.node[2 * i], self.node[2 * i + 1])

    def root(self) -> int:
        top = self.node[1]
        return -1 if top == _NONE else top & 0xFFFFFFFF

    def set(self, leaf: int, rank: int) -> None:
        node, i = self.node, leaf + self.size
        node[i] = _NONE if rank < 0 else (rank << 32) | leaf
        i >>= 1
        while i:
            a, b = node[2 * i], node[2 * i + 1]
            low = a if a < b else b
            if node[i] == low:
                break
            node[i] = low
            i >>= 1


class PairForest:
    """The trees of many short words, one per row, merged in step; the same order of merges as ``PairTree``."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray, made: np.ndarray):
        self.pairs, self.ranks, self.made = pairs, ranks, made

    def keys(self, left: np.ndarray, right: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Leaf values: rank and place of each pair, or nothing for an end or an unknown pair."""
        pair = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        known = (left >= 0) & (right >= 0) & (self.pairs[at] == pair)
        return np.where(known, (self.ranks[at] << 32) | leaf, _NONE)

    def merge(self, ids: np.ndarray) -> np.ndarray:
        """Rows of ids, -1 after a word's end, with a power of two columns; merged ids in place, -1 where none is left."""
        n, size = ids.shape
        tree = np.full((n, 2 * size), _NONE, dtype=np.int64)
        leaves = np.broadcast_to(np.arange(size - 1), (n, size - 1))
        tree[:, size : 2 * size - 1] = self.keys(ids[:, :-1], ids[:, 1:], leaves)
        for i in range(size - 1, 0, -1):
            tree[:, i] = np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1])
        length = (ids >= 0).sum(axis=1)
        after = np.tile(np.arange(1, size + 1), (n, 1))
        before = np.tile(np.arange(-1, size - 1), (n, 1))
        rows = np.flatnonzero(tree[:, 1] != _NONE)
        while len(rows):
            top = tree[rows, 1]
            at = top & 0xFFFFFFFF
            right = after[rows, at]
            ids[rows, at] = self.made[top >> 32]
            ids[rows, right] = -1
            end = after[rows, right]
            after[rows, at] = end
            inner = end < length[rows]
            before[rows[inner], end[inner]] = at[inner]
            self._set(tree, rows, right, np.full(len(rows), _NONE))
            follow = np.where(inner, ids[rows, np.minimum(end, size - 1)], -1)
            self._set(tree, rows, at, self.keys(ids[rows, at], follow, at))
            left = before[rows, at]
            has = left >= 0
            r, x = rows[has], left[has]
            self._set(tree, r, x, self.keys(ids[r, x], ids[r, at[has]], x))
            rows = rows[tree[rows, 1] != _NONE]
        return ids

    @staticmethod
    def _set(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, key: np.ndarray) -> None:
        i = leaf + tree.shape[1] // 2
        tree[rows, i] = key
        while len(i) and i[0] > 1:
            i = i >> 1
            tree[rows, i] = np.minimum(tree[rows, 2 * i], tree[rows, 2 * i + 1])


class Encoder(dict):
    """word -> (its ids as little-endian unsigned 32-bit integers, its tokens joined by spaces)."""

    def __init__(self, file_text: str):
        super().__init__()
        spec = json.loads(file_text)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[self.vocab[a], self.vocab[b]] = rank, self.vocab[a + b]
        table = np.array(sorted(((a << 32) | b, rank) for (a, b), (rank, _) in self.merges.items()) or [(-1, 0)], dtype=np.int64)
        made = np.array([m for _, m in sorted(self.merges.values())] or [0], dtype=np.int64)
        ranks = {r: i for i, r in enumerate(sorted(r for r, _ in self.merges.values()))}
        self.forest = PairForest(table[:, 0].copy(), np.array([ranks.get(r, 0) for r in table[:, 1].tolist()], dtype=np.int64), made)
        self.letter = byte_letters()
        self.byte_id = np.array([self.vocab.get(x, -1) for x in self.letter], dtype=np.int64)
        self.last_id = np.array([self.vocab.get(x + self.suffix, -1) for x in self.letter], dtype=np.int64)
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split.replace(r"[^\s", f"[^{_WHITE}"))
        self.apart = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
    def learn(self, new: list[str]) -> None:
        """Encode words this worker has not met, short ones side by side."""
        if len(self) + len(new) > CACHE_WORDS:
            self.clear()
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for word in new:
            raw = word.encode("utf-8")
            by_size.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((word, raw))
        for size, group in by_size.items():
            if size > 64 or (self.byte_id < 0).any() or (self.last_id < 0).any():
                for word, _ in group:
                    self._keep(word, self.merged(word))
                continue
            for lo in range(0, len(group), 4096):
                part = group[lo : lo + 4096]
                data = np.frombuffer(b"".join([raw.ljust(size, b"\0") for _, raw in part]), dtype=np.uint8).reshape(-1, size)
                length = np.array([len(raw) for _, raw in part])
                ids = np.where(np.arange(size) < length[:, None], self.byte_id[data], -1)
                rows = np.arange(len(part))
                ids[rows, length - 1] = self.last_id[data[rows, length - 1]]
                for (word, _), row in zip(part, self.forest.merge(ids).tolist()):
                    self._keep(word, [i for i in row if i >= 0])

    def _keep(self, word: str, ids: list[int]) -> None:
        self[word] = np.array(ids, dtype="<u4").tobytes(), " ".join([self.token[i] for i in ids])

    def merged(self, word: str) -> list[int]:
        """Ids of one word: pairs merge lowest rank first, leftmost among equals."""
        letters = [self.letter[b] for b in word.encode("utf-8")]
        letters[-1] += self.suffix
        ids = [self.vocab[x] for x in letters if x in self.vocab]
        if len(ids) < 2:
            return ids
        absent = (-1, -1)
        after = list(range(1, len(ids) + 1))
        before = list(range(-1, len(ids) - 1))
        tree = PairTree([self.merges.get(pair, absent)[0] for pair in zip(ids, ids[1:])])
        while (at := tree.root()) >= 0:
            right = after[at]
            ids[at] = self.merges[ids[at], ids[right]][1]
            ids[right] = -1
            after[at] = end = after[right]
            if right < len(ids) - 1:
                tree.set(right, -1)
            if end < len(ids):
                before[end] = at
                tree.set(at, self.merges.get((ids[at], ids[end]), absent)[0])
            else:
                tree.set(at, -1)
            if (left := before[at]) >= 0:
                tree.set(left, self.merges.get((ids[left], ids[at]), absent)[0])
        return [i for i in ids if i >= 0]

    def words_of(self, text: str) -> list[str]:
        """The text's words in order; special tokens stay as they are written."""
        if self.apart is not None and "<" in text:
            out: list[str] = []
            for part in self.apart.split(text):
                if part in self.special:
                    self[part] = np.array([self.special[part]], dtype="<u4").tobytes(), part
                    out.append(part)
                else:
                    out += self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        # Characters are lower-cased one by one, so a final sigma is like any other.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return self.words.findall(text)

    def pieces(self, texts: list[str]) -> list[list[tuple[bytes, str]]]:
        found = [self.words_of(t) for t in texts]
        known = set().union(*found)
        self.learn([w for w in known if w not in self and w not in self.special])
        missing = [w for w in known if w not in self]  # the table was emptied meanwhile
        if missing:
            for w in missing:
                if w in self.special:
                    self[w] = np.array([self.special[w]], dtype="<u4").tobytes(), w
            self.learn([w for w in missing if w not in self])
        return [[self[w] for w in ws] for ws in found]

    def encode(self, text: str) -> bytes:
        return b"".join([p[0] for p in self.pieces([text])[0]])

    def decode(self, ids: bytes) -> str:
        return " ".join([self.token[i] for i in np.frombuffer(ids, dtype="<u4").tolist() if i in self.token])


_READY: dict[int, Encoder] = {}


def encoder(file_text: str) -> Encoder:
    """One encoder per worker process and tokenizer file."""
    key = hash(file_text)
    if key not in _READY:
        _READY.clear()
        _READY[key] = Encoder(file_text)
    return _READY[key]


def _encoded(batches: Iterator[pa.RecordBatch], file, texts: bool) -> Iterator[pa.RecordBatch]:
    enc = encoder(file.value)
    for batch in batches:
        rows = []
        column = batch.column(batch.num_columns - 1).fill_null("")
        for lo, hi, _, _ in words.text_chunks(column):
            for got in enc.pieces(column[lo:hi].to_pylist()):
                ids, decoded = b"".join([g[0] for g in got]), " ".join([g[1] for g in got])
                row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                rows.append((*row, ids, decoded) if texts else row)
        names = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"][: 2 * texts]]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
        made = [pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))]
        rest = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*rest, *made], [*[batch.schema.field(i).name for i in range(batch.num_columns - 1)], *names])


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None, texts: bool = False) -> DataFrame:
    """id, n_tokens, digests of ids and decoded text per row; ``texts`` adds ids (bytes) and decoded text."""
    spark = docs.sparkSession
    shared.attach(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        file = spark.sparkContext.broadcast(f.read())  # the vocabulary: of a fixed size, whatever the corpus
    kept = [F.col(f"`{id_col}`").alias("doc_id")] + ([F.struct("*").alias(carry)] if carry else [])
    rows = docs.select(*kept, F.col(f"`{text_col}`").alias("text"))
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if texts:
        fields += [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
    return rows.mapInArrow(partial(_encoded, file=file, texts=texts), T.StructType([*rows.schema.fields[:-1], *fields]))


def _decoded(batches: Iterator[pa.RecordBatch], file) -> Iterator[pa.RecordBatch]:
    enc = encoder(file.value)
    for batch in batches:
        out = pa.array([None if x is None else enc.decode(x) for x in batch.column(1).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), out], ["doc_id", "decoded"])


def decode(rows: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and decoded text of rows holding ids as little-endian unsigned 32-bit integers; null stays null."""
    spark = rows.sparkSession
    shared.attach(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        file = spark.sparkContext.broadcast(f.read())
    picked = rows.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids"))
    schema = T.StructType([picked.schema.fields[0], T.StructField("decoded", T.StringType())])
    return picked.mapInArrow(partial(_decoded, file=file), schema)
