"""Jaccard self-join on word shingles with token-combination prefixes.

Two documents link when their sets of ``width``-word shingles have a Jaccard
similarity of at least ``num / den``.  Steps:

1. Documents with equal shingle sets form one class; its node is the smallest
   document id, and only one set of a class goes on.
2. Every shingle is counted over all classes.  Each packet of documents sends
   its sorted shingles by hash range and gets their counts back in the same
   order, so nothing is broadcast.  The global order of tokens is by count,
   then hash.
3. A set of n shingles may miss t = n - ceil(n * num / den) of a partner's.
   Shingles of count 1 are in no partner, so a set with more than t of them has
   none and ends here.  The others index their prefix.  Tokens fall into
   classes by count: up to RARE single tokens are indexed, up to RARE ** 2
   pairs, beyond that triples, within small token groups.  A group of
   k-combinations may hide k - 1 shared tokens, so the prefix is extended by
   that for every group it touches: it ends where its tokens, less those,
   number t + 1.  Two linked sets then share a combination that lies in both
   prefixes.  Groups are set by hash and by size class; partners differ by at
   most one size class, and each set is indexed for both.
4. An index entry carries a positional bound: how many tokens up to its last
   one a partner, which first meets the set there, must miss.  With the sizes
   this bounds the overlap of a pair, and pairs that cannot reach the threshold
   are not made.  At the first common entry of a pair the bound holds for sure.
5. In every entry the member with the smallest share of shingles of its own
   (an original rather than an edited copy) is compared with all others, and
   linked sets merge into components.  In large entries whose members are then
   still apart a member of another component is compared with the rest, a few
   rounds long.  At last all pairs of members of different components are
   compared, so no link between components is lost, while groups of copies
   never make all their pairs.
6. Pairs are compared exactly on both whole sets (64-bit shingle hashes).

Defined cases: null, empty and word-less texts have 0 shingles and link with
nothing; texts with fewer words than ``width`` have one shingle, the whole
sequence; a row without id has no component; rows that share an id count as
one document; empty tables give empty results; ids are integers, others raise
TypeError.  Only the id and text columns are read.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import packets, shared, words
from .components import components

#: Tokens of up to so many sets are indexed singly, of up to its square in pairs, others in triples.
RARE = 24
#: Tokens per group that a prefix is planned for.
GROUP = 5
#: Entries with more members than this get some rounds of one member against the rest before all pairs across components.
SMALL = 32
ROUNDS = 2
U64 = np.uint64


def _sets(block: bytes, width: int) -> Iterator[tuple[int, int | None, np.ndarray]]:
    """(row number, id, sorted distinct shingle hashes) of a packet's rows."""
    table = packets.opened(block)
    ids = table.column(0).to_pylist()
    for lo, _, data, offsets in words.text_chunks(table.column(table.num_columns - 1)):
        starts, ends, rows = words.word_spans(data, offsets)
        hashes = words.word_hashes(data, starts, ends, fold=True)
        windows = words.window_hashes(hashes, width)
        short = words.row_hashes(hashes, rows)
        for i in range(len(rows) - 1):
            n = rows[i + 1] - rows[i]
            if n >= width:
                yield lo + i, ids[lo + i], np.unique(windows[rows[i] : rows[i + 1] - width + 1])
            else:
                yield lo + i, ids[lo + i], short[i : i + (1 if n else 0)]


def _key(shingles: np.ndarray) -> tuple[int, int]:
    one = words.mix(shingles + U64(1)).sum(dtype=U64)
    two = words.mix(shingles ^ words.BASE).sum(dtype=U64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def _keys(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for packet, block in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows = [(doc, len(s), *_key(s), packet, i) for i, doc, s in _sets(block.as_py(), width)]
            kinds = [pa.int64()] * 6
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(6)], ["doc_id", "n", "k1", "k2", "packet", "row"])


def _chosen(packed: pa.Table, told: pa.Table, width: int) -> list[tuple[int, np.ndarray]]:
    """(id, shingles) of the rows of one packet that stand for their class."""
    rows = set(told.column("row").drop_null().to_pylist())
    if not rows or not packed.num_rows:
        return []
    return [(doc, s) for i, doc, s in _sets(packed.column("block")[0].as_py(), width) if i in rows]


def _shortened(held: list[tuple[int, np.ndarray]], shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shortened shingles of some sets, and in how many of the sets each is."""
    return np.unique(np.concatenate([s for _, s in held]) >> U64(shift), return_counts=True)


SENT = "bucket int, packet bigint, block binary"


def _counted(packed: pa.Table, told: pa.Table, width: int, shift: int, n_buckets: int) -> pa.Table:
    """Per hash range: the packet's sorted shingles and in how many of its sets each is."""
    held = _chosen(packed, told, width)
    out = []
    if held:
        key, count = _shortened(held, shift)
        bucket = ((key << U64(shift) >> U64(32)) * U64(n_buckets)) >> U64(32)
        cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=U64(1 << 40))), len(key))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            out.append((int(bucket[lo]), shared.pack(shared.ordered(key[lo:hi]), count[lo:hi].astype(np.uint32))))
    packet = packed.column("packet")[0].as_py() if packed.num_rows else 0
    return pa.table([pa.array([b for b, _ in out], pa.int32()), pa.array([packet] * len(out), pa.int64()), pa.array([x for _, x in out], pa.binary())], ["bucket", "packet", "block"])


def _totalled(table: pa.Table) -> pa.Table:
    """One hash range: each packet's shingles get their counts over all packets, in the order they came in."""
    keys, counts = [], []
    for block in table.column("block").to_pylist():
        key, count = shared.unpack(block, np.uint64, np.uint32)
        keys.append(np.cumsum(key, dtype=U64))
        counts.append(count)
    distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(which, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.uint32)[which]
    ends = np.cumsum([len(k) for k in keys])[:-1]
    blocks = [shared.pack(part) for part in np.split(total, ends)]
    return pa.table([table.column("bucket"), table.column("packet"), pa.array(blocks, pa.binary())], ["bucket", "packet", "block"])


def _scheme(size_class: int, num: int, den: int) -> int:
    """Token groups of each kind of combination for sets of this size class or the next; 0 if such sets are too small for combinations."""
    least = math.ceil((den / num) ** size_class - 1e-9)
    groups = max(1, int(least * (den - num) / den / GROUP))
    return groups if -(-least * num // den) - 1 >= 3 * groups else 0


def signatures(shingles: np.ndarray, counts: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Index entries of one set, and for each how many of the set's tokens a partner first met there misses."""
    n = len(shingles)
    need = n - (-(-n * num // den)) + 1
    order = np.lexsort((shingles, counts))
    token, count = shingles[order], counts[order]
    lone = int(np.searchsorted(count, 2))
    kind = 1 + (count > RARE).astype(np.int64) + (count > RARE * RARE)
    size_class = math.floor(math.log(n) / math.log(den / num) + 1e-9)
    entries, places = [], []
    for scheme in {max(size_class, 0), max(size_class - 1, 0)}:
        groups = _scheme(scheme, num, den)
        k = kind if groups else np.ones(n, np.int64)
        dealt = ((token >> U64(20)) % U64(max(groups, 1))).astype(np.int64)
        group = np.where(k > 1, k * max(groups, 1) + dealt, -1)
        hides = np.zeros(n, np.int64)
        fresh = np.unique(group, return_index=True)[1]
        hides[fresh] = k[fresh] - 1
        slack = np.cumsum(hides)
        place = np.maximum(np.arange(n) - slack, lone)
        enough = np.flatnonzero(np.arange(1, n + 1) - slack >= need)
        reach = int(enough[0]) + 1 if len(enough) else n
        single = np.flatnonzero(k[:reach] == 1)
        single = single[single >= lone]
        entries.append(words.mix(token[single] + U64(7)))
        places.append(place[single])
        for size in (2, 3):
            part = np.flatnonzero(k[:reach] == size)
            part = part[np.argsort(group[part], kind="stable")]
            chain, last = words.mix(token[part]), np.arange(len(part))
            for _ in range(size - 1):
                chain, last = _longer(chain, last, token[part], group[part])
            entries.append(chain)
            places.append(place[part[last]])
    entry, place = np.concatenate(entries), np.concatenate(places)
    order = np.lexsort((place, entry))
    entry, place = entry[order], place[order]
    first = np.append(True, entry[1:] != entry[:-1])[: len(entry)]
    return entry[first], place[first]


def _longer(chain: np.ndarray, last: np.ndarray, token: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every combination with each later token of its group added; tokens lie sorted by group."""
    chains, lasts = [chain[:0]], [last[:0]]
    for step in range(1, len(token)):
        more = last + step
        fits = more < len(token)
        fits[fits] = group[more[fits]] == group[last[fits]]
        if not fits.any():
            break
        chains.append(words.mix(chain[fits] * words.STEP + token[more[fits]]))
        lasts.append(more[fits])
    return np.concatenate(chains), np.concatenate(lasts)


SURVIVORS = "node bigint, n int, lone int, shingles binary, entry array<bigint>, place array<int>"


def _surviving(packed: pa.Table, told: pa.Table, width: int, shift: int, num: int, den: int) -> pa.Table:
    """The packet's sets that may have a partner, with their index entries."""
    held = _chosen(packed, told, width)
    out = []
    if held:
        key = _shortened(held, shift)[0]
        answers = sorted((b, x) for b, x in zip(told.column("bucket").to_pylist(), told.column("block").to_pylist()) if x is not None)
        total = np.concatenate([shared.unpack(x, np.uint32)[0] for _, x in answers])
        for doc, shingles in held:
            n = len(shingles)
            count = total[np.searchsorted(key, shingles >> U64(shift))]
            lone = int((count == 1).sum())
            if lone <= n - (-(-n * num // den)):
                entry, place = signatures(shingles, count, num, den)
                out.append((doc, n, lone, shared.pack(shared.ordered(shingles)), entry.view(np.int64), place.astype(np.int32)))
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    return pa.table([pa.array([r[i] for r in out], kinds[i]) for i in range(6)], ["node", "n", "lone", "shingles", "entry", "place"])


def _compared(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs of whole sets that reach the threshold."""
    for batch in batches:
        a, b = [], []
        last, held = None, None
        for x, y, one, two in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            if two != last:
                last, held = two, np.cumsum(shared.unpack(two, np.uint64)[0], dtype=U64)
            s = np.cumsum(shared.unpack(one, np.uint64)[0], dtype=U64)
            common = int((held[np.minimum(np.searchsorted(held, s), len(held) - 1)] == s).sum())
            if den * common >= num * (len(s) + len(held) - common):
                a.append(x)
                b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _released(spark) -> None:
    """Let Spark delete the shuffle files of finished steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _candidates(packed: DataFrame, classes: DataFrame, n_buckets: int, shift: int, width: int, num: int, den: int) -> DataFrame:
    """Sets that may have a partner: node, n, lone, shingles, entry, place."""
    reps = classes.select("packet", "row")
    counted = packed.groupBy("packet").cogroup(reps.groupBy("packet")).applyInArrow(partial(_counted, width=width, shift=shift, n_buckets=n_buckets), SENT)
    answers = counted.groupBy("bucket").applyInArrow(_totalled, SENT)
    none = F.lit(None)
    told = reps.select("packet", "row", none.cast("int").alias("bucket"), none.cast("binary").alias("block"))
    told = told.union(answers.select("packet", none.cast("bigint"), "bucket", "block"))
    return packed.groupBy("packet").cogroup(told.groupBy("packet")).applyInArrow(partial(_surviving, width=width, shift=shift, num=num, den=den), SURVIVORS)


def _linked(classes: DataFrame, members: DataFrame, packed: DataFrame, folder: str, n_buckets: int, shift: int, width: int, num: int, den: int) -> DataFrame:
    """(node, component) of every class that has a link."""
    spark = packed.sparkSession
    drop = lambda name: shared.dropped(spark, f"{folder}/{name}")
    sets = shared.stored(_candidates(packed, classes, n_buckets, shift, width, num, den), folder, "candidates")
    _released(spark)
    drop("packets")
    drop("classes")

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("one"))
        two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("two"))
        both = pairs.distinct().join(one, "a").join(two, "b").select("a", "b", "one", "two")
        return shared.stored(both.mapInArrow(partial(_compared, num=num, den=den), "a bigint, b bigint"), folder, name)

    def may_reach(n, place, m, other):
        return (num + den) * F.least(n - place, m - other) >= num * (n + m)

    rows = sets.select("node", "n", (F.col("lone") / F.col("n")).alias("own"), F.explode(F.arrays_zip("entry", "place")).alias("e"))
    rows = rows.select("e.entry", "node", "n", "e.place", "own")
    leads = rows.groupBy("entry").agg(F.count("*").alias("c"), F.min(F.struct("own", "node", "n", "place")).alias("lead")).where("c > 1")
    rows = shared.stored(rows.join(leads, "entry"), folder, "entries")
    star = rows.where((F.col("node") != F.col("lead.node")) & may_reach(F.col("n"), F.col("place"), F.col("lead.n"), F.col("lead.place")))
    found = linked(star.select(F.col("node").alias("a"), F.col("lead.node").alias("b")), "links-0")
    # An id with several texts is one document: its classes are linked.
    several = members.where("node is not null").groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("high")).where("b < high")
    found = found.union(members.join(several, "doc_id").select(F.col("node").alias("a"), "b"))
    labels = components(found, folder, "components-0")
    rows = rows.drop("lead")
    for turn in range(1, ROUNDS + 2):
        told = rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        apart = told.groupBy("entry").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("entry")
        rows = shared.stored(told.join(apart, "entry"), folder, f"apart-{turn}")
        drop(f"apart-{turn - 1}" if turn > 1 else "entries")
        wide = rows.where(F.col("c") > SMALL)
        last = turn > ROUNDS or wide.isEmpty()
        if last:
            if rows.isEmpty():
                break
            other = rows.select("entry", *[F.col(x).alias(f"b_{x}") for x in ("node", "n", "place", "component")])
            apart = (F.col("component") < F.col("b_component")) & may_reach(F.col("n"), F.col("place"), F.col("b_n"), F.col("b_place"))
            pairs = rows.join(other, "entry").where(apart).select(F.col("node").alias("a"), F.col("b_node").alias("b"))
        else:
            # One member of some component, another one each turn, against the members of all others.
            lead = wide.groupBy("entry").agg(F.min(F.struct(F.xxhash64("component", F.lit(turn)), "own", "node", "n", "place", "component")).alias("lead"))
            apart = (F.col("component") != F.col("lead.component")) & may_reach(F.col("n"), F.col("place"), F.col("lead.n"), F.col("lead.place"))
            pairs = wide.join(lead, "entry").where(apart).select(F.col("node").alias("a"), F.col("lead.node").alias("b"))
        found = linked(pairs, f"links-{turn}")
        if not found.isEmpty():
            known = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
            labels = components(known.union(found), folder, f"components-{turn}")
        rows = rows.drop("component")
        if last:
            break
    drop("candidates")
    return labels


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100, folder: str | None = None) -> DataFrame:
    """doc_id, n_shingles, node (its class), component_id: one row per row of ``docs``."""
    spark = docs.sparkSession
    shared.attach(spark)
    if not isinstance(docs.select(f"`{id_col}`").schema[0].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be an integer column")
    folder = folder or shared.shared_folder(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    n_buckets, n_bytes = shared.buckets_for(rows, "text")
    # Hashes are shortened for counting; at this length few of them fall together, and those only lend each other their counts.
    shift = max(0, 64 - 14 - max(1, n_bytes).bit_length())
    packed = packets.packets(rows, folder)
    keys = shared.stored(packed.mapInArrow(partial(_keys, width=width), "doc_id bigint, n bigint, k1 bigint, k2 bigint, packet bigint, row bigint"), folder, "keys")
    classes = keys.where("doc_id is not null and n > 0").groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "packet", "row")).alias("first"))
    classes = shared.stored(classes.select("k1", "k2", "n", F.col("first.doc_id").alias("node"), "first.packet", "first.row"), folder, "classes")
    same = ["k1", "k2", "n"]
    members = shared.stored(keys.join(classes.select(*same, "node"), same, "left").select("doc_id", F.col("n").alias("n_shingles"), "node"), folder, "members")
    shared.dropped(spark, f"{folder}/keys")
    if num < den:
        labels = _linked(classes, members, packed, folder, n_buckets, shift, width, num, den).select("node", "component")
    else:  # equal sets only
        labels = classes.select("node", F.col("node").alias("component"))
    return members.join(labels, "node", "left").select("doc_id", "n_shingles", "node", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")).alias("component_id"))
