"""Exact dedup, late sessions and fill-in-middle against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.llm import exact_dedup, fill_middle, late_sessions


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def groups_by_hand(rows):
    """doc_id, keep_id, group_size, kept, digest of rows (doc_id, text)."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = Counter()
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        for k, i in enumerate(ids):
            out[i, ids[0], len(ids), k == 0, sha(text)] += 1
    return out


COPIES = [
    *[(i, f"text number {i}") for i in range(500)],
    *[(1000 + i, "one  text\tof very\nmany rows") for i in range(300)],
    *[(2000 + i, "one text of very many rows" if i % 2 else f"pair {i // 4}") for i in range(80)],
    (3000, " a b"), (3001, "a b"), (3002, "a b "), (3003, "a b"), (3004, "A b"), (3004, "A b"), (None, "A b"), (None, None), (3005, ""), (3006, " \n"), (3007, "\x0b\x1c"), (3008, "x" * 300_000), (3009, "x" * 300_000),
]


@pytest.mark.parametrize("most_bits", [exact_dedup.MOST_BITS, 1 << 15])
def test_exact_dedup(spark, frame, monkeypatch, most_bits):
    monkeypatch.setattr(exact_dedup, "LIGHT_ROWS", 3)  # groups of 4 and more are hot
    docs = frame([(i, t, "en", "a", 0) for i, t in COPIES]).repartition(5)
    got = exact_dedup.dedup(docs, most_bits=most_bits)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, got.collect())) == groups_by_hand(COPIES)


def test_exact_dedup_of_many_groups_in_a_full_filter(spark):
    rows = [(i, f"t{i % 700}" if i % 3 else f"alone {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    digests = docs.select(exact_dedup.digest(F.col("text")).alias("digest"))
    for blocks in (1, 4):
        slots = exact_dedup.repeated_slots(digests, blocks)
        possible = {bytes(r.digest) for r in exact_dedup.probed(digests, slots, blocks).where("possible").collect()}
        count = Counter(bytes(r.digest) for r in digests.collect())
        several = {d for d, n in count.items() if n > 1}
        assert several <= possible and len(possible - several) < (300 if blocks == 1 else 100)
    assert Counter(map(tuple, exact_dedup.dedup(docs).collect())) == groups_by_hand(rows)


def test_exact_dedup_keeps_rows_whole(spark, frame):
    docs = frame([(i, t, "en", "a", 0) for i, t in COPIES])
    kept = exact_dedup.keep_first(docs.repartition(3))
    assert kept.columns == docs.columns
    want = Counter((i, d) for (i, _, _, stays, d), n in groups_by_hand(COPIES).items() if stays for _ in range(n))
    assert Counter((r.doc_id, sha(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""))) for r in kept.collect()) == want


def test_blocks():
    assert [exact_dedup.blocks_for(n) for n in (0, 1, 2048, 2049, 10**6, 10**12)] == [1, 1, 1, 2, 512, 1 << 13]


def test_passes_need_no_python(spark, frame):
    plan = exact_dedup.dedup(frame([(1, "a", "en", "a", 0), (2, "a", "en", "a", 0)]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|RDD", plan.replace("Scan ExistingRDD", ""))


def versions_by_hand(events, gap=420):
    """The log of (user, batch, start, end, n, new, retracted, sum, by batch, by start)."""
    users = defaultdict(lambda: defaultdict(list))
    for user, second, batch, weight in events:
        if None not in (user, second, batch):
            users[user][batch].append((second, weight or 0))
    out = []
    for user, batches in users.items():
        so_far, standing = [], []
        for batch in sorted(batches):
            so_far += [(s, w, batch) for s, w in batches[batch]]
            so_far.sort()
            sessions = [[so_far[0]]]
            for e in so_far[1:]:
                if e[0] - sessions[-1][-1][0] <= gap:
                    sessions[-1].append(e)
                else:
                    sessions.append([e])
            for x in sessions:
                new = sum(e[2] == batch for e in x)
                if new:
                    lo, hi = x[0][0], x[-1][0]
                    gone = [v for v in standing if lo <= v[2] <= hi]
                    standing = [v for v in standing if v not in gone]
                    out += [(*v, batch, lo) for v in gone]
                    standing.append((user, batch, lo, hi, len(x), new, len(gone), sum(e[1] for e in x)))
        out += [(*v, None, None) for v in standing]
    return Counter(out)


COLUMNS = ["user", "batch", *late_sessions._KEPT[1:], "retracted_batch", "retracted_start_s"]


def log_of(spark, events, **names):
    rows = spark.createDataFrame(events, "user bigint, second bigint, batch bigint, weight bigint").withColumn("cell", F.lit("x")).withColumn("chunk", F.lit(1))
    return Counter(map(tuple, late_sessions.versions(rows.repartition(4), **names).select(*COLUMNS).collect()))


@pytest.mark.parametrize("span", [2, 512])
def test_late_sessions(spark, monkeypatch, span):
    monkeypatch.setattr(late_sessions, "SPAN", span)
    r = random.Random(3)
    events = [(u, s, s // 3600 + r.choice([0, 0, 1, 2, 3]), r.randrange(1000)) for u in range(6) for s in (r.randrange(-5000, 60_000) for _ in range(60))]
    # One user with a third of all rows: long unbroken runs over many stretches, repeated rows and ties.
    events += [(9, s + r.randrange(100), s // 3600 + r.choice([0, 3]), 1) for s in range(0, 90_000, 300) if s % 9000]
    events += [(9, 500, 2, 7)] * 40 + [(9, 920, 1, 1), (9, 921 + 420, 1, 1), (9, 921 + 840, 9, 1)]
    events += [(None, 5, 1, 1), (3, None, 1, 1), (3, 5, None, 1), (3, 5, 1, None)]
    assert log_of(spark, events) == versions_by_hand(events)
    assert log_of(spark, events, gap=60) == versions_by_hand(events, 60)


def test_late_sessions_borders(spark):
    events = [(1, 0, 0, 1), (1, 420, 0, 2), (1, 841, 0, 4), (2, 0, 0, 1), (2, 800, 0, 1), (2, 400, 1, 1), (3, 0, 2, 1), (3, 10, 2, 1), (3, 5, 4, 1)]
    got = log_of(spark, events)
    assert got == versions_by_hand(events)
    assert (2, 1, 0, 800, 3, 1, 2, 3, None, None) in got and (2, 0, 0, 0, 1, 1, 0, 1, 1, 0) in got
    assert log_of(spark, []) == Counter()


def test_conversation_events(spark):
    rows = [(c, t) for c in (0, 7, 8, 123456) for t in range(9)] + [(None, 1), (5, None), (5, 3), (5, 3)]
    got = late_sessions.conversation_events(spark.createDataFrame(rows, "conv_id bigint, turn bigint").withColumn("second", F.lit("x")))
    want = Counter()
    for conv, turn in rows:
        if conv is not None and turn is not None:
            c, h = zlib.crc32(str(conv).encode()), zlib.crc32(f"{conv}:{turn}".encode())
            s, g = c // 2 % 7200 + 300 * turn + h % 600, h // 600
            want[2 * (conv // 8) + c % 2, s, s // 3600 + (g % 4 if g % 3 == 0 else 0), h] += 1
    assert Counter(map(tuple, got.collect())) == want


TEXTS = [
    None, "", "a", "abc", "abc def", "1234", "a1b2", " a", "a ", "\n\n", "é", "aéb", "日本 text 日本", "x" * 5000, "word " * 4000, "<P>", "a <S> b", "a<M", "<", "ab<>P<P", "𝒳 math 𝒳y", "tab\tand\x00nul", "ÿÀz", "?!?",
]


def by_hand(doc_id, text):
    text = text or ""
    k = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(k), "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (len(k) + 1), h[1] % (len(k) + 1)))
    p, m, s = "".join(k[:a]), "".join(k[a:b]), "".join(k[b:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(k), form, len(p), len(m), sha(out), sha(text)


def test_fill_middle(spark, frame, odd_rows):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(300)] + [(r[0], r[1]) for r in odd_rows] + [(None, "no id here")]
    docs = frame([(i, t, "en", "a", 0) for i, t in rows]).withColumn("form", F.lit(1)).repartition(3)
    got = fill_middle.transform(docs)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    want = Counter(by_hand(*r) for r in rows)
    assert Counter(map(tuple, got.collect())) == want and {w[2] for w in want} == {"plain", "psm", "spm"}
    whole = fill_middle.transform(docs, carry="_row", texts=True).collect()
    assert Counter((r._row.doc_id, r._row.text or "") for r in whole) == Counter((i, t or "") for i, t in rows)
    assert all(sha(r.output) == r.output_sha256 and fill_middle.restored(r.output, r.form) == (r._row.text or "") for r in whole)
    assert fill_middle.transform(docs.limit(0)).count() == 0


def test_starts_and_selection():
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choice("abZ 1é日<\n") for _ in range(r.randrange(1, 80)))
        starts = [m.start() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text)]
        bits = fill_middle.starts_of(text)
        assert bits.bit_count() == len(starts)
        assert [fill_middle.select(bits, k, len(text)) for k in range(len(starts))] == starts
