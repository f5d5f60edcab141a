"""Near duplicates and repeated passages against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest

from quarry.llm import ngram_join, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near_copies(seed=5):
    r = random.Random(seed)
    rows, n = [], 100
    for group in range(6):
        base = [f"g{group}w{r.randrange(400)}" for _ in range(r.choice([6, 30, 90, 200]))]
        for _ in range(r.choice([2, 9, 25])):
            w = list(base)
            for _ in range(r.randrange(0, max(2, len(w) // 25))):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            rows.append((n, " ".join(w) if r.random() < 0.5 else " ".join(w).upper(), "en", "s", 0))
            n += 1
    shared_passage = " ".join(f"p{i}" for i in range(50))
    for i in range(30):
        rows.append((n + i, " ".join(f"u{i}v{k}" for k in range(40)) + " " + shared_passage, "en", "s", 0))
    return rows


def components(rows):
    sets = {}
    for i, t, *_ in rows:
        if i is None:
            continue
        w = WORD.findall((t or "").translate(FOLD))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("rare,small", [(24, 32), (1, 2)])
def test_join_matches_brute_force(frame, odd_rows, monkeypatch, rare, small):
    monkeypatch.setattr(ngram_join, "RARE", rare)
    monkeypatch.setattr(ngram_join, "SMALL", small)
    rows = [*odd_rows, *near_copies()]
    got = ngram_join.join(frame(rows).repartition(3)).collect()
    assert len(got) == len(rows)
    want = components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_join_of_an_empty_table(frame):
    assert ngram_join.join(frame([])).count() == 0


def test_every_partner_shares_a_signature(monkeypatch):
    """Linked sets meet in an entry whose positional bounds let them pass, whatever the counts of their tokens."""
    import numpy as np

    from quarry.llm import words

    monkeypatch.setattr(ngram_join, "RARE", 3)
    r = np.random.default_rng(3)
    met = 0
    for num, den in ((80, 100), (50, 100), (9, 10)):
        for n in (4, 5, 8, 40, 300):
            for most in (2, 4, 30):  # mostly rare tokens, some pairs, mostly triples
                for _ in range(20):
                    x = np.unique(words.mix(r.integers(0, 1 << 60, n).astype(np.uint64)))
                    drop = r.integers(0, 1 + n * (den - num) // den)
                    y = np.unique(np.concatenate((r.permutation(x)[drop:], words.mix(r.integers(0, 1 << 60, drop // 2).astype(np.uint64)))))
                    common = len(np.intersect1d(x, y))
                    if den * common < num * len(np.union1d(x, y)) or len(np.setxor1d(x, y)) == 0:
                        continue
                    counts = dict(zip(np.union1d(x, y).tolist(), r.integers(2, 2 + most, len(np.union1d(x, y))).tolist()))
                    for s in np.setxor1d(x, y).tolist():
                        counts[s] = int(r.integers(1, 2 + most))
                    found = []
                    for s in (x, y):
                        entry, place = ngram_join.signatures(s, np.array([counts[t] for t in s.tolist()]), num, den)
                        found.append(dict(zip(entry.tolist(), place.tolist())))
                    at = [(found[0][e], found[1][e]) for e in found[0].keys() & found[1].keys()]
                    assert any((num + den) * min(len(x) - p, len(y) - q) >= num * (len(x) + len(y)) for p, q in at)
                    met += 1
    assert met > 300


def test_one_id_with_two_texts_is_one_document(frame):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(7, one, "en", "s", 0), (3, one, "en", "s", 0), (7, two, "en", "s", 0), (9, two, "en", "s", 0), (8, "c d e f g h", "en", "s", 0)]
    got = {(r.doc_id, r.component_id) for r in ngram_join.join(frame(rows)).collect()}
    assert got == {(7, 3), (3, 3), (9, 3), (8, 8)}


def test_ids_must_be_integers(spark):
    with pytest.raises(TypeError):
        ngram_join.join(spark.createDataFrame([("a", "x y")], "doc_id string, text string"))


def removed(rows, width=35):
    docs = [(i, WORD.findall(t or "")) for i, t, *_ in rows]
    c = Counter(tuple(w[k : k + width]) for _, w in docs for k in range(len(w) - width + 1))
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if c[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i if i is not None else -1, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_dedup_matches_brute_force(frame, odd_rows):
    rows = [*odd_rows, *near_copies(), (900, " ".join(["la"] * 80), "en", "s", 0), (901, " ".join(f"q{i % 40}" for i in range(100)), "en", "s", 0)]
    got = substring.dedup(frame(rows).repartition(4)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept_sha256) for r in got) == removed(rows)
    assert substring.dedup(frame([])).count() == 0


@pytest.mark.parametrize("width", [3, 8, 20])
def test_dedup_of_other_widths(frame, odd_rows, width):
    rows = odd_rows[:4]
    got = substring.dedup(frame(rows), width=width).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == removed(rows, width)


def test_covers_take_any_two_starts_to_cover_positions():
    for period, cover in substring.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
