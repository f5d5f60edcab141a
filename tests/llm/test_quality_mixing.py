import hashlib
import re
from collections import Counter

import pytest

from quarry.llm import mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c = Counter(wins)
    cover = {p for i, x in enumerate(wins) if c[x] > 1 for p in range(i, i + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)


def test_ledger_on_odd_rows(frame, odd_rows):
    rows = [*odd_rows, (20, "a b c d e a b c d e f\na b c d e f\na b c d e f\n#$ %", "en", "a", 1)]
    got = quality.ledger(frame(rows)).collect()
    assert len(got) == len(rows)
    want = sorted((r[0] or -1, *brute(r[1])) for r in rows)
    assert sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want


def test_policies_and_ablations(frame, odd_rows, tmp_path):
    table = quality.store(frame(odd_rows), f"file://{tmp_path}")
    kept = table.where(quality.passes("v1")).count()
    costs = {r.rule: r for r in quality.ablations(table, "v1").collect()}
    assert kept == quality.keep_good(frame(odd_rows)).count()
    assert costs["too_few_words"].n_kept_without == kept + costs["too_few_words"].n_failed_only
    assert "n_words" in quality.keep_good(frame(odd_rows)).columns


def test_mixing_targets_and_takes(frame):
    rows = [(i, "w " * (1 + i % 7), "en", s, 0) for i, s in enumerate(["a"] * 300 + ["b"] * 100 + ["c"] * 40 + [None] * 20)]
    df = frame(rows)
    got = mixing.taken(df).collect()
    assert len(got) == len(rows)
    total = sum(r.size for r in got)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert abs(sum(t for _, t in by) - total) < 1e-6 * total
    for (size, target), taken in by.items():
        assert target <= 3 * size + 1e-9 and abs(sum(taken) - target) <= len(by)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.taken(df).collect()))


def served_by_hand(rows, cut):
    """Words each row gives, and the whole rows taken in order, by one sort in memory."""
    size = [len(WORD.findall(t or "")) for _, t, *_ in rows]
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    key = [md5(f"{'' if i is None else i}|{'' if s is None else 's' + s}|{md5(t or '')}") for i, t, _, s, _ in rows]
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    whole = {s: sum(n for n, r in zip(size, rows) if r[3] == s) for s in names}
    weight, open_, target = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, set(names), {}
    budget = sum(size)
    while True:
        rest = budget - sum(3 * whole[s] for s in names if s not in open_)
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * whole[s]}
        if not over:
            break
        open_ -= over
    target = {s: weight[s] * level if s in open_ else 3.0 * whole[s] for s in names}
    turns = []
    for s in names:
        at = 0
        for _ in range(3):
            for i in sorted((i for i, r in enumerate(rows) if r[3] == s), key=lambda i: key[i]):
                ends = [at, at + size[i]]
                if cut == "words" and ends[0] < int(target[s]) < ends[1]:
                    ends.insert(1, int(target[s]))
                turns += [(b / target[s] if target[s] else 1e300, s is None, s or "", a, i, b - a) for a, b in zip(ends, ends[1:])]
                at = ends[-1]
    taken, order, ahead = [0] * len(rows), [], 0
    for *_, i, n in sorted(turns):
        got = max(0, min(n, budget - ahead))
        if cut == "documents":
            got = n if 2 * got >= n else 0
        taken[i] += got
        ahead += n
        if got:
            order.append(rows[i][0])
    return [(r[0], n, t) for r, n, t in zip(rows, size, taken)], order


def uneven_rows():
    rows = [(i, f"w{i} " * (1 + (i * 7) % 23), "en", s, 0) for i, s in enumerate(["a"] * 90 + ["b"] * 40 + ["c"] * 9 + [None] * 12)]
    rows += [(None, "no id " * 3, "en", "b", 0), (None, "nor here", "en", "b", 0), (7, None, "en", "a", 0), (8, "", "en", "c", 0)]
    return rows + [(500, "x " * 400, "en", "c", 0)]


@pytest.mark.parametrize("cut", ["words", "documents"])
def test_what_is_taken_is_the_sorted_prefix(frame, cut):
    rows = uneven_rows()
    want, order = served_by_hand(rows, cut)
    got = mixing.taken(frame(rows).repartition(3), cut=cut).collect()
    low = lambda x: (x[0] is None, *[y or 0 for y in x])
    assert sorted(((r.doc_id, r.size, r.taken) for r in got), key=low) == sorted(want, key=low)
    if cut == "words":
        assert sum(r.taken for r in got) == sum(r.size for r in got)
    else:
        assert [r.doc_id for r in mixing.mix(frame(rows).repartition(3)).collect()] == order


def test_ties_repeated_rows_and_sources_without_words(frame):
    rows = [(1, "a b", "en", "s", 0)] * 3 + [(2, "a b", "en", "s", 0), (3, None, "en", "t", 0), (4, " ", "en", None, 0)]
    got = sorted(((r.doc_id, r.taken) for r in mixing.taken(frame(rows)).collect()))
    assert got == [(1, 2), (1, 2), (1, 2), (2, 2), (3, 0), (4, 0)]
    assert sorted(r.doc_id for r in mixing.mix(frame(rows)).collect()) == [1, 1, 1, 2]


def test_mix_returns_whole_rows_in_order(frame, odd_rows):
    df = frame(odd_rows)
    out = mixing.mix(df)
    assert out.columns == df.columns
    texts = {r[1] for r in odd_rows}
    got = out.collect()
    assert got and all(r.text in texts and r.text for r in got)
    assert mixing.mix(frame([])).count() == 0 and mixing.taken(frame([])).count() == 0


def test_many_equal_rows_and_many_empty_rows(frame, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 8)
    rows = [(None, "same words here", None, None, 0)] * 50 + [(None, None, None, "void", 0)] * 40 + [(i, f"t{i} x", "en", "a", 0) for i in range(30)]
    want, order = served_by_hand(rows, "words")
    low = lambda x: (x[0] is None, *[y or 0 for y in x])
    got = mixing.taken(frame(rows).repartition(3))
    assert sorted(((r.doc_id, r.size, r.taken) for r in got.collect()), key=low) == sorted(want, key=low)
    assert {(r.size, r.target) for r in got.where("size = 0").collect()} == {(0, 0.0)}
    _, order = served_by_hand(rows, "documents")
    assert [r.doc_id for r in mixing.mix(frame(rows).repartition(3)).collect()] == order
