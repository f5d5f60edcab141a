"""Continuations found once a key, against a search of every place by every context."""

import random

from pyspark.sql import functions as F

from quarry.operators import drafting


def brute(corpus, context, key_len, most, k, length):
    key = context[-key_len:]
    if len(context) < key_len:
        return []
    places = sorted(((d, p) for d, t in corpus.items() for p in range(len(t) - key_len + 1) if t[p : p + key_len] == key), reverse=True)[:most]
    out = []
    for d, p in places:
        n = 0
        while n < min(p, len(context) - key_len) and corpus[d][p - 1 - n] == context[len(context) - key_len - 1 - n]:
            n += 1
        if corpus[d][p + key_len :]:
            out.append((-key_len - n, d, p))
    return [(r + 1, -m, corpus[d][p + key_len : p + key_len + length]) for r, (m, d, p) in enumerate(sorted(out)[:k])]


def test_continuations_are_those_of_a_search_by_every_context(spark):
    r = random.Random(4)
    corpus = {d: [r.randrange(3) for _ in range(r.randrange(25))] for d in range(60)}
    contexts = {c: [r.randrange(3) for _ in range(r.randrange(12))] for c in range(80)}
    frames = [spark.createDataFrame(list(x.items()), f"{name} bigint, tokens array<int>") for name, x in (("doc", corpus), ("ctx", contexts))]
    out = drafting.ngram_continuations(*frames, key_len=3, max_candidates=5, k=3, max_tokens=4)
    want = sorted((c, *row) for c, t in contexts.items() for row in brute(corpus, t, 3, 5, 3, 4))
    assert len(want) > 100 and sorted((x.ctx, x["rank"], x.match, x.tokens) for x in out.collect()) == want
    assert "windowspecdefinition(key#" in out._jdf.queryExecution().optimizedPlan().toString()  # positions are cut once a key, before contexts join


def suffix(corpus, context, least, most, length):
    """The longest suffix by comparison at every place; the newest of equally long ones."""
    best = None
    for d, t in corpus.items():
        for end in range(least, len(t) + 1):
            n = 0
            while n < min(end, len(context)) and t[end - 1 - n] == context[len(context) - 1 - n]:
                n += 1
            if n >= least and len(context) >= least:
                best = max(best or (0, 0, 0), (min(n, most), d, end))
    return None if best is None or not corpus[best[1]][best[2] :] else (best[0], corpus[best[1]][best[2] : best[2] + length])


def test_longest_suffixes_are_those_of_a_search_by_every_context(spark):
    r = random.Random(6)
    corpus = {d: [r.randrange(3) for _ in range(r.randrange(25))] for d in range(40)}
    contexts = {c: [r.randrange(4) for _ in range(r.randrange(12))] for c in range(80)} | {100: corpus[7][:9], 101: corpus[8]}
    frames = [spark.createDataFrame(list(x.items()), f"{name} bigint, tokens array<int>") for name, x in (("doc", corpus), ("ctx", contexts))]
    for most in (4, 64):
        want = sorted((c, *found) for c, t in contexts.items() if (found := suffix(corpus, t, 2, most, 4)))
        out = drafting.longest_suffix(*frames, min_match=2, most=most, max_tokens=4)
        assert len(want) > 40 and sorted((x.ctx, x.match, x.tokens) for x in out.collect()) == want


def test_a_place_is_met_once_however_many_contexts_ask_for_it(spark):
    corpus = spark.createDataFrame([(d, [1, 2] * 50) for d in range(20)], "doc bigint, tokens array<int>")
    contexts = spark.createDataFrame([(c, [9, 1, 2]) for c in range(500)], "ctx bigint, tokens array<int>")
    out = drafting.longest_suffix(corpus, contexts)
    assert {(x.match, tuple(x.tokens)) for x in out.collect()} == set() and drafting._newest(corpus, contexts.withColumn("match", F.lit(2)), 2).count() == 500
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "max(struct(doc" in plan  # newest places are found by key, before contexts join
