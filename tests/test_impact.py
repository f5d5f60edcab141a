"""The kept lexical view against scores worked out by hand, and how much of it a search opens."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.operators import impact, sparse


def by_hand(docs, queries, k):
    """query, id, score rounded, rank: min(k, n) rows a query."""
    n, mean = len(docs), sum(len(d) for d in docs.values()) / max(len(docs), 1)
    df = Counter(t for d in docs.values() for t in set(d))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = 0.25 * sum(idf.values()) / max(len(idf), 1)
    idf = {t: floor if x < 0 else x for t, x in idf.items()}
    out = []
    for q, asked in queries.items():
        scores = {}
        for i, d in docs.items():
            tf = Counter(d)
            scores[i] = sum(math.floor(times * idf[t] * (tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(d) / mean))) * impact.UNIT + 0.5) for t, times in Counter(asked).items() if t in tf)
        best = sorted(scores, key=lambda i: (-scores[i], i))[:k]
        out += [(q, i, round(scores[i] / impact.UNIT, 6), r + 1) for r, i in enumerate(best)]
    return Counter(out)


def corpus(seed, n=300):
    r = random.Random(seed)
    word = lambda: f"t{int(r.paretovariate(0.7)) % 60}"
    docs = {i: [word() for _ in range(r.randrange(0, 40))] for i in range(n)}
    docs |= {n + i: docs[3] for i in range(20)} | {n + 20: []}
    queries = {q: [word() for _ in range(r.randrange(1, 9))] for q in range(25)} | {90: ["nowhere"], 91: [], 92: ["t1"], 93: ["t1", "t1", "t59"]}
    return docs, queries


def frames(spark, docs, queries):
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()], "key bigint, body string").repartition(3)
    return d, spark.createDataFrame([(q, " ".join(t)) for q, t in queries.items()], "question bigint, asked string")


WORDS = lambda c: F.filter(F.split(F.col(c), " "), lambda t: t != "")


@pytest.mark.parametrize("k", [1, 10, 400])
def test_search_of_a_kept_view(spark, tmp_path, monkeypatch, k):
    monkeypatch.setattr(impact, "SHARD", 64)
    monkeypatch.setattr(impact, "QUERIES_AT_ONCE", 10)
    docs, queries = corpus(k)
    d, q = frames(spark, docs, queries)
    view = impact.build(d, "key", WORDS("body"), f"file://{tmp_path}")
    assert view.shards == 6
    want = by_hand(docs, queries, k)
    for held in (view, impact.load(spark, f"file://{tmp_path}")):
        got = impact.search(held, q, "question", k, WORDS("asked")).select("query_id", "id", "score", "rank")
        assert Counter(map(tuple, got.collect())) == want
    scan = sparse.bm25(d, q, "key", "question", k, WORDS("body"), WORDS("asked")).select("query_id", "id", "score", "rank")
    assert Counter(map(tuple, scan.collect())) == want


def test_tiny_corpora(spark, tmp_path):
    for n, docs in enumerate(({1: ["a", "b"], 2: ["a"], 3: ["c"]}, {1: ["a"], 2: ["a"]}, {5: []}, {})):
        d, q = frames(spark, docs, {1: ["a"], 2: ["zz"]})
        view = impact.build(d, "key", WORDS("body"), f"file://{tmp_path}/{n}")
        got = impact.search(view, q, "question", 3, WORDS("asked")).select("query_id", "id", "score", "rank")
        assert Counter(map(tuple, got.collect())) == by_hand(docs, {1: ["a"], 2: ["zz"]}, 3)


def test_no_text_is_read(spark, tmp_path):
    docs, queries = corpus(2)
    d, q = frames(spark, docs, queries)
    view = impact.build(d, "key", WORDS("body"), f"file://{tmp_path}")
    plan = impact.search(view, q, "question", 5, WORDS("asked"))._jdf.queryExecution().executedPlan().toString()
    assert "body" not in plan and "PartitionFilters" in plan


def test_a_shard_skips_what_cannot_matter():
    """A rare term decides; the frequent one's blocks are looked into for a few documents only."""
    rare, often = np.arange(20), np.arange(5000)
    rows = [("rare", 7, rare, np.linspace(2.0, 2.4, 20)), ("often", 3, often, np.full(5000, 1.0)), ("often", 1, often + 5000, np.full(5000, 0.5))]
    table = pa.table([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2].tolist() for r in rows], pa.list_(pa.int64())), pa.array([r[3].tolist() for r in rows], pa.list_(pa.float64()))], ["term", "level", "ids", "shares"])
    shard = impact.Shard(table)
    places, units = shard.best([("rare", 9.0), ("often", 0.1)], 5)
    ids = shard.documents.take(pa.array(places)).to_pylist()
    assert sorted(ids) == [15, 16, 17, 18, 19]
    assert dict(zip(ids, units.tolist()))[19] == int(np.floor(9 * 2.4 * impact.UNIT + 0.5)) + int(np.floor(0.1 * 1.0 * impact.UNIT + 0.5))
    everyone, _ = shard.best([("rare", 9.0), ("often", 0.1)], None)
    assert len(everyone) == 10000


def test_long_texts_make_more_shards_and_no_posting_is_shuffled(spark, tmp_path, monkeypatch):
    """Shards are bounded by tokens too, and what the building shuffles is texts: a row a document, not a row a posting."""
    monkeypatch.setattr(impact, "TOKENS", 2000)
    r = random.Random(7)
    docs = {i: [f"w{r.randrange(700)}" for _ in range(500)] for i in range(40)}
    queries = {1: ["w3", "w5"], 2: ["w690", "w690", "w2"]}
    d, q = frames(spark, docs, queries)
    store = spark._jsc.sc().statusStore()
    view = impact.build(d, "key", WORDS("body"), f"file://{tmp_path}")
    none = spark._jvm.java.util.ArrayList()
    stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
    texts = [stages.apply(i) for i in range(stages.size()) if stages.apply(i).shuffleWriteRecords() == len(docs)]
    assert view.shards == 10 and texts
    got = impact.search(view, q, "question", 5, WORDS("asked")).select("query_id", "id", "score", "rank")
    assert Counter(map(tuple, got.collect())) == by_hand(docs, queries, 5)


def test_blocks_do_not_depend_on_how_tokens_come(monkeypatch):
    """Long batches are counted in stretches; a posting's term, share and place stay the same."""
    r = random.Random(5)
    tokens = [[f"w{r.randrange(30)}" for _ in range(r.randrange(0, 60))] for _ in range(50)]
    ids = r.sample(range(1000), 50)
    table = pa.table([pa.array(ids), pa.array(tokens, pa.list_(pa.string())), pa.array([4] * 50, pa.int32())], ["id", "tokens", "shard"])
    whole = impact._blocked(table, 30.0)
    counted = impact._counted
    monkeypatch.setattr(impact, "_counted", lambda batch: counted(batch, 100))
    parts = impact._blocked(pa.Table.from_batches(table.to_batches(max_chunksize=7)), 30.0)
    key = [("term", "ascending"), ("level", "ascending")]
    assert whole.sort_by(key).equals(parts.sort_by(key)) and sum(whole.column("n").to_pylist()) == sum(len(set(t)) for t in tokens)
    assert all(x == sorted(x) for x in whole.column("ids").to_pylist())
