"""Every registered query and pipeline stage on small tables, against its SQL or brute force."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from test_pairs import WORD, components, near_copies, removed
from test_quality_mixing import brute, served_by_hand

import corpus_pipeline
from quarry.llm import queries, token_counts

ARTICLE = "<html><body><nav>Menu</nav><article><h1>Title {0}</h1><p>First {0} of text &amp; more.</p><p>Second   paragraph {0}.</p></article><footer>Foot</footer></body></html>"


@pytest.fixture(scope="module")
def rows(odd_rows):
    toxic = [(2000 + i, f"you are a worthless idiot number {i}. the weather was fine today in the town." if i % 2 else f"we walked along the river bank number {i}. the weather was fine today in the town.", "en", "t", 0) for i in range(120)]
    return [r for r in odd_rows if r[0] is not None] + near_copies() + toxic + [*[(3002, "Under the MIT License and the MIT License again, with words to fill the line", "en", "b", 0)] * 2, (3000, "same words again " * 30, "en", None, 0), (3001, "LOUD WORDS ARE SPOKEN HERE BY EVERYONE IN THE WHOLE ROOM TODAY", "en", "b", 0)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    """One folder of tables: documents with odd rows, labels, pages and vectors with ties and holes."""
    path = tmp_path_factory.mktemp("tables")
    r = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in r.integers(-3, 4, 6) / 4]) for i in range(430)] + [(430, None), (431, [float("nan")] * 6), (432, [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    frames = {
        "documents": spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"),
        "labels": spark.createDataFrame([(i, int("idiot" in t), 0) for i, t, *_ in rows if 2000 <= i < 3000], "doc_id bigint, toxic int, spam int"),
        "pages": spark.createDataFrame([(i, f"https://h{i % 2}.org/{i}", ARTICLE.format(f"n{i}")) for i in range(12)] + [(12, None, ""), (13, "x", None)], "page_id bigint, url string, html string"),
        "embeddings": spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>"),
        "conversations": spark.createDataFrame([(i // 5, i % 5, "user", f"t{i}") for i in range(400)] + [(77, k, "user", None) for k in range(150)] + [(3, 1, None, ""), (3, 1, "user", ""), (None, 2, "user", "x"), (4, None, "user", "x")], "conv_id bigint, turn bigint, role string, text string"),
    }
    for name, df in frames.items():
        df.coalesce(2).write.parquet(f"file://{path}/{name}.parquet")
    return str(path)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    names = sorted(c[0] for c in want.description)
    at = [[c[0] for c in want.description].index(n) for n in names]
    got = queries.QUERIES[name](spark, folder).select(*names).collect()
    plain = lambda x: round(x, 6) if isinstance(x, float) else x
    assert Counter(tuple(map(plain, r)) for r in got) == Counter(tuple(plain(r[k]) for k in at) for r in want.fetchall())


def test_toxicity_query(spark, folder, rows):
    got = queries.QUERIES["op1_toxicity"](spark, folder).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    score = {r.doc_id: r.score for r in got if r.held_out and 2000 <= r.doc_id < 3000}
    assert min(s for i, s in score.items() if i % 2) >= 0.7 > max(s for i, s in score.items() if i % 2 == 0)


def test_join_query(spark, folder, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op6_ngram_join"](spark, folder).collect()}
    assert got == components(rows)


def test_dedup_query(spark, folder, rows):
    got = queries.QUERIES["op7_substring_dedup"](spark, folder).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == removed(rows)


def test_token_count_query(spark, folder, rows):
    with open(queries.tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as f:
        library = token_counts._encoding(f.read())
    got = queries.QUERIES["op8_token_counts"](spark, folder).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((i, len(library.encode_ordinary(t or ""))) for i, t, *_ in rows)


def digests(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    out = Counter()
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        out[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    return out


def test_bpe_query(spark, folder, rows):
    got = queries.QUERIES["op9_bpe"](spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert Counter(map(tuple, got)) == digests(rows)


def test_html_query(spark, folder):
    got = {r.page_id: (r.text, r.n_chars) for r in queries.QUERIES["op10_html_text"](spark, folder).collect()}
    for i in range(12):
        text = f"Title n{i}\nFirst n{i} of text & more.\nSecond paragraph n{i}."
        assert got[i] == (text, len(text))
    assert got[12] == got[13] == ("", 0)


def good(text):
    """The policy ``v1`` by its rules."""
    words, chars, symbols, _, repeats = brute(text)
    upper = len(re.findall("[A-ZÀ-ÖØ-Þ]", text or ""))
    return words >= 10 and 100 * repeats <= 20 * words and 100 * symbols <= 25 * words and 100 * upper <= 50 * chars


def one_of_each(rows):
    """The smallest id of each component, one row of each id and text, ids as pairs of id and text."""
    keys = sorted({(r[0], r[1]) for r in rows}, key=lambda k: (k[0], k[1] or ""))
    groups = components([(n, t) for n, (_, t) in enumerate(keys)])
    keep = {keys[n] for n, (_, first) in groups.items() if n == first}
    return [r for k, r in {(r[0], r[1]): r for r in rows}.items() if k in keep]


def without_passages(rows):
    docs = [WORD.findall(t or "") for _, t, *_ in rows]
    count = Counter(tuple(w[k : k + 35]) for w in docs for k in range(len(w) - 34))
    out = []
    for (i, t, lang, source, n), w in zip(rows, docs):
        gone = {p for k in range(len(w) - 34) if count[tuple(w[k : k + 35])] > 1 for p in range(k, k + 35)}
        text = " ".join(x for p, x in enumerate(w) if p not in gone) if gone else t
        out.append((i, text, lang, source, len(text) if gone else n))
    return out


def test_every_stage_and_the_run(spark, folder, rows, frame):
    stages = dict(corpus_pipeline.STAGES)
    made = lambda rows: frame(rows, extra=False).repartition(3)
    plain = lambda df: Counter(map(tuple, df.collect()))
    rows = [*rows, *rows[:2]]
    first = [r for r in rows if good(r[1])]
    assert 0 < len(first) < len(rows) and plain(stages["quality_rules"](spark, made(rows), folder)) == Counter(first)
    second = one_of_each(first)
    assert len(second) < len(first) and plain(stages["near_copies"](spark, made(first), folder)) == Counter(second)
    third = without_passages(second)
    assert third != second and plain(stages["repeated_passages"](spark, made(second), folder)) == Counter(third)
    taken, order = served_by_hand(third, "documents")
    by_id = {r[0]: r for r in third}
    fourth = [by_id[i] for i in order]
    mixed = stages["mixture"](spark, made(third), folder)
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars"] and [tuple(r) for r in mixed.collect()] == fourth
    fifth = digests(fourth)
    select = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert plain(stages["tokens"](spark, made(fourth), folder).select(*select)) == fifth
    table = duckdb.connect().execute(f"SELECT doc_id, text, lang, source, n_chars FROM '{folder}/documents.parquet/*.parquet'").fetchall()
    third = without_passages(one_of_each([r for r in table if good(r[1])]))
    by_id = {r[0]: r for r in third}
    assert plain(corpus_pipeline.run(spark, folder).select(*select)) == digests([by_id[i] for i in served_by_hand(third, "documents")[1]])


def test_stages_of_an_empty_table(spark, frame):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame([], extra=False), "").count() == 0, name
