import re

import numpy as np
import pytest

from quarry.llm import bit_sliced, bpe, html_wrappers, licenses, queries, token_counts, toxicity
from quarry.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def encoder():
    with open(tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f:
        return bpe.Encoder(f.read())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


TEXTS = ["", "Hello world", "ΟΔΟΣ Σ", "İstanbul", "a<|endoftext|>B <|startoftext|>", "x\x1cy z\x85w", "café é", "１２３ ⅷ ²", "日本語 한국", "🤗👩‍👩‍👧", "a" * 3000, "it's I'LL don't", "ab" * 900 + "!!", "\x00\x01 a", "<<a>"]


@pytest.mark.parametrize("text", TEXTS)
def test_bpe_equals_the_library(encoder, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    got = encoder.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == ids
    assert encoder.decode(got) == library.decode(ids, skip_special_tokens=False)


def test_forest_and_tree_merge_alike(encoder):
    words = ["tokenization", "x", "aaaaaaaaaa", "zzzzzzzz", "internationalisation", "éèê"]
    encoder.clear()
    encoder.learn(words)
    for w in words:
        assert np.frombuffer(encoder[w][0], "<u4").tolist() == encoder.merged(w)


def test_bpe_frame(frame, odd_rows, spark):
    out = bpe.encode(frame(odd_rows), tokenizer_path("word_bpe_49k.json"), texts=True)
    got = out.collect()
    assert len(got) == len(odd_rows) and {r.n_tokens for r in got if r.doc_id in (4, 5, 6)} == {0}
    back = {r.doc_id: r.decoded for r in bpe.decode(out, tokenizer_path("word_bpe_49k.json")).collect()}
    assert all(back[r.doc_id] == r.decoded for r in got)
    assert bpe.encode(frame([]), tokenizer_path("word_bpe_49k.json")).count() == 0


def test_license_places(frame, odd_rows):
    got = {r.doc_id: r for r in licenses.scan(frame(odd_rows)).collect()}
    r = got[10]
    assert r.base_labels == "apache-2,cc-by-nc,mit" and r.n_base == 3 and (r.first_word, r.last_word) == (4, 12) and r.score == 1.0
    assert got[4].n_words == 0 and got[4].labels == "" and got[5].first_word is None
    assert len(licenses.scan(frame(odd_rows)).collect()) == len(odd_rows)
    notice = "permission is hereby granted free of charge to any person obtaining a copy of software and documentation files today"
    far = " ".join(["z"] * 31) + " mit license"
    out = {r.doc_id: r for r in licenses.scan(frame([(1, notice, "en", "s", 0), (2, far, "en", "s", 0), (2, far, "en", "s", 0)])).collect()}
    assert out[1].labels == "mit" and out[1].base_labels == "" and 0.8 <= out[1].score < 1
    assert out[2].n_base == 1 and out[2].first_word == 31


def test_license_query_follows_the_phrases_of_its_contract(spark, tmp_path):
    texts = {1: "Under the MIT License and under the mit-license", 2: "MIT License", 3: "the mit license, apache license version 2", 4: "CC BY-NC by nc " + "z " * 29 + "under the mit license", 5: None}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {tuple(r) for r in queries.op3_license_scan(spark, str(tmp_path)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()}
    assert got == {(1, 9, 2, 0, 5, "mit"), (2, 2, 0, None, None, ""), (3, 7, 1, 3, 3, "apache-2"), (4, 38, 2, 0, 34, "cc-by-nc,mit"), (5, 0, 0, None, None, "")}


def test_license_templates_may_be_given(frame):
    notice = "You may copy this work, and you may change it, as long as you say so in plain words."
    text = "preface " * 40 + notice.upper().replace("PLAIN ", "") + " rest" * 20
    got = licenses.scan(frame([(1, text, "en", "s", 0), (2, "mit license", "en", "s", 0)]), notices=[("own", notice)]).collect()
    assert {(r.doc_id, r.labels) for r in got} == {(1, "own"), (2, "mit")}
    with pytest.raises(ValueError):
        licenses.templates(notices=[("x", "a b c " * 30)] * 1000)


def test_long_license_templates_are_matched_whole(frame):
    words = [f"w{i}" for i in range(100)]
    far = ["z"] * 90
    texts = {1: words[:32], 2: words[20:], 3: far + words[20:] + far, 4: words[21:], 5: far[:77] + words, 6: words[::-1], 7: words[:50] + far + far + words[50:]}
    rows = [(i, " ".join(t), "en", "s", 0) for i, t in texts.items()] + [(8, " ".join(f"w{i}" for i in range(20, 40)), "en", "s", 0)]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(frame(rows), notices=[("long", " ".join(words)), ("short", " ".join(words[20:40]))]).collect()}
    # Blocks of the long template hold 256 words and start every 128: brute force over them, as over those of 64 words.
    share = lambda t, w, step: max(len(set(w) & set(t[k : k + 2 * step])) / len(w) for k in range(0, len(t), step))
    for i, t in (*texts.items(), (8, words[20:40])):
        scores = {"long": share(t, words, 128), "short": share(t, words[20:40], 32)}
        found = sorted(k for k, s in scores.items() if s >= 0.8)
        assert got[i] == (",".join(found), max([0.0, *[scores[k] for k in found]])), i
    assert got[1] == ("", 0.0) and got[2] == ("long,short", 1.0) and got[4][0] == "short" and got[5][0] == "long,short" and got[6][0] == "long,short"


@pytest.mark.parametrize("spread", [3, 400])
def test_top_k_with_ties(spark, spread):
    r = np.random.default_rng(1)
    values = r.integers(-spread, spread + 1, (900, 6))
    values[100:300] = values[100]
    index = bit_sliced.BitSlices(values)
    ids = np.arange(900) * 3
    for i, found, score in index.top(values[:20], ids, ids[:20], 10):
        exact = values @ values[i]
        others = np.flatnonzero(ids != ids[i])
        want = others[np.lexsort((ids[others], -exact[others]))[:10]]
        assert found.tolist() == ids[want].tolist() and score.tolist() == exact[want].tolist()


def test_top_k_frame(spark):
    rows = [(0, [0.5, 0.25]), (1, [0.1, float("nan")]), (2, None), (3, [0.2, None]), (100, [-0.3, 0.9]), (5, [0.5, 0.25]), (6, []), (7, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = bit_sliced.top_k(df.where("vec_id % 100 = 0"), df, 10).collect()
    assert {(r.query_id, r.rank, r.vec_id) for r in got} == {(0, 1, 5), (0, 2, 7), (0, 3, 100), (100, 1, 7), (100, 2, 0), (100, 3, 5)}
    empty = df.limit(0)
    assert bit_sliced.top_k(empty, empty).count() == 0


def test_top_k_of_clashing_repeated_and_uneven_rows(spark):
    r = np.random.default_rng(9)
    rows = [(int(i), [float(x) for x in r.normal(size=5)]) for i in range(700)] + [(int(i), [float(x) for x in r.normal(size=3)]) for i in range(700, 760)]
    rows += [rows[3]] * 4 + [(800, [1e300, -1e300, 0.0, 1.0, 2.0]), (900, [9e99] * 5)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for c in ("id", "v", "dim", "block", "rank", "score"):
        df = df.selectExpr("*", f"'x' AS {c}")
    most = bit_sliced.MOST_VALUE
    whole = [(i, np.clip(np.floor(np.array(v) * 1024), -most, most).astype(np.int64)) for i, v in rows]
    queries = {i: v for i, v in whole if i % 100 == 0}
    want = set()
    for i, q in queries.items():
        held = sorted(((-sum(int(a) * int(b) for a, b in zip(v, q)), j) for j, v in whole if j != i and len(v) == len(q)))[:10]
        want |= {(i, n + 1, j, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, j) in enumerate(held)}
    for limit in (1 << 26, 0):
        got = bit_sliced.top_k(df.where("vec_id % 100 = 0"), df, 10, broadcast_bytes=limit).collect()
        assert {tuple(x) for x in got} == want


def test_top_k_of_large_components(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [70000.0]), (2, [100000.0]), (3, [-9e9]), (100, [-2.5e9]), (5, [2.0**46]), (6, [2.0**46 + 1])], "vec_id bigint, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in bit_sliced.top_k(df.where("vec_id % 100 = 0"), df, 10).collect()}
    assert got[0, 3] == (2, 104857600000) and got[0, 4] == (1, 73400320000) and got[0, 1] == (6, (1 << 63) - 1) and got[0, 2] == (5, (1 << 63) - 1)
    # The true scores decide, also where two of them do not fit 64 bits.
    assert [got[100, k] for k in (1, 2)] == [(3, (1 << 63) - 1), (0, -2560000000000 * 1024)] and [got[100, k][0] for k in (5, 6)] == [5, 6]


@pytest.mark.parametrize("size", [1 << 20, 1 << 31, 1 << 45])
def test_wide_sums_are_exact(size):
    r = np.random.default_rng(size % 97)
    values = r.integers(-size, size + 1, (300, 5))
    values[50:90] = values[50]
    index, ids = bit_sliced.BitSlices(values), np.arange(300)
    reopened = bit_sliced.BitSlices.opened(values, *index.packed())
    assert index.wide(values[:12]) == (size > 1 << 29)
    for held in (index, reopened):
        for i, found, score in held.top(values[:12], ids, ids[:12], 10):
            exact = [sum(int(a) * int(b) for a, b in zip(v, values[i])) for v in values]
            want = sorted((n for n in range(300) if n != i), key=lambda n: (-exact[n], n))[:10]
            assert found.tolist() == want and [int(s) for s in score] == [exact[n] for n in want]
            high, low = bit_sliced._limbs(score)
            assert [int(h) * (1 << 64) + int(x) + (1 << 63) for h, x in zip(high, low)] == [exact[n] for n in want]


def test_an_index_serves_many_query_sets(spark, tmp_path):
    r = np.random.default_rng(2)
    df = spark.createDataFrame([(i, [float(x) for x in r.normal(size=4)]) for i in range(300)], "vec_id bigint, embedding array<double>")
    index = bit_sliced.build(df, f"file://{tmp_path}")
    for part in ("vec_id < 5", "vec_id = 77"):
        got = bit_sliced.search(index, df.where(part), f"file://{tmp_path}/q", 3).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, bit_sliced.top_k(df.where(part), df, 3).collect()))


def test_toxicity_learns_and_locates(frame, odd_rows, spark):
    r = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(400):
        sentences = [" ".join(f"w{r.integers(300)}" for _ in range(8)) for _ in range(5)]
        bad = i % 4 == 0
        if bad:
            sentences[int(r.integers(5))] += " you idiot" + "xyz"[i % 3]
        rows.append((i, ". ".join(sentences) + ".", "en", "s", 0))
        labels.append((i, int(bad)))
    known = spark.createDataFrame([x for x in labels if x[0] % 2] + [x for x in labels if not x[0] % 2][:100] + [(None, 1), (7, None)], "doc_id bigint, toxic int")
    model = toxicity.train(frame(rows), known)
    score = {x.doc_id: x.score for x in toxicity.score(frame(rows), model).collect()}
    assert all((score[i] >= 0.7) == bool(y) for i, y in labels)
    found = toxicity.locate(frame(rows), model).collect()
    assert found and all("idiot" in x.sentence for x in found)
    odd = toxicity.score(frame(odd_rows), model).collect()
    assert len(odd) == len(odd_rows) and all(0 <= x.score <= 1 for x in odd) and {x.score for x in odd if x.doc_id in (4, 5, 6)} == {0.0}
    assert toxicity.train(frame([]), known.limit(0)).weights.size == 0


def test_a_document_is_the_noisy_or_of_its_sentences():
    r = np.random.default_rng(4)
    texts = [". ".join(" ".join(f"w{r.integers(40)}" for _ in range(5)) for _ in range(r.integers(1, 6))) + "! " for _ in range(120)]
    model = toxicity.fit(texts, [int("w7" in t.split() or "w9" in t.split()) for t in texts], rounds=40)
    assert len(model.keys)
    import pyarrow as pa

    for text in texts[:40] + ["", "?!", "w7"]:
        parts = [p for p in re.split(r"[.!?\n]", text) if re.search(r"[A-Za-z0-9]", p)]
        single = []
        for p in parts:
            data = np.frombuffer(p.encode(), np.uint8)
            keys = set(toxicity.sentence_features(data, np.array([0, len(data)]))[0].tolist())
            z = model.bias + sum(w for k, w in zip(model.keys.tolist(), model.weights) if k in keys)
            single.append(1 / (1 + np.exp(-z)))
        want = 1 - np.prod([1 - p for p in single])
        assert abs(toxicity.document_scores(model, pa.array([text]))[0] - want) < 1e-9


def test_repeated_rows_teach_once(frame, spark):
    rows = [(i, f"clean words here {i % 7}" if i % 3 else f"you idiot {i % 5}", "en", "s", 0) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id bigint, toxic int")
    once, often = toxicity.train(frame(rows), labels), toxicity.train(frame(rows + rows[:30] * 20), labels)
    assert np.array_equal(once.keys, often.keys) and np.allclose(once.weights, often.weights)


RANKS = tokenizer_path("byte_bpe_50k.tiktoken")


def test_token_counts_across_blocks(frame, odd_rows, monkeypatch):
    with open(RANKS, "rb") as f:
        enc = token_counts._encoding(f.read())
    low = lambda x: (x[0] is None, x)
    want = sorted(((None if r[0] is None else str(r[0]), len(enc.encode_ordinary(r[1] or ""))) for r in odd_rows), key=low)
    for size, run in ((6, 3), (1000, 1024), (1 << 20, 1)):
        monkeypatch.setattr(token_counts, "RUN", run)
        rows = odd_rows[:8] + odd_rows[9:10] if size == 6 else odd_rows  # long texts make too many blocks of 6 bytes
        blocks = token_counts.flat_blocks(frame(rows), RANKS, block_bytes=size)
        got = sorted(((r.name, r.n_tokens) for r in token_counts.count(blocks).collect()), key=low)
        assert got == [x for x in want if x[0] in {None if r[0] is None else str(r[0]) for r in rows}]


def test_documents_are_counted_from_files(frame, odd_rows, monkeypatch):
    with open(RANKS, "rb") as f:
        enc = token_counts._encoding(f.read())
    low = lambda x: (x[0] is None, x)
    for size in (400, 1 << 24):
        monkeypatch.setattr(token_counts, "FILE_BYTES", size)
        got = token_counts.document_counts(frame(odd_rows).repartition(3), RANKS)
        assert got.schema["doc_id"].dataType.simpleString() == "bigint"
        want = sorted(((r[0], len(enc.encode_ordinary(r[1] or ""))) for r in odd_rows), key=low)
        assert sorted(((r.doc_id, r.n_tokens) for r in got.collect()), key=low) == want
    assert token_counts.document_counts(frame([]), RANKS).count() == 0


def test_token_files(spark, tmp_path):
    np.array([9, 1, 2, 9, 9, 3, 9, 4, 5], "<u4").tofile(tmp_path / "a.bin")
    (tmp_path / "b.bin").write_bytes(b"")
    for size in (4, 8, 1 << 20):
        for whole in (1 << 20, 8):  # as one row, or by ranges
            blocks = token_counts.read_files(spark, f"file://{tmp_path}", size, width=4, whole_bytes=whole)
            rows = token_counts.count(blocks, eod=9, dtype="<u4").orderBy("doc_no").collect()
            assert [r.n_tokens for r in rows] == [0, 2, 0, 1, 2]
    # An odd byte at the end is left out, and a prime number of ids makes no more blocks than any other.
    (tmp_path / "c.bin").write_bytes(np.array([9, 7] * 5 + [8], "<u4").tobytes() + b"x")
    for whole in (1 << 20, 8):
        blocks = token_counts.read_files(spark, f"file://{tmp_path}", 12, width=4, whole_bytes=whole)
        assert blocks.where("file like '%c.bin'").agg({"block": "max"}).first()[0] == 3
        rows = token_counts.count(blocks, eod=9, dtype="<u4").where("file like '%c.bin'").orderBy("doc_no").collect()
        assert [r.n_tokens for r in rows] == [0, 1, 1, 1, 1, 2]


PAGE = '<html><head><title>t</title><script>var x = "</p><nav>";</script></head><body><header>Site</header><nav><ul><li>Home<li>News</ul></nav><div class="sidebar">side</div><article><h1>T &amp; {0}</h1><p>a<b>b</b> c{0}<p>d&nbsp;e<br>f<div class="comments"><p>no</p></div><form>f</form></article><div class="cookie-notice">z</div><footer>foot</footer></body></html>'


def test_html_wrappers(spark):
    pages = [(i, f"http://h{i % 2}.example.org/{i}", PAGE.format(i)) for i in range(8)] + [(20, None, None), (21, "http://h0.example.org/x", ""), (22, "x", "plain   text"), (23, "http://y/", "<p>one<p>two<!-- open <p>three")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumnRenamed("page_id", "page_id")
    for limit in (1 << 26, 0):  # wrappers broadcast, wrappers joined
        got = {r.page_id: r for r in html_wrappers.extract(df, broadcast_bytes=limit).collect()}
        assert len(got) == len(pages)
        assert got[3].text == "T & 3\nab c3\nd e f" and got[3].n_chars == len(got[3].text)
        assert got[20].text == got[21].text == "" and got[22].text == "plain text" and got[23].text == "one\ntwo"
    assert html_wrappers.extract(df.limit(0)).count() == 0


def test_wrappers_fold_repeats_and_options():
    w = html_wrappers.expression("<ul><li>a<li>b<li>c</ul><dl><dt>x<dd>y<dt>z<dd>w</dl>")
    assert [i[0] for i in w[3]] == ["ul", "dl"] and w[3][0][3][0][:3] == ["li", 0, 1] and w[3][1][3][0][0] == "()"
    m = html_wrappers.merge(w, html_wrappers.expression("<ul><li>a</ul><p>new</p><dl><dt>x<dd>y</dl>"))
    assert [(i[0], i[1]) for i in m[3]] == [("ul", 0), ("p", 1), ("dl", 0)]
    assert re.match(r"html", html_wrappers._label("html", ""))
