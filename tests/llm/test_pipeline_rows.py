"""Rows of the pipeline with repeated or null ids, and texts that lose nothing."""

from collections import Counter

import corpus_pipeline

ONE, TWO, THREE = (" ".join(f"{w}{i}" for i in range(80)) for w in "abc")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def made(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def test_near_copies_know_rows_by_id_and_text(spark):
    rows = [(1, ONE), (2, ONE + " end"), (2, TWO), (2, TWO), (3, THREE), (3, "short"), (None, TWO), (None, "tiny"), (None, "tiny"), (None, ""), (None, ""), (5, None), (5, None)]
    got = corpus_pipeline.near_copies(spark, made(spark, rows), "")
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = [(1, ONE), (2, TWO), (3, THREE), (3, "short"), (None, "tiny"), (None, ""), (None, ""), (5, None)]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(want)


def test_copies_without_id_stay_once(spark):
    got = corpus_pipeline.near_copies(spark, made(spark, [(None, ONE), (None, ONE), (None, ONE + " end"), (-4, TWO)]), "").collect()
    assert len(got) == 2 and {r.doc_id for r in got} == {None, -4}


def test_texts_that_lose_no_word_stay_as_they_are(spark):
    rows = [(1, "two  lines\n\tof text\n"), (2, None), (3, ""), (4, "x " + ONE + "\n y"), (5, "z\n" + ONE)]
    got = {r.doc_id: r for r in corpus_pipeline.repeated_passages(spark, made(spark, rows), "").collect()}
    assert [got[i].text for i in (1, 2, 3)] == [t for _, t in rows[:3]] and got[1].n_chars == len(rows[0][1])
    assert [got[i].text for i in (4, 5)] == ["x y", "z"] and got[4].n_chars == 3
