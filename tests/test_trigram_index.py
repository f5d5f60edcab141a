"""The kept trigram index against plain Python; texts are cut once."""

from pyspark.sql import functions as F

from quarry.operators import sparse


def test_kept_index_equals_plain_python_and_cuts_texts_once(spark, tmp_path, monkeypatch):
    texts = ["abcabc", "", "ab", None, "ABC\ndef", "a\U0001f600b\U0001f600b", "Straße éàü", "abc" * 50, *[f"text {n} of many" for n in range(60)]]
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(t):
        made.add(1)
        return t

    docs = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string").coalesce(3)
    rows = sparse.keep_trigrams(docs, "id", read("t"), str(tmp_path / "index")).collect()
    want = {(t.lower()[i : i + 3], n) for n, t in enumerate(texts) if t for i in range(len(t) - 2)}
    assert len(rows) == len(want) and {(r.gram, r.id) for r in rows} == want
    assert made.value <= len(texts)


def test_stretches_of_texts_give_the_same_grams():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([5, 6, 7, 8]), pa.array(["abcd", None, "bcde", "xabc"])], ["id", "text"])
    for most in (1, 6, 100):
        got = sorted((g, i) for b in sparse._listed(iter([batch]), most) for g, ids in zip(*[c.to_pylist() for c in b.columns]) for i in ids)
        assert got == [("abc", 5), ("abc", 8), ("bcd", 5), ("bcd", 7), ("cde", 7), ("xab", 8)]
