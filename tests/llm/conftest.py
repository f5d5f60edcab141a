import pytest

CLASH = ["n_words", "size", "packet", "block", "score", "_row"]


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with odd rows: nulls, empty, blank, short, long, repeated, clashing extra columns."""

    def make(rows, extra=True):
        df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
        if extra:
            from pyspark.sql import functions as F

            for c in CLASH:
                df = df.withColumn(c, F.lit("x"))
        return df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    words = [f"w{i}" for i in range(60)]
    passage = " ".join(words)
    return [
        (1, passage, "en", "a", 1),
        (2, passage, "en", "a", 1),
        (2, passage, "en", "a", 1),
        (3, "Before it " + passage + " after it", None, "b", 1),
        (4, None, "en", None, None),
        (5, "", "en", None, 0),
        (6, " \n\t ", "en", "b", 3),
        (7, "one two", "en", "b", 7),
        (8, "ONE two", "en", "b", 7),
        (None, "no id here at all my friend", "en", "c", 5),
        (9, "x" * 100_000, "en", "c", 100_000),
        (10, "é ü ß <|endoftext|> MIT License and Apache License, Version 2.0 CC BY-NC", "de", "c", 9),
        (11, " ".join(f"v{i % 977} u{i}" for i in range(30_000)), "en", "c", 1),
    ]
