"""Inverted lists against brute force."""

import numpy as np
import pytest
from quarry import catalog
from quarry.operators import dense


@pytest.fixture(scope="module")
def vectors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").cache()


def best(pdf, query, k=10):
    score = np.round(np.array(pdf.embedding.tolist(), float) @ np.array(query, float), 6)
    return set(pdf.vec_id.to_numpy()[np.lexsort((pdf.vec_id, -score))[:k]])


def test_recall_of_the_benchmark_queries(vectors):
    pdf = vectors.toPandas()
    centres = dense.fit_centres(vectors, 8, "embedding", "vec_id")
    lists = dense.inverted_lists(vectors, centres, "embedding")
    recall = []
    for q in pdf[pdf.vec_id % 100 == 0].sort_values("vec_id").embedding:
        got = {r.vec_id for r in dense.probe_until_sure(lists, centres, list(q), 3, 10, "embedding", "vec_id").collect()}
        recall.append(len(got & best(pdf, q)) / 10)
    assert np.mean(recall) >= 0.9


def test_query_finds_the_nearest(spark, sf_dir, vectors):
    pdf = vectors.toPandas().sort_values("vec_id")
    got = {r.vec_id for r in catalog.QUERIES["t6_ivf_probe"](spark, sf_dir).collect()}
    assert len(got & best(pdf, pdf.embedding.iloc[0])) >= 9


def test_copies_and_clusters_give_lists_that_are_skipped(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(50)] + [(50 + i, (np.eye(3)[i % 3] + rng.normal(0, 0.01, 3)).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    centres = dense.fit_centres(df, 3, "embedding", "vec_id")
    lists = dense.inverted_lists(df, centres, "embedding")
    assert len({r.cell for r in lists.collect()}) == 3
    found = dense.probe_until_sure(lists, centres, [0.0, 1.0, 0.0], 1, 5, "embedding", "vec_id")
    assert {r.vec_id for r in found.collect()} == best(df.toPandas(), [0.0, 1.0, 0.0], 5)
