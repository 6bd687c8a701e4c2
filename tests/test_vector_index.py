"""The index of lists against the exact search: recall, parts of large lists, and queries that are rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from procaudit.operators import tfidf as I
from procaudit.operators import vector_index as X


def frame(spark, v):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v.astype("float32"))], "id long, v array<float>").repartition(3)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    return np.concatenate([centres[rng.integers(0, 40, 1500)] + 0.4 * rng.normal(size=(1500, 16)), rng.normal(size=(100, 16))])


def test_recall_and_exact_scores(spark, vectors):
    df = frame(spark, vectors)
    index = X.build_index(df)
    assert index.rows.count() == len(vectors) and len(index.centroids) == 40 and 1 <= index.probes < 40
    queries = df.where("id % 20 = 0")
    found = {r["q_id"]: (r["id"], r["score"]) for r in index.search(queries).collect()}
    exact = {r["q_id"]: (r["id"], r["score"]) for r in I.nn_embeddings(queries, df).collect()}
    assert set(found) == set(exact) == set(range(0, len(vectors), 20))
    assert np.mean([found[q] == exact[q] for q in exact]) >= 0.9
    u = X.unit(vectors.astype("float32"))
    assert all(q != i and abs(s - u[q] @ u[i]) < 1e-9 and s <= exact[q][1] for q, (i, s) in found.items())


def test_all_lists_make_the_search_exact(spark, vectors, monkeypatch):
    """With large lists in several parts, and a list that holds a third of all rows."""
    monkeypatch.setattr(I, "BLOCK_ROWS", 100)
    v = vectors.copy()
    v[::3] = v[0]
    df = frame(spark, v)
    index = X.build_index(df, lists=9)
    index.probes = 9
    assert index.rows.groupBy("list").count().agg(F.max("count")).first()[0] > 500
    queries = df.where("id % 50 = 0")
    assert sorted(map(tuple, index.search(queries).collect())) == sorted(map(tuple, I.nn_embeddings(queries, df).collect()))


def test_small_and_empty_tables(spark):
    one = frame(spark, np.ones((1, 4)))
    assert X.build_index(one).search(one).count() == 0
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (None, [1.0, 1.0])], "id long, v array<float>")
    assert [tuple(r) for r in X.build_index(two).search(two.where("id = 2")).collect()] == [(2, 1, 1.0)]
    with pytest.raises(ValueError):
        X.build_index(one.limit(0))


def test_what_is_found_meets_the_table_it_comes_from(spark, vectors):
    """joined with the exact search over the same table, the index lost the column id in its tasks."""
    df = frame(spark, vectors).withColumnRenamed("id", "n").select(F.col("n").alias("id"), "v")
    index = X.build_index(df)
    exact = I.nn_embeddings(df.where("id % 20 = 0"), df).select("q_id", F.col("score").alias("best"))
    rows = exact.join(index.search(df.where("id % 20 = 0")), "q_id", "left").collect()
    assert len(rows) == 80 and all(r["score"] <= r["best"] for r in rows)
