"""Vector search against all cosines, in groups and blocks of any size; reranking by given scores."""

import numpy as np
import pytest

from ravelin.operators import retrieval


@pytest.mark.parametrize("group_rows", [1, 40, 1 << 17])
def test_nearest_is_that_of_all_cosines(spark, monkeypatch, group_rows):
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    r = np.random.default_rng(group_rows)
    x = r.standard_normal((150, 6)).astype(np.float32)
    x[100:140] = x[5]  # ties
    x[7] = 0
    rows = [(i, [float(v) for v in x[i]]) for i in range(150)] + [(None, [1.0] * 6), (900, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {(q.query_id, q.rank): (q.vec_id, q.score) for q in retrieval.nearest(df, df.where("vec_id % 5 = 0"), 6, group_rows=group_rows).collect()}
    unit = x.astype(float) / np.maximum(np.linalg.norm(x.astype(float), axis=1, keepdims=True), 1e-300)
    for q in range(0, 150, 5):
        scores = np.round(unit @ unit[q], 6) + 0.0
        order = sorted((i for i in range(150) if i != q), key=lambda i: (-scores[i], i))[:6]
        assert [got[q, n + 1][0] for n in range(6)] == order and np.allclose([got[q, n + 1][1] for n in range(6)], scores[order], atol=1.1e-6)
    assert len(got) == 30 * 6 and retrieval.nearest(df.limit(0), df.limit(0), 3).count() == 0


def test_reranked_by_given_scores(spark):
    lists = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 10)], "query_id int, doc_id int")
    scores = spark.createDataFrame([(1, 10, 0.5), (1, 10, 0.7), (1, 11, 0.7), (2, 99, 1.0)], "query_id int, doc_id int, score double")
    docs = spark.createDataFrame([(10, "plain"), (11, "a\n| x | y |\nb"), (12, None)], "doc_id int, text string")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in retrieval.reranked(lists, scores, docs).collect()}
    assert got == {(1, 10): 0.7, (1, 11): 0.77, (1, 12): 0.0, (2, 10): 0.0}
