"""Operator 7: pieces, blocks of queries and ties give what brute force gives."""

import numpy as np
import pytest

from verdure.llm import op7_rabitq


@pytest.mark.parametrize(("piece", "block"), [(op7_rabitq.VECTORS, op7_rabitq.BLOCK_BYTES), (97, 4096)])
def test_against_brute_force(spark, monkeypatch, piece, block):
    monkeypatch.setattr(op7_rabitq, "VECTORS", piece)
    monkeypatch.setattr(op7_rabitq, "BLOCK_BYTES", block)
    x = np.random.default_rng(2).normal(size=(1500, 24)).round(2)
    x[300:340] = x[0]  # ties
    rows = [(i, list(map(float, v))) for i, v in enumerate(x)] + [(5001, None), (5002, [0.0] * 24), (5003, [float("inf")] * 24), (5020, [1.0]), (None, [1.0] * 24)]
    vectors, d = op7_rabitq.valid(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), "vec_id", "embedding")
    index = op7_rabitq.build_index(vectors, d)
    got = {}
    for r in op7_rabitq.search(index, index.filter("id % 20 = 0").select("id", "vector"), k=50).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.id, r.score))
    assert len(got) == 75
    for q, found in got.items():
        score = np.zeros(len(x))
        for j in range(24):
            score += x[:, j] * x[q, j]
        score[q] = -np.inf
        want = np.lexsort((np.arange(len(x)), -score))[:50]
        assert [i for i, _ in found] == want.tolist() and [s for _, s in found] == score[want].tolist()


def test_few_candidates_and_empty(spark):
    vectors, d = op7_rabitq.valid(spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.5, 1.0]), (3, [0.5, 1.0])], "vec_id long, embedding array<float>"), "vec_id", "embedding")
    index = op7_rabitq.build_index(vectors, d)
    got = sorted((r.query, r.rank, r.id, r.score) for r in op7_rabitq.search(index, index.filter("id % 20 = 0").select("id", "vector"), k=20).collect())
    assert got == [(0, 1, 20, 1.0), (0, 2, 3, 0.5), (0, 3, 3, 0.5), (20, 1, 0, 1.0), (20, 2, 3, 0.5), (20, 3, 3, 0.5)]
    assert op7_rabitq.search(index, index.filter("id < 0").select("id", "vector")).count() == 0
