import numpy as np
import pytest
from pyspark.sql import functions as F

from graphlake.llm import queries, topk_search


def brute(vectors, ids, own, query, k):
    score = vectors @ query
    return [(int(ids[j]), int(score[j])) for j in np.lexsort((ids, -score)) if j != own][:k]


@pytest.mark.parametrize("k, dense", [(1, True), (5, True), (5, False)])
def test_maxscore_equals_brute_force_and_skips(monkeypatch, k, dense):
    monkeypatch.setattr(topk_search, "CHUNK", 64)
    rng = np.random.default_rng(1)
    vectors = np.floor(rng.normal(size=(1500, 32)) * rng.gamma(1, 1, 32) * 20).astype(np.int64)
    if not dense:
        vectors[rng.random(vectors.shape) < 0.8] = 0
    vectors[100:160] = vectors[99]
    ids = np.sort(rng.integers(0, 900, 1500))  # ids repeat
    index, looked = topk_search.Postings(vectors), 0
    for own in range(0, 1500, 50):
        want = brute(vectors, ids, own, vectors[own], k)
        rows, scores, n = topk_search.best_of(vectors[own].astype(float), index, ids, own, k, -np.inf)
        assert list(zip(ids[rows].tolist(), scores.tolist())) == want
        # a threshold from elsewhere loses nothing that reaches it
        rows, scores, n = topk_search.best_of(vectors[own].astype(float), index, ids, own, k, want[-1][1] - 0.5)
        assert list(zip(ids[rows].tolist(), scores.tolist())) == want
        looked += n
        assert not len(topk_search.best_of(vectors[own].astype(float), index, ids, own, k, 1e12)[0])
    assert looked < 0.75 * 30 * vectors.size


def test_top_k_in_blocks_and_odd_rows(spark, monkeypatch):
    for name, value in (("SHARD_ROWS", 7), ("BLOCK_QUERIES", 3), ("PIVOTS", 6)):
        monkeypatch.setattr(topk_search, name, value)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-4, 5, 6)]) for i in range(40)]
    rows += [(40, None), (41, [1.0, None]), (42, [float("nan")]), (43, [float("inf")]), (None, [1.0]), (44, []), rows[3], rows[5], (5, [1.0] * 6), (45, [2.0])]
    table = spark.createDataFrame([(i, e, "x") for i, e in rows], "vec_id int, embedding array<double>, row_no string")
    vectors = topk_search.scaled(table, "vec_id", "embedding", 1)
    usable = [(i, np.pad(v, (0, 6 - len(v)))) for i, v in rows if i is not None and v is not None and i not in (41, 42, 43)]
    assert vectors.count() == len(usable)
    got = topk_search.top_k(vectors, vectors.where(F.col("vec_id") % 5 == 0), 3).collect()
    matrix, ids = np.array([v for _, v in usable]), np.array([i for i, _ in usable])
    want = [(int(ids[q]), n + 1, *found) for q in range(len(usable)) if ids[q] % 5 == 0 for n, found in enumerate(brute(matrix, ids, q, matrix[q], 3))]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert topk_search.top_k(vectors.limit(0), vectors.limit(0), 3).count() == 0
    alone = vectors.where("vec_id = 0")
    assert topk_search.top_k(alone, alone, 3).count() == 0


def test_query_leaves_out_its_own_row_alone(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.integers(-4, 5, 6)]) for i in range(60)]
    rows += [rows[i] for i in (3, 3, 7, 50)] + [(9, [4.0] * 6)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op3_maxscore_topk(spark, str(tmp_path)).collect()
    matrix, ids = np.array([np.array(v) * 256 for _, v in rows]).astype(int), np.array([i for i, _ in rows])
    want = [(int(ids[q]), n + 1, *found) for q in range(len(rows)) if ids[q] % 50 == 0 for n, found in enumerate(brute(matrix, ids, q, matrix[q], 5))]
    assert sorted(tuple(r) for r in got) == sorted(want)
