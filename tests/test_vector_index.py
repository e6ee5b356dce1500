import numpy as np
import pytest
from pyspark.sql import functions as F

from graphlake.operators import retrieval, vector_index

SCHEMA = "vec_id long, embedding array<double>"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], SCHEMA)


def clusters(n=3000, width=8, seed=3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(30, width))
    rows = middles[rng.integers(0, 30, n)] + rng.normal(scale=0.02, size=(n, width))
    rows[: n // 3] = rows[0]  # a third of all are copies
    return [(i, r) for i, r in enumerate(rows)]


def questions(df, every=50):
    return df.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_exact_search_equals_the_scan_and_reads_less(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 64)
    monkeypatch.setattr(vector_index, "PACK", 7)
    df = table(spark, clusters())
    asked = questions(df)
    index = vector_index.build(df, str(tmp_path), 30)
    found, read = vector_index.searched(index, asked, 5, probes=2)
    assert rows(found) == rows(retrieval.vector_topk_batch(df, asked, 5))
    assert read.agg(F.avg("read")).first()[0] < 0.5 * 3000
    assert index.blocks.agg(F.sum(F.size("ids"))).first()[0] == 3000 and index.blocks.agg(F.max(F.size("ids"))).first()[0] <= 64
    again = vector_index.load(spark, str(tmp_path))
    assert rows(vector_index.search(again, asked, 5)) == rows(found)
    depths = vector_index.depths(index, found, asked)
    probes = vector_index.probes_for(depths, 0.9)
    first = vector_index.search(index, asked, 5, probes, exact=False)
    hits = found.join(first, ["query_id", "vec_id"], "left_semi").count()
    assert 1 <= probes < 30 and hits >= 0.9 * found.count()


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_null_zero_odd_and_repeated_vectors(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(vector_index, "BROADCAST_BYTES", limit)
    odd = [(100, None), (101, [0, 0, 0]), (102, [1, 0, 0]), (102, [1, 0, 0]), (103, [-1, 0, 0]), (104, [-1, -1, 0]), (105, [0, -1, 0])]
    df = table(spark, odd)
    asked = table(spark, [(1, [1, 0, 0]), (2, [0, 0, 0]), (3, None)]).toDF("query_id", "query")
    got = rows(vector_index.search(vector_index.build(df, str(tmp_path), 2), asked, 4, probes=1))
    assert got == [
        (1, 100, 0.0, 3), (1, 101, 0.0, 4), (1, 102, 1.0, 1), (1, 102, 1.0, 2),
        *[(q, i, 0.0, r) for q in (2, 3) for r, i in enumerate((100, 101, 102, 102), 1)],
    ]


def test_no_vectors_and_no_questions(spark, tmp_path):
    empty, one = table(spark, []), table(spark, [(1, [1, 2])])
    asked = one.toDF("query_id", "query")
    assert rows(vector_index.search(vector_index.build(empty, f"{tmp_path}/a"), asked, 3)) == []
    index = vector_index.build(one, f"{tmp_path}/b")
    assert rows(vector_index.search(index, asked, 3)) == [(1, 1, 1.0, 1)]
    assert rows(vector_index.search(index, asked.limit(0), 3)) == []


def test_hits_grow_with_shards_not_with_blocks(spark, tmp_path, monkeypatch):
    """A question had k rows and a copy of its vector for each block that it read."""
    monkeypatch.setattr(vector_index, "BLOCK", 16)
    rng = np.random.default_rng(8)
    df = table(spark, [(i, rng.normal(size=6)) for i in range(2000)] + [(None, np.ones(6))] * 2)
    asked, sizes, real = questions(df, 100), [], vector_index._best
    monkeypatch.setattr(vector_index, "_best", lambda hits, k: sizes.append(hits.count()) or real(hits, k))
    found = vector_index.search(vector_index.build(df, str(tmp_path), 40), asked, 5, probes=2)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(map(tuple, retrieval.vector_topk_batch(df, asked, 5).collect()), key=key)
    assert sizes[-1] <= 20 * 6  # one shard
