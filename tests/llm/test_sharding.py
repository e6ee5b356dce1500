import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphlake.llm import queries, sharding

from .helpers import ODD, docs, folder


def lpt(sizes, shards):
    heap = [(0, i) for i in range(shards)]
    for size in sorted(sizes, reverse=True):
        load, i = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, i))
    return [load for load, _ in sorted(heap, key=lambda x: x[1])]


def test_runs_equal_the_heap():
    rng = np.random.default_rng(0)
    for _ in range(60):
        loads, size, count = rng.integers(0, 500, 7), int(rng.integers(1, 90)), int(rng.integers(1, 400))
        heap, want = [(int(x), i) for i, x in enumerate(loads)], np.zeros(7, int)
        heapq.heapify(heap)
        for _ in range(count):
            load, i = heapq.heappop(heap)
            want[i] += 1
            heapq.heappush(heap, (load + size, i))
        assert sharding.dealt(loads, size, count).tolist() == want.tolist()


def loads_of(rows, shards):
    loads = [0] * shards
    for r in rows:
        loads[r.shard] += r.size
    return loads


@pytest.mark.parametrize("parts, units", [(1024, 10_000), (4, 7)])
def test_loads_equal_lpt_over_all_groups(spark, monkeypatch, parts, units):
    monkeypatch.setattr(sharding, "PARTS", parts)
    monkeypatch.setattr(sharding, "UNIT_ROWS", units)
    rng = random.Random(1)
    groups = [(g, rng.choice([1, 7, 7, 7, 30, 30, rng.randint(1, 1500)]), rng.choice([1, 1, 1, 2])) for g in range(900)] + [(-5, 3, 400), (None, 1, 300)]
    rows = spark.createDataFrame([(g, s) for g, s, n in groups for _ in range(n)], "group_key long, size long")
    got = sharding.lpt_shards(rows.withColumns({c: F.lit("mine") for c in ("row_no", "item", "unit", "first", "within", "units", "key_", "n_")}), 8).collect()
    assert len(got) == rows.count() and {r.within for r in got} == {"mine"} and {r.key_ for r in got} == {"mine"}
    at = {}
    for r in got:
        at.setdefault(r.group_key, set()).add(r.shard)
    assert all(len(x) == 1 for x in at.values())
    want = lpt([s * n for _, s, n in groups], 8)
    # sizes below 2**DIGITS are exact, so the loads are those of the heap over all groups
    assert sorted(loads_of(got, 8)) == sorted(want)
    for shard in range(8):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def test_large_sizes_stay_near_lpt(spark):
    rng = random.Random(2)
    sizes = [int(rng.paretovariate(0.9) * 3000) for _ in range(4000)]
    rows = spark.createDataFrame(list(enumerate(sizes)), "group_key long, size long")
    got, want = sorted(loads_of(sharding.lpt_shards(rows, 16).collect(), 16)), sorted(lpt(sizes, 16))
    assert all(abs(a - b) <= 0.001 * max(want) for a, b in zip(got, want))


def test_odd_rows(spark, tmp_path):
    rows = queries.op8_lpt_shards(spark, folder(spark, tmp_path, ODD)).collect()
    assert len(rows) == len(ODD) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    of = {}
    for r in rows:
        of.setdefault(ODD[r.doc_id], set()).add(r.shard)
        assert r.size == len((ODD[r.doc_id] or "").encode()) + 1
    assert all(len(x) == 1 for x in of.values())
    empty = docs(spark, []).select(F.col("doc_id").alias("group_key"), F.lit(1).alias("size"))
    assert sharding.lpt_shards(empty, 16).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, 5), (1, None), (1, -3)], "group_key long, size long")
    got = sharding.lpt_shards(nulls, 2).collect()
    assert len(got) == 4 and len({(r.group_key, r.shard) for r in got}) == 2
    with pytest.raises(ValueError):
        sharding.lpt_shards(nulls.withColumn("slot", F.lit(1)), 2)
