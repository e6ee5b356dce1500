import random
import re

import numpy as np
import xxhash

from graphlake.llm import near_dedup, queries

from .helpers import ODD, docs, folder

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, ids):
    label = list(range(len(fps)))
    def top(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                label[top(i)] = top(j)
    least = {}
    for i in range(len(fps)):
        least[top(i)] = min(least.get(top(i), ids[i]), ids[i])
    return [least[top(i)] for i in range(len(fps))]


def test_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 5) for _ in range(rng.randint(60, 400))) for _ in range(40)]
    texts = list(ODD) + base + [" ".join(x if rng.random() > 0.01 else "new" for x in b.split(" ")) for b in base for _ in range(4)] + base[:5] * 3
    rows = queries.op7_simhash_vptree(spark, folder(spark, tmp_path, texts)).collect()
    fps = [fingerprint(t) for t in texts]
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{x:016x}" for i, x in enumerate(fps)}
    assert {r.doc_id: r.component_id for r in rows} == dict(enumerate(components(fps, range(len(fps)))))


def test_tree_and_shards_lose_no_pair(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, 2, replace=False)) for _ in range(3000)], np.uint64)
    points = np.unique(np.concatenate([centres, np.repeat(centres, 15) ^ flips, rng.integers(0, 1 << 63, 2000, dtype=np.uint64)]))
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 3)) if i < j}
    got = {(min(a, b), max(a, b)) for x, y in near_dedup.tree_links(points, 3) for a, b in zip(x.tolist(), y.tolist())}
    assert got == want
    label = near_dedup.roots(len(points), *np.array(sorted(want)).T)
    table = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long")
    at = {int(x): i for i, x in enumerate(points.view(np.int64))}
    # one choice of four bands, two of five, three of six; and roots so hot that further vantage points split them
    for size, hot in ((1 << 10, 20_000), (1 << 28, 20_000), (1 << 33, 20_000), (1 << 10, 40)):
        monkeypatch.setattr(near_dedup, "TASK_POINTS", hot)
        sets = near_dedup.band_sets(size, 3)
        found = near_dedup.links(table, 3, sets).toPandas()
        again = near_dedup.roots(len(points), found.a.map(at).to_numpy(), found.b.map(at).to_numpy())
        assert (again == label).all()


def test_hot_roots_are_split_and_neighbours_visit(spark, monkeypatch):
    """Points that all agree in a band fall into one root; no shard of it holds nearly all of them, and each pair meets."""
    monkeypatch.setattr(near_dedup, "TASK_POINTS", 200)
    rng = np.random.default_rng(6)
    points = np.unique(rng.integers(0, 1 << 48, 3000, dtype=np.uint64))
    near = points[:500] ^ np.uint64(0b111)
    points = np.unique(np.concatenate([points, near])).view(np.int64)
    table = spark.createDataFrame([(int(x),) for x in points], "fp long")
    placed = near_dedup.shards(table, len(points), 3, [tuple(range(48, 64))])
    assert placed.groupBy("shard").count().agg({"count": "max"}).first()[0] < 0.3 * len(points)
    mates = placed.alias("x").join(placed.alias("y"), "shard").where("x.fp < y.fp and bit_count(x.fp ^ y.fp) <= 3").select("x.fp", "y.fp").distinct().count()
    assert mates == 500


def test_band_sets_hold_every_pair():
    rng = np.random.default_rng(8)
    for n in (10, 1 << 20, 1 << 25, 1 << 31, 1 << 35):
        sets = [set(x) for x in near_dedup.band_sets(n, 3)]
        assert min(map(len, sets)) >= np.log2(n) - 4
        for _ in range(200):
            flipped = set(rng.choice(64, 3, replace=False).tolist())
            assert any(not (flipped & s) for s in sets)


def test_chains_and_empty(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    assert {r.node: r.root for r in near_dedup.classes(edges).collect()} == {i: 0 for i in range(1, 61)} | {101: 100}
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0
    nulls = near_dedup.near_duplicates(docs(spark, ["x y z w"] * 3 + [None], ids=[None, 5, 5, None])).collect()
    assert sorted(map(str, (r.component_id for r in nulls))) == ["5", "5", "5", "None"]
