import hashlib
import math
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from graphlake.llm import prefix_trie, queries

from .helpers import SF

COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
ROWS = "conv_id long, turn long, role string, text string"


def brute(rows):
    by = {}
    for c, t, r, x in rows:
        r, x = r or "", x or ""
        if c is not None:
            by.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest()[:16], r, x))
    own = {c: [v[3:] for v in sorted(vs)] for c, vs in by.items()}
    nodes = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        turns = own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), {"in": [], "end": [], "kids": 0, "leaves": 0, "saved": 0})["in"].append(c)
        nodes[tuple(turns)]["end"].append(c)
    for k in nodes:
        if k:
            nodes[k[:-1]]["kids"] += 1
    for k, n in nodes.items():
        for a in range(len(k) + 1):
            nodes[k[:a]]["saved"] += (len(n["in"]) - 1) * (len(k[-1][1].encode()) if k else 0)
            nodes[k[:a]]["leaves"] += n["kids"] == 0
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(((min(n["in"]), len(k), min(nodes[k[:-1]]["in"]) if k else None, len(n["in"]), n["kids"], n["leaves"], n["saved"], sha(n["end"])) for k, n in nodes.items()), key=str)


def query(spark, tmp_path, table):
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    return sorted((tuple(r[c] for c in COLUMNS) for r in queries.op12_prefix_trie(spark, str(tmp_path)).collect()), key=str)


ODD = (
    [(None, 1, "u", "x"), (1, None, "u", "a"), (1, 1, None, None), (1, 1, "u", "b"), (1, 1, "u", "b"), (5, 1, "u", "é\n"), (-3, 0, "u", "n"), (-3, 1, "u", "m"), (0, 0, "u", "b"), (0, 1, "a", "c")]
    + [(i, t, "u", f"same {t}") for i in range(20, 60) for t in range(2)]
    + [(i, t, "u", f"long {t}") for i in (100, 101) for t in range(200)]
)


@pytest.mark.parametrize("keys", [32_768, 3])
def test_odd_rows_in_blocks_of_any_size(spark, tmp_path, monkeypatch, keys):
    monkeypatch.setattr(prefix_trie, "BLOCK_KEYS", keys)
    monkeypatch.setattr(prefix_trie, "PIECE_BYTES", 40)
    table = spark.createDataFrame(ODD, ROWS).withColumns({"own": F.lit(1), "key": F.lit(2), "sizes": F.lit(3)})
    assert query(spark, tmp_path, table) == brute(ODD)


def test_random_conversations(spark, tmp_path):
    rng = random.Random(5)
    rows = [(c, t, rng.choice("ua"), rng.choice(["", "x", "yy"])) for c in range(300) for t in range(rng.randint(1, 9))]
    assert query(spark, tmp_path, spark.createDataFrame(rows, ROWS)) == brute(rows)


def test_equals_sql_and_no_rows(spark, tmp_path):
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = duckdb.sql(queries.ORACLE_SQL["op12_prefix_trie"])
    got = queries.op12_prefix_trie(spark, SF).select(*want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
    assert query(spark, tmp_path, spark.createDataFrame([], ROWS)) == []


def test_layouts_grow_and_keep_order():
    root, rng = prefix_trie.Node(b""), random.Random(1)
    keys = {bytes(rng.randrange(256) for _ in range(4)) for _ in range(3000)} | {b"", b"\0\0\0\0"}
    sizes = set()
    for i, key in enumerate(rng.sample(sorted(keys), len(keys))):
        prefix_trie.insert(root, key, i, [])
        sizes.add(root.kind)
    assert sizes == {4, 16, 48, 256}
    found, stack = [], [(root, b"")]
    while stack:
        node, at = stack.pop()
        found += [at] * len(node.ends)
        stack.extend((kid, at + kid.path) for kid in reversed(node.children()))
    assert found == sorted(keys)
