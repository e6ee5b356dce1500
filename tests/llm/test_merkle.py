import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from graphlake.llm import merkle, queries

from .helpers import DOCS, SF

COLUMNS = "doc_id leaf subroot root proof_sha256 folded_root verified".split()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in merkle.FIELDS))


def tree(hashes):
    """The root and, for each hash, what stands left and right of it on each level."""
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for path, i in zip(paths, at):
            path.append(("".join(hashes[i // 3 * 3 : i]), "".join(hashes[i + 1 : i // 3 * 3 + 3])))
        at = [i // 3 for i in at]
        hashes = [sha("".join(hashes[i : i + 3])) for i in range(0, len(hashes), 3)]
    return hashes[0], paths


def brute(rows):
    by = {}
    for row in rows:
        by.setdefault(row["source"], []).append((row["doc_id"] is not None, row["doc_id"] or 0, leaf(row), row))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in order]
    if not trees:
        return []
    root, above = tree([t[0] for t in trees])
    out = []
    for s, (subroot, paths), top in zip(order, trees, above):
        for (known, _, h, row), path in zip(sorted(by[s], key=lambda x: x[:3]), paths):
            cur = h
            if known and row["text"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0:
                cur = leaf({**row, "text": row["text"].replace("\n", "")})
            for a, b in path + top:
                cur = sha(a + cur + b)
            out.append((row["doc_id"], h, subroot, root, sha("".join(a + b for a, b in path + top)), cur, cur == root))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def query(spark, tmp_path, df, levels=6):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got = queries.op13_merkle_manifest(spark, str(tmp_path)) if levels == 6 else merkle.manifest(df, tampered, levels)
    return sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=str)


ODD = (
    [(None, None, None, None, None), (None, "a\nb", "en", "s", 3), (None, "a\nb", "en", "s", 3), (7, "", "", "", 0), (7, "\n", None, "é", None), (-4, "x" * 100_000 + "\n", "de", None, 5)]
    + [(i, f"text\n{i}", "en", "hot", i) for i in range(40)]
    + [(i, "one", "en", f"src{i}", 3) for i in range(100, 117)]
)


@pytest.mark.parametrize("levels", [6, 2])
def test_odd_rows_in_blocks_of_any_depth(spark, tmp_path, levels):
    df = table(spark, ODD).withColumns({"grp": F.lit(1), "leaf": F.lit(2), "rank": F.lit(3), "part": F.lit(4), "hash": F.lit(5)})
    assert query(spark, tmp_path, df, levels) == brute([r.asDict() for r in table(spark, ODD).collect()])


@pytest.mark.parametrize("sizes", [[], [1], [3, 1, 2, 4, 9, 10, 28]])
def test_sizes(spark, tmp_path, sizes):
    df = table(spark, [(i, f"t{i}\n", "en", f"s{n}", 2) for n in sizes for i in range(n)])
    assert query(spark, tmp_path, df, 2) == brute([r.asDict() for r in df.collect()])


def test_equals_sql_without_python_or_joins_of_proofs(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = duckdb.sql(queries.ORACLE_SQL["op13_merkle_manifest"])
    got = queries.op13_merkle_manifest(spark, SF)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan
    assert sorted(map(str, map(tuple, got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))
    assert not all(r.verified for r in got.select("verified").collect())
