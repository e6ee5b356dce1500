"""Every registered query against its SQL in DuckDB on sf0.001, and plans without Python."""

import duckdb
import pytest

from graphlake.plans import all_queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = all_queries()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([float(r[i]) if isinstance(r[i], int | float) and not isinstance(r[i], bool) else r[i] for i in order]) for r in values)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flagship_asks_for_every_conversation(spark, duck):
    """One conversation in twenty was asked for, in the SQL too."""
    got = [r.query_id for r in QUERIES["q_flagship"](spark, SF).collect()]
    want = duck.sql("SELECT DISTINCT conv_id FROM conversations WHERE role = 'user' AND conv_id IN (SELECT vec_id FROM embeddings)").fetchall()
    assert len(want) > 1 and sorted(got) == sorted(i for (i,) in want)
