import pytest
from pyspark.sql import functions as F

from graphlake.sources.tables import upsert
from graphlake.streaming.buckets import BucketedTable

ROWS = "k long, name string, v long, text string"


def rows(df):
    return sorted(map(str, df.collect()))


def files(table):
    data = table._at("data")
    return sorted(f"{w.getPath().getName()}/{b.getPath().getName()}" for w in table._fs.listStatus(data) for b in table._fs.listStatus(w.getPath()) if b.isDirectory())


def test_small_batches_rewrite_few_buckets(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path), ["k", "name"], "v", 16)
    first = spark.range(500).select(F.col("id").alias("k"), F.lit("a").alias("name"), F.lit(1).cast("long").alias("v"), F.concat(F.lit("t"), "id").alias("text"))
    assert table.read() is None and len(table.merge(first, 0)) == 16
    before = table.pointer()["at"]
    second = spark.createDataFrame([(3, "a", 2, "new"), (3, "a", 1, "old"), (7, "a", 0, "older"), (7, None, None, "null name"), (None, "a", 1, None)], ROWS)
    touched = table.merge(second, 1)
    after = table.pointer()["at"]
    assert 0 < len(touched) <= 4 and {int(b) for b in after if after[b] != before.get(b)} == set(touched)
    assert rows(table.read()) == rows(upsert(first, second, ["k", "name"], "v"))
    assert len(files(table)) == len(after)  # what was replaced is gone
    assert table.merge(second.withColumn("v", F.lit(9).cast("long")), 1) == []  # the same batch again
    assert len(table.merge(second.limit(0), 2)) == 0 and table.read().count() == 502


def test_a_crash_before_the_commit_loses_nothing(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path), ["k"], "v", 4)
    one = spark.createDataFrame([(1, "a", 1, "x"), (2, "a", 1, "y")], ROWS)
    two = spark.createDataFrame([(1, "b", 2, "x2"), (3, "b", 1, "z")], ROWS)
    table.merge(one, 0)

    def crash():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        table.merge(two, 1, before_commit=crash)
    assert rows(table.read()) == rows(one) and len(files(table)) > len(table.pointer()["at"])
    again = BucketedTable(spark, str(tmp_path), ["k"], "v")
    assert again.merge(two, 1) and rows(again.read()) == rows(upsert(one, two, ["k"], "v"))
    again.vacuum()
    assert len(files(again)) == len(again.pointer()["at"]) and rows(again.read()) == rows(upsert(one, two, ["k"], "v"))
    assert again.pointer()["buckets"] == 4


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    a, b = (BucketedTable(spark, str(tmp_path), ["k"], "v", 4) for _ in range(2))
    one, two = spark.createDataFrame([(1, "a", 1, "x")], ROWS), spark.createDataFrame([(1, "b", 2, "y")], ROWS)
    with pytest.raises(RuntimeError, match="another writer"):
        a.merge(one, 0, before_commit=lambda: b.merge(two, 0))
    assert rows(a.read()) == rows(two)
