import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from graphlake.operators import documents
from graphlake.streaming import cache

ZERO = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "term string, source string, definition string, at timestamp, ttl double, gone boolean"


def at(seconds):
    return ZERO + timedelta(seconds=seconds)


def run(spark, folder, batches, late="0 seconds"):
    """The changes of the batches, each a file of its own, one a trigger."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{i:03d}")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in/*")
        cache.cache_into(stream, f"{folder}/out", f"{folder}/state", late).awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_entries_expire_return_and_are_invalidated(spark, tmp_path):
    put = lambda term, source, text, t, ttl=100.0: (term, source, text, at(t), ttl, False)
    gone = lambda term, source, t: (term, source, None, at(t), None, True)
    changes = run(spark, str(tmp_path), [
        [put(" GR ", "slb", "one", 0), put("gr", "spe", "two", 5), put("pef", "slb", "p", 10), put("no", "slb", "never", 10, 0.0), put("no", None, "never", 10), (None, "slb", "x", at(1), 5.0, False)],
        [put("gr", "slb", "newer", 50), put("clock", "slb", "c", 120)],
        [put("gr", "spe", "back", 130), gone("pef", "slb", 130), put("gr", "slb", "late", 40)],
        [gone("gr", None, 140), put("gr", "slb", "again", 141), put("gr", "aapg", "same time", 140)],
    ])
    seen = {}
    for r in changes.orderBy("changed").collect():
        seen.setdefault((r.term, r.source), []).append((r.status, r.definition, int((r.changed.replace(tzinfo=timezone.utc) - ZERO).total_seconds())))
    assert seen == {
        ("gr", "slb"): [("stored", "one", 0), ("refreshed", "newer", 50), ("invalidated", "newer", 140), ("stored", "again", 141)],
        ("gr", "spe"): [("stored", "two", 5), ("expired", "two", 105), ("stored", "back", 130), ("invalidated", "back", 140)],
        ("pef", "slb"): [("stored", "p", 10), ("expired", "p", 110)],
        ("clock", "slb"): [("stored", "c", 120)],
    }
    assert sorted((r.term, r.source, r.definition) for r in cache.held(changes, F.lit(at(200))).collect()) == [("clock", "slb", "c"), ("gr", "slb", "again")]


@pytest.mark.parametrize("late", ["100 days", "50 seconds"])
def test_any_order_and_batches_equal_the_batch_operator(spark, tmp_path, late):
    """With rows out of order, as many as the watermark lets in, one term half of all."""
    draw = random.Random(7)
    rows, n = [], 240
    for t in range(n):
        term, source = draw.choice(["hot"] * 20 + list("abcdefghijklmnopqrst")), draw.choice(["slb", "spe"])
        kind = draw.random()
        rows.append((term, None if kind < 0.03 else source, None if kind < 0.1 else f"v{t}", at(t), None if kind < 0.1 else 60.0, kind < 0.1))
    mixed = sorted(rows, key=lambda r: r[3].timestamp() + draw.randrange(40)) if late.startswith("50") else draw.sample(rows, n)
    changes = run(spark, str(tmp_path), [mixed[i::3] for i in range(3)] if late.startswith("100") else [mixed[:80], mixed[80:160], mixed[160:]], late)
    table, now = spark.createDataFrame(rows, SCHEMA), at(n)
    puts = table.where("not gone").withColumn("at_", F.unix_micros("at"))
    newest = documents.cache_latest(puts.withColumn("k", F.struct("term", "source")), "k", "at_", F.lit(int(now.timestamp() * 1e6)), F.lit(60_000_000))
    gone = table.where("gone").select(F.col("term").alias("t"), F.col("source").alias("s"), F.col("at").alias("g"))
    valid = newest.join(gone, (F.col("term") == F.col("t")) & (F.col("s").isNull() | (F.col("s") == F.col("source"))) & (F.col("g") >= F.col("at")), "left_anti")
    want = sorted((r.term, r.source, r.definition) for r in valid.collect())
    assert want and sorted((r.term, r.source, r.definition) for r in cache.held(changes, F.lit(now)).collect()) == want
    if late.startswith("50"):
        assert changes.where("status = 'expired'").count() > 0
