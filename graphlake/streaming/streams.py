"""Streaming forms of the metric, cache and upsert operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.streaming.buckets import BucketedTable


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The events under a folder as a stream, `ts` as a timestamp for watermarks."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_latency(events: DataFrame, late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """Count, mean and approximate percentiles by type and window; rows later than the watermark are dropped."""
    keyed = events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type")
    stats = keyed.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.percentile_approx("value", F.array(F.lit(0.5), F.lit(0.95))).alias("p"))
    return stats.select(F.col("window.start").alias("start"), "event_type", "n", F.round("mean", 4).alias("mean"), F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"))


def first_of_key(events: DataFrame, key: str, ttl: str = "10 minutes") -> DataFrame:
    """The first row of a key within the watermark's time, later ones dropped."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark([key])


def upsert_into(events: DataFrame, path: str, keys: list[str], version: str, checkpoint: str, buckets: int = 64):
    """A query that merges each micro-batch into a `BucketedTable`: a batch rewrites the buckets that it touches, and one that is
    retried is merged once."""
    table = BucketedTable(events.sparkSession, path, keys, version, buckets)
    return events.writeStream.foreachBatch(lambda batch, number: table.merge(batch, number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
