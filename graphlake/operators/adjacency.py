"""Adjacency lists as a stored, bucketed table: hops join a frontier to it by bucket, and hubs are dealt into blocks."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

#: Neighbours of a block, about; rows of hubs that may be broadcast to a frontier; neighbours of a bucket, about.
BLOCK, BROADCAST_ROWS, BUCKET = 1_024, 200_000, 1_000_000


@dataclass
class Adjacency:
    """lists: (node, way, block, others), bucketed by (node, block, way); hubs: (node, way, blocks) of the nodes with more than one
    block, and how many rows that are; buckets: of the lists, and tasks that hops are dealt to."""

    lists: DataFrame
    hubs: DataFrame
    n_hubs: int
    buckets: int


def store(edges: DataFrame, path: str, buckets: int | None = None) -> Adjacency:
    """Stores both directions of edges (source, target) under path; parallel edges count once.

    A node's neighbours are dealt to blocks by their hash, so a hub's list is many rows in many buckets and no task
    gathers it. buckets: at least the session's shuffle partitions, so that joins shuffle the frontier and not the lists, and
    at least one for every BUCKET neighbours, so that a task's share doesn't grow with the graph. The neighbours are dealt to
    the buckets once, and gathered, sorted and written there.
    """
    spark = edges.sparkSession
    out = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), F.lit("outgoing").alias("way"))
    both = out.union(edges.select(F.col("target").alias("node"), F.col("source").alias("other"), F.lit("incoming").alias("way"))).where("node is not null and other is not null")
    seen = Observation()
    counts = both.groupBy("node", "way").agg(F.count("*").alias("n")).observe(seen, F.sum("n").alias("total")).where(F.col("n") > BLOCK)
    counts.select("node", "way", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")).write.mode("overwrite").parquet(f"{path}/hubs")
    hubs = spark.read.parquet(f"{path}/hubs")
    n_hubs = hubs.count()
    buckets = max(buckets or 0, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(seen.get["total"] or 0) // BUCKET))
    some = F.broadcast(hubs) if n_hubs <= BROADCAST_ROWS else hubs
    dealt = both.join(some, ["node", "way"], "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("other"), "blocks"), F.lit(0)).cast("int"))
    lists = dealt.repartition(buckets, "node", "block", "way").groupBy("node", "block", "way").agg(F.collect_set("other").alias("others"))
    name = f"adjacency_{uuid.uuid4().hex}"
    lists.write.option("path", f"{path}/lists").bucketBy(buckets, "node", "block", "way").sortBy("node", "block", "way").saveAsTable(name)
    return Adjacency(spark.table(name), hubs, n_hubs, buckets)


def _kept(df: DataFrame) -> DataFrame:
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def neighbours_of(adjacency: Adjacency, frontier: DataFrame) -> DataFrame:
    """(query_id, node, direction, hops) of the far ends of the frontier's edges, repeated where several lead there: the frontier
    is dealt to the blocks of its nodes and meets the lists in their buckets."""
    ways = F.when(F.col("direction").isNull(), F.array(F.lit("outgoing"), F.lit("incoming"))).otherwise(F.array("direction"))
    asked = frontier.select("query_id", "node", "direction", "hops", F.explode(ways).alias("way"))
    hubs = F.broadcast(adjacency.hubs) if adjacency.n_hubs <= BROADCAST_ROWS else adjacency.hubs
    blocks = F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)
    dealt = asked.join(hubs, ["node", "way"], "left").select("query_id", "node", "direction", "hops", "way", F.explode(blocks).alias("block"))
    met = dealt.join(adjacency.lists, ["node", "block", "way"])
    return met.select("query_id", F.explode("others").alias("node"), "direction", "hops")


def expand_each(adjacency: Adjacency, seeds: DataFrame, most: int = 2) -> DataFrame:
    """As `graph.expand_each`, from a stored adjacency: seeds (query_id, id, direction, hops) give (query_id, node, hop).

    Each hop's frontier is stored before the next one, so no hop runs an earlier one again; the last one is not stored. What a hop
    reaches is dealt once by query and node, where it is made distinct and meets what was seen.
    """
    dealt = lambda df: df.repartition(adjacency.buckets, "query_id", "node")
    frontier = seeds.select("query_id", F.col("id").alias("node"), "direction", "hops").distinct()
    seen = frontier.select("query_id", "node", F.lit(0).alias("hop"))
    for hop in range(1, most + 1):
        reached = dealt(neighbours_of(adjacency, frontier.where(F.col("hops") >= hop))).dropDuplicates(["query_id", "node"])
        frontier = reached.join(dealt(seen.select("query_id", "node")), ["query_id", "node"], "left_anti").select("query_id", "node", "direction", "hops")
        frontier = _kept(frontier) if hop < most else frontier
        seen = seen.union(frontier.select("query_id", "node", F.lit(hop)))
    return seen


def expand(adjacency: Adjacency, seeds: DataFrame, hops: int = 1, direction: str = "both") -> DataFrame:
    """(seed, node, hop): nodes within `hops` edges of each seed (id) by the shortest way, seeds at hop 0."""
    way = {"out": "outgoing", "in": "incoming", "both": None}[direction]
    asked = seeds.select(F.col("id").alias("query_id"), "id", F.lit(way).cast("string").alias("direction"), F.lit(hops).alias("hops"))
    return expand_each(adjacency, asked, hops).withColumnRenamed("query_id", "seed")
