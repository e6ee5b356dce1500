"""Sharding: longest-processing-time scheduling of groups that must stay together."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphlake.llm import common

#: Groups of at least 1/PARTS of a shard's share of the bytes or rows are scheduled by their exact size, one by one: 2 * PARTS
#: for each shard at most. The others are scheduled as runs of equal size, sizes being kept to so many binary digits.
PARTS, DIGITS = 1024, 11
#: Rows that one task numbers.
UNIT_ROWS = 10_000


def dealt(loads: np.ndarray, size: int, count: int) -> np.ndarray:
    """How many of `count` items of one size each shard gets from a heap of loads: least load first, ties to the lowest shard.
    An item that finds load L takes the slot L; the heap hands out the `count` least slots L + j * size."""
    low, high = int(loads.min()), int(loads.max()) + size * (count // len(loads) + 2)
    taken = lambda level: np.maximum(0, -(-(level - loads) // size))  # slots below the level
    while low < high:  # the largest level below which there are at most `count` slots
        middle = (low + high + 1) // 2
        low, high = (middle, high) if taken(middle).sum() <= count else (low, middle - 1)
    given = taken(low)
    rest = count - int(given.sum())
    at_level = np.flatnonzero((loads + given * size) == low)[:rest]
    given[at_level] += 1
    return given


def schedule(runs: list[tuple[int, int]], shards: int) -> tuple[list[np.ndarray], np.ndarray]:
    """LPT over runs (size, count) in falling order of size: how many of each run go to each shard, and the shards' loads."""
    loads, out = np.zeros(shards, np.int64), []
    for size, count in runs:
        if count <= 2 * shards:
            given, heap = np.zeros(shards, np.int64), [(int(x), i) for i, x in enumerate(loads)]
            heapq.heapify(heap)
            for _ in range(count):
                load, i = heapq.heappop(heap)
                given[i] += 1
                heapq.heappush(heap, (load + size, i))
        else:
            given = dealt(loads, size, count)
        loads = loads + given * size
        out.append(given)
    return out, loads


def rounded(size) -> Column:
    """A size to DIGITS binary digits, rounded down: at most 2**(DIGITS - 1) values in each power of two."""
    size = F.col(size) if isinstance(size, str) else size
    unit = F.greatest(F.lit(0), F.floor(F.log2(size + F.lit(0.5))) - F.lit(DIGITS - 1)).cast("int")
    return size - F.pmod(size, F.pow(F.lit(2.0), unit).cast("long"))


def numbered(rows: DataFrame, by: str, order: str, name: str) -> DataFrame:
    """Adds name: a number from 0 without gaps within each value of `by`, which is not null. Values with many rows are dealt
    by hash of `order` to units of about UNIT_ROWS rows, which are numbered in turn."""
    sizes = rows.groupBy(by).agg(F.count("*").alias("n_"))
    sizes = common.written(sizes.select(F.col(by).alias("by_"), F.ceil(F.col("n_") / UNIT_ROWS).cast("int").alias("units_")), "units")
    some = common.maybe_broadcast(sizes, sizes.count())
    tagged = rows.join(some, rows[by] == some["by_"]).withColumn("unit_", F.pmod(F.xxhash64(order, F.lit(3)), F.col("units_")).cast("int")).drop("by_", "units_")
    counts = tagged.groupBy(F.col(by).alias("by_"), F.col("unit_").alias("u_")).agg(F.count("*").alias("n_"))
    before = Window.partitionBy("by_").orderBy("u_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("by_", "u_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("first_"))
    within = F.row_number().over(Window.partitionBy(by, "unit_").orderBy(order))
    tagged = tagged.withColumn("within_", within)
    found = tagged.join(offsets, (tagged[by] == offsets["by_"]) & (tagged["unit_"] == offsets["u_"]))
    return found.withColumn(name, F.col("first_") + F.col("within_") - 1).drop("by_", "u_", "unit_", "first_", "within_")


def lpt_shards(rows: DataFrame, shards: int, key_col: str = "group_key", size_col: str = "size") -> DataFrame:
    """rows and two further columns, shard int and slot long (gapless from 0 in each shard).

    Rows of a group share a shard. All groups are scheduled largest first to the least loaded shard: those of at least
    1 / PARTS of a shard's share by their exact size, and the rest as runs of equal size (to DIGITS binary digits: exact
    below 2**DIGITS bytes, within 1/1024 above). The driver holds one row for each such group and each run, at most
    2 * PARTS * shards and 2**(DIGITS - 1) for each power of two; which group of a run goes where follows from its number in
    the run. Null keys are a group of their own; rows may repeat; null and negative sizes count as 0; columns of the
    input keep their values under any name but shard and slot, which a caller may not use. Empty input: empty output.
    """
    taken = {"shard", "slot"} & set(rows.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are the result's")
    spark = rows.sparkSession
    kept = [f"c{i}_" for i in range(len(rows.columns))]
    size = F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0))
    named = rows.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(rows.columns, kept)], F.col(key_col).isNull().alias("none_"), F.coalesce(F.col(key_col).cast("long"), F.lit(0)).alias("key_"), size.alias("size_"))
    named = common.written(named.withColumn("row_", F.monotonically_increasing_id()), "shard-rows")
    groups = common.written(named.groupBy("none_", "key_").agg(F.sum("size_").alias("bytes_"), F.count("*").alias("rows_")), "shard-groups")
    total, n = groups.agg(F.coalesce(F.sum("bytes_"), F.lit(0)), F.coalesce(F.sum("rows_"), F.lit(0))).first()
    parts = PARTS * shards
    large = (F.col("bytes_") * parts >= F.lit(total)) & (F.col("bytes_") > 0) | (F.col("rows_") * parts >= F.lit(n))
    big = groups.where(large).select("none_", "key_", "bytes_").collect()
    small = groups.where(~large).withColumn("run_", rounded("bytes_"))
    runs = small.groupBy("run_").agg(F.count("*").alias("n")).collect()
    # a large group is a run of one
    items = sorted([(g.bytes_, 1, g) for g in big] + [(r.run_, r.n, None) for r in runs], key=lambda x: (-x[0], x[2] is None, x[2] and (x[2].none_, x[2].key_)))
    given, _ = schedule([(max(1, s), c) for s, c, _ in items], shards)
    of_key = [(g.none_, g.key_, int(x.argmax())) for (_, _, g), x in zip(items, given) if g is not None]
    ends = [(s, [int(e) for e in np.cumsum(x)]) for (s, _, g), x in zip(items, given) if g is None]
    big = F.broadcast(spark.createDataFrame(of_key, "b_none boolean, b_key long, b_shard int"))  # 2 * parts rows at most
    ends = spark.createDataFrame(ends, "e_run long, ends array<long>")
    ends = common.maybe_broadcast(ends, len(runs))
    placed = numbered(small.select("none_", "key_", "run_"), "run_", "key_", "number_").join(ends, F.col("run_") == F.col("e_run"))
    placed = placed.select(F.col("none_").alias("g_none"), F.col("key_").alias("g_key"), F.size(F.filter("ends", lambda e: e <= F.col("number_"))).alias("g_shard"))
    tagged = named.join(big, (named["none_"] == F.col("b_none")) & (named["key_"] == F.col("b_key")), "left")
    # rows of large groups, which would crowd a task of the join, have met their shard already
    at_once = tagged.where(F.col("b_shard").isNotNull()).select(*kept, "row_", F.col("b_shard").alias("shard"))
    others = tagged.where(F.col("b_shard").isNull())
    joined = others.join(placed, (others["none_"] == placed["g_none"]) & (others["key_"] == placed["g_key"])).select(*kept, "row_", F.col("g_shard").alias("shard"))
    slots = numbered(common.written(at_once.unionByName(joined), "placed-rows"), "shard", "row_", "slot")
    return slots.select(*[F.col(k).alias(c) for c, k in zip(rows.columns, kept)], F.col("shard").cast("int"), F.col("slot").cast("long"))
