"""Which members hold a term, as compressed sets of dense numbers: all or any of many terms by AND and OR of stored bitmaps."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphlake.operators.narrow import kept

#: Rows of numbers that may be broadcast; numbers of the bitmaps that a task reads out; letters of a trigram.
BROADCAST_ROWS, READ_OUT, GRAM = 200_000, 1 << 19, 3
#: Characters of texts whose trigrams are found at once; numbers of a bitmap; bitmaps put together at once.
SLICE, BUCKET, AT_ONCE = 1 << 20, 32_768, 512


@dataclass
class Index:
    """numbers: (member, number), dense from 1; bitmaps: (term, bucket, bits), 32,768 numbers each."""

    numbers: DataFrame
    bitmaps: DataFrame


def build(pairs: DataFrame, path: str) -> Index:
    """Stores the index of pairs (term, member) under path; nulls are left out, repeated pairs count once.

    Members are numbered by range: a task numbers its own, from the count of the tasks before it. A term that all members have
    is as many bitmaps as there are buckets, put together from partial ones, so no task sees its pairs at once.
    """
    held = pairs.select("term", "member").where("term is not null and member is not null")
    numbers = _numbered(held.select("member").distinct(), path)
    numbered = held.join(numbers, "member")
    bits = numbered.groupBy("term", F.bitmap_bucket_number("number").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))
    bits.repartitionByRange("term", "bucket").sortWithinPartitions("term", "bucket").write.mode("overwrite").parquet(f"{path}/bitmaps")
    return load(pairs.sparkSession, path)


def _numbered(members: DataFrame, path: str) -> DataFrame:
    """Stores (member, number) of distinct members under path."""
    spark = members.sparkSession
    members.repartitionByRange("member").withColumn("part", F.spark_partition_id()).write.mode("overwrite").parquet(f"{path}/members")
    members = spark.read.parquet(f"{path}/members")
    counts = members.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task of the numbering
    offsets = counts.select(F.col("part").alias("p_"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = members.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("member")))
    within.join(F.broadcast(offsets), F.col("part") == F.col("p_")).select("member", (F.col("first") + F.col("at")).alias("number")).write.mode("overwrite").parquet(f"{path}/numbers")
    return spark.read.parquet(f"{path}/numbers")


def load(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/numbers"), spark.read.parquet(f"{path}/bitmaps"))


def numbers_in(bucket: Column, bits: Column) -> Column:
    """The numbers of a bitmap, as an array: bytes that are not zero, and of those the bits."""
    byte = lambda i: F.substring(bits, i + 1, F.lit(1))
    at = F.filter(F.sequence(F.lit(0), F.octet_length(bits) - 1), lambda i: byte(i) != F.lit(b"\x00"))
    valued = F.transform(at, lambda i: F.struct(i.alias("i"), F.conv(F.hex(byte(i)), 16, 10).cast("int").alias("v")))
    places = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(1 << b).alias("power")) for b in range(8)])
    found = F.flatten(F.transform(valued, lambda x: F.transform(F.filter(places, lambda p: x["v"].bitwiseAND(p["power"]) != 0), lambda p: x["i"] * 8 + p["b"])))
    return F.transform(found, lambda p: (bucket - 1) * 32_768 + p + 1)


def _members(index: Index, sets: DataFrame, key: str = "query_id", numbers: Column | None = None) -> DataFrame:
    """(key, member): the members whose numbers stored sets (key, bucket, bits) hold, or such of them as the array `numbers` has.

    A few KB of bitmaps are millions of numbers, and the planner sees the bytes alone: so bits are counted, and numbers are
    broadcast only if they are few. Of more, bitmaps are dealt to tasks that read them out, and numbers meet members by a merge.
    """
    sets = sets.where(F.bitmap_count("bits") > 0)
    n = sets.agg(F.sum(F.bitmap_count("bits"))).first()[0] or 0
    few = n <= BROADCAST_ROWS
    sets = sets if few else sets.repartition(-(-n // READ_OUT))
    found = sets.select(key, F.explode(numbers_in(F.col("bucket"), F.col("bits")) if numbers is None else numbers).alias("number"))
    found = F.broadcast(found) if few else found.hint("merge")
    return index.numbers.join(found, "number").select(key, "member")


def with_all(index: Index, asked: DataFrame) -> DataFrame:
    """(query_id, member): the members that hold all terms of each query (query_id, term)."""
    wanted = asked.select("query_id", "term").distinct()
    needed = wanted.groupBy("query_id").agg(F.count("*").alias("needed"))
    met = index.bitmaps.join(wanted, "term")
    sets = met.groupBy("query_id", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n")).join(needed, "query_id").where("n = needed")
    return _members(index, kept(sets.select("query_id", "bucket", "bits")))


def with_any(index: Index, asked: DataFrame) -> DataFrame:
    """(query_id, member): the members that hold any term of each query (query_id, term)."""
    met = index.bitmaps.join(asked.select("query_id", "term").distinct(), "term")
    return _members(index, kept(met.groupBy("query_id", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))))


def with_all_but(index: Index, asked: DataFrame, but: DataFrame) -> DataFrame:
    """(query_id, member): the members that hold all terms asked of a query and none of those in but, both (query_id, term)."""
    wanted, barred = asked.select("query_id", "term").distinct(), but.select("query_id", "term").distinct()
    needed = wanted.groupBy("query_id").agg(F.count("*").alias("needed"))
    held = index.bitmaps.join(wanted, "term").groupBy("query_id", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n"))
    out = index.bitmaps.join(barred, "term").groupBy("query_id", "bucket").agg(F.bitmap_or_agg("bits").alias("out"))
    sets = kept(held.join(needed, "query_id").where("n = needed").join(out, ["query_id", "bucket"], "left").select("query_id", "bucket", "bits", "out"))
    left = F.array_except(numbers_in(F.col("bucket"), F.col("bits")), F.when(F.col("out").isNull(), F.array().cast("array<bigint>")).otherwise(numbers_in(F.col("bucket"), F.col("out"))))
    return _members(index, sets, numbers=left)


def terms_but(index: Index, but: list[str]) -> DataFrame:
    """(member, term): each member's terms that aren't among the given ones; the bitmaps of those are not read out."""
    return _members(index, index.bitmaps.where(~F.col("term").isin(but)), "term").select("member", "term")


def grams(text: Column) -> Column:
    """The distinct runs of GRAM characters of the lower-cased text; none in a shorter one."""
    places = F.when(F.length(F.lower(text)) >= GRAM, F.sequence(F.lit(1), F.length(F.lower(text)) - (GRAM - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(F.lower(text), i, F.lit(GRAM))))


def build_grams(docs: DataFrame, path: str) -> Index:
    """The index of the trigrams of docs (id, text).

    A task turns a slice of texts at once into lists of places, one for each trigram and bucket, two bytes a text, which are
    shuffled by trigram and bucket and put together in order. Long texts are cut into pieces that overlap.
    """
    held = docs.where("id is not null and text is not null")
    numbers = _numbered(held.select(F.col("id").alias("member")).distinct(), path)
    texts = held.join(numbers, F.col("id") == F.col("member")).select("number", F.lower("text").alias("text"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slices() -> Iterator[tuple[list, list]]:
            numbers, pieces, size = [], [], 0
            for batch in batches:
                for number, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    text = text.as_py()
                    for at in range(0, max(1, len(text) - GRAM + 1), SLICE):
                        numbers.append(number)
                        pieces.append(text[at : at + SLICE + GRAM - 1])
                        size += len(pieces[-1])
                        if size >= SLICE:
                            yield numbers, pieces
                            numbers, pieces, size = [], [], 0
            yield numbers, pieces

        for numbers, pieces in slices():
            lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
            chars = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
            if not len(chars) or lens.max() < GRAM:
                continue
            order, dense = np.unique(np.array(numbers), return_inverse=True)
            own = np.repeat(np.arange(len(lens)), lens)[: 1 - GRAM]
            whole = own == np.repeat(np.arange(len(lens)), lens)[GRAM - 1 :]
            coded = pa.array((chars[:-2] << 42 | chars[1:-1] << 21 | chars[2:])[whole]).dictionary_encode()
            grams, code = coded.dictionary.to_numpy(), coded.indices.to_numpy().astype(np.int64)
            key = code * len(order) + dense[own[whole]]
            if len(grams) * len(order) <= 64 * SLICE:
                seen = np.zeros(len(grams) * len(order), bool)
                seen[key] = True
                key = np.flatnonzero(seen)
            else:
                key = np.unique(key)
            # by trigram, by number
            code, number = key // len(order), order[key % len(order)] - 1
            begins = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(number // BUCKET, prepend=-1) != 0))
            cuts = np.append(begins, len(key)) * 2
            first = grams[code[begins]]
            terms = np.stack([first >> 42, first >> 21 & 0x1FFFFF, first & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            places = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer((number % BUCKET).astype("<u2"))])
            yield pa.RecordBatch.from_arrays([pa.array([terms[i : i + GRAM] for i in range(0, len(terms), GRAM)]), pa.array(number[begins] // BUCKET + 1), places], ["term", "bucket", "places"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lists = [], []  # of rows in order; lists: those of a key

        def bitmaps() -> pa.RecordBatch:
            bits = np.zeros((len(keys), BUCKET), bool)
            for i, places in enumerate(lists):
                bits[i, np.frombuffer(b"".join(places), "<u2")] = True
            packed = np.packbits(bits, axis=1, bitorder="little")
            made = pa.array([row.tobytes() for row in packed], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), made], ["term", "bucket", "bits"])

        for batch in batches:
            for term, bucket, places in zip(*(c.to_pylist() for c in batch.columns)):
                if not keys or keys[-1] != (term, bucket):
                    if len(keys) >= AT_ONCE:
                        yield bitmaps()
                        keys, lists = [], []
                    keys.append((term, bucket))
                    lists.append([])
                lists[-1].append(places)
        if keys:
            yield bitmaps()

    lists = texts.sortWithinPartitions("number").mapInArrow(found, "term string, bucket long, places binary")
    dealt = lists.repartition("term", "bucket").sortWithinPartitions("term", "bucket")
    dealt.mapInArrow(together, "term string, bucket long, bits binary").write.mode("overwrite").parquet(f"{path}/bitmaps")
    return load(docs.sparkSession, path)


def containing(index: Index, docs: DataFrame, keywords: DataFrame) -> DataFrame:
    """(query_id, id): the docs (id, text) whose text holds the keyword of each query (query_id, keyword), any case.

    Docs that have all of a keyword's trigrams are looked at; a keyword of under GRAM characters has none, so all docs are. Null
    texts and keywords hold nothing, and the empty keyword is in every text.
    """
    asked = keywords.select("query_id", F.lower("keyword").alias("word")).where("word is not null")
    long = asked.where(F.length("word") >= GRAM)
    found = with_all(index, long.select("query_id", F.explode(grams(F.col("word"))).alias("term"))).join(long, "query_id")
    docs = docs.select(F.col("id").alias("member"), F.lower("text").alias("text"))
    words = found.groupBy("member").agg(F.collect_list(F.struct("query_id", "word")).alias("words"))  # a text meets its words once
    checked = words.join(docs, "member").select("member", F.explode(F.filter("words", lambda w: F.contains("text", w["word"]))).alias("w"))
    short = docs.join(F.broadcast(asked.where(F.length("word") < GRAM)), F.lit(True)) if asked.where(F.length("word") < GRAM).take(1) else None  # a stated set of words
    both = checked.select("w.query_id", F.col("member").alias("id"))
    return both if short is None else both.unionByName(short.where(F.contains("text", "word")).select("query_id", F.col("member").alias("id")))
