"""Token-id output: concatenated ids with Elias-Fano document boundaries, written and read by Spark.

A file image (little-endian): magic b"GLEF", u8 bytes of an id, then u64 documents n, u64 ids u, u8 low bits l, the
document ids as another Elias-Fano sequence, the low bits of the n boundaries packed l bits each, the high bits in
unary, and the ids. Images are rows of a Parquet table in the shared folder, so every executor can read every one.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphlake.llm import common, subwords

#: Ids of an image, about: a document is never split, so a longer one makes a longer image.
IMAGE_IDS = 4 << 20
#: Documents whose offsets are selected at once when an image is read.
PAGE_DOCS = 1_024
MAGIC = b"GLEF"


class EliasFano:
    """A non-decreasing sequence of n numbers below u in about n * (2 + log2(u / n)) bits, and a select directory of 32 bits
    for each BLOCK of its unary bits."""

    BLOCK = 64

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        full = len(high) // self.BLOCK * self.BLOCK
        ones = np.bitwise_count(high[:full].reshape(-1, self.BLOCK)).sum(axis=1, dtype=np.uint32)
        self.before = np.concatenate([[0], ones.cumsum(dtype=np.uint32)]).astype(np.uint32)

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) + 1 if len(values) else 1
        l = max(0, (top // n).bit_length() - 1) if n else 0  # noqa: E741
        bits = (values[:, None] >> np.arange(l, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(l)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, l, low, np.packbits(unary, bitorder="little"))

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple["EliasFano", int]:
        n, l, low, high = struct.unpack_from("<QBQQ", data, at)  # noqa: E741
        at += struct.calcsize("<QBQQ")
        return cls(n, l, np.frombuffer(data, np.uint8, low, at), np.frombuffer(data, np.uint8, high, at + low)), at + low + high

    def select(self, first: int, last: int) -> np.ndarray:
        """The numbers of ranks first to last - 1: only the blocks of unary bits and the low parts that hold them are looked at."""
        if first >= last:
            return np.zeros(0, np.int64)
        block = int(np.searchsorted(self.before, first, side="right")) - 1
        stop = int(np.searchsorted(self.before, last, side="left"))
        skip = first - int(self.before[block])
        bits = np.unpackbits(self.high[block * self.BLOCK : stop * self.BLOCK], bitorder="little")
        ones = np.flatnonzero(bits)[skip : skip + last - first] + block * self.BLOCK * 8
        low = np.zeros(last - first, np.int64)
        if self.low_bits:
            at = first * self.low_bits
            bits = np.unpackbits(self.low[at // 8 : -(-last * self.low_bits // 8)], bitorder="little")[at % 8 :][: len(low) * self.low_bits]
            low = (bits.reshape(-1, self.low_bits).astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)
        return ((ones - np.arange(first, last)) << self.low_bits) | low


def pack_image(doc_ids: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> bytes:
    """doc_ids ascend; ends: the ids up to the end of each document."""
    base = int(doc_ids[0])
    keys, bounds = EliasFano.of((doc_ids - base).astype(np.uint64)), EliasFano.of(ends)
    return MAGIC + struct.pack("<Bq", ids.dtype.itemsize, base) + keys.to_bytes() + bounds.to_bytes() + ids.tobytes()


def unpack_image(image: bytes) -> tuple[int, EliasFano, EliasFano, np.ndarray]:
    """The least doc_id, the doc_ids less that one, the documents' ends, and all ids."""
    data = memoryview(image)
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    width, base = struct.unpack_from("<Bq", data, 4)
    keys, at = EliasFano.read(data, 4 + struct.calcsize("<Bq"))
    bounds, at = EliasFano.read(data, at)
    return base, keys, bounds, np.frombuffer(data, f"<u{width}", offset=at)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Encodes every whole text (null: empty) with the end id after it, and writes file images in ascending doc_id order.

    Returns the written table (part int, image_no int, has_null boolean, docs long, ids long, image binary). Rows of equal
    doc_id are ordered by their text's hash and kept; null doc_ids come first, in images of their own. Texts are dealt by
    range of (doc_id, hash, number of the row), so a doc_id or a row that repeats without end is still split; each task
    streams its sorted range into images of about IMAGE_IDS ids. Further columns are not looked at.
    """
    spark = docs.sparkSession
    common.arrow_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    salted = rows.withColumn("h", F.xxhash64("text")).withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)))
    dealt = salted.repartitionByRange(F.asc_nulls_first("doc_id"), "h", "salt")
    dealt = dealt.sortWithinPartitions(F.asc_nulls_first("doc_id"), "h").select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = subwords.load(tokenizer)
        part, held, number, null = 0, [], 0, False

        def flush():
            nonlocal number, held
            keys = np.concatenate([x for x, _, _ in held])
            lengths = np.concatenate([x for _, x, _ in held])
            ids = np.concatenate([x for _, _, x in held])
            number += 1
            image = pack_image(keys, np.cumsum(lengths), ids)
            held = []
            values = (part, number, null, len(keys), len(ids), image)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, SCHEMA.types, strict=True)], SCHEMA.names)

        for batch in batches:
            texts = batch.column(2)
            for first, last in encoder.slices(texts):
                ids, cuts = encoder.encode(texts.slice(first, last - first))
                keys = batch.column(1).slice(first, last - first)
                part = batch.column(0)[0].as_py()
                ended, cuts = np.insert(ids, cuts[1:], end_id), cuts + np.arange(len(cuts))
                nulls = keys.null_count
                keys = keys.fill_null(0).to_numpy()
                at = 0
                for stop, is_null in ((nulls, True), (len(keys), False)):
                    while at < stop:
                        if held and null != is_null:
                            yield flush()
                        null = is_null
                        room = IMAGE_IDS - sum(len(x) for _, _, x in held)
                        upto = min(stop, max(at + 1, int(np.searchsorted(cuts, cuts[at] + room, side="right")) - 1))
                        held.append((keys[at:upto], np.diff(cuts[at : upto + 1]), ended[cuts[at] : cuts[upto]]))
                        at = upto
                        if sum(len(x) for _, _, x in held) >= IMAGE_IDS or at < stop:
                            yield flush()
        if held:
            yield flush()
        subwords.forget()
        common.give_back()

    SCHEMA = pa.schema([("part", pa.int32()), ("image_no", pa.int32()), ("has_null", pa.bool_()), ("docs", pa.int64()), ("ids", pa.int64()), ("image", pa.binary())])
    made = dealt.mapInArrow(images, "part int, image_no int, has_null boolean, docs long, ids long, image binary")
    return common.written(made, "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the written files; start counts the ids before it in all.

    The ids before an image come from the images' totals: a window within each part, and one over the parts' sums, a row
    per part. Boundaries and doc_ids come from the Elias-Fano sequences by select, a page of documents at a time.
    """
    common.arrow_batches(files.sparkSession)
    sums = files.groupBy("part").agg(F.sum("ids").alias("of_part"))
    parts = sums.select("part", F.coalesce(F.sum("of_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("image_no").rowsBetween(Window.unboundedPreceding, -1)
    heads = files.select("part", "image_no", F.coalesce(F.sum("ids").over(within), F.lit(0)).alias("in_part"))
    starts = heads.join(parts, "part").select("part", "image_no", (F.col("in_part") + F.col("part_start")).alias("first"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "image_no", "doc_id", "local", "n_tokens", "ids_crc32"]
        for batch in batches:
            for i in range(batch.num_rows):
                base, keys, bounds, ids = unpack_image(batch.column(3)[i].as_buffer())
                before = 0
                for first in range(0, keys.n, PAGE_DOCS):
                    last = min(keys.n, first + PAGE_DOCS)
                    ends = bounds.select(first, last)
                    begins = np.concatenate([[before], ends[:-1]])
                    before = int(ends[-1])
                    crcs = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(begins.tolist(), ends.tolist())]
                    n = last - first
                    key = pa.nulls(n, pa.int64()) if batch.column(2)[i].as_py() else pa.array(keys.select(first, last) + base, pa.int64())
                    fixed = [pa.array(np.full(n, batch.column(j)[i].as_py(), np.int32)) for j in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*fixed, key, pa.array(begins, pa.int64()), pa.array(ends - begins, pa.int64()), pa.array(crcs, pa.int64())], names)
        common.give_back()

    found = files.select("part", "image_no", "has_null", "image").mapInArrow(documents, "part int, image_no int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["part", "image_no"]).select("doc_id", (F.col("first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
