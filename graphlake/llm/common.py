"""Shared helpers: reading tables, cutting lineage in the shared folder, sizes of work."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a lookup table that may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Bytes of such a table's texts and lists, as JSON.
BROADCAST_BYTES = 64 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, `spark.checkpoint.dir`. Where it is unset, a local session gets a temporary one; on a
    cluster that is an error, because executors would not see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='graphlake-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: later stages start from the files, so a lost
    executor costs no recomputation of what came before. The files go when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def arrow_batches(spark: SparkSession, megabytes: int = 8) -> None:
    """Bounds the Arrow batches that go to Python by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(500 * megabytes))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def give_back() -> None:
    """Returns the memory that a Python worker has freed to the system: idle workers would hold it beside the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint only for a side that was counted and is within the limits of rows and of bytes of its texts and lists."""
    if rows > limit:
        return df
    wide = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))]
    if wide:
        size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*wide))).cast("long"))).first()[0] or 0
        if size > most:
            return df
    return F.broadcast(df)


def lower_ascii(column) -> Column:
    """Lower-cases A-Z alone. Texts without other capitals take the engine's own, faster lower()."""
    column = F.col(column) if isinstance(column, str) else column
    other_capitals = F.rlike(column, F.lit(r"[[^\x00-\x7F]&&[\p{IsUppercase}\p{Lt}]]"))
    plain = F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(other_capitals, plain).otherwise(F.lower(column))


def same_doc(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of the keys of two tables."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & a[key].eqNullSafe(b[key])
    return condition
