"""A keyed table in buckets: a merge rewrites the buckets that it touches, and a pointer file commits them at once."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a new table, and pointers that are kept besides the last one.
BUCKETS, KEPT = 64, 1


class BucketedTable:
    """The latest version of each key, under `path`, in any store that Spark reads.

    data/<write>/bucket_=<b> has the rows of a bucket as one write left them; commits/<n>.json tells which write each bucket
    stands at, how many buckets there are, and the last batch merged. Files that no pointer names are no part of the
    table: a write that ended before its pointer was put in place changes nothing, and is done again.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], version: str, buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.version, self.buckets = spark, path.rstrip("/"), keys, version, buckets
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _commits(self) -> list[int]:
        """Numbers of the pointers; a pointer is renamed to its name when it is whole."""
        at = self._at("commits")
        names = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def pointer(self) -> dict:
        """The last pointer: at (bucket to write), schema (as JSON), batch, buckets; an empty one before the first merge."""
        numbers = self._commits()
        if not numbers:
            return {"number": 0, "at": {}, "schema": None, "batch": -1, "buckets": self.buckets}
        text = self.spark.read.text(f"{self.path}/commits/{numbers[-1]}.json", wholetext=True).first()[0]
        return json.loads(text) | {"number": numbers[-1]}

    def read(self) -> DataFrame | None:
        """The table; None before the first merge."""
        return self._rows(self.pointer())

    def _rows(self, pointer: dict, only: list[int] | None = None) -> DataFrame | None:
        from pyspark.sql.types import StructType

        if pointer["schema"] is None:
            return None
        schema = StructType.fromJson(json.loads(pointer["schema"]))
        paths = [f"{self.path}/data/{write}/bucket_={b}" for b, write in pointer["at"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _latest(self, old: DataFrame | None, new: DataFrame) -> DataFrame:
        """The row of the largest version of each key; of equal ones the new table's. Rows are summed up before the shuffle."""
        columns = new.columns
        both = new.withColumn("new_", F.lit(1))
        both = both if old is None else old.withColumn("new_", F.lit(0)).unionByName(both)
        row = F.max_by(F.struct(*[f"`{c}`" for c in columns]), F.struct(F.col(f"`{self.version}`").alias("v"), "new_"))
        return both.groupBy(*[f"`{k}`" for k in self.keys]).agg(row.alias("row_")).select("row_.*").select(*[f"`{c}`" for c in columns])

    def merge(self, batch: DataFrame, number: int, before_commit=None) -> list[int]:
        """Merges a batch; the numbers of the buckets that were rewritten. A batch whose number was committed is left out, so a
        retried one counts once. A null key is a key; a null version is the least. before_commit is called between write and
        commit (for tests)."""
        now = self.pointer()
        if number <= now["batch"]:
            return []
        count = now["buckets"]
        batch = batch.select(*batch.columns)
        bucket = F.pmod(F.xxhash64(*[f"`{k}`" for k in self.keys]), F.lit(count)).cast("int")
        batch.persist()
        try:
            touched = sorted(r[0] for r in batch.select(bucket).distinct().collect())  # at most `buckets` numbers
            write = f"{number}-{uuid.uuid4().hex}"
            if touched:
                old = self._rows(now, touched)
                merged = self._latest(old, batch).withColumn("bucket_", bucket)
                merged.repartition("bucket_").write.partitionBy("bucket_").parquet(f"{self.path}/data/{write}")
            if before_commit:
                before_commit()
            stale = {b: now["at"][str(b)] for b in touched if str(b) in now["at"]}
            at = now["at"] | {str(b): write for b in touched}
            self._commit(now["number"] + 1, {"at": at, "schema": json.dumps(batch.schema.jsonValue()), "batch": number, "buckets": count})
        finally:
            batch.unpersist()
        for b, old_write in stale.items():
            self._fs.delete(self._at(f"data/{old_write}/bucket_={b}"), True)
        for old_number in self._commits()[: -1 - KEPT]:
            self._fs.delete(self._at(f"commits/{old_number}.json"), False)
        return touched

    def _commit(self, number: int, pointer: dict) -> None:
        draft, name = self._at(f"commits/_{uuid.uuid4().hex}"), self._at(f"commits/{number}.json")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(pointer).encode()))
        stream.close()
        if self._fs.exists(name) or not self._fs.rename(draft, name):
            self._fs.delete(draft, False)
            raise RuntimeError(f"{self.path}: another writer has committed {number}")

    def vacuum(self) -> None:
        """Removes writes that no pointer names: what crashes before a commit have left. Not beside a running merge."""
        named, data = {w for w in self.pointer()["at"].values()}, self._at("data")
        for f in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if f.getPath().getName() not in named:
                self._fs.delete(f.getPath(), True)
