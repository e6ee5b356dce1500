"""A cache with time to live as streaming state: entries are stored, refreshed, invalidated and expire in event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ENTRY = "at long, definition string, expires long, gone long"
_CHANGE = "term string, source string, definition string, at long, expires long, status string, changed long"
#: Of changes at one instant the later in this list holds.
STATUS = ["stored", "refreshed", "invalidated", "expired"]
#: Before any time.
NEVER = -(2**62)


class TtlCache(StatefulProcessor):
    """A term's entries by source: the newest put, and the newest time at which it was invalidated; one more such time for all
    sources. Both only grow, so the state is the same for any order and any batches of the rows that the watermark lets
    in. An entry is live while it is newer than its invalidations; its timer takes it away when the watermark passes its
    end, and an invalidation's timer forgets it when no older put can come.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "source string", _ENTRY)
        self.all_gone = handle.getValueState("all_gone", "gone long")

    def close(self) -> None:
        pass

    @staticmethod
    def _live(entry: tuple, gone: int) -> bool:
        return entry[0] is not None and entry[0] > max(entry[3], gone)

    def _timer(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.all_gone.get()
        before = after = held[0] if held else NEVER
        puts: dict[str, tuple] = {}
        gone: dict[str, int] = {}
        for chunk in rows:  # folded as they stream; a term's rows are never held together
            for source, definition, at, expires, removed in zip(chunk["source"], chunk["definition"], chunk["at_"], chunk["expires_"], chunk["gone"]):
                if removed and source is None:
                    after = max(after, at)
                elif removed:
                    gone[source] = max(gone.get(source, NEVER), at)
                else:
                    puts[source] = max(puts.get(source, (NEVER, "", 0)), (int(at), definition, int(expires)))
        touched = set(puts) | set(gone)
        if after > before:
            self.all_gone.update((int(after),))
            self._timer(int(after))
            touched |= {k[0] for k in self.entries.keys()}
        changes = []
        for source in sorted(touched):
            old = tuple(self.entries.getValue((source,)) or (None, None, None, NEVER)) if self.entries.containsKey((source,)) else (None, None, None, NEVER)
            at, definition, expires = max((old[0] if old[0] is not None else NEVER, old[1] or "", old[2] or 0), puts.get(source, (NEVER, "", 0)))
            new = (None if at == NEVER else at, definition, expires, max(int(gone.get(source, NEVER)), old[3]))
            last = max(new[3], after)
            was, now = self._live(old, before), self._live(new, after)
            stays = was and old[0] > last  # an entry that was invalidated and put again is stored anew
            if new[3] > old[3]:
                self._timer(new[3])
            if was and not stays:
                changes.append((key[0], source, old[1], old[0], old[2], "invalidated", last))
            if now and new[:3] != old[:3]:
                changes.append((key[0], source, definition, at, expires, "refreshed" if stays else "stored", at))
                self._timer(expires)
            if not now:
                new = (None, None, None, new[3])
            if new[0] is None and new[3] == NEVER:
                self.entries.removeKey((source,))
            elif new != old:
                self.entries.updateValue((source,), new)
        yield self._frame(changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = self.all_gone.get()
        changes = []
        for source, (at, definition, expires, gone) in [(k[0], tuple(v)) for k, v in self.entries.iterator()]:
            if at is not None and expires <= passed:
                changes.append((key[0], source, definition, at, expires, "expired", expires))
                at = definition = expires = None
            left = gone if gone > passed else NEVER
            if at is None and left == NEVER:
                self.entries.removeKey((source,))
            else:
                self.entries.updateValue((source,), (at, definition, expires, left))
        if held and held[0] <= passed:
            self.all_gone.clear()
        yield self._frame(changes)

    @staticmethod
    def _frame(changes: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(changes, columns=["term", "source", "definition", "at", "expires", "status", "changed"])


def cache_changes(rows: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(term, source, definition, at, expires, status, changed): what becomes of the entries of a stream of puts and
    invalidations (term, source, definition, at, ttl in seconds, gone), status one of STATUS.

    Terms are trimmed and lower-cased. A row with gone invalidates what was put at its time or before, for one source or,
    with a null source, for all. Of puts at one time the larger definition holds. Puts without a source or time or with a
    ttl that isn't over 0 are left out, a null definition is empty. Rows older than the watermark are dropped. The session's
    state store must be RocksDB (`rocksdb`).
    """
    at = F.unix_micros("at")
    ends = (at + F.col("ttl").cast("double") * 1_000_000).cast("long")
    gone = F.coalesce("gone", F.lit(False))
    used = rows.where("term is not null and at is not null").where(gone | (F.col("source").isNotNull() & (F.col("ttl") > 0)))
    keyed = used.select(
        F.lower(F.trim("term")).alias("term"), "source", F.coalesce("definition", F.lit("")).alias("definition"), F.col("at"),
        at.alias("at_"), F.coalesce(F.when(~gone, ends), F.lit(0)).alias("expires_"), gone.alias("gone"),
    )
    found = keyed.withWatermark("at", late).groupBy("term").transformWithStateInPandas(TtlCache(), _CHANGE, "Append", "EventTime")
    times = {c: F.timestamp_micros(c) for c in ("at", "expires", "changed")}
    return found.withColumns(times)


def held(changes: DataFrame, now) -> DataFrame:
    """(term, source, definition, at, expires) of the entries that are valid at `now`, from all changes so far."""
    rank = F.array_position(F.array(*map(F.lit, STATUS)), F.col("status"))
    last = changes.groupBy("term", "source").agg(F.max_by(F.struct("definition", "at", "expires", "status"), F.struct("changed", rank, "definition")).alias("e"))
    return last.where(F.col("e.status").isin("stored", "refreshed") & (F.col("e.expires") > now)).select("term", "source", "e.definition", "e.at", "e.expires")


def rocksdb(spark: SparkSession) -> None:
    """Sets the state store that a query started after this uses; a restarted one keeps its own."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def cache_into(rows: DataFrame, path: str, checkpoint: str, late: str = "10 minutes"):
    """A query that appends the changes to the Parquet files under path."""
    spark = rows.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    rocksdb(spark)
    try:
        return cache_changes(rows, late).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
