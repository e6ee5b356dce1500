"""Large tables cut to the rows that a query goes on with, before anything shuffles them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct ids that may go to every task; of more, table and ids are dealt by id.
FEW_IDS = 1_000_000


def kept(df: DataFrame) -> DataFrame:
    """df from a checkpoint, or persisted in a session without a folder for them: what is looked at twice isn't run twice."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def among(rows: DataFrame, key: str, ids: DataFrame, id_col: Column | str, few: int = FEW_IDS) -> DataFrame:
    """The rows whose key is one of ids, which is counted here and so better stored. Up to `few` distinct ids go to every task, so that
    rows are dropped where they are read; more are met by a shuffle, by the key that a join with them deals the rows by anyway."""
    wanted = ids.select((F.col(id_col) if isinstance(id_col, str) else id_col).alias(key)).where(F.col(key).isNotNull()).distinct()
    return rows.join(F.broadcast(wanted) if wanted.limit(few + 1).count() <= few else wanted, key, "left_semi")
