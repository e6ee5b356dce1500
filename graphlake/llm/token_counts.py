"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm import common, subwords


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every whole text.

    A map over Arrow batches without a shuffle: a batch is worked on in slices of equal bytes, long texts are cut at
    white space, and only lengths go back. Null text: no bytes, no tokens. Rows repeat as they do in the input; ids may
    be null or repeat; other columns are ignored.
    """
    common.arrow_batches(docs.sparkSession)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = subwords.load(tokenizer)
        for batch in batches:
            counts = pa.array(encoder.lengths(batch.column(2)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], ["id", "n_bytes", "n_tokens"])
        subwords.forget()
        common.give_back()

    n_bytes = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    kind = docs.schema[id_col].dataType.simpleString()
    return (
        docs.select(F.col(id_col).alias("id"), n_bytes.alias("n_bytes"), F.col(text_col).alias("text"))
        .mapInArrow(lengths, f"id {kind}, n_bytes long, n_tokens long")
        .withColumnRenamed("id", id_col)
    )


def with_limit(counts: DataFrame, limit: int = 2048) -> DataFrame:
    """Adds over_limit: n_tokens > limit."""
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
