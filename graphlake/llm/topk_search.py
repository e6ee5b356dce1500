"""Exact top-k by inner product: MaxScore over dimension postings, in blocks of queries against shards of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphlake.llm import common

#: Vectors of a shard, queries of a block, at most about: a task holds one of each. Small tables get smaller shards, one a core.
SHARD_ROWS, BLOCK_QUERIES, LEAST_SHARD = 32_768, 16_384, 4_096
#: Vectors whose postings are traversed before the threshold is raised again; non-essential terms that are probed at once.
CHUNK, PROBED = 4_096, 8
#: Share of the threshold that the non-essential terms may add at most; at 1, partial scores would decide little.
SLACK = 0.5
#: Vectors of all shards that every task scores first, for a threshold to begin with.
PIVOTS = 1_024
_EXACT = float(2**53)


def scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(row_no long, vec_id long, v array<long>), stored: floor(scale * x) of each component, x as double.

    Rows whose id or vector is null, or that hold a null or non-finite component, take no part. Rows may repeat: row_no
    tells them apart. Further columns are not looked at.
    """
    usable = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    found = (
        vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & usable)
        .select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
        .withColumn("row_no", F.monotonically_increasing_id())
    )
    return common.written(found.select("row_no", "vec_id", "v"), "vectors")


class Postings:
    """The terms are the dimensions. A term's postings are the vectors where it isn't 0 and its values there, or all values where
    most are not 0; high and low bound a term's values, norm every vector's length."""

    def __init__(self, vectors: np.ndarray):
        self.n = len(vectors)
        self.high, self.low = (f(axis=0, initial=0).astype(np.float64) for f in (vectors.max, vectors.min))
        self.norm = float(np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))
        self.lists = []
        for column in vectors.T.astype(np.float64):
            at = np.flatnonzero(column)
            self.lists.append((at, column[at]) if 2 * len(at) < self.n else (None, np.ascontiguousarray(column)))

    def add(self, score: np.ndarray, term: int, weight: float, first: int) -> None:
        """Adds a term's products to the scores of the vectors from first on."""
        at, values = self.lists[term]
        if at is None:
            score += weight * values[first : first + len(score)]
        else:
            a, b = np.searchsorted(at, (first, first + len(score)))
            score[at[a:b] - first] += weight * values[a:b]

    def probe(self, term: int, rows: np.ndarray) -> np.ndarray:
        at, values = self.lists[term]
        if at is None:
            return values[rows]
        place = np.minimum(np.searchsorted(at, rows), max(0, len(at) - 1))
        return np.where(at[place] == rows, values[place], 0) if len(at) else np.zeros(len(rows))


def best_of(query: np.ndarray, index: Postings, ids: np.ndarray, own: int, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, score) of the k best for one query, ties to the smaller id, and how many postings were looked at. own: the row that
    is left out, or -1; floor: only scores above it count. ids ascend.

    Terms in falling order of their bounds: the essential ones are those without which the others, by the sum of their bounds
    or by the length of what is left of the query times the longest vector, add more than SLACK of the threshold. The
    essential terms' postings are traversed; the others are probed, while a vector's score and what may come still exceed the
    threshold. A query whose bounds can't reach it looks at nothing.
    """
    bound = np.maximum(query * index.high, query * index.low)
    order = np.argsort(-bound, kind="stable")
    sums = np.append(np.cumsum(bound[order][::-1])[::-1], 0)
    lengths = np.append(np.sqrt(np.cumsum((query[order] ** 2)[::-1])[::-1]), 0) * index.norm
    rest = np.minimum(sums, lengths * (1 + 1e-12))
    rows, scores, limit, looked = np.zeros(0, np.int64), np.zeros(0), floor, 0
    for first in range(0, index.n, CHUNK):
        if rest[0] <= limit:
            break
        essential = int(np.argmax(rest <= SLACK * max(limit, 0)))
        part = np.zeros(min(CHUNK, index.n - first))
        for term in order[:essential]:
            index.add(part, term, query[term], first)
        looked += essential * len(part)
        if 0 <= own - first < len(part):
            part[own - first] = -np.inf
        found = np.flatnonzero(part + rest[essential] > limit)
        score = part[found]
        for at in range(essential, len(order), PROBED):
            looked += len(found) * len(order[at : at + PROBED])
            for term in order[at : at + PROBED]:
                score = score + query[term] * index.probe(term, found + first)
            keep = score + rest[min(at + PROBED, len(order))] > limit
            found, score = found[keep], score[keep]
        keep = score > limit
        rows, scores = np.concatenate([rows, found[keep] + first]), np.concatenate([scores, score[keep]])
        if len(rows) > k:
            top = np.lexsort((ids[rows], -scores))[:k]
            rows, scores = rows[top], scores[top]
        if len(rows) == k:
            limit = max(limit, scores.min())
    top = np.lexsort((ids[rows], -scores))
    return rows[top], scores[top].astype(np.int64), looked


def maxscore(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, floors: np.ndarray | None = None):
    """(query, row, score) of the k best of each query among vectors, whose ids ascend."""
    index = Postings(vectors)
    largest = np.abs(queries).astype(np.float64).sum(axis=1).max(initial=0) * max(np.abs(index.high).max(initial=0), np.abs(index.low).max(initial=0))
    if largest >= _EXACT:
        raise OverflowError("scores need more than 53 bits; lower the scale")
    found = [best_of(q.astype(np.float64), index, ids, int(o), k, -np.inf if floors is None else floors[i])[:2] for i, (q, o) in enumerate(zip(queries, own))]
    number = np.repeat(np.arange(len(found)), [len(r) for r, _ in found])
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return number, join([r for r, _ in found]), join([s for _, s in found])


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.int64()))
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of vectors of largest inner product with each row of queries, itself left out.

    vectors are as of scaled(), queries some of its rows. Vectors are dealt by hash to shards, queries to blocks; each pair of
    block and shard is one bounded task, which returns k rows a query at most, and the shards' lists are merged. A query's
    k-th best among PIVOTS vectors, which every task has, is the threshold that every shard begins with. Ties go to the
    smaller vec_id; rows may repeat in id, vector or both, each with ranks of its own; fewer candidates than k give fewer rows;
    empty input gives none. Vectors of other lengths count as padded with zeros.
    """
    spark = vectors.sparkSession
    n, m = vectors.count(), queries.count()
    shards = max(1, -(-n // SHARD_ROWS), min(-(-n // LEAST_SHARD), spark.sparkContext.defaultParallelism))
    blocks = max(1, -(-m // BLOCK_QUERIES))
    pivots = vectors.orderBy(F.xxhash64("row_no"), "row_no").limit(PIVOTS).select("row_no", "v").toArrow()  # PIVOTS rows
    widest = lambda column: max([1, *(x.value_lengths().to_numpy(zero_copy_only=False).max(initial=0) for x in column.chunks)])
    shared = spark.sparkContext.broadcast((pivots.column("row_no").to_numpy(), matrix(pivots.column("v"), widest(pivots.column("v")))))
    part = lambda count: F.pmod(F.xxhash64("row_no"), F.lit(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = vectors.select("row_no", "vec_id", "v", part(shards).alias("shard"), each(blocks).alias("block"))
    right = queries.select("row_no", "vec_id", "v", part(blocks).alias("block"), each(shards).alias("shard"))

    def search(shard: pa.Table, block: pa.Table) -> pa.Table:
        names = ["query_no", "query_id", "vec_id", "score"]
        if "v" not in shard.schema.names or "v" not in block.schema.names or not len(shard) or not len(block):  # no such group
            return pa.table([pa.array([], pa.int64())] * 4, names)
        pivot_no, pivots = shared.value
        shard = shard.sort_by([("vec_id", "ascending"), ("row_no", "ascending")])
        width = max(pivots.shape[1], widest(shard.column("v")), widest(block.column("v")))
        query_no, asked, row_no = block.column("row_no").to_numpy(), matrix(block.column("v"), width), shard.column("row_no").to_numpy()
        floors = np.full(len(asked), -np.inf)
        known = np.pad(pivots, ((0, 0), (0, width - pivots.shape[1]))).astype(np.float64)
        for at in range(0, len(asked) if len(known) > k else 0, 1_024):
            scores = asked[at : at + 1_024].astype(np.float64) @ known.T
            scores[query_no[at : at + 1_024, None] == pivot_no[None, :]] = -np.inf
            # scores are whole numbers: what is above half a point less reaches the k-th of the pivots
            floors[at : at + 1_024] = np.partition(scores, -k, axis=1)[:, -k] - 0.5
        place = np.argsort(row_no, kind="stable")
        at = np.minimum(np.searchsorted(row_no[place], query_no), len(row_no) - 1)
        own = np.where(row_no[place[at]] == query_no, place[at], -1)
        ids = shard.column("vec_id").to_numpy()
        number, rows, scores = maxscore(asked, own, matrix(shard.column("v"), width), ids, k, floors)
        return pa.table([query_no[number], block.column("vec_id").to_numpy()[number], ids[rows], scores], names)

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(search, "query_no long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query_no").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
