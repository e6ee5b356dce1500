"""Vector search by a stored inverted file: lists of unit vectors around centroids, in blocks with bounds, searched exactly.

A vector's cosine with a question q is q.c + q.(v - c) for the centroid c of its list, and the second part is at most the
distance of v and c. So a block of vectors no farther than r from c holds no cosine over q.c + r. Vectors are blocked by
list and distance; a question reads its nearest lists first, and then only blocks whose bound reaches its k-th best score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphlake.operators import retrieval

#: Vectors of a block and questions that meet it at once; vectors of a list that k-means learns from; the most lists (their centroids go
#: to every task: 4,096 of 1,024 components are 32 MB); rings that the distances of a list are cut to.
BLOCK, PACK, SAMPLE, MOST_LISTS, RINGS = 1_024, 512, 64, 4_096, 8
#: Bytes of questions that go to every shard of the blocks at once.
BROADCAST_BYTES = 32 << 20
#: Scores are compared to this many digits, so a bound must miss by more than rounding.
DIGITS, SLACK = 6, 2e-6
#: Null and zero vectors: no list's centroid is near them, and their score is 0.
NOWHERE = -1
#: Stands for a null id in tasks; it is before all others.
NO_ID = -(1 << 63)


@dataclass
class Index:
    """centroids: (list, unit sum) as an array, row i of list i; blocks: the stored table."""

    centroids: np.ndarray
    blocks: DataFrame


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; null, of another length or not finite: zeros."""
    out = np.zeros((len(column), width))
    lengths = pc.fill_null(column.value_lengths(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null component: NaN
    rows = np.flatnonzero(lengths == width)
    out[rows] = values[(np.cumsum(np.maximum(lengths, 0)) - lengths)[rows, None] + np.arange(width)]
    out[~np.isfinite(out).all(axis=1)] = 0
    return out


def _units(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def centroids(vectors: DataFrame, lists: int, width: int, seed: int = 17) -> np.ndarray:
    """Spark's k-means on unit vectors of at most about SAMPLE vectors a list, drawn by a hash of the id."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    keep = min(1.0, SAMPLE * lists / max(1, n))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    drawn = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 20)) < keep * (1 << 20))
    unit = drawn.where((F.size("embedding") == width) & (norm > 0) & (norm < float("inf"))).select(F.transform("embedding", lambda x: x.cast("double") / norm).alias("v"))
    rows = unit.select(array_to_vector("v").alias("features")).cache()
    try:
        some = rows.distinct().take(2)
        if len(some) < 2:  # k-means needs two different vectors
            return np.array([r.features.toArray() for r in some]).reshape(len(some), width)
        model = KMeans(k=max(2, lists), maxIter=10, seed=seed, initSteps=1).fit(rows)
        return np.array(model.clusterCenters())
    finally:
        rows.unpersist()


def build(vectors: DataFrame, path: str, lists: int | None = None) -> Index:
    """Stores the index of vectors (vec_id, embedding) under path: every row is in one block.

    lists: about the root of the vectors, MOST_LISTS at most. blocks: (list int, ring int, radius double, ids array<long>,
    units binary of little-endian doubles), at most BLOCK vectors each. Null, zero and misfit vectors are in a list of
    their own with radius 0. Repeated ids are kept, each a candidate.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    width = max(1, size.width or 1)
    lists = min(MOST_LISTS, lists or max(2, round(max(1, size.n) ** 0.5)))
    centres = centroids(rows, lists, width)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _units(_matrix(batch.column(1), width))
            some = units.any(axis=1) & (len(centres) > 0)
            near, far = np.full(len(units), NOWHERE, np.int32), np.zeros(len(units))
            if some.any():
                apart = (centres**2).sum(axis=1) - 2 * units[some] @ centres.T
                near[some] = apart.argmin(axis=1)
                far[some] = np.linalg.norm(units[some] - centres[near[some]], axis=1)
            ring = np.minimum(RINGS - 1, (far * RINGS / 1.5).astype(np.int32)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(near), pa.array(ring), pa.array(far), batch.column(0), pa.array([u.tobytes() for u in units.astype("<f8")], pa.binary())], ["list", "ring", "far", "vec_id", "unit"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, units, most = None, [], [], 0.0

        def flush():
            nonlocal ids, units, most
            values = ([key[0]], [key[1]], [most], [ids], [b"".join(units)])
            ids, units, most = [], [], 0.0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.int64()), pa.binary()))], ["list", "ring", "radius", "ids", "units"])

        for batch in batches:
            for near, ring, far, number, unit in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and ((near, ring) != key or len(ids) >= BLOCK):
                    yield flush()
                key, most = (near, ring), max(most, far)
                ids.append(number)
                units.append(unit)
        if ids:
            yield flush()

    # ranges split a list of any size over tasks
    dealt = rows.mapInArrow(assigned, "list int, ring int, far double, vec_id long, unit binary").repartitionByRange("list", "ring", "vec_id").sortWithinPartitions("list", "ring", "vec_id")
    dealt.mapInArrow(blocks, "list int, ring int, radius double, ids array<long>, units binary").write.mode("overwrite").parquet(f"{path}/blocks")
    spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(centres)], "list int, centroid array<double>").write.mode("overwrite").parquet(f"{path}/centroids")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Index:
    """The stored index; the driver holds the centroids, MOST_LISTS rows at most."""
    rows = sorted((r.list, r.centroid) for r in spark.read.parquet(f"{path}/centroids").collect())
    return Index(np.array([c for _, c in rows]), spark.read.parquet(f"{path}/blocks"))


def search(index: Index, questions: DataFrame, k: int, probes: int = 4, exact: bool = True) -> DataFrame:
    """(query_id, vec_id, score, rank): the k best vectors of each question (query_id, query) by cosine, ties by id.

    The `probes` nearest lists of a question are read first. With exact, every block whose bound reaches the k-th score found
    there is read too, so the result is that of a scan; without, only the first lists are.
    """
    found, _ = searched(index, questions, k, probes, exact)
    return found


def searched(index: Index, questions: DataFrame, k: int, probes: int = 4, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """The result of `search`, and (query_id, read): the vectors that each question was compared with."""
    asked = questions.select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("query"))
    width = index.centroids.shape[1] if len(index.centroids) else 1
    if not len(index.centroids):
        width = max(1, asked.agg(F.max(F.size("query"))).first()[0] or 1)
    first = _hits(index, asked, width, k, probes, False)
    if not exact:
        return _best(first, k), _read(first)
    first = _kept(first)
    least = _best(first, k).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= k)
    every = _hits(index, asked.join(least, "query_id", "left"), width, k, probes, True)
    return _best(every, k), _read(first.unionByName(every))


def depths(index: Index, best: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, vec_id, depth): how many of a question's nearest lists are read until each of its best vectors is found; one
    more than there are lists for a vector in none. best: (query_id, vec_id) of an exact search."""
    centres = index.centroids
    width, most = (centres.shape[1], len(centres)) if len(centres) else (1, 0)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, PACK) for b in batches for at in range(0, b.num_rows, PACK)):
            close = _units(_matrix(batch.column(1), width)) @ centres.T if most else np.zeros((batch.num_rows, 0))
            place = np.full((len(close), most + 1), most + 1, np.int32)  # the last: no list
            np.put_along_axis(place, np.argsort(-close, axis=1, kind="stable"), np.arange(1, most + 1, dtype=np.int32)[None], axis=1)
            found, own = batch.column(2).flatten(), np.repeat(np.arange(len(close)), batch.column(2).value_lengths().to_numpy(zero_copy_only=False))
            at = pc.struct_field(found, "list").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pc.struct_field(found, "vec_id"), pa.array(place[own, np.where(at == NOWHERE, most, at)])], ["query_id", "vec_id", "depth"])

    asked = questions.select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("query"))
    home = index.blocks.select("list", F.explode("ids").alias("vec_id"))
    held = best.select("query_id", "vec_id").join(home, "vec_id").groupBy("query_id").agg(F.collect_list(F.struct("vec_id", "list")).alias("held"))  # k of a question, and more where ids repeat
    found = asked.join(held, "query_id").mapInArrow(placed, "query_id long, vec_id long, depth int")
    return found.groupBy("query_id", "vec_id").agg(F.min("depth").alias("depth"))


def probes_for(found: DataFrame, recall: float) -> int:
    """The least number of first lists that holds this share of the best vectors of `depths`: a count for each depth, of which
    there are at most MOST_LISTS + 1, in the driver."""
    counts = sorted((r.depth, r["count"]) for r in found.groupBy("depth").count().collect())
    total, so_far = sum(n for _, n in counts), 0
    for depth, n in counts:
        so_far += n
        if so_far >= recall * total:
            return depth
    return 1


def _kept(df: DataFrame) -> DataFrame:
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.where("score is not null").select("query_id", "vec_id", "score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _read(hits: DataFrame) -> DataFrame:
    return hits.where("score is null").groupBy("query_id").agg(F.sum("read").alias("read"))


def _hits(index: Index, asked: DataFrame, width: int, k: int, probes: int, exact: bool) -> DataFrame:
    """(query_id, vec_id, score, read): the k best of each question in each shard of the blocks, and a row without a score that tells
    how many of the shard's vectors it read. A question reads its first lists; with exact, every block whose bound reaches
    its `least` score, those of its first lists again (not counted again), and returns none below that score.

    Each shard meets each block of questions in one cogrouped task: vectors are shuffled once for a block of questions, questions
    once for a shard, however many lists they read."""
    spark, centres = asked.sparkSession, index.centroids
    n, held = asked.count(), index.blocks.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    parts = max(1, min(n, -(-n * width * 8 // max(1, BROADCAST_BYTES))), -(-n // retrieval.QUESTION_BLOCK))
    shards = max(1, -(-held // retrieval.SHARD_ROWS), -(-held * width * 8 // retrieval.SHARD_BYTES), min(-(-held // retrieval.LEAST_SHARD), 3 * spark.sparkContext.defaultParallelism))
    part = lambda n, *columns: F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.blocks.select("list", "ring", "radius", "ids", "units", part(shards, "list", "ring", F.get("ids", F.lit(0))).alias("shard"), each(parts).alias("part"))
    floor = F.col("least") if exact else F.lit(None).cast("double")
    right = asked.select("query_id", "query", floor.alias("floor"), part(parts, "query_id", "query").alias("part"), each(shards).alias("shard"))
    names = ["query_id", "vec_id", "score", "read"]
    kinds = pa.int64(), pa.int64(), pa.float64(), pa.int64()

    def search(blocks: pa.Table, questions: pa.Table) -> pa.Table:
        if "ids" not in blocks.schema.names or "query" not in questions.schema.names or not len(blocks) or not len(questions):  # no such group
            return pa.table([pa.array([], t) for t in kinds], names)
        blocks = blocks.take(pc.sort_indices(pa.table({"list": blocks["list"], "ring": blocks["ring"], "id": pc.list_element(blocks["ids"], 0)}), sort_keys=[(c, "ascending") for c in ("list", "ring", "id")], null_placement="at_start"))
        lists, radii = blocks["list"].to_numpy(), blocks["radius"].to_numpy()
        column = questions["query"]
        units = _units(_matrix(pa.concat_arrays(column.chunks), width))
        bars = pc.fill_null(questions["floor"], -np.inf).to_numpy()
        scores, ids, read = np.full((len(units), k), -np.inf), np.zeros((len(units), k), np.int64), np.zeros(len(units), np.int64)
        held = []
        for i in range(len(blocks)):
            own = pc.fill_null(blocks["ids"][i].values, NO_ID).to_numpy(zero_copy_only=False)
            table = np.frombuffer(blocks["units"][i].as_buffer(), "<f8").reshape(len(own), -1)
            held.append((own, table if table.shape[1] == width else np.zeros((len(own), width))))  # another width: zeros alone are held
        sizes = np.array([len(own) for own, _ in held])
        for low in range(0, len(units), PACK):
            pack, bar = units[low : low + PACK], bars[low : low + PACK]
            near = pack @ centres.T if len(centres) else np.zeros((len(pack), 1))
            last = np.partition(near, -probes, axis=1)[:, -probes] if probes < near.shape[1] else np.full(len(pack), -np.inf)
            close = np.where(lists == NOWHERE, 0.0, near[:, lists])
            is_first = (lists != NOWHERE) & (close >= last[:, None])
            wanted = close + radii + SLACK >= bar[:, None] if exact else is_first
            read[low : low + PACK] = ((wanted & ~is_first) if exact else wanted) @ sizes
            for i in np.flatnonzero(wanted.any(axis=0)).tolist():
                rows = np.flatnonzero(wanted[:, i])
                _merge(scores, ids, low + rows, bar[rows], pack[rows] @ held[i][1].T, held[i][0])
        row, rank = np.nonzero(scores > -np.inf)
        number = questions["query_id"].combine_chunks()
        number = pa.concat_arrays(number.chunks) if isinstance(number, pa.ChunkedArray) else number
        found = pa.array(ids[row, rank], mask=ids[row, rank] == NO_ID)
        hits = pa.table([number.take(pa.array(row)), found, pa.array(scores[row, rank]), pa.array(np.zeros(len(row), np.int64))], names)
        none = pa.nulls(len(read), pa.int64())
        return pa.concat_tables([hits, pa.table([number, none, none.cast(pa.float64()), pa.array(read)], names)])

    return left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(search, "query_id long, vec_id long, score double, read long")


def _merge(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, bar: np.ndarray, found: np.ndarray, own: np.ndarray) -> None:
    """Puts what of found, the cosines of the questions `rows` with the vectors `own`, is among a question's best into its row of
    scores and ids (k each, best first, ties by id); scores under the question's bar are left out."""
    k = scores.shape[1]
    least, last = scores[rows, -1], ids[rows, -1]
    enough = np.maximum(least, bar)
    if found.shape[1] > 2 * k:  # the k-th best here is a bar as well
        enough = np.maximum(enough, np.partition(found, -k, axis=1)[:, -k] - 1e-6) if np.isneginf(least).any() else enough
    row, at = np.nonzero(found >= enough[:, None] - SLACK)
    score, number = retrieval.rounded(found[row, at]), own[at]
    keep = (score >= bar[row] - SLACK / 10) & ((score > least[row]) | ((score == least[row]) & (number < last[row])))
    row, score, number = row[keep], score[keep], number[keep]
    touched, group = np.unique(row, return_inverse=True)
    if not len(touched):
        return
    mine = rows[touched]
    group = np.concatenate([np.repeat(np.arange(len(touched)), k), group])
    score, number = np.concatenate([scores[mine].ravel(), score]), np.concatenate([ids[mine].ravel(), number])
    order = np.lexsort((number, -score, group))
    top = order[np.searchsorted(group[order], np.arange(len(touched)))[:, None] + np.arange(k)]
    scores[mine], ids[mine] = score[top], number[top]
