"""Retrieval over a table of questions: vector top-k, hybrid rerank, filters with fallback, expansion."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from graphlake.functions import text as T

#: Confidence bands and what each gives.
HIGH, MEDIUM = 0.85, 0.6
TOP_K = {"high": 30, "medium": 18, "low": 15}
WEIGHTS_HIGH, WEIGHTS_LOW = (0.6, 0.4), (0.7, 0.3)
TRUNCATE, FALLBACK = 15, 5
FIRST_LIMIT, AGGREGATION_LIMIT, AGGREGATION_CAP, FETCH_LIMIT = 100, 1000, 5000, 1000
#: The most and the least questions of a block, and bytes of their vectors as doubles; vectors of a shard and bytes likewise.
QUESTION_BLOCK, LEAST_BLOCK, BLOCK_BYTES = 32_768, 1_024, 32 << 20
SHARD_ROWS, LEAST_SHARD, SHARD_BYTES = 65_536, 2_048, 64 << 20
#: Questions and vectors whose scores are taken by one product of matrices.
PACK, CHUNK = 512, 4_096


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_of(a: Column, b: Column, n: Column) -> Column:
    """The cosine of vectors whose norms have the product n; 0 where either is null or zero."""
    return F.coalesce(F.when(n > 0, dot(a, b) / n), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is null or zero."""
    return cosine_of(a, b, norm(a) * norm(b))


def vector_topk(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k vectors of largest cosine with one query, ties by id: a top-k of each task, merged."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.withColumn("score", F.round(cosine(F.col("embedding"), q), 6))
    return scored.orderBy(F.desc("score"), "vec_id").limit(k)


@dataclass
class Units:
    """Rows of a column of vectors, by width, at length 1 (zeros stay, a component that is not finite makes NaN). Null and empty
    vectors and those with a null component are in no width. usual: the width of all rows, if it is one and no row is left out."""

    n: int
    by_width: dict[int, tuple[np.ndarray, np.ndarray]]
    usual: int | None

    @classmethod
    def of(cls, column: pa.Array) -> Units:
        lengths = pc.fill_null(column.value_lengths(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten()
        begins = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
        if flat.null_count:
            nulls = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
            lengths = np.where(nulls[begins + np.maximum(lengths, 0)] > nulls[begins], -1, lengths)
            flat = pc.fill_null(flat, 0)
        values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
        by_width = {}
        for width in np.unique(lengths[lengths > 0]).tolist():
            rows = np.flatnonzero(lengths == width)
            table = values.reshape(-1, width) if len(rows) * width == len(values) else values[begins[rows, None] + np.arange(width)]
            with np.errstate(all="ignore"):
                norms = np.sqrt((table * table).sum(axis=1, keepdims=True))
                by_width[width] = rows, np.where(norms == 0, 0.0, table / norms)
        usual = next((w for w, (rows, _) in by_width.items() if len(rows) == len(lengths)), None)
        return cls(len(lengths), by_width, usual)

    def part(self, first: int, last: int) -> Units:
        last = min(last, self.n)
        if self.usual:
            return Units(last - first, {self.usual: (np.arange(last - first), self.by_width[self.usual][1][first:last])}, self.usual)
        cut = {w: (np.searchsorted(rows, (first, last)), rows, units) for w, (rows, units) in self.by_width.items()}
        return Units(last - first, {w: (rows[at[0] : at[1]] - first, units[at[0] : at[1]]) for w, (at, rows, units) in cut.items()}, None)

    def cosines(self, others: Units) -> np.ndarray:
        """(own rows, others' rows): 0 where either is null or zero or their widths differ; infinite where it is not a number, which
        as in Spark's order is above all others."""
        with np.errstate(all="ignore"):
            if self.usual and self.usual == others.usual:
                out = self.by_width[self.usual][1] @ others.by_width[self.usual][1].T
            else:
                out = np.zeros((self.n, others.n))
                for width in self.by_width.keys() & others.by_width.keys():
                    (a, own), (b, other) = self.by_width[width], others.by_width[width]
                    out[np.ix_(a, b)] = own @ other.T
        if np.isnan(out.sum()):
            out[np.isnan(out)] = np.inf
        return out


def rounded(score: np.ndarray) -> np.ndarray:
    """To six digits, halves away from zero."""
    return np.sign(score) * np.floor(np.abs(score) * 1e6 + 0.5) / 1e6 + 0.0


def best_rows(questions: Units, vectors: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(questions, k) scores, falling, and places of the k best of the vectors for each question; ties to the earlier place, -inf
    where there are fewer. A score at or below a question's k-th can't enter, as the places ascend."""
    scores, places = np.full((questions.n, k), -np.inf), np.zeros((questions.n, k), np.int64)
    first, size = 0, 256
    while first < len(vectors) and k > 0:
        chunk = Units.of(vectors.slice(first, size))
        for low in range(0, questions.n, PACK):
            found = questions.part(low, low + PACK).cosines(chunk)
            least = scores[low : low + PACK, -1]
            row, at = np.nonzero(found > least[:, None] + 4.9e-7)
            score = rounded(found[row, at])
            keep = score > least[row]
            row, at, score = row[keep], at[keep], score[keep]
            touched, own = np.unique(row, return_inverse=True)
            if not len(touched):
                continue
            group = np.concatenate([np.repeat(np.arange(len(touched)), k), own])
            score = np.concatenate([scores[low + touched].ravel(), score])
            place = np.concatenate([places[low + touched].ravel(), first + at])
            order = np.lexsort((place, -score, group))
            begins = np.searchsorted(group[order], np.arange(len(touched)))
            top = order[begins[:, None] + np.arange(k)]
            scores[low + touched], places[low + touched] = score[top], place[top]
        first, size = first + size, min(CHUNK, size * 2)
    return scores, places


def vector_topk_batch(vectors: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): the k best vectors of each question by cosine of six digits, ties by id.

    Vectors are dealt by hash to shards and questions to blocks; each pair of shard and block is one group of bounded size,
    scored by products of matrices, which returns k rows a question at most; the shards' rows are merged by a window. The
    scores are as many as questions times vectors, what is shuffled is as many as questions times shards times k; so for work for
    all tasks, questions are dealt to more blocks first, and only then vectors to more shards.
    """
    spark = vectors.sparkSession
    sizes = lambda df, column: df.agg(F.count("*").alias("n"), F.greatest(F.coalesce(F.max(F.size(column)), F.lit(1)), F.lit(1)).alias("width")).first()
    asked, held = sizes(questions, "query"), sizes(vectors, "embedding")
    groups = 3 * spark.sparkContext.defaultParallelism
    blocks = max(1, -(-asked.n // QUESTION_BLOCK), -(-asked.n * asked.width * 8 // BLOCK_BYTES))
    shards = max(1, -(-held.n // SHARD_ROWS), -(-held.n * held.width * 8 // SHARD_BYTES))
    blocks = max(blocks, min(-(-asked.n // LEAST_BLOCK), -(-groups // shards)))
    shards = max(shards, min(-(-held.n // LEAST_SHARD), -(-groups // blocks)))
    part = lambda n, *columns: F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.select("vec_id", "embedding", part(shards, "vec_id", "embedding").alias("shard"), each(blocks).alias("block"))
    right = questions.select("query_id", "query", part(blocks, "query_id", "query").alias("block"), each(shards).alias("shard"))
    names = ["query_id", "vec_id", "score"]
    whole = lambda column: pa.concat_arrays(column.chunks)

    def search(shard: pa.Table, block: pa.Table) -> pa.Table:
        if "embedding" not in shard.schema.names or "query" not in block.schema.names or not len(shard) or not len(block):  # no such group
            return pa.table([pa.array([], t) for t in (query_type, vec_type, pa.float64())], names)
        shard = shard.take(pc.sort_indices(shard, sort_keys=[("vec_id", "ascending")], null_placement="at_start"))
        scores, places = best_rows(Units.of(whole(block.column("query"))), whole(shard.column("embedding")), k)
        row, rank = np.nonzero(scores > -np.inf)
        score = scores[row, rank]
        score[np.isinf(score)] = np.nan
        return pa.table([block.column("query_id").take(pa.array(row)), shard.column("vec_id").take(pa.array(places[row, rank])), pa.array(score)], names)

    kinds = questions.schema["query_id"].dataType, vectors.schema["vec_id"].dataType
    query_type, vec_type = map(to_arrow_type, kinds)
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(search, f"query_id {kinds[0].simpleString()}, vec_id {kinds[1].simpleString()}, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def fetch_by_ids(docs: DataFrame, wanted: DataFrame, limit: int = FETCH_LIMIT, query: list[float] | None = None) -> DataFrame:
    """The documents whose id is wanted, `limit` at most: in order of id, or given a query vector by cosine, ties by id. A wanted id
    that repeats counts once, one that is no document not at all."""
    found = docs.join(wanted.select("id").distinct(), "id", "left_semi")
    if query is None:
        return found.orderBy("id").limit(limit)
    q = F.array(*[F.lit(float(x)) for x in query])
    return found.withColumn("score", F.round(cosine(F.col("embedding"), q), 6)).orderBy(F.desc("score"), "id").limit(limit)


def rerank(candidates: DataFrame, vector_weight: Column | float = 0.7, keyword_weight: Column | float = 0.3, top_k: Column | int = 5) -> DataFrame:
    """candidates (query_id, rank, query_text, text, ...): adds score and new_rank, the top_k of each query.

    score = vector_weight * (1 - (rank - 1) / n) + keyword_weight * keyword score, n the candidates of the query; ties keep
    the vector order. Texts are tokenized once a candidate, queries too, unless query_words has their tokens instead of query_text;
    with found_, the keyword score, neither is looked at.
    """
    n = F.count("*").over(Window.partitionBy("query_id"))
    words = candidates
    if "found_" not in candidates.columns:
        asked = F.col("query_words") if "query_words" in candidates.columns else T.tokens(F.col("query_text"))
        words = words.withColumn("asked_", asked).withColumn("held_", T.tokens(F.col("text")))
        words = words.withColumn("found_", T.share_of("asked_", "held_")).drop("asked_", "held_")
    score = vector_weight * (1 - (F.col("rank") - 1) / n) + keyword_weight * F.col("found_")
    scored = words.withColumn("hybrid", F.round(score, 6)).drop("found_")
    order = Window.partitionBy("query_id").orderBy(F.desc("hybrid"), "rank")
    return scored.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= top_k)


def route_params(confidence: Column, override: Column | None = None) -> dict[str, Column]:
    """top_k, weights and hops of a question by its relationship confidence."""
    band = lambda high, medium, low: F.when(confidence >= HIGH, high).when(confidence >= MEDIUM, medium).otherwise(low)
    top_k = band(TOP_K["high"], TOP_K["medium"], TOP_K["low"])
    return {
        "top_k": top_k if override is None else F.coalesce(override, top_k),
        "vector_weight": F.when(confidence >= HIGH, WEIGHTS_HIGH[0]).otherwise(WEIGHTS_LOW[0]),
        "keyword_weight": F.when(confidence >= HIGH, WEIGHTS_HIGH[1]).otherwise(WEIGHTS_LOW[1]),
        "hops": band(2, 1, 0),
    }


def initial_limit(is_aggregation: Column) -> dict[str, Column]:
    return {"first_limit": F.when(is_aggregation, AGGREGATION_LIMIT).otherwise(FIRST_LIMIT), "max_documents": F.when(is_aggregation, AGGREGATION_CAP)}


def keyword_match(text: Column, keywords: Column, any_of: Column) -> Column:
    """Any keyword in the text, or all, case-insensitive; no keywords pass."""
    lowered = F.lower(text)
    has = lambda k: F.contains(lowered, F.lower(k))
    return F.when(F.size(keywords) == 0, True).when(any_of, F.exists(keywords, has)).otherwise(F.forall(keywords, has))


def id_match(node_id: Column, text: Column, wanted: Column) -> Column:
    low = F.lower(wanted)
    return F.contains(F.lower(node_id), low) | F.contains(F.lower(text), low)


def filter_with_fallback(ranked: DataFrame, passes: Column, active: Column, limit: int = TRUNCATE, fallback: int = FALLBACK) -> DataFrame:
    """Rows of (query_id, new_rank) that pass, the first `limit` of them where a filter is active; where none passes, the
    first `fallback` rows of the unfiltered order. One window, no second job."""
    of_query = Window.partitionBy("query_id")
    kept = ranked.withColumn("passes", passes).withColumn("any_pass", F.max("passes").over(of_query))
    kept = kept.withColumn("place", F.sum(F.when(F.col("passes"), 1).otherwise(0)).over(of_query.orderBy("new_rank")))
    chosen = F.when(F.col("any_pass"), F.col("passes") & (~active | (F.col("place") <= limit))).otherwise(F.col("new_rank") <= fallback)
    return kept.where(chosen).drop("any_pass", "place")


def expansion_stats(before: Column, after: Column) -> Column:
    """After over before; 0 where there was nothing before."""
    return F.coalesce(F.try_divide(after, before), F.lit(0.0))


def choose_seeds(found: DataFrame, named: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, id): the node that a question names, where it names one that exists; else what was retrieved for it.

    found and named are (query_id, id); null ids in named name nothing."""
    known = named.join(nodes.select("id"), "id", "left_semi").select("query_id", "id")
    return known.unionByName(found.join(known, "query_id", "left_anti").select("query_id", "id")).distinct()


def seed_direction(relation: Column, direction: Column, seed_types: Column) -> Column:
    """The relation's direction; null, which is both ways, where the seeds already stand at the relation's far end."""
    far = lambda kind, node: F.coalesce((relation == kind) & F.array_contains(seed_types, node), F.lit(False))
    return F.when(~(far("well_to_curves", "las_curve") | far("curve_to_well", "las_document")), direction)


def generated_text(node_id: Column, kind: Column, attributes: Column) -> Column:
    """A text of a node without one: its type, its id, and its attributes sorted by name, null and empty ones left out."""
    held = F.array_sort(F.map_entries(F.map_filter(attributes, lambda k, v: v.isNotNull() & (v != ""))))
    lines = F.transform(held, lambda e: F.concat(F.lit("  - "), e["key"], F.lit(": "), e["value"]))
    block = F.when(F.size(attributes) > 0, F.concat(F.array(F.lit("ATTRIBUTES:")), lines)).otherwise(F.array().cast("array<string>"))
    head = F.array(F.concat(F.lit("ENTITY TYPE: "), F.upper(kind)), F.concat(F.lit("ENTITY ID: "), node_id), F.lit(""))
    return F.array_join(F.concat(head, block), "\n")


def enrich_expanded(reached: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """reached (query_id, id) with the stored text (texts: id, text) or else a generated one; ids that are no node are dropped."""
    known = reached.join(nodes.select("id", "type", "attributes"), "id").join(texts.select("id", "text"), "id", "left")
    return known.select("query_id", "id", "type", F.coalesce("text", generated_text(F.col("id"), F.col("type"), F.col("attributes"))).alias("text"))
