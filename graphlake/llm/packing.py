"""Lexical retrieval packing: a sharded BM25 index returns unused neighbours for each seed, which fill its window."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm import common, subwords

#: Tokens of an index shard, about: its documents, index and sequences fit one task.
SHARD_TOKENS = 2 << 20
#: BM25's k1 and b; the rarest terms of a seed that it asks for first, before it asks for all of them.
K1, B, QUERY_TERMS = 1.2, 0.75, 12
#: Parts of a shard's tokens above which documents of one key are dealt to several shards.
HOT_PARTS = 4
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def token_rows(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, key, second, ids binary) of every whole text, the end id after it; ids are 16-bit, little-endian. Stored. key
    is one of the text's ids, rare ones likelier: texts that share rare ids often share it. second is the least hash of two
    ids in turn: two texts share it with the probability of their pairs' Jaccard similarity."""
    common.arrow_batches(docs.sparkSession)
    place = drawing_order(end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = subwords.load(tokenizer)
        for batch in batches:
            for first, last in encoder.slices(texts := batch.column(1).fill_null("")):
                ids, cuts = encoder.encode(texts.slice(first, last - first))
                ended, cuts = np.insert(ids, cuts[1:], end_id).astype("<u2"), cuts + np.arange(len(cuts))
                packed = pa.Array.from_buffers(pa.binary(), last - first, [None, pa.py_buffer((cuts * 2).astype(np.int32)), pa.py_buffer(ended.tobytes())])
                key = np.minimum.reduceat(place[ended], cuts[:-1]) if last > first else np.zeros(0, np.uint16)
                keys = [pa.array(np.diff(cuts)), pa.array(key.astype(np.int64)), pa.array(least_hashes(ended, cuts)), packed]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *keys], ["doc_id", "n", "key", "second", "ids"])
        subwords.forget()
        common.give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return common.written(rows.mapInArrow(encode, "doc_id long, n long, key long, second long, ids binary"), "token-rows")


def drawing_order(end_id: int) -> np.ndarray:
    """Each id's place in the order in which a text's key is drawn from its ids: weighted min-hashing, the end id last. The
    tokenizers number ids from common to rare, so an id's logarithm stands for its rarity."""
    wait = -np.log(np.random.default_rng(7).random(1 << 16).clip(1e-12)) / np.log(np.arange(1 << 16) / 256 + 1.1)
    wait[end_id] = np.inf
    place = np.empty(1 << 16, np.uint16)
    place[np.argsort(wait)] = np.arange(1 << 16)
    return place


def least_hashes(ids: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The least hash, of 32 bits, of two ids in turn of each text, none of which is empty; a text of one id has the largest."""
    if len(cuts) < 2:
        return np.zeros(0, np.int64)
    y = ids.astype(np.uint32)
    x = y * _MIX[0]
    x[:-1] += y[1:] * _MIX[1]
    x ^= x >> np.uint32(15)
    x *= _MIX[2]
    x[cuts[1:] - 1] = np.iinfo(np.uint32).max
    return np.minimum.reduceat(x, cuts[:-1]).astype(np.int64)


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int, int]:
    """(documents that hold each id, documents, tokens) over all rows; the result is bounded by 2^16 ids."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, 1 << 15):  # a row's number and an id fit 32 bits
                ids, bounds = flat(batch.column(0).slice(first, 1 << 15), np.int32)
                pairs = np.sort(np.repeat(np.arange(len(bounds) - 1, dtype=np.int32) << 16, np.diff(bounds)) | ids)
                pairs = pairs[np.flatnonzero(np.diff(pairs, prepend=-1))]
                total += np.bincount(pairs & 0xFFFF, minlength=1 << 16)
        common.give_back()
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], ["id", "n"])

    counted = rows.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(1 << 16, np.int64)
    for r in counted:
        df[r.id] = r.n
    sums = rows.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    return df, sums.docs, sums.tokens


def flat(column: pa.Array, kind=np.int64) -> tuple[np.ndarray, np.ndarray]:
    """All 16-bit ids of a binary column, and where each row's begin."""
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 2 if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], "<u2")[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.zeros(0, "<u2")
    return data.astype(kind), bounds - bounds[0]


class Bm25:
    """An inverted index of one shard's documents: for each id, its documents and their weights."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, df: np.ndarray, docs: int, mean: float):
        lengths = np.diff(bounds)
        self.size = len(lengths)
        bits, kind = (15, np.int32) if self.size <= 1 << 15 else (32, np.int64)
        pairs, tf = np.unique((ids.astype(kind) << bits) | np.repeat(np.arange(self.size, dtype=kind), lengths), return_counts=True)
        term, self.doc = (pairs >> bits).astype(np.int32), (pairs & ((1 << bits) - 1)).astype(np.int32)
        idf = np.log1p((docs - df + 0.5) / (df + 0.5))
        self.weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[self.doc] / max(mean, 1)))).astype(np.float32)
        self.begin = np.searchsorted(term, np.arange((1 << 16) + 1))
        # a document's terms that others of the shard have too, rarest of all documents first
        shared = np.diff(self.begin)[term] > 1
        by_rarity = np.lexsort((np.arange(1 << 16), df))
        rarity = np.empty(1 << 16, np.int64)
        rarity[by_rarity] = np.arange(1 << 16)
        asked = np.sort((self.doc[shared].astype(np.int64) << 16) | rarity[term[shared]])
        self.query = by_rarity[asked & 0xFFFF].astype(np.int32)
        self.query_begin = np.searchsorted(asked >> 16, np.arange(self.size + 1))

    def scored(self, terms: np.ndarray, used: np.ndarray) -> np.ndarray:
        """The unused documents that have any of the terms, best BM25 score first (ties: the earlier one)."""
        spans = [slice(self.begin[t], self.begin[t + 1]) for t in terms]
        doc = np.concatenate([self.doc[s] for s in spans])
        score = np.bincount(doc, weights=np.concatenate([self.weight[s] for s in spans]), minlength=self.size)
        score[used] = 0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]

    def neighbours(self, seed: int, used: np.ndarray) -> Iterator[int]:
        """The unused neighbours of a seed, best first: those by its QUERY_TERMS rarest shared terms, and when they run out, all
        that share any term with it. What is returned is taken to be used by then."""
        terms = self.query[self.query_begin[seed] : self.query_begin[seed + 1]]
        for some in (terms[:QUERY_TERMS], terms) if len(terms) > QUERY_TERMS else (terms,):
            if len(some):
                yield from (d for d in self.scored(some, used).tolist() if not used[d])


def pack(bounds: np.ndarray, index: Bm25, window: int) -> np.ndarray:
    """(document row, start, length, sequence, offset) of every piece of a shard.

    Sequences are filled to the last token. Each begins with what is left of the document cut before it, or with a new
    seed, and goes on with the seed's unused neighbours, best first, until it is full or no document is left that shares a
    term with the seed; then the next unused document is the seed. Only the last sequence isn't full: it is cut into
    powers of two, which need no padding.
    """
    lengths = np.diff(bounds)
    used = np.zeros(len(lengths), bool)
    order: list[int] = []
    room, following, queue = window, 0, iter(())
    while len(order) < len(lengths):
        doc = next(queue, None)
        fresh = doc is None
        if fresh:
            while used[following]:
                following += 1
            doc = following
        used[doc] = True
        order.append(doc)
        over = lengths[doc] >= room
        room = (room - lengths[doc]) % window or window
        if over or fresh:  # a new window opens, and this document, which reaches into it, is its seed; or a new seed
            queue = index.neighbours(doc, used)
    order = np.array(order, np.int64)
    ends = np.cumsum(lengths[order])
    total = int(ends[-1]) if len(ends) else 0
    cuts = np.arange(0, total, window)
    tail, rest = total - total % window, total % window
    for bit in range(window.bit_length() - 1, -1, -1):
        if rest >> bit & 1 and tail not in cuts:
            cuts = np.append(cuts, tail)
        tail += rest & (1 << bit)
    points = np.unique(np.concatenate([cuts, ends - lengths[order]]))
    stops = np.append(points[1:], total)
    place = np.searchsorted(ends, points, side="right")
    doc = order[place]
    sequence = np.searchsorted(cuts, points, side="right") - 1
    return np.stack([doc, points - (ends[place] - lengths[doc]), stops - points, sequence, points - cuts[sequence]], axis=1)


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents in sequences of at most
    `window` tokens.

    Documents are tokenized once and stored. Document frequencies are counted over all of them; then each shard, about
    SHARD_TOKENS tokens, is indexed and packed by one task. Documents of one key, which like texts share, go to one shard;
    a key with more than a part of a shard's tokens is split by the second key, and copies beyond that by row. Neighbours are looked for within the shard. A document longer
    than the window fills sequences of its own. Null and empty texts are the end id alone; repeated rows and null ids are
    packed like others; further columns are not looked at; empty input gives no pieces.
    """
    rows = token_rows(docs, tokenizer, end_id, id_col, text_col)
    df, n_docs, n_tokens = document_frequencies(rows)
    count = max(1, -(-n_tokens // SHARD_TOKENS))
    mean = n_tokens / max(1, n_docs)
    shared = docs.sparkSession.sparkContext.broadcast(df)  # 2^16 numbers
    part = max(1, SHARD_TOKENS // HOT_PARTS)
    pairs = common.written(rows.groupBy("key", "second").agg(F.sum("n").alias("n_")), "shard-keys")
    spread = F.ceil(F.col("n_") / part).cast("long")
    hot = pairs.groupBy("key").agg(F.sum("n_").alias("n_")).where(F.col("n_") > part).select(F.col("key").alias("key_"), spread.alias("spread"))
    same = pairs.where(F.col("n_") > part).select(F.col("key").alias("key_"), F.col("second").alias("second_"), spread.alias("copies"))
    hot, same = (common.maybe_broadcast(t, t.count()) for t in (common.written(hot, "hot-keys"), common.written(same, "hot-pairs")))
    numbered = rows.withColumn("row_no", F.monotonically_increasing_id()).join(hot, F.col("key") == F.col("key_"), "left").drop("key_")
    numbered = numbered.join(same, (F.col("key") == F.col("key_")) & (F.col("second") == F.col("second_")), "left")
    again = F.coalesce(F.pmod(F.xxhash64("row_no"), F.col("copies")), F.lit(0))
    salt = F.coalesce(F.pmod(F.xxhash64("second", again), F.col("spread")), F.lit(0))
    dealt = numbered.select("doc_id", "row_no", "n", "ids", F.pmod(F.xxhash64("key", salt), F.lit(count)).cast("int").alias("shard"))

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("row_no", "ascending")])
        column = pa.concat_arrays(table.column("ids").chunks) if table.num_rows else pa.array([], pa.binary())
        ids, bounds = flat(column)
        pieces = pack(bounds, Bm25(ids, bounds, shared.value, n_docs, mean), window)
        wide = ids.astype("<u4")
        at = bounds[pieces[:, 0]] + pieces[:, 1]
        crcs = [zlib.crc32(wide[a : a + n]) for a, n in zip(at.tolist(), pieces[:, 2].tolist())]
        shard = table.column("shard")[0].as_py()
        doc_ids = table.column("doc_id").combine_chunks().take(pa.array(pieces[:, 0]))
        lengths = np.diff(bounds)[pieces[:, 0]]
        common.give_back()
        values = [doc_ids, pieces[:, 1], pieces[:, 2], np.array(crcs, np.int64), lengths, (shard << 32) + pieces[:, 3], pieces[:, 4]]
        return pa.table([pa.array(v) for v in values], [c.split()[0] for c in PIECES.split(", ")])

    return dealt.groupBy("shard").applyInArrow(packed, PIECES)
