"""Byte-level BPE by corpus-level merge replay: every distinct chunk of the corpus is encoded once, all merges in rank order.

Texts are cut to chunks where the split pattern always cuts, and a slice of texts is kept as codes into its own list of
distinct chunks. The lists of all slices are dealt by the chunks' hash. A task joins its chunks' words to one sequence with
an inverted index from token pair to positions, and takes the pairs by rank: each merge goes to all positions of its pair
at once and touches only the neighbours, whose new pairs join the index. The ids go back to the slices: codes become ids.
"""

from __future__ import annotations

import base64
import heapq
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.llm import common

#: Bytes of text in a slice, distinct chunks in one replay, chunks and pairs that a worker remembers, and buckets of chunks
#: for each shuffle partition.
SLICE_BYTES, BLOCK_CHUNKS, KNOWN, PAIRS, BUCKETS = 24 << 20, 32_768, 200_000, 1 << 20, 4
#: White space across which the pattern looks ahead: such texts are cut by the pattern itself.
_UNSAFE = re.compile(r"\s\s\s|\s\s\Z")
_loaded: dict[tuple[str, str], "Merges"] = {}


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """A rank file of the public tokenizers and the pattern that goes with it."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def load(path: str, pattern: str) -> "Merges":
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Merges(path, pattern)
    return _loaded[path, pattern]


class Merges:
    """The ranks of a vocabulary, and the replay of its merges over many words at once."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.words: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for word, rank in self.ranks.items():
            self.words[rank] = word
        self.split = regex.compile(pattern).findall
        single = [bytes([b]) for b in range(256)]
        self.of_byte = np.array([self.ranks[b] for b in single], np.int32)
        self.of_bytes = np.array([[self.ranks.get(a + b, -1) for b in single] for a in single], np.int32)
        self.known: dict[int, int] = {}

    def pair(self, a: int, b: int) -> int:
        """The rank of the token that two tokens make, or -1."""
        key = a << 32 | b
        rank = self.known.get(key)
        if rank is None:
            if len(self.known) >= PAIRS:
                self.known.clear()
            self.known[key] = rank = self.ranks.get(self.words[a] + self.words[b], -1)
        return rank

    def encode(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk as little-endian unsigned 32-bit integers."""
        number: dict[bytes, int] = {}
        split = [[number.setdefault(word.encode(), len(number)) for word in self.split(chunk)] for chunk in chunks]
        ids = self.replay(list(number))
        return [ids[words[0]] if len(words) == 1 else b"".join([ids[w] for w in words]) for words in split]

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word: a word that is a token is that token, and the others share one replay of all merges."""
        found = [self.ranks.get(word) for word in words]
        rest = [word for word, rank in zip(words, found) if rank is None and word]
        replayed = iter(self._replay(rest)) if rest else iter(())
        return [(next(replayed) if word else b"") if rank is None else array("I", [rank]).tobytes() for word, rank in zip(words, found)]

    def _replay(self, words: list[bytes]) -> list[bytes]:
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(word) for word in words])
        starts = np.concatenate([[0], ends[:-1]])
        token = self.of_byte[data].tolist()
        after, before = np.arange(1, len(data) + 1), np.arange(-1, len(data) - 1)
        after[ends - 1], before[starts] = -1, -1
        made = np.full(len(data), -1, np.int32)  # the rank of the pair that begins at a position
        made[:-1] = self.of_bytes[data[:-1], data[1:]]
        made[ends - 1] = -1
        order = np.argsort(made, kind="stable")
        order = order[made[order] >= 0]
        ranks, firsts = np.unique(made[order], return_index=True)
        index = {int(rank): places.tolist() for rank, places in zip(ranks, np.split(order, firsts[1:]))}
        after, before, made = after.tolist(), before.tolist(), made.tolist()
        heap = list(index)
        heapq.heapify(heap)
        pair = self.pair
        while heap:
            rank = heapq.heappop(heap)
            for place in sorted(index.pop(rank)):
                if made[place] != rank:
                    continue
                due = [(rank, place)]
                while due:  # the merge, and any that it makes possible and that no other may precede
                    now, at = heapq.heappop(due)
                    if made[at] != now:
                        continue
                    gone = after[at]
                    right, left = after[gone], before[at]
                    token[at], token[gone], made[gone] = now, -1, -1
                    after[at] = right
                    touched = []
                    if right >= 0:
                        before[right] = at
                        made[at] = new = pair(now, token[right])
                        if new >= 0:
                            touched.append((new, at))
                    else:
                        made[at] = -1
                    if left >= 0:
                        made[left] = new = pair(token[left], now)
                        if new >= 0:
                            touched.append((new, left))
                    for new, where in touched:
                        if new <= rank:
                            heapq.heappush(due, (new, where))
                        elif new in index:
                            index[new].append(where)
                        else:
                            index[new] = [where]
                            heapq.heappush(heap, new)
        token = np.array(token, np.int64)
        alive = token >= 0
        upto = np.concatenate([[0], np.cumsum(alive)])[ends] * 4
        ids = token[alive].astype("<u4").tobytes()
        return [ids[a:b] for a, b in zip([0, *upto[:-1].tolist()], upto.tolist())]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Codes of the chunks of some texts, the distinct chunks, and the first chunk of each text (one more than texts)."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        base, end = int(offsets[0]), int(offsets[-1])
        data = np.frombuffer(texts.buffers()[2], np.uint8)[base:end] if end > base else np.zeros(0, np.uint8)
        starts = offsets - base
        line = data == 10
        letter = (data | 32) - np.uint8(97) < 26
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = letter[:-1] & ~letter[1:] & (data[1:] < 128)
        cut[:-1] |= line | (data == 32)
        cut[1:] |= line
        for i in range(len(texts)):
            text = texts[i].as_py()
            if _UNSAFE.search(text):
                cut[starts[i] : starts[i + 1]] = False
                lengths = [len(word.encode()) for word in self.split(text)]
                cut[starts[i] + np.cumsum(lengths)[:-1]] = True
        cut[starts] = True
        cut[-1] = False
        at = np.flatnonzero(cut)
        bounds = np.append(at, len(data)).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        return chunks.indices.to_numpy(zero_copy_only=False), chunks.dictionary, np.searchsorted(at, starts)


_ZSTD = pa.Codec("zstd", compression_level=3)


def squeeze(numbers: np.ndarray) -> bytes:
    """Numbers from 0 to 2**32 - 1 in little more than their information: their bit lengths, compressed, and for each length the
    bits below the highest one, a plane of bits for each place."""
    numbers = np.asarray(numbers, np.int64)
    lengths = np.frexp(numbers.astype(np.float64))[1].astype(np.uint8)
    head = _ZSTD.compress(lengths.tobytes(), asbytes=True) if len(lengths) else b""
    planes = [struct.pack("<QQ", len(numbers), len(head)), head]
    for length in np.unique(lengths).tolist():
        some = numbers[lengths == length]
        planes += [np.packbits((some >> place & 1).astype(np.uint8)).tobytes() for place in range(length - 1)]
    return b"".join(planes)


def unsqueeze(data: bytes) -> np.ndarray:
    n, size = struct.unpack_from("<QQ", data)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    lengths, at = np.frombuffer(_ZSTD.decompress(data[16 : 16 + size], n), np.uint8), 16 + size
    for length in np.unique(lengths).tolist():
        where = np.flatnonzero(lengths == length)
        some, width = np.full(len(where), 1 << length >> 1, np.int64), -(-len(where) // 8)
        for place in range(length - 1):
            some |= np.unpackbits(np.frombuffer(data, np.uint8, width, at), count=len(where)).astype(np.int64) << place
            at += width
        out[where] = some
    return out


def pack_ids(parts: list[bytes]) -> bytes:
    """A list of id strings: how many ids each has, and all ids in 16 bits where they fit, compressed."""
    counts = squeeze(np.fromiter(map(len, parts), np.int64, len(parts)) // 4)
    ids = np.frombuffer(b"".join(parts), "<u4")
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    data = ids.astype(f"<u{width}").tobytes()
    return struct.pack("<QBQ", len(counts), width, len(data)) + counts + (_ZSTD.compress(data, asbytes=True) if data else b"")


def unpack_ids(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    first, width, size = struct.unpack_from("<QBQ", data)
    at = struct.calcsize("<QBQ")
    ids = np.frombuffer(_ZSTD.decompress(data[at + first :], size), f"<u{width}") if size else np.zeros(0, "<u2")
    return unsqueeze(data[at : at + first]), ids


def pack(parts: list[bytes]) -> bytes:
    """A list of byte strings: their lengths and their bytes, compressed."""
    lengths, data = squeeze(np.fromiter(map(len, parts), np.int64, len(parts))), b"".join(parts)
    return struct.pack("<QQ", len(lengths), len(data)) + lengths + (_ZSTD.compress(data, asbytes=True) if data else b"")


def unpack(data: bytes) -> tuple[np.ndarray, bytes]:
    """Lengths and bytes of a packed list."""
    first, size = struct.unpack_from("<QQ", data)
    return unsqueeze(data[16 : 16 + first]), _ZSTD.decompress(data[16 + first :], size).to_pybytes() if size else b""


def _binary(value: bytes | None) -> pa.Array:
    return pa.array([value], pa.binary())


def slices(docs: DataFrame, vocabulary: tuple[str, str], id_col: str, text_col: str) -> DataFrame:
    """(slice long, bucket int, ids array, firsts, codes, buckets, chunks binary), written.

    A slice of about SLICE_BYTES of texts is a row (bucket -1) with their ids, how many codes each has, the codes, shorter ones
    for commoner chunks, and how many codes each bit length and bucket has; and a row for each bucket with its chunks in
    order of their codes.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    common.arrow_batches(spark)
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.spark_partition_id().cast("long").alias("part"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = ["slice", "bucket", "ids", "firsts", "codes", "buckets", "chunks"]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, number = load(*vocabulary), 0
        held, weight, part = [], 0, 0

        def flush():
            nonlocal held, weight, number
            table = pa.Table.from_batches(held).combine_chunks()
            codes, chunks, firsts = merges.cut(table.column(2).chunk(0))
            keys = table.column(1).chunk(0)
            held, weight, number = [], 0, number + 1
            common_first = np.argsort(-np.bincount(codes, minlength=len(chunks)), kind="stable")
            texts = chunks.take(pa.array(common_first)).cast(pa.binary()).to_pylist()
            # codes of one bit length cost the same, so among them chunks go by bucket and text, which packs best
            lengths = np.frexp(np.arange(len(texts), dtype=np.float64))[1].astype(np.int64)
            of = np.fromiter((zlib.crc32(x) % buckets for x in texts), np.int64, len(texts))
            cells = lengths * buckets + of
            order = [i for _, _, i in sorted(zip(cells.tolist(), texts, range(len(texts))))]
            rank = np.empty(len(order), np.int64)
            rank[common_first[order]] = np.arange(len(order))
            texts, of = [texts[i] for i in order], of[order]
            table_of_cells = np.bincount(cells, minlength=(int(lengths.max()) + 1) * buckets if len(texts) else 0)
            name = pa.array([part << 32 | number], pa.int64())
            whole = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
            yield pa.RecordBatch.from_arrays([name, pa.array([-1], pa.int32()), whole, _binary(squeeze(np.diff(firsts))), _binary(squeeze(rank[codes])), _binary(squeeze(np.append(table_of_cells, buckets))), _binary(None)], names)
            by = np.argsort(of, kind="stable")
            parts = np.split(by, np.flatnonzero(np.diff(of[by])) + 1) if len(by) else []
            n = len(parts)
            packed = pa.array([pack([texts[i] for i in some.tolist()]) for some in parts], pa.binary())
            none = pa.nulls(n, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([name[0].as_py()] * n, pa.int64()), pa.array([of[some[0]] for some in parts], pa.int32()), pa.nulls(n, whole.type), none, none, none, packed], names)

        for batch in batches:
            part = batch.column(0)[0].as_py() if batch.num_rows else part
            texts = batch.column(2)
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + batch.num_rows + 1]) if batch.num_rows else []
            at = 0
            while at < batch.num_rows:
                room = int(np.searchsorted(np.cumsum(sizes[at:]), SLICE_BYTES - weight, side="right"))
                take = max(1, room) if not held else room
                if take:
                    held.append(batch.slice(at, take))
                    weight += int(sizes[at : at + take].sum())
                    at += take
                if at < batch.num_rows or weight >= SLICE_BYTES:
                    yield from flush()
        if held:
            yield from flush()
        common.give_back()

    made = rows.mapInArrow(coded, f"slice long, bucket int, ids array<{kind}>, firsts binary, codes binary, buckets binary, chunks binary")
    return common.written(made, "bpe-slices")


def replayed(slices: DataFrame, vocabulary: tuple[str, str]) -> DataFrame:
    """(slice, bucket, tokens binary): the ids of each row of chunks, in the same order.

    Rows are dealt by bucket, so each distinct chunk of the corpus is in one task, which replays those that it hasn't met; a
    bucket's chunks are forgotten beyond KNOWN of them and replayed when they come again.
    """
    rows = slices.where("bucket >= 0").select("slice", "bucket", "chunks").repartition("bucket").sortWithinPartitions("bucket")

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, known, last = load(*vocabulary), {}, None
        for batch in batches:
            out = []
            for bucket, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if bucket != last or len(known) > KNOWN:
                    known, last = {}, bucket
                lengths, text = unpack(data)
                ends = np.cumsum(lengths).tolist()
                chunks = [text[a:b] for a, b in zip([0, *ends], ends)]
                new = [c for c in chunks if c not in known]
                for at in range(0, len(new), BLOCK_CHUNKS):
                    some = new[at : at + BLOCK_CHUNKS]
                    known.update(zip(some, merges.encode([c.decode() for c in some])))
                out.append(pack_ids([known[c] for c in chunks]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["slice", "bucket", "tokens"])
        merges.known.clear()
        common.give_back()

    return rows.mapInArrow(replay, "slice long, bucket int, tokens binary")


def encode(docs: DataFrame, vocabulary: tuple[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens long, ids binary): the ids of every whole text as little-endian unsigned 32-bit integers.

    vocabulary: a rank file and its split pattern; every match of the pattern is encoded by itself, without special
    tokens. Null and empty texts have no tokens. Rows repeat as they do in the input, ids may be null or repeat, and other
    columns are ignored; an empty table gives an empty result. A slice's texts are kept whole, so a text longer than
    SLICE_BYTES is a slice of its own.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    kept = slices(docs, vocabulary, id_col, text_col)
    lists = replayed(kept, vocabulary).groupBy("slice").agg(F.collect_list(F.struct("bucket", "tokens")).alias("found"))
    met = kept.where("bucket = -1").select("slice", "ids", "firsts", "codes", "buckets").join(lists, "slice", "left").drop("slice")

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys = batch.column(0).slice(i, 1).flatten()
                counts, codes, cells = (unsqueeze(batch.column(j)[i].as_py()) for j in (1, 2, 3))
                cells, buckets = cells[:-1], int(cells[-1])
                by = np.argsort(np.repeat(np.arange(len(cells)) % buckets, cells), kind="stable")
                found = [unpack_ids(x["tokens"]) for x in sorted(batch.column(4)[i].as_py() or [], key=lambda x: x["bucket"])]
                sizes = np.concatenate([n for n, _ in found]) if found else np.zeros(0, np.int64)
                flat = np.concatenate([x for _, x in found]).astype("<u4") if found else np.zeros(0, "<u4")
                begin, length = np.empty_like(sizes), np.empty_like(sizes)
                length[by], begin[by] = sizes, np.cumsum(sizes) - sizes
                out, n_tokens, at = [], [], 0
                for count in counts.tolist():
                    some = codes[at : at + count]
                    at += count
                    width = length[some]
                    total = np.cumsum(width)
                    n = int(total[-1]) if count else 0
                    out.append(flat[np.repeat(begin[some] - total + width, width) + np.arange(n)].tobytes())
                    n_tokens.append(n)
                yield pa.RecordBatch.from_arrays([keys, pa.array(n_tokens, pa.int64()), pa.array(out, pa.binary())], ["id", "n_tokens", "ids"])
        common.give_back()

    return met.mapInArrow(ids, f"id {kind}, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocabulary: tuple[str, str]) -> DataFrame:
    """The table of `encode` with `decoded` (binary): the bytes that each row's ids stand for, null ids as none."""
    names = encoded.columns

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, at = load(*vocabulary), names.index("ids")
        for batch in batches:
            texts = pa.array([merges.decode(x or b"") for x in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*names, "decoded"])
        common.give_back()

    return encoded.mapInArrow(back, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in encoded.schema.fields)}, decoded binary")
