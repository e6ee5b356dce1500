"""SimHash near-dedup: fingerprints in vantage-point trees by Hamming distance, exact pairs, classes by star contraction."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.llm import common

BLANKS = r"[\x20\x09-\x0D]+"
#: Points of a shard's tree below which they are compared one by one.
LEAF = 192
#: Points that one task works through in turn; a shard with more of them is split.
TASK_POINTS = 20_000
#: Shingles whose bits are counted at once.
COUNTED = 1 << 16
#: Pairs that a task holds before it joins them.
HELD_PAIRS = 1 << 20
#: Bands of a shingle set's signature and minimum hashes of a band. A pair of Jaccard similarity s shares no band with
#: probability (1 - s**4)**32: 5e-8 at 0.8, 1e-15 at 0.9.
SET_BANDS, BAND_ROWS = 32, 4
#: Sets of a block, about, of which a task holds two at once; elements of the sets that a task works through.
BLOCK_SETS, TASK_ELEMENTS = 512, 1 << 20


def shingle_hashes(text: str, size: int = 3) -> tuple[Column, Column]:
    """The words `w` of a text, lower-cased, and over a column `w` the XXH64 (seed 42) of each run of `size` words; fewer
    words: of the whole sequence; none: []."""
    w = F.coalesce(F.array_remove(F.split(common.lower_ascii(text), BLANKS), ""), F.array().cast("array<string>"))
    joined = lambda i: F.concat_ws(" ", *[F.get(F.col("w"), i + j) for j in range(size)])
    n = F.size(F.col("w"))
    several = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(joined(i)))
    hashes = F.when(n == 0, F.array().cast("array<bigint>")).when(n < size, F.array(F.xxhash64(F.array_join("w", " ")))).otherwise(several)
    return w, hashes


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long): a bit is 1 if it is 1 in over half the shingle hashes, repeats included. No words or null: 0."""
    common.arrow_batches(docs.sparkSession, 4)
    w, hashes = shingle_hashes(text_col, size)
    hashed = docs.select(F.col(id_col).alias("id"), w.alias("w")).select("id", hashes.alias("h"))
    kind = docs.schema[id_col].dataType.simpleString()

    def majority(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            ones = np.zeros((len(counts) + 1, 64), np.int64)
            owner = np.repeat(np.arange(len(counts)), counts)
            for at in range(0, len(values), COUNTED):
                bits = np.unpackbits(values[at : at + COUNTED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                own = owner[at : at + COUNTED]
                first = np.flatnonzero(np.diff(own, prepend=-1))
                ones[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
            fp = np.packbits(ones[:-1] * 2 > counts[:, None], axis=1, bitorder="little").view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["id", "fp"])
            common.give_back()

    return hashed.mapInArrow(majority, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest point reachable from each of n points over the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    while (label[label] != label).any():
        label = label[label]
    return label


def tree_links(points: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Exact pairs within `radius` differing bits, by a vantage-point tree joined with itself.

    A node's points are split at the median distance to one of them; by the triangle bound, a pair across the split has
    both points within `radius` of it, so only those bands are followed into each other's branch.
    """

    def distance(x: np.ndarray, vantage) -> np.ndarray:
        return np.bitwise_count(points[x] ^ points[vantage]).astype(np.int16)

    def compare(x: np.ndarray, y: np.ndarray | None):
        other = x if y is None else y
        for at in range(0, len(x), 512):
            part = x[at : at + 512]
            i, j = np.nonzero(np.bitwise_count(points[part][:, None] ^ points[other][None, :]) <= radius)
            if y is None:
                keep = i + at < j
                i, j = i[keep], j[keep]
            if len(i):
                yield part[i], other[j]

    work: list[tuple[np.ndarray, np.ndarray | None]] = [(np.arange(len(points)), None)]
    while work:
        x, y = work.pop()
        if not len(x) or y is not None and not len(y):
            continue
        if len(x) <= LEAF if y is None else len(x) * len(y) <= LEAF * LEAF:
            yield from compare(x, y)
            continue
        vantage = x[len(x) // 2]
        d = distance(x, vantage)
        split = int(np.median(d))
        near, far = d <= split, d > split
        if y is None:
            if not far.any():
                split -= 1
                near, far = d <= split, d > split
            if not near.any() or not far.any():
                yield from compare(x, None)
                continue
            work += [(x[near], None), (x[far], None), (x[near & (d > split - radius)], x[far & (d <= split + radius)])]
        else:
            e = distance(y, vantage)
            parts = [(x[near], y[e <= split]), (x[far], y[e > split]), (x[near & (d > split - radius)], y[(e > split) & (e <= split + radius)]), (x[far & (d <= split + radius)], y[(e <= split) & (e > split - radius)])]
            if max(len(a) * len(b) for a, b in parts) > 0.9 * len(x) * len(y):
                yield from compare(x, y)
            else:
                work += parts


def band_sets(n: int, radius: int) -> list[tuple[int, ...]]:
    """(the bits of each tree's part of a fingerprint): every choice of k - radius of k bands. Of two fingerprints within `radius`
    bits, at least k - radius bands are equal, so they meet in a tree; k is the least for which a part has log2(n) - 4 bits."""
    for k in range(radius + 1, 65):
        edges = [64 * i // k for i in range(k + 1)]
        bands = [tuple(range(a, b)) for a, b in zip(edges[:-1], edges[1:])]
        if min(map(len, bands)) * (k - radius) >= math.log2(max(2, n)) - 4 or k == 64:
            return [sum(chosen, ()) for chosen in itertools.combinations(bands, k - radius)]
    return []


def shards(points: DataFrame, n: int, radius: int, sets: list[tuple[int, ...]] | None = None) -> DataFrame:
    """(shard long, fp): the shards of a forest of vantage-point trees.

    A tree's roots are told apart by the part of the fingerprint that band_sets() gives it, in which a pair within `radius`
    bits agrees. A root's points are dealt by their distance to its vantage point into rings radius + 1 wide; by the
    triangle bound a pair lies in one ring or in two that touch, so a point lives in its own ring and also visits the one
    below, where its distance is within `radius` of the boundary. Roots of more than TASK_POINTS points have as many further
    vantage points as halve them often enough, a point visiting each combination of rings: a hot shard is split, exactly.
    """
    sets = sets or band_sets(n, radius)
    parts = []
    for tree, bits in enumerate(sets):
        mask = sum(1 << b for b in bits)
        part = F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))
        parts.append(F.xxhash64(F.lit(tree), part))
    rooted = points.select("fp", F.explode(F.array(*parts)).alias("root"))
    hot = rooted.groupBy(F.col("root").alias("hot_")).agg(F.count("*").alias("n_")).where(F.col("n_") > TASK_POINTS)
    hot = common.written(hot.select("hot_", (1 + F.ceil(F.log2(F.col("n_") / TASK_POINTS))).cast("int").alias("levels")), "hot-roots")
    rooted = rooted.join(common.maybe_broadcast(hot, hot.count()), F.col("root") == F.col("hot_"), "left")
    width = radius + 1

    def visit(keys: Column, level: Column) -> Column:
        away = F.bit_count(F.col("fp").bitwiseXOR(F.xxhash64("root", level))).cast("int")
        ring, below = F.floor(away / width), F.floor((away - radius) / width)
        rings = F.array_distinct(F.array(ring, F.greatest(below, F.lit(0).cast("long"))))
        return F.flatten(F.transform(keys, lambda k: F.transform(rings, lambda r: F.xxhash64(k, r))))

    keys = F.aggregate(F.sequence(F.lit(1), F.coalesce("levels", F.lit(1))), F.array(F.col("root")), visit)
    return rooted.select(F.explode(keys).alias("shard"), "fp")


def links(points: DataFrame, radius: int = 3, sets: list[tuple[int, ...]] | None = None) -> DataFrame:
    """(a, b) with b < a: links that join the distinct fingerprints `fp` of points as all pairs within `radius` bits do.

    Each shard is joined by its own tree over whole fingerprints; of its pairs, each point's link to the smallest point that
    they reach goes on, so a group's links grow with its points, not their pairs. A shard holds distinct numbers of 64
    bits, 8 bytes each.
    """
    n = points.count()
    placed = common.written(shards(points, n, radius, sets), "fingerprint-shards")
    tasks = max(1, -(-placed.count() // TASK_POINTS))
    keyed = placed.withColumn("task", F.pmod(F.xxhash64("shard"), F.lit(tasks)).cast("int"))

    def joined(table: pa.Table) -> pa.Table:
        shard, fp = table.column("shard").to_numpy(), table.column("fp").to_numpy()
        order = np.lexsort((fp, shard))
        shard, fp = shard[order], fp[order]
        cuts = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard))
        a, b = [], []
        for first, last in zip(cuts[:-1], cuts[1:]):
            if last - first == 1:
                continue
            own = fp[first:last]
            label = np.arange(len(own))
            held, count = [], 0
            for pair in itertools.chain(tree_links(own.view(np.uint64), radius), [None]):
                if pair is not None:
                    held.append(pair)
                    count += len(pair[0])
                if held and (pair is None or count > HELD_PAIRS):
                    moved = np.flatnonzero(label != np.arange(len(own)))
                    i, j = (np.concatenate(x) for x in zip(*held, (moved, label[moved])))
                    label, held, count = roots(len(own), i, j), [], 0
            linked = np.flatnonzero(label != np.arange(len(own)))
            a.append(own[linked]), b.append(own[label[linked]])
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table([join(a), join(b)], ["a", "b"])

    return keyed.groupBy("task").applyInArrow(joined, "a long, b long").distinct()


def classes(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the connected component of each node that has a link.

    Alternating large-star and small-star steps, each a sum by node and a join, written to the shared folder; a hub's
    neighbours are summed before the shuffle and its join is one that AQE can split.
    """
    low, high = F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")
    edges = common.written(edges.where("a <> b").select(high, low).distinct(), "star")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = common.written(large.where("a <> b").distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = common.written(small.where("a <> b").distinct(), "small-star")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): documents whose fingerprints differ in at most `radius` bits are linked; the component id is
    the smallest id reachable.

    Equal fingerprints are one point from the start, with the smallest id of its documents. Null ids give no component
    id, unless another of the component has one. Every input row gives a row, repeated ones too; further columns are not
    looked at; empty input gives none.
    """
    found = common.written(fingerprints(docs, size, id_col, text_col), "fingerprints")
    points = common.written(found.groupBy("fp").agg(F.min(id_col).alias("least")), "points")
    of_node = classes(links(points.select("fp"), radius))
    known = points.join(of_node, points["fp"] == of_node["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    known = common.written(known, "classes")
    ids = known.groupBy("root").agg(F.min("least").alias("component_id"))
    members = known.join(ids, "root").select("fp", "component_id")
    return found.join(members, "fp").select(id_col, "fp", "component_id")


def signatures(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, node, n, bands): h tells texts of one id apart, node stands for the set of a text's shingles, n is their
    number, and two sets share each of the bands' keys with probability s**BAND_ROWS. No words or null: node 0, no bands.
    """
    common.arrow_batches(docs.sparkSession, 4)
    w, hashes = shingle_hashes(text_col, size)
    hashed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), w.alias("w")).select("id", "h", hashes.alias("x"))
    kind = docs.schema[id_col].dataType.simpleString()
    rng = np.random.default_rng(5)
    odd = rng.integers(0, 1 << 31, (SET_BANDS, BAND_ROWS), np.uint32) * np.uint32(2) + np.uint32(1)
    mix = rng.integers(0, 1 << 63, BAND_ROWS + 2, np.uint64) * np.uint64(2) + np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).cumsum()
            values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            sets = [np.unique(x) for x in np.split(values, ends[:-1])] if len(ends) else []
            n = np.array([len(x) for x in sets], np.int64)
            some = np.flatnonzero(n)
            node, keys = np.zeros(len(n), np.uint64), np.zeros((len(some), SET_BANDS), np.uint64)
            if len(some):
                x, starts = np.concatenate(sets), (n.cumsum() - n)[some]
                node[some] = np.add.reduceat((x ^ x >> np.uint64(29)) * mix[-1], starts)
                short = (x >> np.uint64(32)).astype(np.uint32)
                keys += np.arange(SET_BANDS, dtype=np.uint64) * mix[-2]
                for band in range(SET_BANDS):
                    for row in range(BAND_ROWS):
                        least = np.minimum.reduceat(short * odd[band, row], starts).astype(np.uint64)
                        keys[:, band] = (keys[:, band] ^ keys[:, band] >> np.uint64(32) ^ least) * mix[row]
            offsets = np.concatenate([[0], ((n > 0) * SET_BANDS).cumsum()]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node.view(np.int64)), pa.array(n), bands], ["id", "h", "node", "n", "bands"])
            common.give_back()

    return hashed.mapInArrow(sign, f"id {kind}, h long, node long, n long, bands array<long>")


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets' exact Jaccard similarity is at least `least`."""
    of = lambda side: sets.select(F.col("node").alias(side), F.col("x").alias(f"x{side}"))
    both = F.size(F.array_intersect("xa", "xb"))
    return pairs.join(of("a"), "a").join(of("b"), "b").where(both >= F.lit(least) * (F.size("xa") + F.size("xb") - both)).select("a", "b")


def cross_links(open_: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): links between sets of different roots in one bucket, by exact Jaccard similarity; enough of them to join what all
    such pairs join. open_: (key, node, n, root, blocks).

    A bucket's sets are dealt to blocks of about BLOCK_SETS, and each two blocks meet in a cell: a set is copied once for
    each block of its bucket, pairs are held against each other inside a task, and no more links leave a cell than it has sets.
    """
    elements = open_.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0
    tasks = max(1, -(-elements // TASK_ELEMENTS))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.xxhash64("key", F.least(own, o), F.greatest(own, o)))
    placed = open_.join(sets, "node").select(F.explode(cells).alias("cell"), "node", "root", "x")
    placed = placed.withColumn("task", F.pmod(F.xxhash64("cell"), F.lit(tasks)).cast("int"))

    def linked(table: pa.Table) -> pa.Table:
        cell, node, root = (table.column(c).to_numpy() for c in ("cell", "node", "root"))
        lists = table.column("x").combine_chunks()
        values, size = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.cumsum(size) - size
        order = np.lexsort((node, cell))
        cuts = np.append(np.flatnonzero(np.append(True, cell[order][1:] != cell[order][:-1])), len(order))
        found = []
        for first, last in zip(cuts[:-1], cuts[1:]):
            rows = order[first:last]
            if len(np.unique(root[rows])) < 2:
                continue
            i, j = np.nonzero(np.triu(similarities([values[begin[r] : begin[r] + size[r]] for r in rows]) >= least, 1))
            apart = root[rows[i]] != root[rows[j]]
            i, j = rows[i[apart]], rows[j[apart]]
            _, code = np.unique(root[rows], return_inverse=True)
            of_row = dict(zip(rows.tolist(), code.tolist()))
            label = np.arange(code.max() + 1)
            for x, y in zip(i.tolist(), j.tolist()):  # a link is kept if it joins what earlier ones left apart
                p, q = label[of_row[x]], label[of_row[y]]
                if p != q:
                    label[label == q] = p
                    found.append((max(node[x], node[y]), min(node[x], node[y])))
        common.give_back()
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table([pairs[:, 0], pairs[:, 1]], ["a", "b"])

    return placed.groupBy("task").applyInArrow(linked, "a long, b long").distinct()


def similarities(sets: list[np.ndarray]) -> np.ndarray:
    """The Jaccard similarity of every two of some sets of distinct numbers, none of them empty."""
    size = np.array([len(x) for x in sets])
    own = np.repeat(np.arange(len(sets)), size)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    place = np.full(len(count), -1)
    place[shared] = np.arange(len(shared))
    own, column = own[place[code] >= 0], place[code][place[code] >= 0]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, len(shared), 4_096):
        some = (column >= lo) & (column < lo + 4_096)
        page = np.zeros((len(sets), min(4_096, len(shared) - lo)), np.float32)
        page[own[some], column[some] - lo] = 1
        both += page @ page.T
    return both / (size[:, None] + size[None, :] - both)


def near_sets(docs: DataFrame, size: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, root): documents whose sets of `size`-word shingles have a Jaccard similarity of at least `least` are linked;
    root stands for the documents that links reach.

    Equal sets are one point. Candidates share a band of their signatures, and each link is checked on the sets
    themselves. First the points of a bucket are held against its smallest and its largest, so that a group of copies
    has links in proportion to its points; then those of a bucket that no links join yet are held against each other in
    blocks: see cross_links().
    """
    found = common.written(signatures(docs, size, id_col, text_col), "signatures")
    points = found.groupBy("node").agg(F.first(F.struct("id", "h", "n", "bands")).alias("r")).select("node", "r.*").where("n > 0")
    placed = common.written(points.select("node", "id", "h", "n", F.explode("bands").alias("key")), "buckets")
    buckets = placed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    placed = common.written(placed.join(buckets, "key"), "shared-buckets")
    alike = lambda x, y: F.least(x, y) >= F.lit(least) * F.greatest(x, y)

    members = common.written(placed.select("node", "id", "h", "n").distinct(), "members")
    few = common.maybe_broadcast(members.select("id", "h", "node").withColumnsRenamed({"id": "id_", "h": "h_"}), members.count())
    w, hashes = shingle_hashes("t", size)
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))
    texts = texts.join(few, texts["id"].eqNullSafe(few["id_"]) & (texts["h"] == few["h_"])).dropDuplicates(["node"])
    sets = common.written(texts.select("node", "t", w.alias("w")).select("node", F.array_distinct(hashes).alias("x")), "sets")

    pair = lambda end: placed.where(F.col("node") != F.col(end)).select(F.least("node", end).alias("b"), F.greatest("node", end).alias("a"))
    sizes = members.select("node", "n")
    sized = lambda p: p.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
    first = sized(pair("low").unionByName(pair("high")).distinct()).where(alike(F.col("na"), F.col("nb"))).select("a", "b")
    first = common.written(first, "bucket-pairs")
    linked = common.written(similar(first, sets, least), "similar")
    of_node = classes(linked)

    open_ = placed.join(of_node, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    mixed = open_.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("m")).where("low <> high").select("key", F.ceil(F.col("m") / BLOCK_SETS).cast("int").alias("blocks"))
    open_ = common.written(open_.join(mixed, "key"), "open-buckets")
    more = common.written(cross_links(open_, sets, least), "similar")
    if not more.isEmpty():
        of_node = classes(linked.unionByName(more))
    return found.join(of_node, "node", "left").select(F.col("id").alias(id_col), "h", F.coalesce("root", "node").alias("root"))
