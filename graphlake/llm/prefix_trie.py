"""Conversation prefix trie: adaptive radix trees over the sorted byte keys of conversations, merged along their edges.

A turn's id is WIDTH big-endian bytes of the hash of its role and text; a conversation's key is its turns' ids in order.
Keys are dealt by range, so every task reads a sorted run whatever the number of copies, and builds one tree for each
block of BLOCK_KEYS keys. Nodes off the block's first and last paths have all their members in it and are final; those on
the two paths are open, and partial sums of the same node meet by its key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.llm import common

#: Bytes of a turn's id, keys and key bytes that one tree holds, and bytes of an ended list's piece.
WIDTH, BLOCK_KEYS, BLOCK_BYTES, PIECE_BYTES = 16, 32_768, 16 << 20, 1 << 20


class Node:
    """A node of an adaptive radix tree: the bytes of its compressed path, its children and what ends at it.

    Children are kept in the layout that their number asks for: sorted bytes beside a list up to 16 (4 and 16 differ only
    in their room), a 256-byte index into a list up to 48, and a list of 256 beyond.
    """

    __slots__ = ("path", "kind", "keys", "kids", "ends", "sizes")

    def __init__(self, path: bytes):
        self.path, self.kind, self.keys, self.kids = path, 4, bytearray(), []
        self.ends: list[int] = []
        self.sizes: list[int] = []

    def find(self, byte: int) -> "Node | None":
        if self.kind <= 16:
            at = self.keys.find(byte)
            return self.kids[at] if at >= 0 else None
        if self.kind == 48:
            at = self.keys[byte]
            return self.kids[at - 1] if at else None
        return self.kids[byte]

    def put(self, byte: int, kid: "Node") -> None:
        """Adds or replaces a child; a full layout grows to the next one."""
        if self.kind <= 16:
            at = self.keys.find(byte)
            if at >= 0:
                self.kids[at] = kid
                return
            if len(self.kids) == self.kind:
                self._grow()
                return self.put(byte, kid)
            at = sum(k < byte for k in self.keys)
            self.keys.insert(at, byte)
            self.kids.insert(at, kid)
        elif self.kind == 48:
            at = self.keys[byte]
            if at:
                self.kids[at - 1] = kid
            elif len(self.kids) == 48:
                self._grow()
                self.put(byte, kid)
            else:
                self.kids.append(kid)
                self.keys[byte] = len(self.kids)
        else:
            self.kids[byte] = kid

    def _grow(self) -> None:
        if self.kind == 4:
            self.kind = 16
        elif self.kind == 16:
            index = bytearray(256)
            for i, byte in enumerate(self.keys):
                index[byte] = i + 1
            self.kind, self.keys = 48, index
        else:
            wide: list[Node | None] = [None] * 256
            for byte, at in enumerate(self.keys):
                if at:
                    wide[byte] = self.kids[at - 1]
            self.kind, self.keys, self.kids = 256, bytearray(), wide

    def children(self) -> list["Node"]:
        """In order of their first byte."""
        if self.kind <= 16:
            return self.kids
        if self.kind == 48:
            return [self.kids[at - 1] for at in self.keys if at]
        return [kid for kid in self.kids if kid is not None]


def insert(root: Node, key: bytes, number: int, sizes: list[int]) -> None:
    """Adds a key with the number that ends at it and the byte sizes of its turns' texts."""
    node, at = root, 0
    while at < len(key):
        kid = node.find(key[at])
        if kid is None:
            kid = Node(key[at:])
            node.put(key[at], kid)
            node, at = kid, len(key)
            break
        path, rest = kid.path, key[at:]
        same = _common(path, rest)
        if same == len(path):
            node, at = kid, at + same
            continue
        middle = Node(path[:same])
        kid.path = path[same:]
        middle.put(path[same], kid)
        node.put(key[at], middle)
        node, at = middle, at + same
    node.ends.append(number)
    node.sizes = sizes


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y))


def turn_ids(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, tid, size): the id of each turn's role and text, and its text's bytes; null role or text is empty.
    Rows without a conv_id belong to no conversation and are left out."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    tid = F.substring(F.unhex(F.sha2(named, 256)), 1, WIDTH)
    kept = turns.where(F.col("conv_id").isNotNull())
    return kept.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), tid.alias("tid"), F.octet_length(text).cast("int").alias("size"))


def rebuilt(turns: DataFrame, base: Column, shared: Column, most: int) -> DataFrame:
    """(conv_id, key, sizes): for each conversation the first `shared` turns (at most `most`) of conversation `base`, all of
    them if it has fewer and none if there is no such one, then its own turns after its first `shared`.

    base and shared are columns over conv_id. Turns go by number, null first; equal numbers by their turn's id, and
    repeated rows stay. Texts give way to ids before the shuffle; the ids of one conversation are one row.
    """
    listed = F.sort_array(F.collect_list(F.struct("turn", "tid", "size")))
    own = turn_ids(turns).groupBy("conv_id").agg(F.transform(listed, lambda t: F.struct(t["tid"].alias("tid"), t["size"].alias("size"))).alias("own"))
    own = common.written(own, "conversations")
    heads = own.select(F.col("conv_id").alias("base_"), F.slice("own", 1, most).alias("head_"))
    asked = own.withColumn("base_id", base).withColumn("h", shared.cast("int"))
    joined = asked.join(heads, F.col("base_id") == F.col("base_"), "left")
    first = F.coalesce(F.slice("head_", F.lit(1), F.col("h")), F.array().cast(own.schema["own"].dataType))
    whole = joined.select("conv_id", F.concat(first, F.expr("slice(own, h + 1, size(own))")).alias("turns"))
    key = F.unhex(F.concat_ws("", F.transform("turns", lambda t: F.hex(t["tid"]))))
    return whole.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes"))


def flatten(root: Node) -> tuple[list[int], list[int], list[list[int]], list[list[int]]]:
    """Depths in turns, parents, ended numbers and a member's text sizes of the nodes at turn boundaries, in order of their
    keys; a compressed path gives a node for each boundary that it crosses."""
    depths, parents, ends, sizes = [0], [-1], [root.ends], [root.sizes]
    stack = [(kid, 0, 0) for kid in reversed(root.children())]
    while stack:
        node, at, above = stack.pop()
        upto = at + len(node.path)
        for depth in range(at // WIDTH + 1, upto // WIDTH + 1):
            depths.append(depth)
            parents.append(above)
            ends.append([])
            sizes.append([])
            above = len(depths) - 1
        if node.ends:
            ends[above], sizes[above] = node.ends, node.sizes
        stack.extend((kid, upto, above) for kid in reversed(node.children()))
    for i in range(len(depths) - 1, 0, -1):
        if len(sizes[i]) > len(sizes[parents[i]]):
            sizes[parents[i]] = sizes[i]
    return depths, parents, ends, sizes


def block_rows(keys: list[bytes], numbers: list[int], sizes: list[list[int]], part: int, block: int) -> Iterator[tuple]:
    """The rows (in the order of ROWS) of one tree over sorted keys: final nodes, open nodes and pieces of open nodes' lists."""
    root = Node(b"")
    for key, number, size in zip(keys, numbers, sizes):
        insert(root, key, number, size)
    depths, parents, ends, texts = flatten(root)
    count = len(depths)
    is_open = [False] * count
    for i in range(len(keys[0]) // WIDTH + 1):
        is_open[i] = True
    last = count - 1
    while last >= 0:
        is_open[last] = True
        last = parents[last]
    n, least = [len(e) for e in ends], [min(e, default=None) for e in ends]
    kids, leaves, saved = [0] * count, [0] * count, [0] * count
    for i in range(count - 1, -1, -1):
        size = texts[i][depths[i] - 1] if depths[i] else 0
        if not is_open[i]:
            leaves[i] += kids[i] == 0
            saved[i] += (n[i] - 1) * size
        up = parents[i]
        if up >= 0:
            n[up] += n[i]
            least[up] = least[i] if least[up] is None else min(least[up], least[i])
            kids[up] += not is_open[i]
            leaves[up] += leaves[i]
            saved[up] += saved[i]
    named: dict[int, str] = {}
    piece = 0
    first, final = keys[0], keys[-1]
    for i in range(count):
        up, size = parents[i], texts[i][depths[i] - 1] if depths[i] else 0
        if is_open[i]:
            key = (first if i <= len(first) // WIDTH else final)[: depths[i] * WIDTH]
            named[i] = name = hashlib.sha256(key).hexdigest()
            yield OPEN, name, key, least[i], depths[i], size, None, None, n[i], kids[i], leaves[i], saved[i], None, None, None, None
            for text in pieces(ends[i]):
                yield PIECE, name, None, None, None, None, None, None, None, None, None, None, None, part, block << 24 | piece, text
                piece += 1
        else:
            sha = hashlib.sha256(",".join(map(str, ends[i])).encode()).hexdigest()
            parent = (None, named[up]) if is_open[up] else (least[up], None)
            yield CLOSED, None, None, least[i], depths[i], size, *parent, n[i], kids[i], leaves[i], saved[i], sha, None, None, None


def pieces(numbers: list[int]) -> Iterator[str]:
    """Comma-joined runs of about PIECE_BYTES."""
    step = PIECE_BYTES // 20
    for at in range(0, len(numbers), step):
        yield ",".join(map(str, numbers[at : at + step]))


CLOSED, OPEN, PIECE = 0, 1, 2
ROWS = "kind int, id string, key binary, conv_id long, depth int, size int, parent long, parent_id string, n long, kids long, leaves long, saved long, ends string, part int, seq long, piece string"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
SCHEMA = pa.schema([(name, _TYPES[kind]) for name, kind in (x.split() for x in ROWS.split(", "))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, SCHEMA.types)], schema=SCHEMA)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One tree for each block of a task's sorted run; of a tree, its rows are kept until 4,096 have gathered."""
    held, weight, block, rows = ([], [], []), 0, 0, []
    part = 0

    def flush():
        nonlocal held, weight, block
        found = block_rows(*held, part, block)
        held, weight, block = ([], [], []), 0, block + 1
        return found

    for batch in batches:
        part = batch.column(0)[0].as_py() if batch.num_rows else part
        for key, number, size in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            for column, value in zip(held, (key, number, size)):
                column.append(value)
            weight += len(key)
            if len(held[0]) >= BLOCK_KEYS or weight >= BLOCK_BYTES:
                for row in flush():
                    rows.append(row)
                    if len(rows) >= 4096:
                        yield _batch(rows)
                        rows = []
    if held[0]:
        for row in flush():
            rows.append(row)
            if len(rows) >= 4096:
                yield _batch(rows)
                rows = []
    if rows:
        yield _batch(rows)
    common.give_back()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, ends) of pieces sorted by id: one running hash, whatever the number of pieces."""
    now, state = None, None
    out = lambda: pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], ["id", "ends"])
    for batch in batches:
        for name, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if name != now:
                if state:
                    yield out()
                now, state = name, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
    if state:
        yield out()


def trie(keys: DataFrame) -> DataFrame:
    """The nodes of all conversations' prefixes, from (conv_id, key, sizes) as `rebuilt` gives them.

    (conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long,
    ends_sha256 string). Equal keys are members of one node and conv_ids may repeat; an empty table has no nodes. Keys
    are dealt by range of (key, conv_id), so that copies without end are still spread. Open nodes are two paths a block:
    their sums below each other cost the square of the turns of such a conversation. The list of ids that end at an
    open node goes through one hash, which can't be split, as text in pieces of a megabyte.
    """
    common.arrow_batches(keys.sparkSession)
    dealt = keys.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    made = common.written(dealt.select(F.spark_partition_id().alias("part"), "key", "conv_id", "sizes").mapInArrow(_trees, ROWS), "trie-rows")
    open_rows = made.where(F.col("kind") == OPEN)
    sums = [F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")]
    merged = common.written(open_rows.groupBy("id").agg(F.first("key").alias("key"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("size").alias("size"), *sums), "trie-open")
    up = F.sha2(F.expr(f"substring(key, 1, (depth - 1) * {WIDTH})"), 256)
    merged = merged.withColumn("up", F.when(F.col("depth") > 0, up))
    below = merged.where("depth > 0").groupBy(F.col("up").alias("b_id")).agg(F.count("*").alias("open_kids"))
    own = merged.join(below, merged["id"] == below["b_id"], "left").withColumn("kids", F.col("kids") + F.coalesce("open_kids", F.lit(0)))
    paths = own.select(F.explode(F.sequence(F.lit(0), "depth")).alias("a"), "key", (F.col("kids") == 0).cast("long").alias("leaf"), ((F.col("n") - 1) * F.col("size")).alias("mine"))
    above = paths.groupBy(F.sha2(F.expr(f"substring(key, 1, a * {WIDTH})"), 256).alias("a_id")).agg(F.sum("leaf").alias("more_leaves"), F.sum("mine").alias("more_saved"))
    lists = made.where(F.col("kind") == PIECE).repartition("id").sortWithinPartitions("id", "part", "seq").select("id", "piece").mapInArrow(_hashed, "id string, ends string")
    lists = lists.select(F.col("id").alias("l_id"), F.col("ends").alias("list"))
    parents = merged.select(F.col("id").alias("p_id"), F.col("conv_id").alias("p_conv"))
    whole = own.join(above, own["id"] == above["a_id"]).join(lists, own["id"] == lists["l_id"], "left").join(parents, own["up"] == parents["p_id"], "left")
    final = whole.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.col("p_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
        (F.col("leaves") + F.col("more_leaves")).alias("n_leaves"), (F.col("saved") + F.col("more_saved")).alias("saved_tokens"), F.coalesce("list", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )
    few = common.maybe_broadcast(parents, parents.count())
    closed = made.where(F.col("kind") == CLOSED).join(few, F.col("parent_id") == few["p_id"], "left")
    closed = closed.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.coalesce("parent", "p_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )
    return closed.unionByName(final)
