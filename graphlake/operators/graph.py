"""Property graph: nodes (id, type, attributes) and edges (id, source, target, type, pos) as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.operators.narrow import among, kept

#: Nodes of a task where edges are dealt by their ends.
NODES_A_TASK = 250_000


def node_table(rows: DataFrame, node_id: Column, kind: str, attributes: dict[str, Column]) -> DataFrame:
    """Nodes of one type; missing attributes stay in the map as null."""
    pairs = [x for k, v in attributes.items() for x in (F.lit(k), v.cast("string"))]
    return rows.select(node_id.alias("id"), F.lit(kind).alias("type"), F.create_map(*pairs).alias("attributes"))


def first_nodes(rows: DataFrame, key: str, order: Column, values: list[str]) -> DataFrame:
    """One row per key, the first in order."""
    return rows.groupBy(key).agg(*[F.min_by(v, order).alias(v) for v in values])


def edge_table(rows: DataFrame, source: Column, target: Column, kind: str, pos: Column) -> DataFrame:
    return rows.select(F.concat_ws("-", F.lit(kind), source, target).alias("id"), source.alias("source"), target.alias("target"), F.lit(kind).alias("type"), pos.cast("long").alias("pos"))


def combine(*tables: DataFrame) -> DataFrame:
    """All nodes, or all edges, of several graphs: duplicates are kept."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def first_target(edges: DataFrame, kind: str) -> DataFrame:
    """(source, target) of each source's first edge of a type."""
    return edges.where(F.col("type") == kind).groupBy("source").agg(F.min_by("target", F.struct("pos", "target")).alias("target"))


def enrich_with_parent(nodes: DataFrame, edges: DataFrame, kind: str, attribute: str, name: str) -> DataFrame:
    """(id, name): a child's parent's attribute, or the parent's id where it has none; children of unknown parents are left out."""
    parents = nodes.select(F.col("id").alias("target"), F.nullif(F.col("attributes")[attribute], F.lit("")).alias("value"))
    return first_target(edges, kind).join(parents, "target").select(F.col("source").alias("id"), F.coalesce("value", "target").alias(name))


def enrich_with_children(nodes: DataFrame, edges: DataFrame, kind: str, attribute: str, limit: int = 10) -> DataFrame:
    """(id, codes): a parent's distinct child codes in the order of their edges, the first `limit`."""
    codes = nodes.select(F.col("id").alias("source"), F.nullif(F.col("attributes")[attribute], F.lit("")).alias("code")).where("code is not null")
    pairs = edges.where(F.col("type") == kind).join(codes, "source").groupBy("target", "code").agg(F.min("pos").alias("pos"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "code")))
    return pairs.groupBy("target").agg(F.slice(F.transform(ordered, lambda x: x["code"]), 1, limit).alias("codes")).withColumnRenamed("target", "id")


def neighbours(nodes: DataFrame, edges: DataFrame, starts: DataFrame, direction: str = "outgoing", kind: str | None = None) -> DataFrame:
    """(start, id, type, edge_type) of the nodes at the far end of the starts' edges; ends that are no node are dropped."""
    if direction not in ("outgoing", "incoming"):
        raise ValueError(f"direction {direction!r}: outgoing or incoming")
    near, far = ("source", "target") if direction == "outgoing" else ("target", "source")
    chosen = edges.where(F.col("type") == kind) if kind else edges
    ends = chosen.select(F.col(near).alias("start"), F.col(far).alias("id"), F.col("type").alias("edge_type"))
    return ends.join(starts.select(F.col("id").alias("start")), "start", "left_semi").join(nodes.select("id", "type"), "id").select("start", "id", "type", "edge_type")


def parents_of(nodes: DataFrame, edges: DataFrame, children: DataFrame, kind: str) -> DataFrame:
    """(id, parent): the first target that is a node, or null."""
    known = edges.where(F.col("type") == kind).join(nodes.select(F.col("id").alias("target")), "target", "left_semi")
    return children.select("id").join(first_target(known, kind).withColumnRenamed("source", "id"), "id", "left").withColumnRenamed("target", "parent")


def inverted_index(nodes: DataFrame, edges: DataFrame, kind: str, attribute: str) -> DataFrame:
    """(code, n, first, last): upper-cased child codes, how many parents have each, and the first and last of them."""
    pairs = code_holders(nodes, edges, kind, attribute)
    return pairs.groupBy("code").agg(F.count("*").alias("n"), F.min("target").alias("first"), F.max("target").alias("last"))


def code_holders(nodes: DataFrame, edges: DataFrame, kind: str, attribute: str) -> DataFrame:
    """(code, target): the index itself, one row for each parent that has a child of the upper-cased code; a code that nearly
    every parent has stays spread over rows."""
    codes = nodes.select(F.col("id").alias("source"), F.upper(F.col("attributes")[attribute]).alias("code")).where("code is not null")
    return edges.where(F.col("type") == kind).join(codes, "source").select("code", "target").distinct()


def expand(edges: DataFrame, seeds: DataFrame, hops: int = 1, direction: str = "both") -> DataFrame:
    """(seed, node, hop): nodes within `hops` edges of each seed by the shortest way, seeds at hop 0.

    A frontier is distinct before it meets the edges, and nodes seen before are left out by an anti join, so a hub is
    followed once a seed. Each hop's frontier is stored before the next.
    """
    way = {"out": "outgoing", "in": "incoming", "both": None}[direction]
    asked = seeds.select(F.col("id").alias("query_id"), "id", F.lit(way).cast("string").alias("direction"), F.lit(hops).alias("hops"))
    return expand_each(edges, asked, hops).withColumnRenamed("query_id", "seed")


def expand_each(edges: DataFrame, seeds: DataFrame, most: int = 2) -> DataFrame:
    """seeds (query_id, id, direction, hops): (query_id, node, hop) within each query's own hops, `most` at most, and direction
    (outgoing, incoming, or null for both), by the shortest way; seeds are at hop 0. One direction and hops a query.

    Where a hop's frontier has few nodes, edges are cut to theirs where they are read, and only those are shuffled."""
    out = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), F.lit("outgoing").alias("way"))
    steps = out.union(edges.select(F.col("target").alias("a"), F.col("source").alias("b"), F.lit("incoming").alias("way")))
    frontier = kept(seeds.select("query_id", F.col("id").alias("node"), "direction", "hops").distinct())
    seen = frontier.select("query_id", "node", F.lit(0).alias("hop"))
    for hop in range(1, most + 1):
        going = frontier.where(F.col("hops") >= hop)
        go = going.join(among(steps, "a", going, "node"), (F.col("node") == F.col("a")) & (F.col("direction").isNull() | (F.col("direction") == F.col("way"))))
        reached = go.select("query_id", F.col("b").alias("node"), "direction", "hops").distinct()
        frontier = reached.join(seen.select("query_id", "node"), ["query_id", "node"], "left_anti").select("query_id", "node", "direction", "hops")
        frontier = kept(frontier) if hop < most else frontier
        seen = seen.union(frontier.select("query_id", "node", F.lit(hop)))
    return seen


def tasks_for(nodes: DataFrame) -> int:
    """How many tasks nodes and what belongs to them are dealt to: a task's share stays the same however many there are."""
    return max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() // NODES_A_TASK))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n_out, n_in, and by edge type out and in as one sorted text) of every node, 0 without edges. Ends are dealt once, by
    id, to as many tasks as the nodes need; counts, sums and nodes meet there."""
    n = tasks_for(nodes)
    ends = edges.select(F.col("source").alias("id"), F.lit("out").alias("way"), "type").union(edges.select(F.col("target").alias("id"), F.lit("in").alias("way"), "type"))
    by_type = ends.where("id is not null").repartition(n, "id").groupBy("id", "way", "type").agg(F.count("*").alias("n"))
    label = F.concat_ws(":", "way", "type", F.col("n").cast("string"))
    total = lambda way: F.coalesce(F.sum(F.when(F.col("way") == way, F.col("n"))), F.lit(0)).alias(f"n_{way}")
    sums = by_type.groupBy("id").agg(total("out"), total("in"), F.array_join(F.array_sort(F.collect_list(label)), ",").alias("by_type"))
    zero = F.lit(0).cast("long")
    met = nodes.select("id").repartition(n, "id").join(sums, "id", "left")
    return met.select("id", F.coalesce("n_out", zero).alias("n_out"), F.coalesce("n_in", zero).alias("n_in"), F.coalesce("by_type", F.lit("")).alias("by_type"))


def orphan_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edges whose source or target is no node (null is none). Edges are dealt by source and then by target to as many tasks
    as the nodes need, and stream past the ids there; nothing sorts them, and an edge lost at both ends is there once."""
    n = tasks_for(nodes)
    ids = nodes.select(F.col("id").alias("node")).where("node is not null").repartition(n, "node").distinct()
    known = lambda end: ids.select(F.col("node").alias(f"{end}_node_")).hint("shuffle_hash")
    met = edges.repartition(n, "source").join(known("source"), F.col("source") == F.col("source_node_"), "left")
    met = met.withColumn("found_", F.col("source_node_").isNotNull()).drop("source_node_").repartition(n, "target").join(known("target"), F.col("target") == F.col("target_node_"), "left")
    return met.where(~F.col("found_") | F.col("target_node_").isNull()).select(*edges.columns).distinct()


def provenance(nodes: DataFrame, sources: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """(id, source_file, key_fields): a node's source by its type, and the key attributes that it has, as sorted k=v."""
    table = F.create_map(*[x for k, (file, _) in sources.items() for x in (F.lit(k), F.lit(file))])
    keys = F.create_map(*[x for k, (_, fields) in sources.items() for x in (F.lit(k), F.array(*map(F.lit, fields)))])
    held = F.map_filter("attributes", lambda k, v: F.array_contains(keys[F.col("type")], k) & v.isNotNull() & (v != ""))
    pairs = F.transform(F.array_sort(F.map_entries(held)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return nodes.select("id", F.coalesce(table[F.col("type")], F.lit("unknown")).alias("source_file"), F.coalesce(F.array_join(pairs, ";"), F.lit("")).alias("key_fields"))


def answer_provenance(answers: DataFrame, traced: DataFrame) -> DataFrame:
    """answers (query_id, ids): (query_id, n_nodes, files) over the nodes each answer was given from."""
    of = answers.select("query_id", F.explode("ids").alias("id")).join(traced, "id")
    return of.groupBy("query_id").agg(F.count("*").alias("n_nodes"), F.array_join(F.array_sort(F.collect_set("source_file")), ",").alias("files"))
