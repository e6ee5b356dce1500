"""Merkle manifest: rank digits are grouped away one after another within blocks, nesting child structs; proofs are exploded.

Nodes of a group have ranks from 0. A rank's last DEPTH digits to base FAN place a node in its block of FAN ** DEPTH; one
grouping for each digit nests up to FAN children in their parent's struct, which ends as one row a block. Blocks' roots are
the nodes of the next round until a group has one node left. On the way down, a block and the siblings above it meet by a
grouping of their union, and transforms explode the struct again with the siblings of every node. No join makes a proof.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphlake.llm import common

#: Children of a node, and levels that one block nests: a row holds at most FAN ** DEPTH nodes.
FAN, DEPTH = 3, 6
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
STEP = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 bytes' count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """(doc_id, grp, leaf, other): a row's hash over FIELDS, and over them without line feeds where `tampered` is true and
    that differs, else null. grp orders as the sources do, null first. Texts are not kept."""
    head = F.concat(*[field(F.col(c)) for c in FIELDS[:-1]])
    less = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    changes = F.coalesce(tampered, F.lit(False)) & F.coalesce(F.col("text").contains("\n"), F.lit(False))
    return docs.select(
        "doc_id",
        F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string"))).alias("grp"),
        digest(F.concat(head, field(F.col("text")))).alias("leaf"),
        F.when(changes, digest(F.concat(head, field(less)))).alias("other"),
    )


def ranked(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows, written, with `rank` (long, from 0 within each group) and `n` (long, the group's rows).

    Rows are dealt by range of (group, order), so a group of any size is spread; a task's rows of a group are numbered by
    themselves, from the count of the tasks before it.
    """
    keys = [F.col(group), *[F.asc_nulls_first(c) for c in order]]
    dealt = common.written(rows.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), name)
    counts = dealt.groupBy(group, "part").agg(F.count("*").alias("c"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(group).alias("g_"), F.col("part").alias("p_"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("first_"), F.sum("c").over(whole).alias("n"))
    counts = common.written(counts, f"{name}-counts")
    counts = common.maybe_broadcast(counts, counts.count())
    within = F.row_number().over(Window.partitionBy(group, "part").orderBy(*[F.asc_nulls_first(c) for c in order])) - 1
    numbered = dealt.withColumn("within_", within)
    found = numbered.join(counts, (numbered[group] == counts["g_"]) & (numbered["part"] == counts["p_"]))
    return found.withColumn("rank", F.col("first_") + F.col("within_")).drop("g_", "p_", "part", "first_", "within_")


def nest(nodes: DataFrame, levels: int = DEPTH) -> DataFrame:
    """(grp, n, block, tree): nodes (grp, rank, n, hash, rest) nested in one struct for each block of FAN ** levels ranks.

    The digits are columns; each grouping drops the last of those left and puts the children, in order, in a struct
    {digit, hash, kids}. Where a group has but one node left on a level, it goes up as it is.
    """
    digits = [f"d{k}" for k in range(levels)]
    at = nodes.select(
        "grp",
        "n",
        F.floor(F.col("rank") / FAN**levels).cast("long").alias("block"),
        *[(F.floor(F.col("rank") / FAN**k) % FAN).cast("int").alias(d) for k, d in enumerate(digits)],
        F.struct("hash", "rest").alias("node"),
    ).repartition("grp", "block")
    for k, digit in enumerate(digits):
        kids = F.transform(F.sort_array(F.collect_list(F.struct(F.col(digit).alias("digit"), "node"))), lambda x: x["node"])
        at = at.groupBy("grp", "n", "block", *digits[k + 1 :]).agg(kids.alias("kids"))
        joined = F.concat_ws("", F.transform("kids", lambda x: x["hash"]))
        many = F.col("n") > FAN**k
        at = at.withColumn("node", F.struct(F.when(many, digest(joined)).otherwise(joined).alias("hash"), "kids")).drop("kids")
    return at.select("grp", "n", "block", F.col("node").alias("tree"))


def unnest(blocks: DataFrame, above: DataFrame, levels: int = DEPTH) -> DataFrame:
    """(grp, rank, n, hash, rest, proof, root): every node of the blocks with its siblings up to the root.

    above: (grp, block, proof, root) for each block. Both are grouped by (grp, block), a row of each; then each level's
    children are exploded with the hashes left and right of them before what stands above.
    """
    both = blocks.select("grp", "block", "n", "tree", F.lit(None).cast(STEP).alias("proof"), F.lit(None).cast("string").alias("root")).unionByName(
        above.select("grp", "block", "proof", "root"), allowMissingColumns=True
    )
    met = both.groupBy("grp", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n", "tree", "proof", "root")])
    at = met.select("grp", "n", F.col("block").alias("rank"), F.col("tree").alias("node"), "proof", "root")
    for k in reversed(range(levels)):
        hashes = F.transform("node.kids", lambda x: x["hash"])
        at = at.withColumn("hashes", hashes).select("grp", "n", "rank", "proof", "root", "hashes", F.posexplode("node.kids").alias("i", "node"))
        step = F.struct(F.concat_ws("", F.expr("slice(hashes, 1, i)")).alias("left"), F.concat_ws("", F.expr("slice(hashes, i + 2, size(hashes))")).alias("right"))
        proof = F.when(F.col("n") > FAN**k, F.concat(F.array(step), F.col("proof"))).otherwise(F.col("proof"))
        at = at.select("grp", "n", (F.col("rank") * FAN + F.col("i")).alias("rank"), proof.alias("proof"), "root", "node")
    return at.select("grp", "rank", "n", "node.hash", "node.rest", "proof", "root")


def climb(nodes: DataFrame, name: str, levels: int = DEPTH) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each round, written, and the last round's nodes: (grp, rank 0, n 1, hash), a root for each group."""
    rounds, most = [], nodes.agg(F.max("n")).first()[0] or 1
    while most > 1 or not rounds:
        blocks = common.written(nest(nodes, levels), f"{name}-blocks")
        rounds.append(blocks)
        n = F.ceil(F.col("n") / FAN**levels).cast("long")
        nodes = blocks.select("grp", F.col("block").alias("rank"), n.alias("n"), F.col("tree.hash").alias("hash"), F.lit(None).cast("string").alias("rest"))
        most = -(-most // FAN**levels)
    return rounds, nodes


def descend(rounds: list[DataFrame], above: DataFrame, levels: int = DEPTH) -> DataFrame:
    """(grp, rank, n, hash, rest, proof, root) of every first node; above: (grp, proof, root) of each group's own root."""
    found = above.select("grp", F.lit(0).cast("long").alias("rank"), "proof", "root")
    for blocks in reversed(rounds):
        found = unnest(blocks, found.select("grp", F.col("rank").alias("block"), "proof", "root"), levels)
    return found


def manifest(docs: DataFrame, tampered: Column, levels: int = DEPTH) -> DataFrame:
    """One row for each document: (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, proof).

    docs needs doc_id, source, lang, n_chars and text, any of them null; other columns are not looked at, whatever their
    names. Leaves of a source ascend by doc_id (null first), equal ones by their hash, so repeated rows are leaves each.
    The root folds each document's leaf, or where `tampered` is true the leaf of its text without line feeds, with the
    siblings of the untampered tree; a null condition counts as false. An empty table gives an empty result.
    """
    rows = ranked(leaves(docs, tampered), "grp", ["doc_id", "leaf"], "merkle-leaves")
    nodes = common.written(rows.select("grp", "rank", "n", F.col("leaf").alias("hash"), F.struct("doc_id", "other").alias("rest")), "merkle-ranked")
    rounds, tops = climb(nodes, "merkle-leaves", levels)
    order = ranked(tops.select(F.col("grp").alias("source_"), "hash", F.lit(0).alias("one")), "one", ["source_"], "merkle-sources")
    upper, top = climb(order.select(F.lit("").alias("grp"), "rank", "n", "hash", F.col("source_").alias("rest")), "merkle-top", levels)
    end = descend(upper, top.select("grp", F.array().cast(STEP).alias("proof"), F.col("hash").alias("root")), levels)
    above = end.select(F.col("rest").alias("grp"), "proof", F.concat_ws(" ", "hash", "root").alias("root"))
    found = descend(rounds, above, levels)
    start = F.coalesce(F.col("rest.other"), F.col("hash"))
    folded = F.aggregate("proof", start, lambda acc, s: digest(F.concat(s["left"], acc, s["right"])))
    siblings = F.concat_ws("", F.transform("proof", lambda s: F.concat(s["left"], s["right"])))
    found = found.select(
        F.col("rest.doc_id").alias("doc_id"),
        F.col("hash").alias("leaf"),
        F.substring_index("root", " ", 1).alias("subroot"),
        F.substring_index("root", " ", -1).alias("root"),
        digest(siblings).alias("proof_sha256"),
        folded.alias("folded_root"),
        "proof",
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
