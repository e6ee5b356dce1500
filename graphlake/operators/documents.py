"""From nodes to retrieval documents: domain, time, place, texts, embeddings, definitions, caches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.functions import text as T

#: A node type's domain, and what is said of each type.
DOMAINS = {"eia_record": "energy", "usgs_site": "surface_water", "usgs_measurement": "surface_water", "las_document": "subsurface", "las_curve": "subsurface"}
CONTEXT = {
    "energy": "Energy production record.", "surface_water": "Surface water monitoring data.", "subsurface": "Subsurface well log data.",
}


def mapped(values: dict[str, str], key: Column, default: str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(table[key], F.lit(default))


def domain(kind: Column) -> Column:
    return mapped(DOMAINS, kind, "unknown")


def serial_month(serial: Column) -> Column:
    """A spreadsheet day number as year and month: 1900 + days / 365.25, truncated."""
    years = serial / 365.25
    whole = years.cast("int")
    return F.format_string("%d-%02d", 1900 + whole, ((years - whole) * 12).cast("int") + 1)


def place(*parts: Column) -> Column:
    """The parts that are there, joined by commas; null when none is."""
    return T.missing(F.concat_ws(", ", *[T.missing(p) for p in parts]))


def state(attribute: Column, location: Column, names: list[str]) -> Column:
    return F.coalesce(T.missing(attribute), *[F.when(F.contains(location, F.lit(n)), n) for n in names])


def attribute_lines(attributes: Column) -> Column:
    """Sorted `  - key: value` lines of the attributes that have a value, or a line that says there are none."""
    held = F.map_filter(attributes, lambda k, v: v.isNotNull() & (v != ""))
    lines = F.array_join(F.transform(F.array_sort(F.map_entries(held)), lambda e: F.concat(F.lit("  - "), e["key"], F.lit(": "), e["value"])), "\n")
    return F.coalesce(T.missing(lines), F.lit("  (no attributes)"))


def contextual_text(nodes: DataFrame, edges: DataFrame, kind: str, name: str, code: str) -> DataFrame:
    """(id, semantic_text): `TYPE [TAG] value ...` with what a node's edges say. The edges are summed once for each end, so no
    node looks through them; tags without a value are left out."""
    of_edges = edges.where(F.col("type") == kind)
    target = of_edges.groupBy("source").agg(F.min_by("target", F.struct("pos", "target")).alias("parent"))
    named = target.join(nodes.select(F.col("id").alias("parent"), F.col("attributes")[name].alias("parent_name")), "parent").select(F.col("source").alias("id"), "parent_name")
    codes = of_edges.join(nodes.select(F.col("id").alias("source"), F.col("attributes")[code].alias("c")), "source", "left")
    children = codes.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set("c")), 1, 10), " ").alias("codes"))
    tag = lambda label, value: F.when(T.missing(value.cast("string")).isNotNull(), F.concat(F.lit(f"[{label}] "), value.cast("string")))
    a = F.col("attributes")
    text = F.concat_ws(" ", F.upper("type"), tag("NAME", a[name]), tag("MNEMONIC", a[code]), tag("DOMAIN", domain(F.col("type"))), tag("BELONGS_TO_WELL", F.col("parent_name")), tag("HAS_CURVES", F.col("n")), tag("CURVE_TYPES", F.col("codes")))
    return nodes.join(named, "id", "left").join(children, "id", "left").select("id", text.alias("semantic_text"))


def layout(kind: Column, node_id: Column, attributes: Column, location: Column, temporal: Column, context: Column) -> Column:
    """The text a reader sees: type and id, attributes, place, time, context, blank lines between."""
    part = lambda label, value: F.when(value.isNotNull(), F.concat(F.lit(f"{label}: "), value))
    return F.concat_ws("\n\n", F.concat(F.lit("ENTITY TYPE: "), kind, F.lit("\nENTITY ID: "), node_id), F.concat(F.lit("ATTRIBUTES:\n"), attribute_lines(attributes)), part("LOCATION", location), part("TEMPORAL", temporal), part("CONTEXT", context))


def hashed_vector(text: Column, dim: int = 64) -> Column:
    """A bag-of-words vector: each token counts in the bucket of its md5, the vector has length 1 (or 0 without tokens)."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    buckets = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % dim)
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(buckets, lambda b: b == i)).cast("double"))
    length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(counts, lambda x: F.when(length > 0, x / length).otherwise(0.0).cast("float"))


def embed(rows: DataFrame, id_col: str, text_col: str, embedder: Callable[[list[str]], list[list[float]]], batch: int = 500) -> DataFrame:
    """(id, embedding) by a user's embedder, called with `batch` texts at a time in the tasks; a vector too few is an error."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), batch):
                some = part.iloc[at : at + batch]
                vectors = embedder(some[text_col].fillna("").tolist())
                if len(vectors) != len(some):
                    raise ValueError(f"{len(vectors)} vectors for {len(some)} texts")
                yield pd.DataFrame({id_col: some[id_col], "embedding": vectors})

    return rows.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, embedding array<float>")


def embedding_stats(ids: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors, least and largest dimension, and ids without one. Both sides have `id`."""
    held = vectors.agg(F.count("embedding").alias("vectors"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most"))
    lost = ids.join(vectors.where("embedding is not null"), "id", "left_anti").agg(F.count("*").alias("without"))
    return held.join(F.broadcast(lost), F.lit(True))


def page_definition(html: Column) -> Column:
    """The first paragraph's text: tags out, entities for <, >, & and quotes, white space as one space; 10 to 2000 characters."""
    paragraph = F.regexp_extract(html, r"(?is)<p(?:\s[^>]*)?>(.*?)</p>", 1)
    return clean_definition(unescape(F.regexp_replace(paragraph, r"<[^>]*>", " ")))


def unescape(text: Column) -> Column:
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def clean_definition(text: Column) -> Column:
    """White space as one space, cut to 2000 characters; null under 10."""
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(plain) >= 10, F.substring(plain, 1, 2000))


def valid_definition(term: Column, definition: Column, source: Column) -> Column:
    fits = F.length(F.trim(term)).between(1, 100) & F.length(F.trim(F.regexp_replace(definition, r"\s+", " "))).between(10, 2000)
    return F.coalesce(fits & source.isin("slb", "spe", "aapg", "static"), F.lit(False))


def first_answer(rows: DataFrame, term: str, definition: str, source: str, priority: list[str]) -> DataFrame:
    """(term, definition, source) of the first source in order that has one."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col(source))
    held = rows.where((rank > 0) & F.col(definition).isNotNull()).groupBy(term)
    return held.agg(F.min_by(definition, F.struct(rank, definition)).alias("definition"), F.min_by(source, F.struct(rank, definition)).alias("source"))


def cache_latest(rows: DataFrame, key: str, at: str, now: Column, ttl: Column, cap: int | None = None) -> DataFrame:
    """Each key's newest row, if it is still valid: at + ttl > now, and ttl > 0. With a cap, the newest `cap` keys: a top-k."""
    held = rows.groupBy(F.col(key).alias("key_")).agg(F.max_by(F.struct("*"), F.col(at)).alias("row_")).select("row_.*")
    valid = held.where((ttl > 0) & (F.col(at) + ttl > now))
    return valid if cap is None else valid.orderBy(F.desc(at), key).limit(cap)


def invalidate(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone, keys, "left_anti")
