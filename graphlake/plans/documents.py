"""Queries of the document operators and of the table sources and sinks."""

from pyspark.sql import functions as F

from graphlake.operators import documents as D
from graphlake.operators import retrieval as R
from graphlake.plans.base import NODES, edges, folder, nodes, query, read, tagged
from graphlake.sources import tables as S
from graphlake.streaming import cache
from graphlake.streaming.streams import event_stream


@query(f"WITH {NODES} SELECT id, CASE type WHEN 'part' THEN 'unknown' ELSE 'subsurface' END AS domain FROM nodes")
def q_domain_map(spark, sf):
    return nodes(spark, sf).select("id", D.domain(F.col("type")).alias("domain"))


@query("""SELECT o_orderkey, printf('%d-%02d', 1900 + CAST(trunc((30000 + o_orderkey % 15000) / 365.25) AS INTEGER),
    CAST(trunc(((30000 + o_orderkey % 15000) / 365.25 - trunc((30000 + o_orderkey % 15000) / 365.25)) * 12) AS INTEGER) + 1) AS month FROM orders""")
def q_excel_serial_month(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", D.serial_month(30000 + F.col("o_orderkey") % 15000).alias("month"))


@query("SELECT c_custkey, nullif(concat_ws(', ', CASE WHEN c_custkey % 3 > 0 THEN n_name END, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END), '') AS place FROM customer JOIN nation ON c_nationkey = n_nationkey")
def q_location_info(spark, sf):
    return _placed(spark, sf).select("c_custkey", D.place(F.col("state"), F.col("county")).alias("place"))


def _placed(spark, sf):
    rows = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.withColumn("state", F.when(F.col("c_custkey") % 3 > 0, F.col("n_name")).otherwise("")).withColumn("county", F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")))


@query("SELECT o_orderkey, year(o_orderdate)::INTEGER AS year FROM orders WHERE regexp_matches(strftime(o_orderdate, '%Y'), '^(19|20)')")
def q_extract_year(spark, sf):
    from graphlake.functions import text as T

    return read(spark, sf, "orders").select("o_orderkey", T.year(F.concat(F.lit("date "), F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("year")).where("year is not null")


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 > 0 THEN n_name END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'BUILD' END) AS state FROM customer JOIN nation ON c_nationkey = n_nationkey")
def q_extract_state(spark, sf):
    return _placed(spark, sf).select("c_custkey", D.state(F.col("state"), F.col("c_mktsegment"), ["BUILD"]).alias("state"))


@query(f"WITH {NODES} SELECT id, concat_ws(' ', CASE WHEN type <> 'part' THEN 'Subsurface well log data.' END, CASE WHEN unit = 'F' THEN 'Finished.' END) AS context FROM nodes")
def q_domain_context(spark, sf):
    domain = D.domain(F.col("type"))
    said = F.when(domain.isin(*D.CONTEXT), D.mapped(D.CONTEXT, domain, ""))
    return nodes(spark, sf).select("id", F.concat_ws(" ", said, F.when(F.col("attributes")["unit"] == "F", "Finished.")).alias("context"))


@query(f"""WITH {NODES}, l AS (SELECT id, type, list_filter([CASE WHEN type = 'las_document' THEN (SELECT '  - UWI: ' || c_mktsegment || chr(10) || '  - WELL: ' || c_name FROM customer c WHERE 'customer-' || c.c_custkey = id) END,
    '  - mnemonic: ' || mnemonic, '  - unit: ' || unit], lambda x: x IS NOT NULL) AS v FROM nodes WHERE type <> 'part') SELECT id, array_to_string(v, chr(10)) AS lines FROM l""")
def q_format_attributes(spark, sf):
    return nodes(spark, sf).where("type <> 'part'").select("id", D.attribute_lines(F.col("attributes")).alias("lines"))


@query(f"""WITH {NODES}, k AS (SELECT o_custkey, count(*) AS n, (SELECT 1) AS one FROM orders GROUP BY o_custkey),
    s AS (SELECT o_custkey, string_agg(DISTINCT nullif(o_orderpriority, '5-LOW'), ' ' ORDER BY nullif(o_orderpriority, '5-LOW')) AS codes FROM orders GROUP BY o_custkey)
    SELECT n.id, concat_ws(' ', upper(type), '[NAME] ' || name, '[MNEMONIC] ' || mnemonic, '[DOMAIN] ' || CASE type WHEN 'part' THEN 'unknown' ELSE 'subsurface' END,
        '[BELONGS_TO_WELL] ' || c_name, '[HAS_CURVES] ' || k.n, '[CURVE_TYPES] ' || s.codes) AS semantic_text
    FROM nodes n LEFT JOIN (SELECT 'order-' || o_orderkey AS id, c_name FROM orders JOIN customer ON o_custkey = c_custkey) p USING (id)
    LEFT JOIN k ON n.id = 'customer-' || k.o_custkey LEFT JOIN s ON n.id = 'customer-' || s.o_custkey""")
def q_contextual_text(spark, sf):
    return D.contextual_text(nodes(spark, sf), edges(spark, sf), "describes", "WELL", "mnemonic")


@query("""SELECT 'customer-' || c_custkey AS id, 'ENTITY TYPE: las_document' || chr(10) || 'ENTITY ID: customer-' || c_custkey || chr(10) || chr(10) || 'ATTRIBUTES:' || chr(10) || '  - UWI: ' || c_mktsegment || chr(10) || '  - WELL: ' || c_name
    || chr(10) || chr(10) || 'LOCATION: ' || n_name || chr(10) || chr(10) || 'CONTEXT: Subsurface well log data.' AS text, vec_id IS NOT NULL AS has_vector
    FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN embeddings ON vec_id = c_custkey""")
def q_document_assembly(spark, sf):
    """The whole document of each parent node, and whether its vector is there."""
    rows = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("id", tagged("customer", "c_custkey"))
    docs = rows.join(read(spark, sf, "embeddings"), F.col("vec_id") == F.col("c_custkey"), "left")
    attributes = F.create_map(F.lit("WELL"), F.col("c_name"), F.lit("UWI"), F.col("c_mktsegment"))
    text = D.layout(F.lit("las_document"), F.col("id"), attributes, F.col("n_name"), F.lit(None).cast("string"), F.lit(D.CONTEXT["subsurface"]))
    return docs.select("id", text.alias("text"), F.col("vec_id").isNotNull().alias("has_vector"))


@query("SELECT count(embedding) AS vectors, CAST(min(len(embedding)) AS INTEGER) AS least, CAST(max(len(embedding)) AS INTEGER) AS most, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS without FROM embeddings")
def q_embedding_stats(spark, sf):
    return D.embedding_stats(read(spark, sf, "documents").select(F.col("doc_id").alias("id")), read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding"))


@query("SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 3) AS norm FROM embeddings")
def q_vector_norm(spark, sf):
    return read(spark, sf, "embeddings").select("vec_id", F.round(R.norm(F.col("embedding")), 3).alias("norm"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(regexp_extract(html, '(?is)<p(?:\s[^>]*)?>(.*?)</p>', 1), '<[^>]*>', ' ', 'g') AS t FROM pages),
    u AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM p)
    SELECT page_id, CASE WHEN length(t) >= 10 THEN substr(t, 1, 2000) END AS definition FROM u""")
def q_page_first_paragraph(spark, sf):
    return read(spark, sf, "pages").select("page_id", D.page_definition(F.col("html")).alias("definition"))


@query(r"""WITH c AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, ['slb', 'other', 'aapg'][item_id % 3 + 1] AS source FROM benchmark)
    SELECT item_id, substr(t, 1, 2000) AS definition, source <> 'other' AND length(t) BETWEEN 10 AND 2000 AS valid FROM c""")
def q_definition_clean(spark, sf):
    source = F.element_at(F.array(F.lit("slb"), F.lit("other"), F.lit("aapg")), (F.col("item_id") % 3 + 1).cast("int"))
    return read(spark, sf, "benchmark").select("item_id", D.clean_definition(F.col("text")).alias("definition"), D.valid_definition(F.lit("term"), F.col("text"), source).alias("valid"))


@query("""WITH s AS (SELECT user_id AS term, ['slb', 'spe', 'aapg', 'web'][event_id % 4 + 1] AS source, CASE WHEN value > 30 THEN props END AS definition FROM events),
    r AS (SELECT *, CASE source WHEN 'slb' THEN 1 WHEN 'spe' THEN 2 WHEN 'aapg' THEN 3 END AS rank FROM s)
    SELECT term, arg_min(definition, {'r': rank, 'd': definition}) AS definition, arg_min(source, {'r': rank, 'd': definition}) AS source FROM r WHERE rank IS NOT NULL AND definition IS NOT NULL GROUP BY term""")
def q_priority_coalesce(spark, sf):
    """The first source, in order, that answers."""
    source = F.element_at(F.array(*map(F.lit, ["slb", "spe", "aapg", "web"])), (F.col("event_id") % 4 + 1).cast("int"))
    rows = read(spark, sf, "events").select(F.col("user_id").alias("term"), source.alias("source"), F.when(F.col("value") > 30, F.col("props")).alias("definition"))
    return D.first_answer(rows, "term", "definition", "source", ["slb", "spe", "aapg", "static"])


@query("""WITH n AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id) SELECT user_id FROM n WHERE ts + INTERVAL 12 HOUR > (SELECT max(ts) FROM events)""")
def q_ttl_latest(spark, sf):
    """Keys whose newest entry is within its 12 hours at the log's end."""
    rows = read(spark, sf, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    end = rows.agg(F.max("at").alias("end"))
    return D.cache_latest(rows.join(F.broadcast(end), F.lit(True)), "user_id", "at", F.col("end"), F.lit(12 * 3600 * 1_000_000)).select("user_id")


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS term, CASE WHEN value <= 60 THEN event_type END AS source, value > 40 AS gone, coalesce(props, '') AS definition, ts FROM events),
    p AS (SELECT * FROM e WHERE NOT gone QUALIFY row_number() OVER (PARTITION BY term, source ORDER BY ts DESC, definition DESC) = 1)
    SELECT term, source, definition FROM p WHERE ts + INTERVAL 24 HOUR > (SELECT max(ts) FROM events)
        AND NOT EXISTS (SELECT 1 FROM e g WHERE g.gone AND g.term = p.term AND (g.source IS NULL OR g.source = p.source) AND g.ts >= p.ts)""")
def q_ttl_state(spark, sf):
    """The same cache kept as streaming state: events are puts, those over 40 invalidate their source, those over 60 all sources
    of their key. Rows of up to 40 days before the newest are let in, so the order of the files doesn't matter."""
    at = folder(spark, "cache")
    value = F.col("value")
    rows = event_stream(spark, f"{sf}/events.parque[t]", 1_000).select(  # a pattern, because a stream takes no single file
        F.col("user_id").cast("string").alias("term"), F.when(value <= 60, F.col("event_type")).alias("source"), F.col("props").alias("definition"),
        F.col("ts").alias("at"), F.lit(24 * 3600.0).alias("ttl"), (value > 40).alias("gone"),
    )
    cache.cache_into(rows, f"{at}/changes", f"{at}/state", "40 days").awaitTermination()
    end = read(spark, sf, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("end"))
    changes = spark.read.schema("term string, source string, definition string, at timestamp, expires timestamp, status string, changed timestamp").parquet(f"{at}/changes")
    return cache.held(changes, end.first()[0]).select("term", "source", "definition")  # one value: the log's end


@query("SELECT event_type, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY event_type")
def q_upsert_latest(spark, sf):
    """Two halves of the events merged by key, the latest version first."""
    rows = read(spark, sf, "events").select("event_type", "event_id", "value")
    return S.upsert(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), ["event_type"], "event_id")


@query("SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS INTEGER) AS size_bytes FROM documents")
def q_checksum_docs(spark, sf):
    return read(spark, sf, "documents").select("doc_id", *S.checksum(F.col("text").cast("binary")))


@query("""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'x' ELSE sha256(text) END AS sha, octet_length(encode(text)) + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS size, doc_id % 13 = 0 AS gone FROM documents)
    SELECT status, count(*) AS n FROM (SELECT CASE WHEN gone THEN 'MISSING' WHEN doc_id % 7 = 0 THEN 'SIZE MISMATCH' WHEN doc_id % 11 = 0 THEN 'HASH MISMATCH' ELSE 'OK' END AS status FROM s) GROUP BY status""")
def q_manifest_verify(spark, sf):
    """A stored manifest with planted faults against the current files."""
    now = read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", *S.checksum(F.col("text").cast("binary")))
    sha, size = F.when(F.col("doc_id") % 11 == 0, "x").otherwise(F.col("sha256")), F.col("size_bytes") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)
    stored = now.select("path", sha.alias("sha256"), size.alias("size_bytes"))
    return S.verify_manifest(stored, now.where("doc_id % 13 > 0").select("path", "sha256", "size_bytes")).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[1:2], chr(10)) AS head, len(string_split(text, chr(10))) >= 2 AS truncated FROM documents")
def q_text_head(spark, sf):
    return read(spark, sf, "documents").select("doc_id", *S.head(F.col("text"), 2))


@query("""SELECT coalesce(a.lang, b.lang) AS type, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang) a
    FULL JOIN (SELECT lang, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND lang <> 'es' GROUP BY lang) b USING (lang)""")
def q_reconcile_counts(spark, sf):
    """Rows of each type before and after a stage."""
    docs = read(spark, sf, "documents").withColumnRenamed("lang", "type")
    after = docs.join(read(spark, sf, "labels"), "doc_id").where("toxic = 1 and type <> 'es'")
    return S.reconcile(docs, after, "type")
