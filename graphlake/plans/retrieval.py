"""Queries of the retrieval operators, over a table of questions."""

from pyspark.sql import functions as F

from graphlake.functions import text as T
from graphlake.operators import answers as S
from graphlake.operators import bitmap_index as B
from graphlake.operators import classify as Q
from graphlake.operators import documents as D
from graphlake.operators import graph as G
from graphlake.operators import retrieval as R
from graphlake.operators import vector_index as V
from graphlake.operators.narrow import among
from graphlake.plans import questions as P
from graphlake.plans.base import ANSWERS, EDGES, NODES, answers, edges, folder, nodes, query, read, stored, tagged, tokens_sql


def _questions(spark, sf):
    """Every twentieth vector as a question, with the text of the document of the same number."""
    vectors, docs = read(spark, sf, "embeddings").where("vec_id % 20 = 0"), read(spark, sf, "documents")
    return vectors.join(docs, F.col("vec_id") == F.col("doc_id")).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("text").alias("query_text"))


_COS = """round(list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / (sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) * sqrt(list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[])))), 6)"""
_BATCH = f"""questions AS (SELECT vec_id AS query_id, embedding AS query, text AS query_text FROM embeddings JOIN documents ON vec_id = doc_id WHERE vec_id % 20 = 0),
    scored AS (SELECT query_id, query_text, vec_id, {_COS.format(a="v.embedding", b="q.query")} AS score FROM embeddings v, questions q),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)"""


@query(f"WITH {_BATCH} SELECT query_id, vec_id, score, rank FROM ranked WHERE rank <= 10")
def q_vector_topk(spark, sf):
    return R.vector_topk_batch(read(spark, sf, "embeddings"), _questions(spark, sf), 10)


@query(f"""WITH {_BATCH}, f AS (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored JOIN embeddings USING (vec_id) WHERE label = 3)
    SELECT * FROM f WHERE rank <= 10""")
def q_vector_topk_filtered(spark, sf):
    """The equality filter goes to the scan, before any score."""
    return R.vector_topk_batch(read(spark, sf, "embeddings").where("label = 3"), _questions(spark, sf), 10)


@query(f"WITH {_BATCH} SELECT query_id, vec_id, score, rank FROM ranked WHERE rank <= 30")
def q_vector_topk_batch(spark, sf):
    return R.vector_topk_batch(read(spark, sf, "embeddings"), _questions(spark, sf), 30)


@query(f"WITH {_BATCH} SELECT query_id, vec_id, score, rank FROM ranked WHERE rank <= 10")
def q_vector_index_exact(spark, sf):
    """The same result from a stored inverted file: the nearest lists, then the blocks whose bound reaches the tenth score."""
    index = V.build(read(spark, sf, "embeddings"), folder(spark, "vector-index"))
    return V.search(index, _questions(spark, sf), 10)


@query(f"""WITH {_BATCH}, r AS (SELECT query_id, count(*) AS n FROM ranked WHERE rank <= 10 GROUP BY query_id)
    SELECT query_id, n, true AS enough FROM r""")
def q_vector_index_recall(spark, sf):
    """Recall of the search of the first lists alone, as many as 0.95 of the best vectors of the even questions need, over all
    questions; a row for each with the number of its best, and whether the recall of all is nine tenths or more."""
    vectors = read(spark, sf, "embeddings")
    index = V.build(vectors, folder(spark, "vector-index"))
    asked = stored(_questions(spark, sf))
    best = stored(V.search(index, asked, 10))
    probes = V.probes_for(V.depths(index, best, asked).where("query_id % 40 = 0"), 0.95)
    first = V.search(index, asked, 10, probes, exact=False).select("query_id", "vec_id")
    whole = best.join(first.withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    total = whole.agg((F.sum("hits") >= 0.9 * F.sum("n")).alias("enough"))  # one row
    return whole.join(F.broadcast(total), F.lit(True)).select("query_id", "n", "enough")


def _candidates(spark, sf, k=30):
    """The k nearest documents of each question, with their texts and the question's words. Documents that none is near are not shuffled."""
    docs = read(spark, sf, "documents").select("doc_id", "text")
    asked = stored(_questions(spark, sf).withColumn("query_words", T.tokens(F.col("query_text"))).drop("query_text"))
    found = stored(R.vector_topk_batch(read(spark, sf, "embeddings"), asked, k))
    held = among(docs, "doc_id", found, "vec_id")
    return found.join(held, F.col("vec_id") == F.col("doc_id")).join(asked.select("query_id", "query_words"), "query_id").select("query_id", "query_words", "doc_id", "text", "score", "rank")


_KEYWORD = f"""CASE WHEN len({tokens_sql("query_text")}) = 0 THEN 0.0 ELSE CAST(len(list_intersect({tokens_sql("query_text")}, {tokens_sql("text")})) AS DOUBLE) / len({tokens_sql("query_text")}) END"""
_RERANK = f"""{_BATCH}, cand AS (SELECT r.query_id, query_text, doc_id, text, rank FROM ranked r JOIN documents ON vec_id = doc_id WHERE rank <= 30),
    hybrid AS (SELECT *, round(0.7 * (1 - CAST(rank - 1 AS DOUBLE) / count(*) OVER (PARTITION BY query_id)) + 0.3 * ({_KEYWORD}), 6) AS hybrid FROM cand),
    re AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, rank) AS INTEGER) AS new_rank FROM hybrid)"""


@query(f"WITH {_RERANK} SELECT query_id, doc_id, hybrid, new_rank FROM re WHERE new_rank <= 10")
def q_rerank_hybrid(spark, sf):
    return R.rerank(_candidates(spark, sf), 0.7, 0.3, 10).select("query_id", "doc_id", "hybrid", "new_rank")


@query(f"WITH {ANSWERS} SELECT doc_id, round({_KEYWORD}, 6) AS score FROM (SELECT query_id AS doc_id, answer AS text, expected AS query_text FROM answers)")
def q_keyword_score(spark, sf):
    pairs = answers(spark, sf, True)
    return pairs.select(F.col("query_id").alias("doc_id"), F.round(T.share_of("expected_words", "answer_words"), 6).alias("score"))


@query("""WITH c AS (SELECT event_id, (event_id % 11) / 10.0::DOUBLE AS c, CASE WHEN event_id % 13 = 0 THEN 7 END AS o, event_type = 'click' AS agg FROM events)
    SELECT event_id, coalesce(o, CASE WHEN c >= 0.85 THEN 30 WHEN c >= 0.6 THEN 18 ELSE 15 END) AS top_k, CAST(CASE WHEN c >= 0.85 THEN 0.6 ELSE 0.7 END AS DOUBLE) AS vector_weight,
        CAST(CASE WHEN c >= 0.85 THEN 0.4 ELSE 0.3 END AS DOUBLE) AS keyword_weight, CASE WHEN c >= 0.85 THEN 2 WHEN c >= 0.6 THEN 1 ELSE 0 END AS hops,
        CASE WHEN agg THEN 1000 ELSE 100 END AS first_limit, CASE WHEN agg THEN 5000 ELSE 0 END AS max_documents FROM c""")
def q_route_params(spark, sf):
    """Limits, weights and hops by confidence, an override first."""
    confidence, override = (F.col("event_id") % 11) / 10, F.when(F.col("event_id") % 13 == 0, 7)
    return read(spark, sf, "events").select("event_id", *[F.coalesce(c, F.lit(0)).alias(n) for n, c in (R.route_params(confidence, override) | R.initial_limit(F.col("event_type") == "click")).items()])


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'idiot') OR contains(lower(text), 'und der')")
def q_keyword_any(spark, sf):
    return read(spark, sf, "documents").where(R.keyword_match(F.col("text"), F.array(F.lit("Idiot"), F.lit("und der")), F.lit(True))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'that') AND contains(lower(text), 'the of')")
def q_keyword_all(spark, sf):
    return read(spark, sf, "documents").where(R.keyword_match(F.col("text"), F.array(F.lit("that"), F.lit("THE OF")), F.lit(False))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(CAST(doc_id AS VARCHAR), '15') OR contains(lower(text), '15')")
def q_id_contains(spark, sf):
    return read(spark, sf, "documents").where(R.id_match(F.col("doc_id").cast("string"), F.col("text"), F.lit("15"))).select("doc_id")


@query("""WITH w AS (SELECT item_id, string_split(text, ' ')[2] AS word FROM benchmark UNION ALL SELECT -1, '15')
    SELECT item_id, doc_id FROM documents JOIN w ON contains(lower(text), lower(word))""")
def q_substring_index(spark, sf):
    """Documents that hold each benchmark item's second word, by stored trigrams, and those that hold 15, which has none."""
    words = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.get(F.split("text", " "), F.lit(1)).alias("keyword"))
    words = words.unionByName(spark.createDataFrame([(-1, "15")], "query_id long, keyword string"))
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return B.containing(B.build_grams(docs, folder(spark, "trigrams")), docs, words).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"))


_KEYED = _RERANK + ", k AS (SELECT *, contains(lower(text), @word) AS passes FROM re WHERE new_rank <= 30)"
_FALLBACK = """, w AS (SELECT *, bool_or(passes) OVER (PARTITION BY query_id) AS any_pass, count(*) FILTER (passes) OVER (PARTITION BY query_id ORDER BY new_rank) AS place FROM k)
    SELECT query_id, doc_id, new_rank, passes FROM w WHERE CASE WHEN any_pass THEN passes AND place <= 15 ELSE new_rank <= 5 END"""


def _filtered(spark, sf, word):
    ranked = R.rerank(_candidates(spark, sf), 0.7, 0.3, 30)
    return R.filter_with_fallback(ranked, F.contains(F.lower("text"), F.lit(word)), F.lit(True)).select("query_id", "doc_id", "new_rank", "passes")


@query("WITH " + _KEYED.replace("@word", "'th'") + _FALLBACK)
def q_filter_truncate(spark, sf):
    """At most 15 rows of a question pass an active filter."""
    return _filtered(spark, sf, "th")


@query("WITH " + _KEYED.replace("@word", "'no such words'") + _FALLBACK)
def q_filter_fallback(spark, sf):
    """Where no row passes, the first five stand."""
    return _filtered(spark, sf, "no such words")


@query(f"""WITH RECURSIVE {_RERANK}, found AS (SELECT query_id, 'order-' || doc_id AS id FROM re WHERE new_rank <= 5),
    edges AS (SELECT 'order-' || o_orderkey AS source, 'customer-' || o_custkey AS target FROM orders UNION SELECT DISTINCT 'order-' || l_orderkey, 'part-' || l_partkey FROM lineitem),
    made AS (SELECT 'customer-' || c_custkey AS id, concat('LAS_DOCUMENT', chr(10), 'ENTITY ID: customer-', c_custkey, chr(10), chr(10), 'ATTRIBUTES:', chr(10), '  - UWI: ', c_mktsegment, chr(10), '  - WELL: ', c_name) AS made FROM customer
        UNION ALL SELECT 'order-' || o_orderkey, concat('LAS_CURVE', chr(10), 'ENTITY ID: order-', o_orderkey, chr(10), chr(10), 'ATTRIBUTES:', CASE WHEN o_orderpriority <> '5-LOW' THEN concat(chr(10), '  - mnemonic: ', o_orderpriority) ELSE '' END, chr(10), '  - unit: ', o_orderstatus) FROM orders
        UNION ALL SELECT 'part-' || p_partkey, concat('PART', chr(10), 'ENTITY ID: part-', p_partkey, chr(10), chr(10), 'ATTRIBUTES:', chr(10), '  - brand: ', p_brand) FROM part),
    far AS (SELECT query_id, id FROM found UNION SELECT query_id, target FROM found JOIN edges ON id = source UNION SELECT query_id, source FROM found JOIN edges ON id = target),
    grown AS (SELECT *, round(CAST(count(*) OVER (PARTITION BY query_id) AS DOUBLE) / (SELECT count(*) FROM found f WHERE f.query_id = far.query_id), 6) AS ratio FROM far)
    SELECT query_id, id, coalesce(d.text, 'ENTITY TYPE: ' || made) AS text, ratio FROM grown JOIN made USING (id) LEFT JOIN documents d ON id = 'order-' || doc_id""")
def q_retrieve_expand(spark, sf):
    """Retrieved documents as seeds, one hop in the graph, the stored text where there is one, and the growth."""
    found = R.rerank(_candidates(spark, sf), 0.7, 0.3, 5).select("query_id", tagged("order", "doc_id").alias("id"))
    found = stored(found)
    walk = found.select("query_id", "id", F.lit(None).cast("string").alias("direction"), F.lit(1).alias("hops"))
    far = stored(G.expand_each(edges(spark, sf), walk, 1).select("query_id", F.col("node").alias("id")))
    docs = among(read(spark, sf, "documents").select(tagged("order", "doc_id").alias("id"), "text"), "id", far, "id")
    counts = far.groupBy("query_id").agg(F.count("*").alias("after")).join(found.groupBy("query_id").agg(F.count("*").alias("before")), "query_id")
    told = R.enrich_expanded(far, among(nodes(spark, sf), "id", far, "id"), docs)
    return told.join(counts, "query_id").select("query_id", "id", "text", F.round(R.expansion_stats(F.col("before"), F.col("after")), 6).alias("ratio"))


_BAND = "CASE WHEN c >= 0.85 THEN {} WHEN c >= 0.6 THEN {} ELSE {} END"
_WALK = """SELECT query_id, b AS node, hops, direction FROM {} JOIN steps ON node = a AND (direction IS NULL OR direction = way) WHERE hops >= {}"""


@query(f"""WITH {P.ASKED}, {NODES}, {EDGES},
    f AS (SELECT conv_id AS query_id, arg_min(question, turn) AS question, arg_min(q, turn) AS q FROM a GROUP BY conv_id),
    r AS (SELECT query_id, question, {P._REL} AS relation, {P._CONF} AS c, {P._ROUTE} AS route, {P._WORDS} AS words, {P._ENT["well_id"]} AS well FROM f SEMI JOIN embeddings ON query_id = vec_id),
    s AS (SELECT r.query_id, v.vec_id, {_COS.format(a="v.embedding", b="e.embedding")} AS score FROM r JOIN embeddings e ON e.vec_id = r.query_id, embeddings v),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s),
    cand AS (SELECT query_id, question AS query_text, words, c, doc_id, text, rank FROM k JOIN r USING (query_id) JOIN documents ON vec_id = doc_id WHERE rank <= {_BAND.format(30, 18, 15)}),
    h AS (SELECT *, round({_BAND.format("0.6::DOUBLE", "0.7::DOUBLE", "0.7::DOUBLE")} * (1 - CAST(rank - 1 AS DOUBLE) / count(*) OVER (PARTITION BY query_id)) + {_BAND.format("0.4::DOUBLE", "0.3::DOUBLE", "0.3::DOUBLE")} * ({_KEYWORD}), 6) AS hybrid FROM cand),
    re AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, rank) AS new_rank, len(words) = 0 OR len(list_filter(words, lambda w: contains(lower(text), w))) > 0 AS passes FROM h),
    w AS (SELECT *, bool_or(passes) OVER (PARTITION BY query_id) AS any_pass, count(*) FILTER (passes) OVER (PARTITION BY query_id ORDER BY new_rank) AS place FROM re),
    found AS (SELECT query_id, 'order-' || doc_id AS id FROM w WHERE CASE WHEN any_pass THEN passes AND (len(words) = 0 OR place <= 15) ELSE new_rank <= 5 END),
    named AS (SELECT query_id, nodes.id FROM r JOIN nodes ON nodes.id = 'customer-' || split_part(well, '_', 1) WHERE relation = 'well_to_curves'),
    seeds AS (SELECT query_id, id FROM named UNION SELECT query_id, id FROM found WHERE query_id NOT IN (SELECT query_id FROM named)),
    types AS (SELECT query_id, list(DISTINCT type) AS types FROM seeds JOIN nodes USING (id) GROUP BY query_id),
    zero AS (SELECT query_id, id AS node, CASE WHEN relation IS NULL THEN 0 ELSE {_BAND.format(2, 1, 0)} END AS hops,
        CASE WHEN coalesce((relation = 'well_to_curves' AND list_contains(types, 'las_curve')) OR (relation = 'curve_to_well' AND list_contains(types, 'las_document')), false) THEN NULL
            WHEN relation IN ('well_to_curves', 'site_to_measurements') THEN 'incoming' WHEN relation IN ('curve_to_well', 'measurement_to_site') THEN 'outgoing' END AS direction
        FROM seeds JOIN r USING (query_id) LEFT JOIN types USING (query_id)),
    steps AS (SELECT source AS a, target AS b, 'outgoing' AS way FROM edges UNION ALL SELECT target, source, 'incoming' FROM edges),
    one AS ({_WALK.format("zero", 1)}), two AS ({_WALK.format("one", 2)}),
    reached AS (SELECT query_id, node FROM zero UNION SELECT query_id, node FROM one UNION SELECT query_id, node FROM two),
    counts AS (SELECT query_id, count(*) AS n_nodes, count(*) FILTER (type = 'las_curve') AS n_curves, count(*) FILTER (type = 'las_document') AS n_wells FROM reached JOIN nodes ON node = id GROUP BY query_id)
    SELECT query_id, route, relation, coalesce(n_nodes, 0) AS n_nodes, coalesce(n_curves, 0) AS n_curves, coalesce(n_wells, 0) AS n_wells FROM r LEFT JOIN counts USING (query_id)""")
def q_flagship(spark, sf):
    """Questions to answers in one plan: route, relation and its confidence; vector search and hybrid rerank by it; filter with
    fallback; the well that is named, or else what was found, as seeds; the graph around them by direction and hops. Every
    conversation with a vector asks what its first user turn does."""
    vectors, docs, known = read(spark, sf, "embeddings"), read(spark, sf, "documents").select("doc_id", "text"), nodes(spark, sf)
    first = P.asked(spark, sf).groupBy("conv_id").agg(F.min_by("question", "turn").alias("query_text"))
    q = F.col("query_text")
    asked = first.join(vectors, F.col("conv_id") == F.col("vec_id")).select(
        F.col("conv_id").alias("query_id"), "query_text", F.col("embedding").alias("query"), Q.route(q).alias("route"), Q.relation(q).alias("relation"),
        Q.relation_confidence(q).alias("confidence"), Q.critical_keywords(q).alias("words"), Q.entities(q)["well_id"].alias("well"),
        T.tokens(q).alias("query_words"),
    )
    asked = stored(asked)
    params = R.route_params(F.col("confidence"))
    ruled = asked.select("query_id", "query_words", "route", "relation", "words", "well", *[c.alias(n) for n, c in params.items()])
    near = stored(R.vector_topk_batch(vectors, asked, max(R.TOP_K.values())).join(ruled.select("query_id", "top_k"), "query_id").where("rank <= top_k").select("query_id", "vec_id", "rank"))
    held = among(docs, "doc_id", near, "vec_id").withColumn("held_words", T.tokens(F.col("text")))  # once a text; no text goes further than its questions' words
    best = near.join(ruled, "query_id").join(held, F.col("vec_id") == F.col("doc_id"))
    best = best.withColumn("found_", T.share_of("query_words", "held_words")).withColumn("passes", R.keyword_match(F.col("text"), F.col("words"), F.lit(True)))
    best = best.select("query_id", "doc_id", "rank", "found_", "passes", (F.size("words") > 0).alias("active"), "vector_weight", "keyword_weight", "top_k")
    ranked = R.rerank(best, F.col("vector_weight"), F.col("keyword_weight"), F.col("top_k"))
    kept = R.filter_with_fallback(ranked, F.col("passes"), F.col("active"))
    named = ruled.where("relation = 'well_to_curves'").select("query_id", F.concat(F.lit("customer-"), F.substring_index("well", "_", 1)).alias("id"))
    seeds = stored(R.choose_seeds(kept.select("query_id", tagged("order", "doc_id").alias("id")), named, among(known, "id", named, "id")))
    types = seeds.join(among(known.select("id", "type"), "id", seeds, "id"), "id").groupBy("query_id").agg(F.collect_set("type").alias("types"))
    direction = R.seed_direction(F.col("relation"), Q.traversal(F.col("relation"))[0], F.col("types"))
    hops = F.when(F.col("relation").isNull(), 0).otherwise(F.col("hops"))
    walk = seeds.join(ruled, "query_id").join(types, "query_id", "left").select("query_id", "id", direction.alias("direction"), hops.alias("hops"))
    reached = stored(G.expand_each(edges(spark, sf), walk, 2))
    met = reached.join(among(known.select(F.col("id").alias("node"), "type"), "node", reached, "node"), "node")
    counts = met.groupBy("query_id").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("type") == "las_curve").alias("n_curves"), F.count_if(F.col("type") == "las_document").alias("n_wells"))
    return ruled.join(counts, "query_id", "left").select("query_id", "route", "relation", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("n_nodes", "n_curves", "n_wells")])


#: Terms that the pages define in turn.
TERMS = ["porosity", "permeability", "lithology"]
_PARAGRAPH = r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<p(?:\s[^>]*)?>(.*?)</p>', 1), '<[^>]*>', ' ', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM pages"""
_ANY = P._any
_PLAIN = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"
_FIRST_TOPIC = "CASE " + " ".join(f"WHEN {_ANY(words)} THEN '{topic}'" for topic, words in P.rules.OUT_OF_SCOPE) + " END"
_RULE_ANSWER = P._first([(P.rules.DOMAIN_ANSWERS[n], p) for n, p in P.rules.DOMAIN_RULES])
_LISTED = "coalesce('Found ' || len(listed) || ' unique ' || field || ' values: ' || array_to_string(listed, ', ') || '.', 'No values found for ' || field || '.')"
_OUT_TEXT = S.OUT_OF_SCOPE.replace("%s", "' || topic || '")


@query(f"""WITH {P.ASKED}, {NODES}, {EDGES},
    r AS (SELECT conv_id * 100000 + turn AS query_id, conv_id, question, q, {P._ROUTE} AS route, {P._AGG} AS kind, coalesce({P._FIELD}, 'entity_type') AS field, {P._ATTR} AS attribute, {_FIRST_TOPIC} AS topic,
        {_RULE_ANSWER} AS ruled, 'customer-' || split_part(nullif(replace(regexp_extract(q, '{P.rules.WELL_ID}', 1), '/', '_'), ''), '_', 1) AS target, {_ANY(S.COMPLEX)} AS complex FROM a SEMI JOIN embeddings ON conv_id = vec_id WHERE conv_id % 20 = 0),
    s AS (SELECT c.conv_id, v.vec_id, {_COS.format(a="v.embedding", b="e.embedding")} AS score FROM (SELECT DISTINCT conv_id FROM r) c JOIN embeddings e ON e.vec_id = c.conv_id, embeddings v),
    k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, vec_id) AS rank FROM s),
    found AS (SELECT query_id, rank, lang, source, n_chars, mnemonic, concat('ENTITY TYPE: LAS_CURVE', chr(10), 'ENTITY ID: ', n.id, chr(10), chr(10), 'ATTRIBUTES:', CASE WHEN mnemonic IS NOT NULL THEN concat(chr(10), '  - mnemonic: ', mnemonic) ELSE '' END,
        chr(10), '  - unit: ', unit, chr(10), d.text) AS text FROM k JOIN r USING (conv_id) JOIN documents d ON vec_id = doc_id JOIN nodes n ON n.id = 'order-' || doc_id WHERE rank <= 10),
    best AS (SELECT query_id, left(arg_min(text, rank), 200) AS text FROM found GROUP BY query_id),
    p AS ({_PARAGRAPH}), d AS (SELECT {TERMS!r}[page_id % {len(TERMS)} + 1] AS term, arg_min(substr(t, 1, 2000), page_id) AS definition FROM p WHERE length(t) >= 10 GROUP BY 1),
    gl AS (SELECT query_id, CASE WHEN definition IS NOT NULL THEN '**' || g.term || '**: ' || definition ELSE 'No definition of ''' || coalesce(g.term, '') || ''' is stored.' END AS answer
        FROM (SELECT query_id, nullif(regexp_extract(q, '{S.TERM}', 1), '') AS term FROM r WHERE route = 'glossary') g LEFT JOIN d USING (term)),
    held AS (SELECT upper(mnemonic) AS code, target FROM edges JOIN nodes ON source = id WHERE edges.type = 'describes' AND mnemonic IS NOT NULL),
    wells AS (SELECT target, list_sort(list(DISTINCT code)) AS codes FROM held GROUP BY target),
    holders AS (SELECT code, min(target) AS holder, count(DISTINCT target) AS n FROM held GROUP BY code),
    tokens AS (SELECT query_id, unnest(t) AS code, generate_subscripts(t, 1) AS pos FROM (SELECT query_id, regexp_extract_all(question, '[A-Z0-9_-]{{2,}}') AS t FROM r WHERE route = 'relation' AND target IS NULL)),
    told AS (SELECT query_id, arg_min(coalesce(name || ' (well ID: ' || holder || ')', holder) || CASE WHEN n > 1 THEN ' (plus ' || n - 1 || ' other matches)' ELSE '' END, pos) AS answer
        FROM tokens JOIN holders USING (code) LEFT JOIN nodes ON id = holder GROUP BY query_id),
    ex AS (SELECT query_id, CASE WHEN complex OR attribute IS DISTINCT FROM 'mnemonic' OR len(m) = 0 THEN NULL WHEN len(m) <= 5 THEN array_to_string(m, ', ') ELSE len(m) || ' curves found: ' || array_to_string(m[1:5], ', ') || '...' END AS answer
        FROM r JOIN (SELECT query_id, list(mnemonic ORDER BY rank) FILTER (mnemonic IS NOT NULL) AS m FROM found GROUP BY query_id) USING (query_id)),
    rows AS (SELECT query_id, rank, n_chars, CASE field WHEN 'domain' THEN lang WHEN 'operator' THEN source WHEN 'state' THEN source ELSE lang END AS value FROM found JOIN r USING (query_id)),
    groups AS (SELECT query_id, value, count(*) AS size, min(rank) AS first FROM rows WHERE value IS NOT NULL GROUP BY ALL),
    top AS (SELECT query_id, arg_max(value || ' (' || size || ' records).', size * 1000 - first) AS compared, list_sort(list(value))[1:20] AS listed FROM groups GROUP BY query_id),
    sums AS (SELECT query_id, count(*) AS n, sum(n_chars) AS total, min(n_chars) AS low, max(n_chars) AS high FROM rows GROUP BY query_id),
    ag AS (SELECT query_id, CASE kind WHEN 'COUNT' THEN CASE WHEN coalesce(n, 0) = 1 THEN 'There is 1 record.' ELSE 'There are ' || coalesce(n, 0) || ' records.' END
        WHEN 'COMPARISON' THEN coalesce(compared, 'No data found for comparison.') WHEN 'SUM' THEN 'Total is ' || coalesce(total, 0) || '.'
        WHEN 'RANGE' THEN coalesce('Range is ' || high - low || ' (' || low || ' to ' || high || ').', '{S.NOTHING}') WHEN 'MAX' THEN coalesce(CAST(high AS VARCHAR), '{S.NOTHING}') WHEN 'MIN' THEN coalesce(CAST(low AS VARCHAR), '{S.NOTHING}')
        WHEN 'LIST' THEN {_LISTED} WHEN 'DISTINCT' THEN {_LISTED} END AS answer
        FROM r LEFT JOIN sums USING (query_id) LEFT JOIN top USING (query_id)),
    u AS (SELECT r.query_id, route, list_filter([
            {{'by': route, 'a': CASE route WHEN 'glossary' THEN gl.answer WHEN 'out_of_scope' THEN '{_OUT_TEXT}' WHEN 'curve_count' THEN CAST((SELECT count(*) FROM edges WHERE edges.type = 'describes' AND edges.target = r.target) AS VARCHAR)
                WHEN 'well_count' THEN 'There are ' || (SELECT count(*) FROM customer) || ' wells.' WHEN 'relation' THEN coalesce(len(wells.codes) || ' curve types: ' || array_to_string(wells.codes[1:10], ', '), told.answer) END}},
            {{'by': 'extraction', 'a': CASE WHEN route IN ('relation', 'extraction') THEN ex.answer END}}, {{'by': 'aggregation', 'a': CASE WHEN route IN ('relation', 'extraction', 'aggregation') THEN ag.answer END}},
            {{'by': 'rule', 'a': CASE WHEN route <> 'fallback' THEN ruled END}}, {{'by': 'fallback', 'a': best.text}}, {{'by': 'none', 'a': '{S.NOTHING}'}}], lambda x: x.a IS NOT NULL)[1] AS v
        FROM r LEFT JOIN best USING (query_id) LEFT JOIN gl USING (query_id) LEFT JOIN wells ON wells.target = r.target LEFT JOIN told USING (query_id) LEFT JOIN ex USING (query_id) LEFT JOIN ag USING (query_id))
    SELECT query_id, route, v.by AS answered_by, v.a AS answer FROM u""")
def q_answers(spark, sf):
    """An answer for every question of every twentieth conversation, by a plan for each route, from the ten nearest documents of
    the conversation's vector, the graph, and the terms that the pages define."""
    asked, vectors, known = P.asked(spark, sf).where("conv_id % 20 = 0"), read(spark, sf, "embeddings"), nodes(spark, sf)
    by_vector = asked.select("conv_id").distinct().join(vectors, F.col("conv_id") == F.col("vec_id"))
    near = stored(R.vector_topk_batch(vectors, by_vector.select(F.col("conv_id").alias("query_id"), F.col("embedding").alias("query")), 10))
    routed = asked.join(by_vector.select("conv_id"), "conv_id", "left_semi").select("conv_id", (F.col("conv_id") * 100_000 + F.col("turn")).alias("query_id"), "question", Q.route(F.col("question")).alias("route"))
    routed = stored(routed)
    curves = among(known.where("type = 'las_curve'"), "id", near, tagged("order", "vec_id"))
    told = curves.select("id", R.generated_text(F.col("id"), F.col("type"), F.col("attributes")).alias("told"))
    docs = among(read(spark, sf, "documents"), "doc_id", near, "vec_id").select("doc_id", tagged("order", "doc_id").alias("id"), "text", "lang", "source", "n_chars")
    texts = near.join(docs, near["vec_id"] == docs["doc_id"]).join(told, "id").select(F.col("query_id").alias("conv_id"), "rank", F.concat_ws("\n", "told", "text").alias("text"), "lang", "source", "n_chars")
    found = stored(routed.select("conv_id", "query_id").join(texts, "conv_id").drop("conv_id"))
    terms = F.element_at(F.array(*map(F.lit, TERMS)), (F.col("page_id") % len(TERMS) + 1).cast("int"))
    pages = read(spark, sf, "pages").select("page_id", terms.alias("term"), D.page_definition(F.col("html")).alias("definition")).where("definition is not null")
    defined = pages.groupBy("term").agg(F.min_by("definition", "page_id").alias("definition"))
    fields = {"domain": "lang", "operator": "source", "state": "source", "entity_type": "lang", "year": "n_chars"}
    well = lambda w: F.concat(F.lit("customer-"), F.substring_index(w, "_", 1))
    return S.answer_all(routed, S.Sources(found, known, edges(spark, sf), defined, fields, well))
