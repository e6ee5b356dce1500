"""Queries of the graph operators."""

from pyspark.sql import functions as F

from graphlake.operators import adjacency as N
from graphlake.operators import graph as G
from graphlake.plans.base import EDGES, NODES, edges, folder, nodes, query, read, tagged


@query(f"WITH {NODES} SELECT id, type, coalesce(name, mnemonic, '') AS label FROM nodes")
def q_nodes_build(spark, sf):
    """Nodes of three types in one table."""
    a = F.col("attributes")
    return nodes(spark, sf).select("id", "type", F.coalesce(a["WELL"], a["mnemonic"], F.lit("")).alias("label"))


@query(f"WITH {EDGES} SELECT type || '-' || source || '-' || target AS id, source, target, type, pos FROM edges")
def q_edges_build(spark, sf):
    return edges(spark, sf)


@query("""SELECT 'site-' || user_id AS id, arg_min(event_type, event_id) AS first_type, count(*) AS measurements FROM events GROUP BY user_id""")
def q_sites_build(spark, sf):
    """One site node for each user, the first event's values, and its number of measurements."""
    events = read(spark, sf, "events")
    first = G.first_nodes(events, "user_id", F.col("event_id"), ["event_type"])
    counts = events.groupBy("user_id").agg(F.count("*").alias("measurements"))
    return first.join(counts, "user_id").select(tagged("site", "user_id").alias("id"), F.col("event_type").alias("first_type"), "measurements")


@query("SELECT 'order-' || o_orderkey AS id, c_name AS well_name FROM orders JOIN customer ON o_custkey = c_custkey")
def q_enrich_parent(spark, sf):
    return G.enrich_with_parent(nodes(spark, sf), edges(spark, sf), "describes", "WELL", "well_name")


@query("""WITH p AS (SELECT o_custkey, o_orderpriority AS code, min(o_orderkey) AS pos FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY ALL)
    SELECT 'customer-' || o_custkey AS id, array_to_string(list(code ORDER BY pos, code)[1:10], ',') AS codes FROM p GROUP BY o_custkey""")
def q_enrich_children(spark, sf):
    found = G.enrich_with_children(nodes(spark, sf), edges(spark, sf), "describes", "mnemonic")
    return found.select("id", F.array_join("codes", ",").alias("codes"))


_STARTS = "FROM edges e JOIN nodes n ON n.id = e.{far} JOIN nodes s ON s.id = e.{near}"


@query(f"WITH {NODES}, {EDGES} SELECT e.source AS start, n.id, n.type, e.type AS edge_type " + _STARTS.format(near="source", far="target"))
def q_neighbors_out(spark, sf):
    n = nodes(spark, sf)
    return G.neighbours(n, edges(spark, sf), n, "outgoing")


@query(f"WITH {NODES}, {EDGES} SELECT e.target AS start, n.id, n.type, e.type AS edge_type " + _STARTS.format(near="target", far="source"))
def q_neighbors_in(spark, sf):
    n = nodes(spark, sf)
    return G.neighbours(n, edges(spark, sf), n, "incoming")


@query("SELECT 'customer-' || o_custkey AS parent, 'order-' || o_orderkey AS child FROM orders SEMI JOIN customer ON o_custkey = c_custkey")
def q_children_of(spark, sf):
    wanted = read(spark, sf, "customer").select(tagged("customer", "c_custkey").alias("id"))
    return G.neighbours(nodes(spark, sf), edges(spark, sf), wanted, "incoming", "describes").select(F.col("start").alias("parent"), F.col("id").alias("child"))


@query(f"WITH {NODES} SELECT n.id, 'customer-' || o_custkey AS parent FROM nodes n LEFT JOIN orders ON n.id = 'order-' || o_orderkey")
def q_parent_of(spark, sf):
    n = nodes(spark, sf)
    return G.parents_of(n, edges(spark, sf), n, "describes")


@query(f"WITH {NODES}, w AS (SELECT DISTINCT 'part-' || l_partkey AS id FROM lineitem WHERE l_quantity > 49) SELECT n.id, n.type FROM nodes n SEMI JOIN w USING (id)")
def q_lookup_ids(spark, sf):
    """Nodes of a table of ids."""
    wanted = read(spark, sf, "lineitem").where("l_quantity > 49").select(tagged("part", "l_partkey").alias("id"))
    return nodes(spark, sf).join(wanted, "id", "left_semi").select("id", "type")


@query("""SELECT upper(o_orderpriority) AS code, count(DISTINCT o_custkey) AS n, min('customer-' || o_custkey) AS first, max('customer-' || o_custkey) AS last
    FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1""")
def q_inverted_index(spark, sf):
    return G.inverted_index(nodes(spark, sf), edges(spark, sf), "describes", "mnemonic")


@query("SELECT DISTINCT upper(o_orderpriority) AS code, 'customer-' || o_custkey AS target FROM orders WHERE o_orderpriority <> '5-LOW'")
def q_code_holders(spark, sf):
    """The members of the inverted index."""
    return G.code_holders(nodes(spark, sf), edges(spark, sf), "describes", "mnemonic")


def _expand_sql(hops: int) -> str:
    return f"""WITH RECURSIVE {EDGES}, both_ways AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges),
    walk AS (SELECT 'customer-' || c_custkey AS seed, 'customer-' || c_custkey AS node, 0 AS hop FROM customer
        UNION SELECT seed, b, hop + 1 FROM walk JOIN both_ways ON node = a WHERE hop < {hops})
    SELECT seed, node, min(hop) AS hop FROM walk GROUP BY seed, node"""


def _seeds(spark, sf):
    return read(spark, sf, "customer").select(tagged("customer", "c_custkey").alias("id"))


@query(_expand_sql(1))
def q_expand_1hop(spark, sf):
    return N.expand(N.store(edges(spark, sf), folder(spark, "adjacency")), _seeds(spark, sf), 1)


@query(_expand_sql(2))
def q_expand_2hop(spark, sf):
    """Two hops from all customers over a stored adjacency: the edges are dealt once, and hops deal their frontier alone."""
    return N.expand(N.store(edges(spark, sf), folder(spark, "adjacency")), _seeds(spark, sf), 2)


@query(f"""WITH {NODES}, {EDGES}, e AS (SELECT source AS id, 'out' AS way, type FROM edges UNION ALL SELECT target, 'in', type FROM edges),
    t AS (SELECT id, way, type, count(*) AS n FROM e GROUP BY ALL),
    s AS (SELECT id, sum(n) FILTER (way = 'out') AS n_out, sum(n) FILTER (way = 'in') AS n_in, string_agg(way || ':' || type || ':' || n, ',' ORDER BY way || ':' || type || ':' || n) AS by_type FROM t GROUP BY id)
    SELECT n.id, CAST(coalesce(n_out, 0) AS BIGINT) AS n_out, CAST(coalesce(n_in, 0) AS BIGINT) AS n_in, coalesce(by_type, '') AS by_type FROM nodes n LEFT JOIN s USING (id)""")
def q_degree_summary(spark, sf):
    return G.degrees(nodes(spark, sf), edges(spark, sf))


@query("SELECT count(*) AS n FROM customer WHERE 'customer-' || c_custkey LIKE 'customer-1%'")
def q_count_prefix(spark, sf):
    """Parent nodes in scope: those whose id has the prefix."""
    return nodes(spark, sf).where((F.col("type") == "las_document") & F.startswith("id", F.lit("customer-1"))).agg(F.count("*").alias("n"))


@query(f"WITH {EDGES} SELECT source, target, type FROM edges WHERE type = 'contains' AND target NOT IN (SELECT 'part-' || p_partkey FROM part WHERE p_size <= 25)")
def q_orphan_edges(spark, sf):
    """Edges to parts that the node table lacks: it has those of p_size <= 25 alone."""
    return G.orphan_edges(nodes(spark, sf, all_parts=False), edges(spark, sf).select("source", "target", "type"))


@query(f"WITH {NODES}, {EDGES} SELECT 'node' AS what, type, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type")
def q_type_counts(spark, sf):
    counted = lambda df, what: df.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "type", "n")
    return counted(nodes(spark, sf), "node").union(counted(edges(spark, sf), "edge"))


#: Each type's source file and key attributes.
SOURCES = {"las_document": ("customer.parquet", ["WELL", "UWI"]), "las_curve": ("orders.parquet", ["mnemonic"])}
_PROVENANCE = """p AS (SELECT 'customer-' || c_custkey AS id, 'customer.parquet' AS source_file, 'UWI=' || c_mktsegment || ';WELL=' || c_name AS key_fields FROM customer
    UNION ALL SELECT 'order-' || o_orderkey, 'orders.parquet', coalesce('mnemonic=' || nullif(o_orderpriority, '5-LOW'), '') FROM orders
    UNION ALL SELECT 'part-' || p_partkey, 'unknown', '' FROM part)"""


@query(f"WITH {_PROVENANCE} SELECT * FROM p")
def q_provenance(spark, sf):
    return G.provenance(nodes(spark, sf), SOURCES)


@query(f"""WITH {_PROVENANCE}, a AS (SELECT o_custkey AS query_id, unnest(['order-' || o_orderkey, 'customer-' || o_custkey, 'nothing']) AS id FROM orders)
    SELECT query_id, count(*) AS n_nodes, string_agg(DISTINCT source_file, ',' ORDER BY source_file) AS files FROM a JOIN p USING (id) GROUP BY query_id""")
def q_answer_provenance(spark, sf):
    """Sources of the nodes that each answer rests on."""
    ids = F.array(tagged("order", "o_orderkey"), tagged("customer", "o_custkey"), F.lit("nothing"))
    asked = read(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), ids.alias("ids"))
    return G.answer_provenance(asked, G.provenance(nodes(spark, sf), SOURCES))
