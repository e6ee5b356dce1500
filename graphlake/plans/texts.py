"""Queries of the text functions."""

from pyspark.sql import functions as F

from graphlake.functions import rules
from graphlake.functions import text as T
from graphlake.functions import units as U
from graphlake.operators import classify as Q
from graphlake.plans.base import ANSWERS, answers, query, read, tokens_sql

_A, _E = tokens_sql("answer"), tokens_sql("expected")
_OVERLAP = f"CASE WHEN len({_A}) = 0 OR len({_E}) = 0 THEN 0.0 ELSE CAST(len(list_intersect({_A}, {_E})) AS DOUBLE) / greatest(len({_A}), len({_E})) END"


@query(f"WITH {ANSWERS} SELECT query_id, round({_OVERLAP}, 6) AS overlap FROM answers")
def q_token_overlap(spark, sf):
    return answers(spark, sf, True).select("query_id", F.round(T.overlap_of("answer_words", "expected_words"), 6).alias("overlap"))


@query(f"WITH {ANSWERS} SELECT query_id, round(CAST(len(list_intersect({_A}, {_E})) AS DOUBLE) / nullif(len(list_distinct(list_concat({_A}, {_E}))), 0), 6) AS jaccard FROM answers")
def q_jaccard(spark, sf):
    """Neither text has a number here more than by chance, so the semantic score is checked in tests and the Jaccard part here."""
    return answers(spark, sf, True).select("query_id", F.round(T.jaccard_of("answer_words", "expected_words"), 6).alias("jaccard"))


_NUMBER = r"TRY_CAST(nullif(regexp_extract(replace(replace(replace({}, '%', ''), 'API', ' '), 'm', ' '), '-?[0-9]+\.?[0-9]*', 0), '') AS DOUBLE)"


@query(f"SELECT event_id, {_NUMBER.format('''event_type || ' ' || props || ' ' || CAST(value AS VARCHAR) || '%' ''')} AS number FROM events")
def q_first_number(spark, sf):
    return read(spark, sf, "events").select("event_id", T.first_number(F.concat_ws(" ", "event_type", "props", F.concat(F.col("value").cast("string"), F.lit("% ")))).alias("number"))


_KINDS = ["exact", "approximate", "contains", "contains_all"]


@query("""WITH m AS (SELECT p_partkey, ['exact', 'approximate', 'contains', 'contains_all'][p_partkey % 4 + 1] AS kind, p_name AS name, p_size AS size FROM part),
    s AS (SELECT p_partkey, kind, CASE kind WHEN 'exact' THEN CASE WHEN name = 'red widget' THEN 1.0 ELSE 0.0 END
        WHEN 'approximate' THEN CASE WHEN abs(size - 25) <= 1.25 THEN 1 - abs(size - 25) / 1.25::DOUBLE ELSE 0.0 END
        WHEN 'contains' THEN CASE WHEN contains(name, 'bolt') THEN 1.0 ELSE 0.0 END
        ELSE (CASE WHEN contains(name, 'small') THEN 1 ELSE 0 END + CASE WHEN contains(name, 'ring') THEN 1 ELSE 0 END) / 2.0 END AS confidence FROM m)
    SELECT p_partkey, kind, CAST(round(confidence, 6) AS DOUBLE) AS confidence FROM s""")
def q_match_types(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("p_partkey") % 4 + 1).cast("int"))
    expected = F.element_at(F.array(*map(F.lit, [" Red Widget", "25 units", "BOLT", "small, ring,"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    actual = F.when(kind == "approximate", F.concat(F.lit("about "), F.col("p_size").cast("string"))).otherwise(F.col("p_name"))
    return read(spark, sf, "part").select("p_partkey", kind.alias("kind"), F.round(T.match_score(kind, actual, expected), 6).alias("confidence"))


@query(r"SELECT doc_id, md5(regexp_replace(lower(trim(text)), '\s+', ' ', 'g')) AS fingerprint FROM documents")
def q_text_fingerprint(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("fingerprint"))


_SPELT = ["Ohm-m", "ohm m", "g/cm3", "OHM.M", "US  -FT", ""]


@query("SELECT p_partkey, ['ohm.m', 'ohm.m', 'g/cm3', 'ohm.m', 'us.ft', ''][p_size % 6 + 1] AS unit FROM part")
def q_unit_normalize(spark, sf):
    unit = F.element_at(F.array(*map(F.lit, _SPELT)), (F.col("p_size") % 6 + 1).cast("int"))
    return read(spark, sf, "part").select("p_partkey", T.normalize_unit(unit).alias("unit"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN round(p_size * 0.3048, 6) WHEN 1 THEN round(p_size / 0.3048, 6) WHEN 2 THEN round(p_size * 9.0 / 5 + 32, 6)
    WHEN 3 THEN round(p_size + 273.15, 6) WHEN 4 THEN CAST(p_size AS DOUBLE) END AS converted FROM part""")
def q_convert_units(spark, sf):
    pairs = [("ft", "m"), ("m", "ft"), ("C", "F"), ("C", "K"), ("bbl", "bbl"), ("ft", "bbl")]
    pick = lambda i: F.element_at(F.array(*[F.lit(p[i]) for p in pairs]), (F.col("p_partkey") % 6 + 1).cast("int"))
    asked = read(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("value"), pick(0).alias("from_unit"), pick(1).alias("to_unit"))
    return U.convert(asked).select("p_partkey", F.round("converted", 6).alias("converted"))


@query("SELECT o_orderkey, 'well-' || o_orderkey || '_9-' || o_custkey AS node_id FROM orders")
def q_id_normalize(spark, sf):
    raw = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "well-").otherwise(""), F.col("o_orderkey").cast("string"), F.lit("/9-"), F.col("o_custkey").cast("string"), F.lit("?! "))
    return read(spark, sf, "orders").select("o_orderkey", T.normalize_id(raw, "well-").alias("node_id"))


def _notes(spark, sf):
    """Node texts in the three layouts that attributes are looked for in."""
    name, nation, key = F.col("c_name"), F.col("c_nationkey").cast("string"), F.col("c_custkey") % 4
    listed = F.concat(F.lit("ENTITY\n  - Operator: "), name, F.lit("\nYEAR: 19"), F.lpad(nation, 2, "0"))
    plain, tag = F.concat(F.lit("x\noperator: "), name), F.concat(F.lit("LAS [OPERATOR] "), name, F.lit(" [STATE] Kansas"))
    return read(spark, sf, "customer").select("c_custkey", "c_name", F.when(key == 0, listed).when(key == 1, plain).when(key == 2, tag).otherwise("nothing 1850").alias("note"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 < 3 THEN c_name END AS operator FROM customer")
def q_extract_attribute(spark, sf):
    return _notes(spark, sf).select("c_custkey", T.attribute(F.col("note"), "operator").alias("operator"))


@query("SELECT c_custkey, 1900 + c_nationkey AS year FROM customer WHERE c_custkey % 4 = 0")
def q_extract_temporal(spark, sf):
    note = F.col("note")
    return _notes(spark, sf).select("c_custkey", T.year(F.coalesce(T.attribute(note, "year"), T.attribute(note, "temporal"), T.attribute(note, "date"))).alias("year")).where("year is not null")


_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_STATE = "CASE " + " ".join(f"WHEN regexp_matches(upper(place), '\\b{a}\\b') THEN '{n}'" for a, n in rules.STATES.items()) + " " + " ".join(f"WHEN contains(upper(place), '{n.upper()}') THEN '{n}'" for n in rules.STATES.values()) + " END"
_TITLE = "array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


@query(f"""WITH p AS (SELECT s_suppkey, n_name, CASE s_suppkey % 3 WHEN 0 THEN 'VERMILION RIVER NEAR ' || n_name || ', ' || {_LIST(rules.STATES)}[s_suppkey % 51 + 1]
    WHEN 1 THEN 'Spring Creek at ' || n_name || ' Lake (' || {_LIST(rules.STATES.values())}[s_suppkey % 51 + 1] || ')' ELSE 'no place' END AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT s_suppkey, {_STATE} AS state, CASE WHEN s_suppkey % 3 < 2 THEN {_TITLE} ELSE 'No Place' END AS city FROM p""")
def q_extract_state_city(spark, sf):
    """States and cities of places that suppliers' nations stand in."""
    key, pick = F.col("s_suppkey"), lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("s_suppkey") % 51 + 1).cast("int"))
    near = F.concat(F.lit("VERMILION RIVER NEAR "), "n_name", F.lit(", "), pick(list(rules.STATES)))
    at = F.concat(F.lit("Spring Creek at "), "n_name", F.lit(" Lake ("), pick(list(rules.STATES.values())), F.lit(")"))
    places = read(spark, sf, "supplier").join(read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    places = places.select("s_suppkey", F.when(key % 3 == 0, near).when(key % 3 == 1, at).otherwise("no place").alias("place"))
    return places.select("s_suppkey", T.state(F.col("place")).alias("state"), T.city(F.col("place")).alias("city"))


@query("""WITH f AS (SELECT user_id, event_type, min(event_id) AS seen FROM events GROUP BY ALL), l AS (SELECT user_id, list(event_type ORDER BY seen) AS v FROM f GROUP BY user_id)
    SELECT user_id, CASE WHEN len(v) <= 5 THEN array_to_string(v, ', ') ELSE len(v) || ' values: ' || array_to_string(v[1:5], ', ') END AS types FROM l""")
def q_multi_values(spark, sf):
    """Distinct values in the order they were first seen."""
    first = read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("at"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "event_type"))), lambda x: x["event_type"])
    return first.groupBy("user_id").agg(ordered.alias("v")).select("user_id", T.joined_values(F.col("v")).alias("types"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN CAST(1900 + c_nationkey AS VARCHAR) WHEN 1 THEN c_name WHEN 2 THEN 'Kansas' END AS answer FROM customer")
def q_structured_extract(spark, sf):
    """Strategies in order: temporal, state, generic attribute."""
    note = F.col("note")
    year = T.year(T.attribute(note, "year")).cast("string")
    return _notes(spark, sf).select("c_custkey", F.coalesce(year, T.attribute(note, "state"), T.attribute(note, "operator")).alias("answer"))


#: Fields a question may name.
FIELDS = ["event_type", "value", "user", "gas_unit", "oil_unit", "id", "type"]
_FIELD_WORDS = "['which event_type is it', 'what val was it', 'by user and value', 'nothing here', 'gases by it', 'show ' || event_type, 'count of type and id']"


@query(f"""WITH q AS (SELECT event_id, event_type, {_FIELD_WORDS}[event_id % 7 + 1] AS q FROM events)
    SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'event_type' WHEN 1 THEN 'value' WHEN 2 THEN 'user' WHEN 4 THEN 'gas_unit' WHEN 6 THEN 'event_type' END AS field FROM q""")
def q_field_match(spark, sf):
    """The field that a question about an event names: a word that is one, the shortest that holds a word, one by a keyword."""
    asked = F.array(*map(F.lit, ["which event_type is it", "what val was it", "by user and value", "nothing here", "gases by it"]), F.concat(F.lit("show "), "event_type"), F.lit("count of type and id"))
    question = F.element_at(asked, (F.col("event_id") % 7 + 1).cast("int"))
    return read(spark, sf, "events").select("event_id", Q.chosen_field(question, FIELDS).alias("field"))
