"""Queries of question classification, over the user turns of the conversations."""

from pyspark.sql import functions as F

from graphlake.functions import rules
from graphlake.operators import classify as Q
from graphlake.plans.base import query, read

#: Beginnings of questions; a turn's text follows, so that every turn of the table asks something.
STARTS = [
    "How many wells are there", "What curves are available for well 15_9-13", "Which well has curve NPHI", "Define porosity", "What data is available",
    "Which state has the most records", "latest year of gas production", "year span of streamflow", "What is the site code of site 03339000", "sum of oil",
    "well name for 15/9-13", "which site is the measurement from", "election news", "list all operators named Apex", "files that contain lithofacies",
    "compare density and resistivity then predict for all wells 15/9-13 16/1-2", "unit ohm-m curves", "photoelectric", "monitoring of energy", "different",
]
_STARTS = ", ".join(f"'{s}'" for s in STARTS)
ASKED = f"asked AS (SELECT conv_id, turn, [{_STARTS}][(conv_id * 7 + turn) % {len(STARTS)} + 1] || ' ' || coalesce(text, '') AS question FROM conversations WHERE role = 'user'), a AS (SELECT *, lower(question) AS q FROM asked)"


def asked(spark, sf):
    start = F.element_at(F.array(*map(F.lit, STARTS)), ((F.col("conv_id") * 7 + F.col("turn")) % len(STARTS) + 1).cast("int"))
    return read(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat_ws(" ", start, F.coalesce("text", F.lit(""))).alias("question"))


def _any(phrases) -> str:
    return "(" + " OR ".join(f"contains(q, '{p.lower()}')" for p in phrases) + ")"


def _first(table) -> str:
    return "CASE " + " ".join(f"WHEN {_any(p)} THEN '{n}'" for n, p in table) + " END"


def _classified(spark, sf, **columns):
    return asked(spark, sf).select("conv_id", "turn", *[f(F.col("question")).alias(n) for n, f in columns.items()])


_AGG = f"""CASE WHEN contains(q, 'what data') AND contains(q, 'available') THEN 'COUNT'
    WHEN (contains(q, 'which') AND {_any([' more ', ' most '])}) OR {_any(['are there more', 'more records', 'more data', 'more measurements', 'more curves'])} THEN 'COMPARISON'
    WHEN {_any(['range', 'how many years', 'number of years', 'years of data', 'year span'])} OR (contains(q, 'span') AND {_any(['year', 'time', 'period'])}) OR (contains(q, 'difference between') AND contains(q, 'max')) THEN 'RANGE'
    ELSE {_first(rules.AGGREGATION)} END"""
_FIELD = _first([("domain", ["domain"]), ("operator", ["operator"]), ("state", ["state"]), ("entity_type", ["entity", "type"])])


@query(f"WITH {ASKED} SELECT conv_id, turn, {_AGG} AS aggregation, {_FIELD} AS field FROM a")
def q_classify_agg(spark, sf):
    return _classified(spark, sf, aggregation=Q.aggregation_type, field=Q.comparison_field)


_ENT = {n: f"nullif(regexp_extract(question, '{p if p.startswith('(?i)') else '(?i)' + p}', 0), '')" for n, p in rules.ENTITY_PATTERNS.items()}
_MATCHED = "CASE " + " ".join(f"WHEN {' OR '.join(f'regexp_matches(q, {p!r})' for p in ps)} THEN '{n}'" for n, ps in rules.RELATION_PATTERNS) + " END"
_MATCHED = _MATCHED.replace("\\\\", "\\")
_REL = f"coalesce({_MATCHED}, CASE WHEN {_ENT['well_id']} IS NOT NULL AND ({_any(rules.WELL_CURVE_TERMS)} OR (contains(q, 'curve') AND contains(q, 'well'))) THEN 'well_to_curves' END)"


_ABOUT = f"({_any(rules.WELL_CURVE_TERMS)} OR (contains(q, 'curve') AND contains(q, 'well')))"
_TARGET = "coalesce(CASE " + " ".join(f"WHEN regexp_matches(q, '{p}') THEN regexp_extract(q, '{p}', 1)" for _, ps in rules.RELATION_PATTERNS for p in ps if "(" in p) + f" END, CASE WHEN {_ABOUT} THEN {_ENT['well_id']} END)"
_ASKS = f"({_REL} IS NOT NULL OR {_any(rules.RELATION_WORDS)})"


@query(f"WITH {ASKED} SELECT conv_id, turn, {_REL} AS relation, {_TARGET} AS target, {_ASKS} AS asks, {', '.join(f'{v} AS {n}' for n, v in _ENT.items())} FROM a")
def q_classify_rel(spark, sf):
    found = {n: (lambda q, n=n: Q.entities(q)[n]) for n in rules.ENTITY_PATTERNS}
    return _classified(spark, sf, relation=Q.relation, target=Q.target, asks=Q.is_relationship, **found)


_CONF = f"""(SELECT CAST(least(10, 6 * p + 2 * w + least(2, n) + p * w) AS DOUBLE) / 10 FROM (SELECT CAST({_REL} IS NOT NULL AS INTEGER) AS p, CAST({_any(rules.RELATION_WORDS)} AS INTEGER) AS w,
    {' + '.join(f'CAST({_ENT[k]} IS NOT NULL AS INTEGER)' for k in ('well_id', 'curve_name', 'site_id'))} AS n))"""
_HOPS = "CASE WHEN c >= 0.85 THEN 2 WHEN c >= 0.6 THEN 1 ELSE 0 END"


_PATTERN, _WORD = f"{_REL} IS NOT NULL", _any(rules.RELATION_WORDS)
_TWO = "nullif(array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_ENT[k]} IS NOT NULL THEN 'entity:{k}:+0.1' END" for k in ("well_id", "curve_name", "site_id")) + "], lambda x: x IS NOT NULL)[1:2], ','), '')"
_EVIDENCE = f"concat_ws(',', CASE WHEN {_PATTERN} THEN 'pattern_match:+0.6' END, CASE WHEN {_WORD} THEN 'keyword_hit:+0.2' END, {_TWO}, CASE WHEN {_PATTERN} AND {_WORD} THEN 'synergy:+0.1' END)"


@query(f"""WITH {ASKED}, r AS (SELECT conv_id, turn, {_REL} AS relation, {_CONF} AS c, {_EVIDENCE} AS evidence FROM a)
    SELECT conv_id, turn, c AS confidence, evidence, CASE WHEN relation IN ('well_to_curves', 'site_to_measurements') THEN 'incoming' WHEN relation IN ('curve_to_well', 'measurement_to_site') THEN 'outgoing' END AS direction,
        CASE WHEN relation LIKE '%well%' THEN 'describes' WHEN relation LIKE '%site%' THEN 'reports_on' END AS edge_type, CASE WHEN relation IS NULL THEN 0 ELSE {_HOPS} END AS hops FROM r""")
def q_rel_confidence(spark, sf):
    """Confidence of the relation, and how the graph is followed at it."""
    from graphlake.operators import retrieval as R

    found = _classified(spark, sf, relation=Q.relation, confidence=Q.relation_confidence, evidence=lambda q: F.array_join(Q.evidence(q), ","))
    direction, kind = Q.traversal(F.col("relation"))
    hops = F.when(F.col("relation").isNull(), 0).otherwise(R.route_params(F.col("confidence"))["hops"])
    return found.select("conv_id", "turn", "confidence", "evidence", direction.alias("direction"), kind.alias("edge_type"), hops.alias("hops"))


@query(f"WITH {ASKED} SELECT conv_id, turn, {_first(rules.ENTITY_WORDS)} AS entity FROM a")
def q_entity_rule(spark, sf):
    return _classified(spark, sf, entity=Q.entity_filter)


_WORDS = " || ".join(f"regexp_extract_all(q, '{p}', 1)" for p in rules.KEYWORD_PATTERNS)


@query(f"WITH {ASKED} SELECT conv_id, turn, array_to_string({_WORDS}, ',') AS keywords FROM a")
def q_critical_keywords(spark, sf):
    return _classified(spark, sf, keywords=lambda q: F.array_join(Q.critical_keywords(q), ","))


@query(f"WITH {ASKED} SELECT conv_id, turn, nullif(replace(regexp_extract(q, '{rules.WELL_ID}', 1), '/', '_'), '') AS well FROM a")
def q_detect_id(spark, sf):
    return _classified(spark, sf, well=Q.well_id)


_ATTR = f"coalesce({_first(rules.ATTRIBUTES)}, CASE WHEN contains(q, 'unit') AND {_any(['ohm.m', 'ohm m', 'ohm-m'])} THEN 'mnemonic' END)"


@query(f"WITH {ASKED} SELECT conv_id, turn, {_ATTR} AS attribute FROM a")
def q_attribute_rule(spark, sf):
    return _classified(spark, sf, attribute=Q.attribute_asked)


_OUT, _IN = f"({_first(rules.OUT_OF_SCOPE)} IS NOT NULL)", f"({_first(rules.IN_SCOPE)} IS NOT NULL)"


def _topics(table) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(q, '{w.lower()}') THEN '{t}:{w}' END" for t, words in table for w in words) + "], lambda x: x IS NOT NULL), ',')"


@query(f"WITH {ASKED} SELECT conv_id, turn, CASE WHEN {_OUT} THEN {_topics(rules.OUT_OF_SCOPE)} ELSE {_topics(rules.IN_SCOPE)} END AS topics, NOT {_OUT} AS in_scope, CAST(CASE WHEN {_OUT} THEN 0.9 WHEN {_IN} THEN 0.85 ELSE 0.4 END AS DOUBLE) AS confidence FROM a")
def q_scope(spark, sf):
    topics = lambda q: F.array_join(F.transform(Q.matched_topics(q), lambda x: F.concat_ws(":", x["topic"], x["keyword"])), ",")
    return _classified(spark, sf, topics=topics, in_scope=lambda q: Q.scope(q)[0], confidence=lambda q: Q.scope(q)[1])


_MORE = ", ".join(f"CASE WHEN contains(q, '{t}') THEN '{' '.join(w)}' END" for t, w in rules.SYNONYMS)


@query(f"WITH {ASKED} SELECT conv_id, turn, CASE WHEN NOT {_any(rules.NO_EXPANSION)} AND {_any(rules.EXPANSION)} THEN concat_ws(' ', question, {_MORE}) ELSE question END AS question FROM a")
def q_expand_query(spark, sf):
    return _classified(spark, sf, question=Q.expanded)


_GLOSSARY = f"(NOT {_any(rules.NOT_GLOSSARY)} AND {_any(rules.GLOSSARY)})"


@query(f"WITH {ASKED} SELECT conv_id, turn, {_GLOSSARY} AS glossary FROM a")
def q_glossary_flag(spark, sf):
    return _classified(spark, sf, glossary=Q.is_glossary)


@query(f"WITH {ASKED} SELECT conv_id, turn, {_first(rules.DOMAIN_RULES)} AS rule, {_first([(rules.DOMAIN_ANSWERS[n], p) for n, p in rules.DOMAIN_RULES])} AS answer FROM a")
def q_domain_rule(spark, sf):
    return _classified(spark, sf, rule=Q.domain_rule, answer=Q.domain_answer)


_ROUTE = f"""CASE WHEN {_GLOSSARY} THEN 'glossary' WHEN {_OUT} THEN 'out_of_scope'
    WHEN contains(q, 'how many curves') AND regexp_matches(q, '{rules.WELL_ID}') THEN 'curve_count' WHEN contains(q, 'how many wells') THEN 'well_count' WHEN {_CONF} >= 0.6 THEN 'relation'
    WHEN {_ATTR} IS NOT NULL THEN 'extraction' WHEN {_AGG} IS NOT NULL THEN 'aggregation' WHEN {_first(rules.DOMAIN_RULES)} IS NOT NULL THEN 'rule' ELSE 'fallback' END"""


@query(f"WITH {ASKED} SELECT conv_id, turn, {_ROUTE} AS route FROM a")
def q_route(spark, sf):
    return _classified(spark, sf, route=Q.route)


def _points(table) -> str:
    return "(1 + " + " + ".join(f"CASE WHEN {_any(p)} THEN {n} ELSE 0 END" for n, p in table) + ")"


def _hits(words) -> str:
    return "(" + " + ".join(f"CAST(contains(q, '{w}') AS INTEGER)" for w in words) + ")"


@query(f"""WITH {ASKED}, f AS (SELECT conv_id, turn, q, {_points(rules.STEP_WORDS)} AS steps, {_points(rules.TOOL_WORDS)} AS tools, len(regexp_extract_all(question, '\\d+/\\d+-\\d+')) AS wells, {_hits(rules.CURVE_WORDS)} AS curves,
    {_hits(rules.AGGREGATION_WORDS)} AS agg, {_any(rules.INFERENCE_WORDS)} AS novel FROM a),
    s AS (SELECT conv_id, turn, round(100 * (0.1 * CAST(novel AS INTEGER)::DOUBLE + 0.3::DOUBLE * least(1, steps / 10::DOUBLE) + 0.25::DOUBLE * least(1, tools / 5::DOUBLE)
        + 0.2::DOUBLE * least(1, greatest(CASE WHEN wells > 0 THEN wells WHEN {_any(['all wells', 'all three wells', 'each well'])} THEN 3 ELSE 1 END, curves) / 10::DOUBLE) + 0.15::DOUBLE * least(1, agg / 5::DOUBLE)), 6) AS score FROM f)
    SELECT *, CASE WHEN score <= 20 THEN 1 WHEN score <= 40 THEN 2 WHEN score <= 60 THEN 3 WHEN score <= 80 THEN 4 ELSE 5 END AS tier FROM s""")
def q_complexity_tier(spark, sf):
    return _classified(spark, sf, score=lambda q: Q.complexity(q)[0], tier=lambda q: Q.complexity(q)[1])


@query(f"WITH {ASKED} SELECT length(question) > 500 AS rejected, count(*) AS n FROM a GROUP BY 1")
def q_length_guard(spark, sf):
    return _classified(spark, sf, rejected=Q.too_long).groupBy("rejected").agg(F.count("*").alias("n"))
