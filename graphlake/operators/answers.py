"""Answers to whole tables of questions: structured extraction, and a plan of its own for each route, united at the end."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.functions import rules
from graphlake.functions import text as T
from graphlake.operators import aggregate as A
from graphlake.operators import classify as Q
from graphlake.operators.narrow import among, kept

#: Keys of dates, and words of questions that structured extraction leaves alone.
DATE_KEYS = ["date", "datetime", "measurement_dt", "timestamp"]
COMPLEX = ["why", "how does", "explain", "compare", "difference between", "relationship", "what is the effect"]
#: What a question out of scope and one without anything found are told.
OUT_OF_SCOPE = (
    "This question appears to be about %s, which is outside the scope of this system. This system contains geological, hydrological, and energy production data. "
    "Please ask questions related to well logs, energy production, or surface water monitoring."
)
NOTHING = "No data found."
#: A term is what follows these words, up to three words.
TERM = r"(?:define|definition of|meaning of|what is|what does|explain|describe|clarify)\s+(?:the |an |a )?([a-z0-9/-]+)"
#: Characters of the best text that stand where no rule answers.
HEAD = 200


def first_of(texts: Column, value: Callable[[Column], Column]) -> Column:
    """The first text's value that is not null."""
    return F.get(F.filter(F.transform(texts, value), lambda v: v.isNotNull()), F.lit(0))


def all_of(texts: Column, value: Callable[[Column], Column]) -> Column:
    return F.filter(F.transform(texts, value), lambda v: v.isNotNull())


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value as a variable: an expression that is used twice is planned and run once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def listed(found: Column, more: str) -> Column:
    """Up to five values with commas, else their number, what they are, and the first five; null without one."""
    five = lambda v: F.array_join(F.slice(v, 1, 5), ", ")
    return let(found, lambda v: F.when(F.size(v) == 0, None).when(F.size(v) <= 5, five(v)).otherwise(F.format_string(f"%d {more} found: %s...", F.size(v), five(v))))


def unit_mnemonics(texts: Column, unit: str) -> Column:
    """Upper-cased mnemonics of the texts whose normalised unit is the one asked for, distinct and sorted."""
    found = all_of(texts, lambda t: F.when(T.normalize_unit(T.attribute(t, "unit")) == unit, F.upper(T.attribute(t, "mnemonic"))))
    return T.missing(F.array_join(F.array_sort(F.array_distinct(found)), ", "))


def temporal(text: Column, name: str) -> Column:
    """A year by its line, a temporal line or its attribute; a date by a temporal line or one of the keys of dates."""
    part = lambda pattern: T.missing(F.trim(F.regexp_extract(text, pattern, 1)))
    if name == "year":
        return F.coalesce(part(r"YEAR:\s*(\d{4})"), part(r"TEMPORAL:?\s*.*?(\d{4})"), T.missing(F.regexp_extract(T.attribute(text, "year"), r"(\d{4})", 1)))
    return F.coalesce(part(r"TEMPORAL:\s*([^\n]+)"), *[T.attribute(text, key) for key in DATE_KEYS])


def place(text: Column) -> Column:
    """A location line, a state line, the site's name, or a tag of either."""
    part = lambda pattern: T.missing(F.trim(F.regexp_extract(text, pattern, 1)))
    return F.coalesce(part(r"LOCATION:\s*([^\n]+)"), part(r"STATE:\s*([^\n]+)"), T.attribute(text, "site_name"), part(r"(?i)\[(?:LOCATION|SITE_NAME)\]\s*([^\[\]\r\n]+)"))


def state_answer(texts: Column) -> Column:
    """`IN (Indiana)` from a state attribute, else from a location; an unknown state stands as it is."""
    names = F.create_map(*[x for short, name in rules.STATES.items() for x in (F.lit(short), F.lit(name))])
    shorts = F.create_map(*[x for short, name in rules.STATES.items() for x in (F.lit(name), F.lit(short))])
    full = lambda short, name: F.concat(short, F.lit(" ("), name, F.lit(")"))
    by_name = lambda name: F.coalesce(full(F.try_element_at(shorts, name), name), name)
    given = let(first_of(texts, lambda t: T.attribute(t, "state")), lambda raw: F.coalesce(full(F.upper(raw), F.try_element_at(names, F.upper(raw))), by_name(F.initcap(F.trim(raw)))))
    placed = let(first_of(texts, place), lambda where: F.coalesce(let(T.state(where), by_name), F.concat(F.lit("Location: "), where)))
    return F.coalesce(given, placed)


def location_answer(question: Column, texts: Column) -> Column:
    """City and state of a question for a place, else the state, else the location as it stands."""

    def told(where: Column) -> Column:
        return let(T.state(where), lambda state: F.coalesce(F.concat(F.lit("Location: "), T.city(where), F.lit(", "), state), state, F.concat(F.lit("Location: "), where)))

    return F.when(Q.has_any(F.lower(question), ["where", "located"]), let(first_of(texts, place), told))


def mnemonic_answer(texts: Column) -> Column:
    """Mnemonics with their descriptions."""
    detail = lambda t: F.concat(T.attribute(t, "mnemonic"), F.coalesce(F.concat(F.lit(" ("), T.attribute(t, "description"), F.lit(")")), F.lit("")))
    return listed(all_of(texts, detail), "curves")


def named_attribute(text: Column, name: Column) -> Column:
    """As `text.attribute` for a name that is a column."""
    part = lambda *pattern: T.missing(F.trim(F.call_function("regexp_extract", text, F.concat(*pattern), F.lit(1))))
    value = F.lit(r"\s*:\s*([^\n]+)")
    return F.coalesce(part(F.lit(r"(?im)^\s*-\s*"), name, value), part(F.lit(r"(?im)^\s*"), name, value), part(F.lit(r"(?i)\["), name, F.lit(r"\]\s*([^\n\[]+)")))


def generic_answer(texts: Column, name: Column) -> Column:
    """The distinct values of an attribute, in order."""
    return listed(F.array_distinct(all_of(texts, lambda t: named_attribute(t, name))), "different values")


def structured_answer(question: Column, attribute: Column, texts: Column) -> Column:
    """The answer to a question for an attribute from an array of texts, by the first strategy that has one: unit, time, state,
    place, well, mnemonic, any attribute. Null without an attribute, without texts, and where nothing is found."""
    q = F.lower(question)
    of_unit = Q.has_any(q, ["unit"]) & Q.has_any(q, ["ohm.m", "ohm m", "ohm-m"])
    when = lambda name, answer: F.when(attribute == name, answer)
    strategies = [
        F.when(of_unit, unit_mnemonics(texts, "ohm.m")),
        when("year", first_of(texts, lambda t: temporal(t, "year"))),
        when("date", first_of(texts, lambda t: temporal(t, "date"))),
        when("state", state_answer(texts)),
        F.when(attribute.isNotNull(), location_answer(question, texts)),
        when("well", first_of(texts, lambda t: T.attribute(t, "well"))),
        when("mnemonic", mnemonic_answer(texts)),
        F.when(attribute != "mnemonic", generic_answer(texts, attribute)),
    ]
    return F.when(~Q.has_any(q, COMPLEX), F.coalesce(*strategies))


@dataclass
class Sources:
    """What answers come from. found: (query_id, rank, id, text and fields), what was retrieved for each question; nodes and edges of
    the graph; definitions: (term, definition), a row a term; fields: the columns of found behind the fields that questions name,
    where `year` is the numeric one; well_node: the node id of a well id as it is written in a question."""

    found: DataFrame
    nodes: DataFrame
    edges: DataFrame
    definitions: DataFrame
    fields: dict[str, str]
    well_node: Callable[[Column], Column]


def glossary(asked: DataFrame, s: Sources) -> DataFrame:
    term = T.missing(F.regexp_extract(F.lower("question"), TERM, 1))
    named = asked.withColumn("term", term).join(s.definitions.select(F.lower("term").alias("term"), "definition"), "term", "left")
    none = F.concat(F.lit("No definition of '"), F.coalesce("term", F.lit("")), F.lit("' is stored."))
    return named.select("query_id", F.coalesce(F.concat(F.lit("**"), "term", F.lit("**: "), "definition"), none).alias("answer"))


def out_of_scope(asked: DataFrame, s: Sources) -> DataFrame:
    topic = F.get(Q.matched_topics(F.col("question")), F.lit(0))["topic"]
    return asked.select("query_id", F.format_string(OUT_OF_SCOPE, topic).alias("answer"))


def curve_counts(asked: DataFrame, s: Sources) -> DataFrame:
    """The number of curves that describe the well of a question; 0 for an unknown one."""
    wells = asked.select("query_id", s.well_node(Q.well_id(F.col("question"))).alias("target"))
    counts = among(s.edges.where("type = 'describes'"), "target", wells, "target").groupBy("target").agg(F.count("*").alias("n"))
    return wells.join(counts, "target", "left").select("query_id", F.coalesce("n", F.lit(0)).cast("string").alias("answer"))


def well_counts(asked: DataFrame, s: Sources) -> DataFrame:
    total = A.count_entities(s.nodes, "las_document")  # one row
    return asked.join(F.broadcast(total), F.lit(True)).select("query_id", F.concat(F.lit("There are "), F.col("n").cast("string"), F.lit(" wells.")).alias("answer"))


def relations(asked: DataFrame, s: Sources) -> DataFrame:
    """A named well's curves, by name; without a well, the first well with the first code of the question that any well has, and
    how many others have it. Null where neither is known. Edges are cut to the wells that are named, and curves to the codes."""
    coded = s.nodes.where("type = 'las_curve'").select(F.col("id").alias("source"), F.upper(F.col("attributes")["mnemonic"]).alias("code")).where("code is not null")
    describes = s.edges.where("type = 'describes'").select("source", "target")
    wells = asked.withColumn("target", s.well_node(Q.well_id(F.col("question"))))
    theirs = kept(among(describes, "target", wells, "target"))
    of_well = theirs.join(among(coded, "source", theirs, "source"), "source").groupBy("target").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    named = wells.join(of_well, "target", "left")
    told_codes = F.concat(F.size("codes").cast("string"), F.lit(" curve types: "), F.array_join(F.slice("codes", 1, 10), ", "))
    first = named.select("query_id", "question", "target", F.when(F.size("codes") > 0, told_codes).alias("listed"))
    tokens = first.where("target is null").select("query_id", F.posexplode(F.regexp_extract_all("question", F.lit("([A-Z0-9_-]{2,})"), F.lit(1))).alias("pos", "code"))
    named_codes = kept(among(coded, "code", tokens, "code"))
    holders = among(describes, "source", named_codes, "source").join(named_codes, "source").select("code", "target").distinct().groupBy("code").agg(F.min("target").alias("holder"), F.count("*").alias("n"))
    hits = tokens.join(holders, "code").groupBy("query_id").agg(F.min_by(F.struct("holder", "n"), "pos").alias("hit"))
    names = s.nodes.where("type = 'las_document'").select(F.col("id").alias("holder"), F.col("attributes")["WELL"].alias("name"))
    told = hits.select("query_id", "hit.holder", "hit.n").join(names, "holder", "left")
    one = F.coalesce(F.concat("name", F.lit(" (well ID: "), "holder", F.lit(")")), F.col("holder"))
    told = told.select("query_id", F.concat(one, F.when(F.col("n") > 1, F.concat(F.lit(" (plus "), (F.col("n") - 1).cast("string"), F.lit(" other matches)"))).otherwise("")).alias("told"))
    return first.join(told, "query_id", "left").select("query_id", F.coalesce("listed", "told").alias("answer"))


def extractions(asked: DataFrame, s: Sources) -> DataFrame:
    texts = s.found.join(asked.select("query_id"), "query_id", "left_semi").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("texts"))
    q = F.col("question")
    return asked.join(texts, "query_id", "left").select("query_id", structured_answer(q, Q.attribute_asked(q), F.coalesce("texts", F.array().cast("array<string>"))).alias("answer"))


def plain(number: Column) -> Column:
    """A number as text, without a zero fraction."""
    return F.when(number == F.floor(number), number.cast("long").cast("string")).otherwise(number.cast("string"))


def aggregations(asked: DataFrame, s: Sources) -> DataFrame:
    """Counts, lists, sums, extremes, ranges and comparisons over what was found for each question."""
    q = F.col("question")
    tagged = asked.withColumn("kind", Q.aggregation_type(q)).withColumn("field", F.coalesce(Q.comparison_field(q), F.lit("entity_type")))
    picked = F.coalesce(*[F.when(F.col("field") == name, T.missing(F.col(column).cast("string"))) for name, column in s.fields.items() if name != "year"])
    rows = s.found.join(tagged.select("query_id", "kind", "field"), "query_id").withColumn("value", picked).withColumn("number", F.col(s.fields["year"]).cast("double"))
    groups = rows.where("value is not null").groupBy("query_id", "value").agg(F.count("*").alias("size"), F.min("rank").alias("first"))
    best = groups.groupBy("query_id").agg(F.max_by(F.struct("value", "size"), F.struct("size", -F.col("first"))).alias("best"), F.slice(F.array_sort(F.collect_list("value")), 1, 20).alias("listed"))
    sums = rows.groupBy("query_id").agg(F.count("*").alias("n"), F.sum("number").alias("total"), F.min("number").alias("low"), F.max("number").alias("high"))
    held = tagged.join(sums, "query_id", "left").join(best, "query_id", "left")
    kind, n = F.col("kind"), F.coalesce("n", F.lit(0))
    unique = F.concat(F.lit("Found "), F.size("listed").cast("string"), F.lit(" unique "), "field", F.lit(" values: "), F.array_join("listed", ", "), F.lit("."))
    span = F.concat(F.lit("Range is "), plain(F.col("high") - F.col("low")), F.lit(" ("), plain(F.col("low")), F.lit(" to "), plain(F.col("high")), F.lit(")."))
    answer = (
        F.when(kind == "COUNT", A.count_answer(n, F.lit("record"), F.array().cast("array<string>")))
        .when(kind.isin("LIST", "DISTINCT"), F.coalesce(unique, F.concat(F.lit("No values found for "), "field", F.lit("."))))
        .when(kind == "COMPARISON", F.coalesce(F.concat("best.value", F.lit(" ("), F.col("best.size").cast("string"), F.lit(" records).")), F.lit("No data found for comparison.")))
        .when(kind == "SUM", F.concat(F.lit("Total is "), plain(F.coalesce("total", F.lit(0.0))), F.lit(".")))
        .when(kind == "RANGE", F.coalesce(span, F.lit(NOTHING)))
        .when(kind == "MAX", F.coalesce(plain(F.col("high")), F.lit(NOTHING)))
        .when(kind == "MIN", F.coalesce(plain(F.col("low")), F.lit(NOTHING)))
    )
    return held.select("query_id", answer.alias("answer"))


def by_rule(asked: DataFrame, s: Sources) -> DataFrame:
    return asked.select("query_id", Q.domain_answer(F.col("question")).alias("answer"))


def best_text(asked: DataFrame, s: Sources) -> DataFrame:
    """The beginning of the best text: a generator is not part of this library."""
    first = s.found.join(asked.select("query_id"), "query_id", "left_semi").groupBy("query_id").agg(F.min_by("text", "rank").alias("text"))
    return asked.select("query_id").join(first, "query_id", "left").select("query_id", F.left("text", F.lit(HEAD)).alias("answer"))


#: Routes that always answer, and those that leave a question they can't answer to the next.
SURE = {"glossary": glossary, "out_of_scope": out_of_scope, "curve_count": curve_counts, "well_count": well_counts}
CHAIN = {"relation": relations, "extraction": extractions, "aggregation": aggregations, "rule": by_rule, "fallback": best_text}


def answer_all(routed: DataFrame, sources: Sources) -> DataFrame:
    """(query_id, route, answered_by, answer): one answer for each row of routed (query_id, question, route).

    Each route's questions go through its own plan, and the parts are united. Where a relation, an extraction, an aggregation
    or a rule has no answer, the next of these plans is asked, at last the question's best text, and where nothing was found
    for it the answer is NOTHING; answered_by tells which. query_id is a key.
    """
    asked = routed.select("query_id", "question", "route")
    of = lambda route: asked.where(F.col("route") == route)
    parts = [plan(of(route), sources).withColumn("answered_by", F.lit(route)) for route, plan in SURE.items()]
    pending = None
    for route, plan in CHAIN.items():
        mine = of(route) if pending is None else of(route).unionByName(pending)
        part = kept(plan(mine, sources))
        parts.append(part.where("answer is not null").withColumn("answered_by", F.lit(route)))
        pending = mine.join(part.where("answer is null").select("query_id"), "query_id", "left_semi")
    parts.append(pending.select("query_id", F.lit(NOTHING).alias("answer"), F.lit("none").alias("answered_by")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return asked.select("query_id", "route").join(out, "query_id")
