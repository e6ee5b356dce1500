"""Question classification: columns over a table of questions, from fixed rules; no question passes through the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphlake.functions import rules
from graphlake.functions import text as T


def has_any(lowered: Column, phrases: list[str]) -> Column:
    """Any phrase as a substring of the lower-cased question."""
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(p.lower())) for p in phrases])


def first_rule(lowered: Column, table: list[tuple[str, list[str]]]) -> Column:
    """The name of the first rule with a phrase in the question, null if none has."""
    return F.coalesce(*[F.when(has_any(lowered, phrases), name) for name, phrases in table])


def aggregation_type(question: Column) -> Column:
    q = F.lower(question)
    has = lambda *p: has_any(q, list(p))
    comparison = (has("which") & has(" more ", " most ")) | has("are there more", "more records", "more data", "more measurements", "more curves")
    spans = has("range", "how many years", "number of years", "years of data", "year span") | (has("span") & has("year", "time", "period")) | (has("difference between") & has("max"))
    return F.when(has("what data") & has("available"), "COUNT").when(comparison, "COMPARISON").when(spans, "RANGE").otherwise(first_rule(q, rules.AGGREGATION))


def chosen_field(question: Column, fields: list[str]) -> Column:
    """The field that a question names: a word that is one, else the shortest field that holds a word of three letters, word by
    word, else the shortest one that holds the first keyword of the question that any field holds. Stop words and reserved
    fields don't count; null where nothing fits."""
    q = F.lower(question)
    known = sorted((f for f in fields if f.lower() not in rules.RESERVED_FIELDS), key=lambda f: (len(f), f.lower()))
    if not known:
        return F.lit(None).cast("string")
    words = F.filter(F.regexp_extract_all(q, F.lit(r"[a-z0-9_]+"), F.lit(0)), lambda w: ~w.isin(rules.STOPWORDS))
    first = lambda found: F.get(F.filter(F.transform(words, found), lambda f: f.isNotNull()), F.lit(0))
    exact = first(lambda w: F.coalesce(*[F.when(w == f.lower(), f) for f in known]))
    inside = first(lambda w: F.when(F.length(w) >= 3, F.coalesce(*[F.when(F.contains(F.lit(f.lower()), w), f) for f in known])))
    holding = [(k, [f for f in known if k in f.lower()]) for k in rules.KEYWORD_PRIORITY]
    by_word = [F.when(F.contains(q, F.lit(k)), held[0]) for k, held in holding if held]
    return F.coalesce(exact, inside, *by_word)


def comparison_field(question: Column, fields: list[str] | None = None) -> Column:
    """What a comparison is over: domain, operator or state by name, the type where an entity is named; given the fields, a
    question that names none of these takes the field that it names otherwise."""
    q = F.lower(question)
    if fields is None:
        return first_rule(q, [("domain", ["domain"]), ("operator", ["operator"]), ("state", ["state"]), ("entity_type", ["entity", "type"])])
    by_rule = first_rule(q, [("domain", ["domain"]), ("operator", ["operator"]), ("state", ["state"]), ("entity_type", rules.COMPARED_ENTITIES)])
    return F.coalesce(by_rule, chosen_field(question, fields))


def entities(question: Column) -> dict[str, Column]:
    """The first match of each entity pattern, null without one."""
    found = {n: T.missing(F.regexp_extract(question, p if p.startswith("(?i)") else f"(?i){p}", 0)) for n, p in rules.ENTITY_PATTERNS.items()}
    return found


def relation(question: Column) -> Column:
    """The relation of the first pattern that matches; a well with curve words asks for its curves."""
    q = F.lower(question)
    matched = F.coalesce(*[F.when(reduce(lambda a, b: a | b, [q.rlike(p) for p in patterns]), name) for name, patterns in rules.RELATION_PATTERNS])
    about_curves = has_any(q, rules.WELL_CURVE_TERMS) | (has_any(q, ["curve"]) & has_any(q, ["well"]))
    return F.coalesce(matched, F.when(entities(question)["well_id"].isNotNull() & about_curves, "well_to_curves"))


def is_relationship(question: Column) -> Column:
    """Whether a question asks for a relation, by pattern or by a relation word alone."""
    return relation(question).isNotNull() | has_any(F.lower(question), rules.RELATION_WORDS)


def target(question: Column) -> Column:
    """What the first matching pattern's group names, else the well of a question for its curves; null without either."""
    q = F.lower(question)
    named = [F.when(q.rlike(p), F.regexp_extract(q, p, 1)) for _, patterns in rules.RELATION_PATTERNS for p in patterns if "(" in p]
    about_curves = has_any(q, rules.WELL_CURVE_TERMS) | (has_any(q, ["curve"]) & has_any(q, ["well"]))
    return F.coalesce(*named, F.when(about_curves, entities(question)["well_id"]))


def evidence(question: Column) -> Column:
    """What the confidence rests on, as texts in the order of the points: pattern, words, two entities at most, both together."""
    pattern, words = relation(question).isNotNull(), has_any(F.lower(question), rules.RELATION_WORDS)
    found = entities(question)
    held = lambda *cs: F.filter(F.array(*cs), lambda x: x.isNotNull())
    two = F.slice(held(*[F.when(found[k].isNotNull(), f"entity:{k}:+0.1") for k in ("well_id", "curve_name", "site_id")]), 1, 2)
    return F.concat(held(F.when(pattern, "pattern_match:+0.6"), F.when(words, "keyword_hit:+0.2")), two, held(F.when(pattern & words, "synergy:+0.1")))


def relation_confidence(question: Column) -> Column:
    """0.6 for a relation, 0.2 for a relation word, 0.1 for each of two entities at most, 0.1 for relation and word together."""
    yes = lambda c: c.cast("int")
    pattern, words = relation(question).isNotNull(), has_any(F.lower(question), rules.RELATION_WORDS)
    found = entities(question)
    n = sum((yes(found[k].isNotNull()) for k in ("well_id", "curve_name", "site_id")), F.lit(0))
    tenths = 6 * yes(pattern) + 2 * yes(words) + F.least(F.lit(2), n) + yes(pattern & words)
    return F.least(F.lit(10), tenths) / 10


def traversal(relation_: Column) -> tuple[Column, Column]:
    """Direction and edge type of a relation."""
    pick = lambda i: F.coalesce(*[F.when(relation_ == k, v[i]) for k, v in rules.TRAVERSAL.items()])
    return pick(0), pick(1)


def entity_filter(question: Column) -> Column:
    return first_rule(F.lower(question), rules.ENTITY_WORDS)


def critical_keywords(question: Column) -> Column:
    q = F.lower(question)
    return F.flatten(F.array(*[F.regexp_extract_all(q, F.lit(p), F.lit(1)) for p in rules.KEYWORD_PATTERNS]))


def well_id(question: Column) -> Column:
    return T.missing(F.replace(F.regexp_extract(F.lower(question), rules.WELL_ID, 1), F.lit("/"), F.lit("_")))


def attribute_asked(question: Column) -> Column:
    q = F.lower(question)
    units = has_any(q, ["unit"]) & has_any(q, ["ohm.m", "ohm m", "ohm-m"])
    return F.coalesce(first_rule(q, rules.ATTRIBUTES), F.when(units, "mnemonic"))


def scope(question: Column) -> tuple[Column, Column]:
    """Whether a question is in scope (in doubt it is), and how sure that is: 0.9 out, 0.85 in, 0.4 by default."""
    q = F.lower(question)
    out, inside = first_rule(q, rules.OUT_OF_SCOPE).isNotNull(), first_rule(q, rules.IN_SCOPE).isNotNull()
    return ~out, F.when(out, 0.9).when(inside, 0.85).otherwise(0.4)


def matched_topics(question: Column) -> Column:
    """Array of (topic, keyword) that a question matches: those out of scope, or where there are none those in scope."""
    q = F.lower(question)
    pairs = lambda table: F.filter(
        F.array(*[F.when(F.contains(q, F.lit(w.lower())), F.struct(F.lit(t).alias("topic"), F.lit(w).alias("keyword"))) for t, words in table for w in words]), lambda x: x.isNotNull()
    )
    out = pairs(rules.OUT_OF_SCOPE)
    return F.when(F.size(out) > 0, out).otherwise(pairs(rules.IN_SCOPE))


def expanded(question: Column) -> Column:
    """The question with three synonyms of each term in it, where expansion helps."""
    q = F.lower(question)
    more = [F.when(F.contains(q, F.lit(term)), " ".join(words)) for term, words in rules.SYNONYMS]
    return F.when(~has_any(q, rules.NO_EXPANSION) & has_any(q, rules.EXPANSION), F.concat_ws(" ", question, *more)).otherwise(question)


def is_glossary(question: Column) -> Column:
    q = F.lower(question)
    return ~has_any(q, rules.NOT_GLOSSARY) & has_any(q, rules.GLOSSARY)


def domain_rule(question: Column) -> Column:
    return first_rule(F.lower(question), rules.DOMAIN_RULES)


def domain_answer(question: Column) -> Column:
    """The fixed answer of the first domain rule that a question meets, else null."""
    return first_rule(F.lower(question), [(rules.DOMAIN_ANSWERS[name], phrases) for name, phrases in rules.DOMAIN_RULES])


def route(question: Column) -> Column:
    """What answers a question: the first route that takes it."""
    in_scope, _ = scope(question)
    q = F.lower(question)
    return (
        F.when(is_glossary(question), "glossary").when(~in_scope, "out_of_scope").when(has_any(q, ["how many curves"]) & well_id(question).isNotNull(), "curve_count")
        .when(has_any(q, ["how many wells"]), "well_count").when(relation_confidence(question) >= 0.6, "relation").when(attribute_asked(question).isNotNull(), "extraction")
        .when(aggregation_type(question).isNotNull(), "aggregation").when(domain_rule(question).isNotNull(), "rule").otherwise("fallback")
    )


def complexity(question: Column) -> tuple[Column, Column]:
    """Score of 0 to 100 and tier of 1 to 5."""
    q = F.lower(question)
    points = lambda table: sum((F.when(has_any(q, words), n).otherwise(0) for n, words in table), F.lit(1))
    hits = lambda words: sum((F.contains(q, F.lit(w)).cast("int") for w in words), F.lit(0))
    wells = F.regexp_count(question, F.lit(r"\d+/\d+-\d+"))
    scope_ = F.greatest(F.when(wells > 0, wells).when(has_any(q, ["all wells", "all three wells", "each well"]), 3).otherwise(1), hits(rules.CURVE_WORDS))
    factors = {"steps": points(rules.STEP_WORDS), "tools": points(rules.TOOL_WORDS), "scope": scope_, "aggregations": hits(rules.AGGREGATION_WORDS)}
    w = rules.COMPLEXITY_WEIGHTS
    score = 100 * sum((F.least(F.lit(1.0), v / rules.COMPLEXITY_CAPS[k]) * w[k] for k, v in factors.items()), F.when(has_any(q, rules.INFERENCE_WORDS), w["inference"]).otherwise(0.0))
    score = F.round(score, 6)
    return score, F.when(score <= 20, 1).when(score <= 40, 2).when(score <= 60, 3).when(score <= 80, 4).otherwise(5)


def too_long(question: Column, limit: int = 500) -> Column:
    return F.length(question) > limit
