"""Text functions: Column to Column, built-ins alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphlake.functions import rules

#: A numeric string as the field coercion takes it: no NaN, no infinity, no type suffix.
NUMERIC = r"^[ ]*[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?[ ]*$"


def tokens(text: Column) -> Column:
    """Distinct lower-cased runs of letters, digits and underscores, in any script; null has none."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    return F.coalesce(found, F.array().cast("array<string>"))


def share_of(q, t) -> Column:
    """keyword_score of two arrays of distinct tokens."""
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, t)) / F.size(q))


def keyword_score(query: Column, text: Column) -> Column:
    """Share of the query's tokens that the text has; 0 for a query without tokens."""
    return share_of(tokens(query), tokens(text))


def overlap_of(x, y) -> Column:
    """token_overlap of two arrays of distinct tokens."""
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y)))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the larger of the two token counts; 0 when either has none."""
    return overlap_of(tokens(a), tokens(b))


def jaccard_of(x, y) -> Column:
    """jaccard of two arrays of distinct tokens."""
    common = F.size(F.array_intersect(x, y))
    return F.coalesce(F.try_divide(common, F.size(x) + F.size(y) - common), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    return jaccard_of(tokens(a), tokens(b))


def first_number(text: Column) -> Column:
    """The first number after % is dropped and m and API become spaces."""
    plain = F.replace(F.replace(F.replace(text, F.lit("%"), F.lit("")), F.lit("API"), F.lit(" ")), F.lit("m"), F.lit(" "))
    return F.regexp_extract(plain, r"-?[0-9]+\.?[0-9]*", 0).try_cast("double")


def semantic_score(actual: Column, expected: Column) -> Column:
    """The larger of the Jaccard score and 0.7 * numeric agreement + 0.3 * Jaccard, where both have a number."""
    j, a, e = jaccard(actual, expected), first_number(actual), first_number(expected)
    agreement = F.when(a == e, 1.0).when(e == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(a - e) / F.abs(e)))
    return F.coalesce(F.greatest(j, 0.7 * agreement + 0.3 * j), j)


def numeric(value: Column) -> Column:
    """The number a trimmed numeric string holds, else null."""
    return F.when(value.rlike(NUMERIC), F.trim(value).try_cast("double"))


def missing(value: Column) -> Column:
    """Null for the empty string, which counts as missing like null."""
    return F.nullif(value, F.lit(""))


def first_field(*containers: Column) -> Column:
    """The first container's value that is neither null nor empty."""
    return F.coalesce(*[missing(c) for c in containers])


def normalize_unit(unit: Column) -> Column:
    """Lower-cased and trimmed; spaces and dashes become dots, runs of dots one; ohm with any end before .m is ohm.m."""
    dotted = F.regexp_replace(F.translate(F.lower(F.trim(F.coalesce(unit, F.lit("")))), " -", ".."), r"\.{2,}", ".")
    return F.when(dotted.rlike(r"^ohm[a-z]*\.?m$"), "ohm.m").otherwise(dotted)


def normalize_id(raw: Column, prefix: str) -> Column:
    """Slashes become underscores, trailing non-word characters go, the prefix is put where it lacks."""
    plain = F.regexp_replace(F.replace(raw, F.lit("/"), F.lit("_")), r"[^A-Za-z0-9_]+$", "")
    return F.when(plain == "", None).when(F.startswith(plain, F.lit(prefix)), plain).otherwise(F.concat(F.lit(prefix), plain))


def attribute(text: Column, name: str) -> Column:
    """The value of `- name: v`, `name: v` or `[NAME] v` lines, first form that is there, any case."""
    part = lambda pattern: missing(F.trim(F.regexp_extract(text, pattern, 1)))
    return F.coalesce(part(rf"(?im)^\s*-\s*{name}\s*:\s*([^\n]+)"), part(rf"(?im)^\s*{name}\s*:\s*([^\n]+)"), part(rf"(?i)\[{name}\]\s*([^\n\[]+)"))


def year(text: Column) -> Column:
    return missing(F.regexp_extract(text, "(?:19|20)[0-9]{2}", 0)).try_cast("int")


def fingerprint(text: Column) -> Column:
    """md5 of the trimmed, lower-cased text with each run of white space as one space."""
    return F.md5(F.regexp_replace(F.lower(F.trim(text)), r"\s+", " "))


def state(place: Column) -> Column:
    """The US state of a place: by abbreviation as a word of the upper-cased text, in the table's order, else by name."""
    upper = F.upper(place)
    short = [F.when(upper.rlike(rf"\b{a}\b"), n) for a, n in rules.STATES.items()]
    return F.coalesce(*short, *[F.when(F.contains(upper, F.lit(n.upper())), n) for n in rules.STATES.values()])


def city(place: Column) -> Column:
    """The city of a place: what stands after the last NEAR, AT or the like and before a comma with two letters, without words
    of direction and of water; null where nothing is left."""
    plain = F.regexp_replace(F.upper(F.trim(place)), r"\([^)]*\)", "")
    before = F.regexp_replace(plain, r"(?s),\s*[A-Z]{2}\b.*$", "")
    last = F.element_at(F.split(before, rf"\b(?:{'|'.join(rules.PLACE_SPLITS)})\b"), -1)
    words = F.filter(F.split(F.replace(last, F.lit("-"), F.lit(" ")), r"\s+"), lambda w: ~w.isin("", *rules.DIRECTIONS, *rules.PLACE_FEATURES))
    return missing(F.initcap(F.array_join(words, " ")))


def joined_values(values: Column) -> Column:
    """One value as it is, up to five with commas, more as their number and the first five."""
    n = F.size(values)
    five = F.array_join(F.slice(values, 1, 5), ", ")
    return F.when(n == 0, None).when(n <= 5, five).otherwise(F.format_string("%d values: %s", n, five))


def match_score(kind: Column, actual: Column, expected: Column) -> Column:
    """Confidence of an answer by match type: exact, approximate (5 % of the expected number, 0.01 about 0), contains, or
    contains_all (share of the comma parts)."""
    a, e = F.lower(F.trim(actual)), F.lower(F.trim(expected))
    x, y = first_number(actual), first_number(expected)
    tolerance = F.when(y == 0, 0.01).otherwise(F.abs(y) * 0.05)
    close = F.when(F.abs(x - y) <= tolerance, 1 - F.abs(x - y) / tolerance).otherwise(0.0)
    parts = F.filter(F.transform(F.split(e, ","), lambda p: F.trim(p)), lambda p: p != "")
    share = F.when(F.size(parts) == 0, 1.0).otherwise(F.size(F.filter(parts, lambda p: F.contains(a, p))) / F.size(parts))
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    return F.when(kind == "exact", yes(a == e)).when(kind == "approximate", F.coalesce(close, F.lit(0.0))).when(kind == "contains", yes(F.contains(a, e))).otherwise(share)
