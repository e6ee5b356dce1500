"""What a well's codes make possible: groups of codes, basin, suite, setting and capabilities as answers (A3, A12, A16-A20, A22-A24, A27)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.functions import text as T

#: The names of the groups, each group's wording in answers, and what is said where nothing else can be.
GROUPS = ["depth", "resistivity", "porosity", "lithology"]
WORDING = {"depth": "depth control", "resistivity": "resistivity logs", "porosity": "porosity logs", "lithology": "lithofacies interpretation"}
NO_SUITE = "standard FORCE 2020 open-hole suite"
NO_PLACE = "part of the FORCE 2020 Norwegian Continental Shelf release"
NO_CURVES = "standard open-hole measurements"
NO_ANALYSIS, NO_LIMIT = "basic well-log quality control only", "None noted"
COVERAGE = {"reservoir": "porosity and resistivity coverage for reservoir evaluation", "lithology": "lithofacies logs for depositional context"}
NEEDS = {"saturation": "saturation analysis (needs both porosity and resistivity curves)", "lithology": "lithofacies interpretation (requires lithology curves)"}
EVALUATION = "Yes - the curve suite supports a complete petrophysical evaluation."
USES = {"resistivity": "to spot hydrocarbon-bearing zones", "porosity": "to confirm density-neutron crossover"}


def held_codes(rows: DataFrame, well: str, code: str) -> DataFrame:
    """(well, codes): each well's distinct codes, summed up before the shuffle; bounded by the number of codes there are."""
    return rows.groupBy(well).agg(F.array_sort(F.collect_set(F.upper(F.trim(code)))).alias("codes"))


def groups(codes: Column, sets: dict[str, list[str]]) -> dict[str, Column]:
    """The codes of each group, in the order of the codes; a group without a set is empty."""
    among = lambda name: F.array(*map(F.lit, sets.get(name, []))).cast("array<string>")
    return {name: _within(codes, among(name)) for name in GROUPS}


def _within(codes: Column, listed: Column) -> Column:
    return F.filter(codes, lambda c: F.array_contains(listed, c))


def _has(group: Column) -> Column:
    return F.coalesce(F.size(group) > 0, F.lit(False))


def _named(words: str, group: Column) -> Column:
    return F.when(_has(group), F.concat(F.lit(f"{words} ("), F.array_join(group, ", "), F.lit(")")))


def basin(well: Column, uwi: Column) -> Column:
    """By the well's name, else by its block; null without a name where the block doesn't tell."""
    name, block = F.lower(F.trim(F.coalesce(well, F.lit("")))), F.trim(F.coalesce(uwi, F.lit("")))
    return (
        F.when(F.contains(name, F.lit("sleipner")), "Sleipner area of the Norwegian North Sea")
        .when(F.startswith(block, F.lit("15/")), F.concat(F.lit("Norwegian North Sea (block "), F.substring_index(block, "-", 1), F.lit(")")))
        .when(name != "", "Norwegian Continental Shelf")
    )


def suite_answer(held: dict[str, Column], well: Column, uwi: Column, well_id: Column) -> Column:
    """The suite's parts and the area it is typical of (A19)."""
    parts = F.concat_ws("; ", *[_named(WORDING[g], held[g]) for g in ("depth", "porosity", "resistivity", "lithology")])
    area, block = basin(well, uwi), T.missing(uwi)
    place = F.coalesce(
        F.concat(F.lit(" This suite is typical of the "), area, F.lit(".")),
        F.concat(F.lit(" This suite is typical of Norwegian Continental Shelf block "), block, F.lit(".")),
        F.lit(""),
    )
    name = F.coalesce(T.missing(well), F.concat(F.lit("well "), well_id))
    return F.concat(name, F.lit(" log suite classification: "), F.coalesce(T.missing(parts), F.lit(NO_SUITE)), F.lit("."), place)


def setting_answer(held: dict[str, Column], well: Column, uwi: Column) -> Column:
    """Where a well lies and what its codes tell of it (A19)."""
    area, name = basin(well, uwi), T.missing(well)
    block = F.when(area.isNotNull() | name.isNotNull(), F.concat(F.lit("block "), T.missing(uwi)))
    where = F.concat_ws("; ", F.concat(F.lit("located in the "), area), F.concat(F.lit("well name "), name), block)
    support = F.concat_ws(", ", F.when(_has(held["porosity"]) & _has(held["resistivity"]), COVERAGE["reservoir"]), F.when(_has(held["lithology"]), COVERAGE["lithology"]))
    said = lambda text, otherwise: F.coalesce(T.missing(text), F.lit(otherwise))
    return F.concat(F.lit("Geological setting: "), said(where, NO_PLACE), F.lit(". Curve support includes "), said(support, NO_CURVES), F.lit("."))


def capability_answer(held: dict[str, Column]) -> Column:
    """What can and can't be done with the codes (A18)."""
    saturation = _has(held["porosity"]) & _has(held["resistivity"])
    with_both = F.concat(F.lit("saturation analysis ("), F.array_join(held["resistivity"], ", "), F.lit(" with "), F.array_join(held["porosity"], ", "), F.lit(")"))
    can = F.concat_ws("; ", F.when(saturation, with_both), _named("lithology interpretation", held["lithology"]), _named(WORDING["depth"], held["depth"]))
    cannot = F.concat_ws("; ", F.when(~saturation, NEEDS["saturation"]), F.when(~_has(held["lithology"]), NEEDS["lithology"]))
    return F.concat(F.lit("Possible: "), F.coalesce(T.missing(can), F.lit(NO_ANALYSIS)), F.lit(". Impossible: "), F.coalesce(T.missing(cannot), F.lit(NO_LIMIT)), F.lit("."))


def evaluation_answer(held: dict[str, Column]) -> Column:
    parts = T.missing(F.concat_ws("; ", *[_named(WORDING[g], held[g]) for g in ("resistivity", "porosity", "depth")]))
    rock = F.when(_has(held["lithology"]), F.concat(F.lit("Lithology coverage comes from "), F.array_join(held["lithology"], ", "), F.lit(".")))
    return F.concat_ws(" ", F.lit(EVALUATION), F.concat(F.lit("It includes "), parts, F.lit(" for interpretation.")), rock)


def hydrocarbon_answer(held: dict[str, Column]) -> Column:
    """Null where there is neither a resistivity nor a porosity code."""
    use = F.concat_ws(" and ", *[F.concat(_named(WORDING[g], held[g]), F.lit(f" {USES[g]}")) for g in ("resistivity", "porosity")])
    return F.concat(F.lit("Use "), T.missing(use), F.lit("."))


def distinct_codes(rows: DataFrame, code: Column) -> DataFrame:
    """(n, codes): the distinct upper-cased codes but NONE, sorted (A3)."""
    found = rows.select(F.upper(F.trim(code)).alias("c")).where("c <> '' and c <> 'NONE'").distinct()
    return found.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("c")), ",").alias("codes"))


def parent_of(text: Column, *fields: Column) -> Column:
    """A child's parent: the first of its fields, else the tag in its text (A12)."""
    return T.first_field(*fields, F.regexp_extract(text, r"\[BELONGS_TO_WELL\]\s*(\S+)", 1))


def children_per_parent(rows: DataFrame, parent: Column) -> DataFrame:
    """(parent, n); children without a parent are left out (A12, A27)."""
    return rows.select(parent.alias("parent")).where("parent is not null").groupBy("parent").agg(F.count("*").alias("n"))


def with_unit(rows: DataFrame, unit: Column, wanted: str = "ohm.m") -> DataFrame:
    """The rows whose normalised unit is the wanted one (A20)."""
    return rows.where(T.normalize_unit(unit) == wanted)


def has_all(rows: DataFrame, well: str, code: str, wanted: list[str]) -> DataFrame:
    """(well,) of those that hold every wanted code (A22)."""
    held = rows.where(F.col(code).isin(wanted)).groupBy(well).agg(F.count_distinct(code).alias("n"))
    return held.where(F.col("n") == len(set(wanted))).select(well)


def codes_except(rows: DataFrame, well: str, code: str, but: list[str], limit: int = 10) -> DataFrame:
    """(well, codes): the first codes by name but the given ones (A23)."""
    rest = rows.where(~F.col(code).isin(but)).groupBy(well).agg(F.collect_set(code).alias("c"))
    return rest.select(well, F.array_join(F.slice(F.array_sort("c"), 1, limit), ",").alias("codes"))


def underscore_count(rows: DataFrame, code: Column) -> DataFrame:
    """(n,): distinct standard codes, of up to 8 characters and not of the release's own, that hold an underscore (A24)."""
    standard = F.contains("code", F.lit("_")) & (F.length("code") <= 8) & ~F.startswith("code", F.lit("FORCE_2020"))
    return rows.select(code.alias("code")).distinct().agg(F.count_if(standard).alias("n"))
