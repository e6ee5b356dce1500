"""Aggregations over retrieved documents: counts, lists, extremes with string fallback, groups, categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.functions import text as T


def count_entities(docs: DataFrame, kind: str | None = None) -> DataFrame:
    chosen = F.count("*") if kind is None else F.count_if(F.coalesce(F.col("type") == kind, F.lit(False)))
    return docs.agg(chosen.alias("n"))


def count_with_total(docs: DataFrame, filtered: Column, total: int | None, filter_applied: bool) -> DataFrame:
    """A total known beforehand stands unless a filter was applied."""
    found = F.count_if(F.coalesce(filtered, F.lit(False)))
    return docs.agg((found if filter_applied or total is None else F.lit(total).cast("long")).alias("n"))


def distinct_values(docs: DataFrame, field: Column, limit: int = 20) -> DataFrame:
    """The first values in order, and how many there are after the cut (`listed`)."""
    return docs.select(T.missing(field.cast("string")).alias("value")).where("value is not null").distinct().orderBy("value").limit(limit)


def extreme(docs: DataFrame, field: Column, largest: bool = True) -> DataFrame:
    """The largest (smallest) number, as text without a zero fraction; only where no value is numeric, the string extreme."""
    values = docs.select(T.missing(field.cast("string")).alias("s")).withColumn("n", T.numeric(F.col("s")))
    pick = F.max if largest else F.min
    n = pick("n")
    number = F.when(n == F.floor(n), n.cast("long").cast("string")).otherwise(n.cast("string"))
    return values.agg(F.coalesce(number, pick("s")).alias("value"))


def total(docs: DataFrame, field: Column) -> DataFrame:
    return docs.agg(F.round(F.coalesce(F.sum(T.numeric(field.cast("string"))), F.lit(0.0)), 4).alias("total"))


def span(docs: DataFrame, field: Column, inclusive: bool = False) -> DataFrame:
    """Least, largest and their difference, one more where both years count; no row without a number."""
    n = docs.select(T.numeric(field.cast("string")).alias("n"))
    width = F.round(F.max("n") - F.min("n") + (1 if inclusive else 0), 3)
    return n.agg(F.min("n").alias("low"), F.max("n").alias("high"), width.alias("span")).where("low is not null")


def group_counts(docs: DataFrame, field: Column, order: Column) -> DataFrame:
    """(key, n, first): rows of each key, null left out; `first` is the order of its first row, for ties."""
    return docs.select(field.cast("string").alias("key"), order.alias("at")).where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("at").alias("first"))


def top_group(groups: DataFrame) -> DataFrame:
    """The largest group, the first to appear on ties; a row (null, 0) without groups."""
    return groups.agg(F.max_by("key", F.struct("n", -F.col("first"))).alias("key"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))


def summary_of_counts(counts: DataFrame) -> DataFrame:
    zero = F.lit(0)
    return counts.agg(F.count("*").alias("parents"), F.coalesce(F.min("n"), zero).alias("least"), F.coalesce(F.max("n"), zero).alias("most"), F.coalesce(F.round(F.avg("n"), 2), F.lit(0.0)).alias("average"))


def state_match(states: list[str], *fields: Column) -> Column:
    """Any of the names as a substring of the joined location fields."""
    place = F.lower(F.concat_ws(" ", *fields))
    return F.exists(F.array(*[F.lit(s.lower()) for s in states]), lambda s: F.contains(place, s))


def count_answer(n: Column, label: Column, states: Column) -> Column:
    """`There are 3 orders in A, B.`: is and are, the plural, the states where there are any."""
    noun = F.when(n == 1, label).otherwise(F.concat(label, F.lit("s")))
    place = F.when(F.size(states) > 0, F.concat(F.lit(" in "), F.array_join(states, ", "))).otherwise(F.lit(""))
    return F.concat(F.when(n == 1, "There is ").otherwise("There are "), n.cast("string"), F.lit(" "), noun, place, F.lit("."))


def ordered_codes(codes: Column, preferred: list[str]) -> Column:
    """Distinct upper-cased trimmed codes, the preferred ones first in their order, then by name."""
    clean = F.array_distinct(F.filter(F.transform(codes, lambda c: F.upper(F.trim(c))), lambda c: c != ""))
    places = F.array(*map(F.lit, preferred))
    place = lambda c: F.when(F.array_position(places, c) > 0, F.array_position(places, c)).otherwise(F.lit(999))
    return F.transform(F.array_sort(F.transform(clean, lambda c: F.struct(place(c).alias("p"), c.alias("c")))), lambda x: x["c"])


def category_lists(rows: DataFrame, key: str, code: str, categories: dict[str, list[str]], limit: int = 10) -> DataFrame:
    """(key, one array a category): a key's distinct codes in each category, in the category's own order."""
    held = rows.groupBy(key).agg(F.collect_set(code).alias("held"))
    return held.select(key, *[F.array_join(F.slice(F.array_intersect(F.array(*map(F.lit, codes)), F.col("held")), 1, limit), ",").alias(name) for name, codes in categories.items()])


def category_share(part: Column, whole: Column) -> Column:
    """Percent, halves to the even number."""
    return F.coalesce(F.bround(100 * part / F.nullif(whole, F.lit(0))), F.lit(0.0)).cast("long")


def first_holders(held: DataFrame, code: str, parent: str, child: str) -> DataFrame:
    """(code, holder, others, first_child): for each code the first parent that holds it, how many others do, and the first child
    that has it; null codes are left out. Distinct parents are summed up before the last shuffle."""
    pairs = held.where(F.col(code).isNotNull()).groupBy(code, parent).agg(F.min(child).alias("child_"))
    return pairs.groupBy(code).agg(F.min(parent).alias("holder"), (F.count("*") - 1).alias("others"), F.min("child_").alias("first_child"))
