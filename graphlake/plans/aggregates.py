"""Queries of the aggregation operators."""

from pyspark.sql import functions as F

from graphlake.functions import text as T
from graphlake.operators import aggregate as A
from graphlake.operators import bitmap_index as B
from graphlake.operators import wells as W
from graphlake.plans.base import NODES, folder, nodes, query, read


@query(f"WITH {NODES} SELECT count(*) AS n FROM nodes WHERE type = 'las_curve'")
def q_count_entities(spark, sf):
    return A.count_entities(nodes(spark, sf), "las_curve")


@query("SELECT count(*) AS n FROM documents WHERE lang = 'fr' AND source = 'src0'")
def q_count_filtered(spark, sf):
    """A filter was applied, so the total known beforehand doesn't stand."""
    return A.count_with_total(read(spark, sf, "documents"), (F.col("lang") == "fr") & (F.col("source") == "src0"), 10_000, True)


@query("SELECT count(DISTINCT upper(p_brand)) AS n, string_agg(DISTINCT upper(p_brand), ',' ORDER BY upper(p_brand)) AS codes FROM part WHERE upper(p_brand) <> 'NONE'")
def q_count_distinct(spark, sf):
    return W.distinct_codes(read(spark, sf, "part"), F.col("p_brand"))


@query("SELECT DISTINCT nullif(p_name, '') AS value FROM part WHERE p_name IS NOT NULL AND p_name <> '' ORDER BY 1 LIMIT 20")
def q_distinct_top20(spark, sf):
    return A.distinct_values(read(spark, sf, "part"), F.col("p_name"), 20)


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END, 'none') AS value FROM orders")
def q_field_coalesce(spark, sf):
    """The first container that has a value: missing ones are empty strings here."""
    blank = lambda c, missing: F.when(F.col(c) == missing, "").otherwise(F.col(c))
    value = T.first_field(blank("o_orderstatus", "O"), blank("o_orderpriority", "5-LOW"), F.lit("none"))
    return read(spark, sf, "orders").select("o_orderkey", value.alias("value"))


_NUMERIC = r"regexp_matches({0}, '^[ ]*[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?[ ]*$')"
_MIXED = "CASE WHEN event_id % 7 = 0 THEN event_type WHEN event_id % 7 = 1 THEN ' ' || CAST(user_id AS VARCHAR) || 'd' WHEN event_id % 7 = 2 THEN '' ELSE ' ' || CAST(user_id AS VARCHAR) || ' ' END"


def _mixed():
    e, user = F.col("event_id") % 7, F.col("user_id").cast("string")
    return F.when(e == 0, F.col("event_type")).when(e == 1, F.concat(F.lit(" "), user, F.lit("d"))).when(e == 2, "").otherwise(F.concat(F.lit(" "), user, F.lit(" ")))


@query(f"WITH m AS (SELECT event_id, {_MIXED} AS s FROM events) SELECT event_id, CASE WHEN {_NUMERIC.format('s')} THEN CAST(trim(s) AS DOUBLE) END AS n FROM m")
def q_coerce_numeric(spark, sf):
    return read(spark, sf, "events").select("event_id", T.numeric(_mixed()).alias("n"))


def _extreme_sql(f: str) -> str:
    return f"""WITH m AS (SELECT nullif({_MIXED}, '') AS s FROM events), n AS (SELECT s, CASE WHEN {_NUMERIC.format('s')} THEN CAST(trim(s) AS DOUBLE) END AS n FROM m)
    SELECT coalesce(CAST(CAST({f}(n) AS BIGINT) AS VARCHAR), {f}(s)) AS value FROM n"""


@query(_extreme_sql("max"))
def q_max_field(spark, sf):
    return A.extreme(read(spark, sf, "events"), _mixed(), True)


@query(_extreme_sql("min"))
def q_min_field(spark, sf):
    return A.extreme(read(spark, sf, "events"), _mixed(), False)


@query("SELECT min(c_name) AS value FROM customer")
def q_min_field_strings(spark, sf):
    """Without a number among the values, their string order holds."""
    return A.extreme(read(spark, sf, "customer"), F.col("c_name"), False)


@query("SELECT round(sum(CAST(p_size AS DOUBLE)), 4) AS total FROM part")
def q_sum_field(spark, sf):
    return A.total(read(spark, sf, "part"), F.col("p_size"))


@query("SELECT CAST(min(year(o_orderdate)) AS DOUBLE) AS low, CAST(max(year(o_orderdate)) AS DOUBLE) AS high, CAST(max(year(o_orderdate)) - min(year(o_orderdate)) + 1 AS DOUBLE) AS span FROM orders")
def q_range_years(spark, sf):
    return A.span(read(spark, sf, "orders"), F.year("o_orderdate"), True)


@query("SELECT p_type AS key, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY p_type")
def q_group_count(spark, sf):
    return A.group_counts(read(spark, sf, "part"), F.col("p_type"), F.col("p_partkey"))


@query("SELECT p_brand AS key, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, min(p_partkey) LIMIT 1")
def q_top_group(spark, sf):
    return A.top_group(A.group_counts(read(spark, sf, "part"), F.col("p_brand"), F.col("p_partkey")))


@query("SELECT 'customer-' || o_custkey AS parent, count(*) AS n FROM orders GROUP BY o_custkey")
def q_children_per_parent(spark, sf):
    return _children(spark, sf)


def _children(spark, sf):
    """Children of each parent, the parent taken from the tag in the child's text."""
    tag = F.concat(F.lit("LAS_CURVE [BELONGS_TO_WELL] customer-"), F.col("o_custkey").cast("string"), F.lit(" [UNIT] x"))
    return W.children_per_parent(read(spark, sf, "orders"), W.parent_of(tag))


@query("WITH c AS (SELECT count(*) AS n FROM orders GROUP BY o_custkey) SELECT count(*) AS parents, min(n) AS least, max(n) AS most, round(avg(n), 2) AS average FROM c")
def q_children_summary(spark, sf):
    return A.summary_of_counts(_children(spark, sf))


@query("SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE lower(n_name) LIKE '%nation_1%' OR contains(lower(n_name), 'nation_7')")
def q_state_filter(spark, sf):
    """Any of the names inside the location; NATION_1 also matches NATION_10."""
    placed = read(spark, sf, "supplier").join(read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return placed.where(A.state_match(["NATION_1", "NATION_7"], F.col("n_name"))).select("s_suppkey")


@query("""SELECT c_nationkey, CASE WHEN count(*) = 1 THEN 'There is ' ELSE 'There are ' END || count(*) || ' customer' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END || ' in ' || any_value(n_name) || '.' AS answer
    FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_nationkey""")
def q_answer_text(spark, sf):
    counts = read(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    named = counts.join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select("c_nationkey", A.count_answer(F.col("n"), F.lit("customer"), F.array("n_name")).alias("answer"))


#: Categories of part types, each in its own order.
CATEGORIES = {"depth": ["STANDARD", "SMALL"], "porosity": ["MEDIUM", "LARGE"], "lithology": ["ECONOMY", "PROMO"]}
_PARTS = "o AS (SELECT l_orderkey, p_type FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _order_parts(spark, sf):
    return read(spark, sf, "lineitem").join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_type", "p_name")


def _category_sql(name: str) -> str:
    listed = ", ".join(f"CASE WHEN bool_or(p_type = '{c}') THEN '{c}' END" for c in CATEGORIES[name])
    return f"array_to_string(list_filter([{listed}], lambda x: x IS NOT NULL), ',') AS {name}"


@query(f"WITH {_PARTS} SELECT l_orderkey, {', '.join(map(_category_sql, CATEGORIES))} FROM o GROUP BY l_orderkey")
def q_category_pivot(spark, sf):
    return A.category_lists(_order_parts(spark, sf), "l_orderkey", "p_type", CATEGORIES)


@query(f"""WITH {_PARTS}, d AS (SELECT DISTINCT l_orderkey, p_type, CASE p_type WHEN 'PROMO' THEN 1 WHEN 'LARGE' THEN 2 ELSE 999 END AS p FROM o)
    SELECT l_orderkey, string_agg(p_type, ',' ORDER BY p, p_type) AS codes FROM d GROUP BY l_orderkey""")
def q_ordered_codes(spark, sf):
    """Preferred codes first, the rest by name."""
    held = _order_parts(spark, sf).groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit(" "), F.lower("p_type"))).alias("c"))
    return held.select("l_orderkey", F.array_join(A.ordered_codes(F.col("c"), ["PROMO", "LARGE"]), ",").alias("codes"))


def _flags(rows, key):
    held = {n: F.bool_or(F.col("p_type").isin(c)).alias(n) for n, c in CATEGORIES.items()}
    return rows.groupBy(key).agg(*held.values()).withColumn("saturation", F.col("porosity") & F.col("depth"))


_FLAGS_SQL = ", ".join(f"bool_or(p_type IN ({', '.join(map(repr, c))})) AS {n}" for n, c in CATEGORIES.items())


@query(f"WITH {_PARTS}, f AS (SELECT l_orderkey, {_FLAGS_SQL} FROM o GROUP BY l_orderkey) SELECT *, porosity AND depth AS saturation FROM f")
def q_capability_flags(spark, sf):
    """What each order's categories make possible; saturation needs two of them."""
    return _flags(_order_parts(spark, sf), "l_orderkey")


@query(f"""WITH {_PARTS}, f AS (SELECT l_orderkey, {_FLAGS_SQL} FROM o GROUP BY l_orderkey)
    SELECT l_orderkey, CASE WHEN depth AND porosity AND lithology THEN 'full' WHEN depth AND porosity THEN 'basic' ELSE 'partial' END AS suite,
    concat_ws('; ', CASE WHEN depth THEN 'depth' END, CASE WHEN porosity THEN 'porosity' END, CASE WHEN lithology THEN 'lithology' END) AS components FROM f""")
def q_suite_summary(spark, sf):
    flags = _flags(_order_parts(spark, sf), "l_orderkey")
    suite = F.when(F.expr("depth and porosity and lithology"), "full").when(F.expr("depth and porosity"), "basic").otherwise("partial")
    return flags.select("l_orderkey", suite.alias("suite"), F.concat_ws("; ", *[F.when(F.col(n), n) for n in CATEGORIES]).alias("components"))


_UNITS = ["Ohm-m", "ohm m", "OHMM", "g/cm3", "ohm..m", ""]


@query("SELECT p_brand, count(*) AS n FROM part WHERE p_size % 6 IN (0, 1, 2, 4) GROUP BY p_brand")
def q_unit_filter(spark, sf):
    """Brands of parts whose unit, spelt in several ways, is ohm.m."""
    unit = F.element_at(F.array(*map(F.lit, _UNITS)), (F.col("p_size") % 6 + 1).cast("int"))
    return W.with_unit(read(spark, sf, "part"), unit).groupBy("p_brand").agg(F.count("*").alias("n"))


@query(f"""WITH {_PARTS} SELECT l_orderkey, CAST(round_even(100.0 * count(DISTINCT p_type) FILTER (p_type IN ('MEDIUM', 'LARGE')) / count(DISTINCT p_type), 0) AS BIGINT) AS share FROM o GROUP BY l_orderkey""")
def q_category_share(spark, sf):
    distinct = _order_parts(spark, sf).select("l_orderkey", "p_type").distinct().groupBy("l_orderkey")
    counts = distinct.agg(F.count_if(F.col("p_type").isin(CATEGORIES["porosity"])).alias("part"), F.count("*").alias("whole"))
    return counts.select("l_orderkey", A.category_share(F.col("part"), F.col("whole")).alias("share"))


@query(f"WITH {_PARTS} SELECT l_orderkey FROM o WHERE p_type IN ('SMALL', 'PROMO') GROUP BY l_orderkey HAVING count(DISTINCT p_type) = 2")
def q_has_all(spark, sf):
    """Orders that have every wanted type (relational division)."""
    return W.has_all(_order_parts(spark, sf), "l_orderkey", "p_type", ["SMALL", "PROMO"])


def _bitmaps(spark, sf):
    return B.build(_order_parts(spark, sf).select(F.col("p_type").alias("term"), F.col("l_orderkey").alias("member")), folder(spark, "bitmaps"))


@query(f"WITH {_PARTS} SELECT l_orderkey FROM o WHERE p_type IN ('SMALL', 'PROMO') GROUP BY l_orderkey HAVING count(DISTINCT p_type) = 2")
def q_has_all_bitmaps(spark, sf):
    """The same by an AND of the types' stored bitmaps."""
    index = _bitmaps(spark, sf)
    wanted = spark.createDataFrame([(1, "SMALL"), (1, "PROMO")], "query_id int, term string")  # the two that are asked for
    return B.with_all(index, wanted).select(F.col("member").alias("l_orderkey"))


@query(f"WITH {_PARTS}, d AS (SELECT DISTINCT l_orderkey, p_type FROM o WHERE p_type NOT IN ('SMALL', 'PROMO', 'LARGE')) SELECT l_orderkey, array_to_string(list(p_type ORDER BY p_type)[1:10], ',') AS codes FROM d GROUP BY l_orderkey")
def q_codes_except(spark, sf):
    return W.codes_except(_order_parts(spark, sf), "l_orderkey", "p_type", ["SMALL", "PROMO", "LARGE"])


@query(f"WITH {_PARTS}, d AS (SELECT DISTINCT l_orderkey, p_type FROM o WHERE p_type NOT IN ('SMALL', 'PROMO', 'LARGE')) SELECT l_orderkey, array_to_string(list(p_type ORDER BY p_type)[1:10], ',') AS codes FROM d GROUP BY l_orderkey")
def q_codes_except_bitmaps(spark, sf):
    """The same from the stored bitmaps of the other types."""
    rest = B.terms_but(_bitmaps(spark, sf), ["SMALL", "PROMO", "LARGE"])
    return rest.groupBy(F.col("member").alias("l_orderkey")).agg(F.array_join(F.slice(F.array_sort(F.collect_list("term")), 1, 10), ",").alias("codes"))


@query(f"WITH {_PARTS} SELECT l_orderkey FROM o GROUP BY l_orderkey HAVING bool_or(p_type = 'SMALL') AND NOT bool_or(p_type IN ('PROMO', 'LARGE'))")
def q_has_but_bitmaps(spark, sf):
    """Orders with one type and without two others: AND NOT of the stored bitmaps."""
    asked = spark.createDataFrame([(1, "SMALL")], "query_id int, term string")
    but = spark.createDataFrame([(1, "PROMO"), (1, "LARGE")], "query_id int, term string")
    return B.with_all_but(_bitmaps(spark, sf), asked, but).select(F.col("member").alias("l_orderkey"))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT replace(p_name, ' ', '_') AS code FROM part) WHERE contains(code, '_') AND length(code) <= 8")
def q_pattern_count(spark, sf):
    return W.underscore_count(read(spark, sf, "part"), F.replace("p_name", F.lit(" "), F.lit("_")))


@query("""SELECT p_name AS code, min(l_orderkey) AS holder, count(DISTINCT l_orderkey) - 1 AS others, min(p_partkey) AS first_child FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name""")
def q_code_lookup(spark, sf):
    """The first order that holds a code, how many others do, and the first part that has it."""
    lines, parts = read(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), read(spark, sf, "part").select("p_partkey", F.col("p_name").alias("code"))
    return A.first_holders(lines.join(parts, F.col("l_partkey") == F.col("p_partkey")), "code", "l_orderkey", "p_partkey")


#: Part types as codes of the four groups.
CURVES = {"depth": ["STANDARD"], "resistivity": ["SMALL"], "porosity": ["MEDIUM", "LARGE"], "lithology": ["ECONOMY", "PROMO"]}


def _curves_sql(name: str) -> str:
    return f"array_to_string(list(DISTINCT p_type ORDER BY p_type) FILTER (p_type IN ({', '.join(map(repr, CURVES[name]))})), ', ') AS {name}"


def _wells(spark, sf):
    """(well_id, well, uwi, codes) of each order: its customer's name but for those of segment BUILDING, and a block from its keys but
    for every third customer."""
    codes = W.held_codes(_order_parts(spark, sf), "l_orderkey", "p_type")
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    block = F.when(customer % 3 != 0, F.concat((customer % 5 + 12).cast("string"), F.lit("/"), (key % 12).cast("string"), F.lit("-"), (key % 7).cast("string")))
    orders = read(spark, sf, "orders").select("o_orderkey", "o_custkey", block.alias("uwi"))
    named = read(spark, sf, "customer").select("c_custkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_name")).alias("well"))
    joined = codes.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(named, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col("o_orderkey").cast("string").alias("well_id"), "well", "uwi", "codes")


_WELLS = f"""{_PARTS}, g AS (SELECT l_orderkey, {', '.join(map(_curves_sql, CURVES))} FROM o GROUP BY l_orderkey),
    b AS (SELECT CAST(o_orderkey AS VARCHAR) AS well_id, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_name END AS well,
        CASE WHEN o_custkey % 3 <> 0 THEN (o_custkey % 5 + 12) || '/' || (o_orderkey % 12) || '-' || (o_orderkey % 7) END AS uwi, g.*
        FROM g JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
    w AS (SELECT *, CASE WHEN uwi LIKE '15/%' THEN 'Norwegian North Sea (block ' || split_part(uwi, '-', 1) || ')' WHEN well IS NOT NULL THEN 'Norwegian Continental Shelf' END AS basin FROM b)"""


@query(f"""WITH {_WELLS} SELECT well_id,
    coalesce(well, 'well ' || well_id) || ' log suite classification: ' || coalesce(nullif(concat_ws('; ', 'depth control (' || depth || ')', 'porosity logs (' || porosity || ')',
        'resistivity logs (' || resistivity || ')', 'lithofacies interpretation (' || lithology || ')'), ''), 'standard FORCE 2020 open-hole suite') || '.'
        || coalesce(' This suite is typical of the ' || basin || '.', ' This suite is typical of Norwegian Continental Shelf block ' || uwi || '.', '') AS suite,
    'Geological setting: ' || CASE WHEN basin IS NULL AND well IS NULL THEN 'part of the FORCE 2020 Norwegian Continental Shelf release'
        ELSE concat_ws('; ', 'located in the ' || basin, 'well name ' || well, 'block ' || uwi) END || '. Curve support includes '
        || coalesce(nullif(concat_ws(', ', CASE WHEN porosity <> '' AND resistivity <> '' THEN 'porosity and resistivity coverage for reservoir evaluation' END,
            CASE WHEN lithology <> '' THEN 'lithofacies logs for depositional context' END), ''), 'standard open-hole measurements') || '.' AS setting FROM w""")
def q_suite_and_setting(spark, sf):
    """Each well's suite, basin and geological setting as answers."""
    wells = _wells(spark, sf)
    held = W.groups(F.col("codes"), CURVES)
    well, uwi = F.col("well"), F.col("uwi")
    return wells.select("well_id", W.suite_answer(held, well, uwi, F.col("well_id")).alias("suite"), W.setting_answer(held, well, uwi).alias("setting"))


@query(f"""WITH {_WELLS} SELECT well_id,
    'Possible: ' || coalesce(nullif(concat_ws('; ', 'saturation analysis (' || resistivity || ' with ' || porosity || ')', 'lithology interpretation (' || lithology || ')', 'depth control (' || depth || ')'), ''),
        'basic well-log quality control only') || '. Impossible: '
        || coalesce(nullif(concat_ws('; ', CASE WHEN porosity IS NULL OR resistivity IS NULL THEN 'saturation analysis (needs both porosity and resistivity curves)' END,
            CASE WHEN lithology IS NULL THEN 'lithofacies interpretation (requires lithology curves)' END), ''), 'None noted') || '.' AS capability,
    concat_ws(' ', 'Yes - the curve suite supports a complete petrophysical evaluation.',
        'It includes ' || nullif(concat_ws('; ', 'resistivity logs (' || resistivity || ')', 'porosity logs (' || porosity || ')', 'depth control (' || depth || ')'), '') || ' for interpretation.',
        'Lithology coverage comes from ' || lithology || '.') AS evaluation,
    'Use ' || nullif(concat_ws(' and ', 'resistivity logs (' || resistivity || ') to spot hydrocarbon-bearing zones', 'porosity logs (' || porosity || ') to confirm density-neutron crossover'), '') || '.' AS hydrocarbon
    FROM w""")
def q_capability_answers(spark, sf):
    """What each well's codes allow: capabilities, evaluation, and the way to hydrocarbons where there is one."""
    held = W.groups(F.col("codes"), CURVES)
    return _wells(spark, sf).select("well_id", W.capability_answer(held).alias("capability"), W.evaluation_answer(held).alias("evaluation"), W.hydrocarbon_answer(held).alias("hydrocarbon"))
