"""Queries of the evaluation operators and the metric log."""

from pyspark.sql import functions as F

from graphlake.functions import text as T
from graphlake.operators import evaluate as E
from graphlake.operators import metrics as M
from graphlake.plans.base import ANSWERS, answers, query, read, stored, tokens_sql

_A, _E = tokens_sql("answer"), tokens_sql("expected")
_SHARE = f"CASE WHEN len({_A}) = 0 THEN 0.0 ELSE CAST(len(list_intersect({_A}, {_E})) AS DOUBLE) / len({_A}) END"
_WORDS = "list_filter(string_split(expected, ' ')[1:4], lambda w: w <> '')"
_FOUND = f"CASE WHEN len({_WORDS}) = 0 THEN 1.0 ELSE CAST(len(list_filter({_WORDS}, lambda w: contains(lower(answer), lower(w)))) AS DOUBLE) / len({_WORDS}) END"
_OVERLAP = f"CASE WHEN len({_A}) = 0 OR len({_E}) = 0 THEN 0.0 ELSE CAST(len(list_intersect({_A}, {_E})) AS DOUBLE) / greatest(len({_A}), len({_E})) END"


def _wanted():
    return F.filter(F.slice(F.split("expected", " "), 1, 4), lambda w: w != "")


@query(f"WITH {ANSWERS} SELECT query_id, round({_SHARE}, 6) AS faithfulness FROM answers")
def q_faithfulness(spark, sf):
    return answers(spark, sf, True).select("query_id", F.round(T.share_of("answer_words", "expected_words"), 6).alias("faithfulness"))


@query(f"WITH {ANSWERS} SELECT query_id, round({_FOUND}, 6) AS found FROM answers")
def q_context_precision(spark, sf):
    """Share of the expected entities (an item's first words) in the text."""
    return answers(spark, sf).select("query_id", F.round(E.share_found(F.col("answer"), _wanted()), 6).alias("found"))


@query(f"WITH {ANSWERS} SELECT query_id, round({_OVERLAP}, 6) AS recall FROM answers")
def q_context_recall(spark, sf):
    return answers(spark, sf, True).select("query_id", F.round(T.overlap_of("answer_words", "expected_words"), 6).alias("recall"))


@query(f"WITH {ANSWERS} SELECT query_id, array_to_string(list_filter({_WORDS}, lambda w: NOT contains(lower(answer), lower(w))), '|') AS missing FROM answers")
def q_keyword_missing(spark, sf):
    return answers(spark, sf).select("query_id", F.array_join(E.not_found(F.col("answer"), _wanted()), "|").alias("missing"))


def _scored(spark, sf):
    """The question is an item's first eight words, the entities its first four, the keywords the four after them."""
    words = F.split("expected", " ")
    some = lambda first, n: F.filter(F.slice(words, first, n), lambda w: w != "")
    rows = answers(spark, sf).select("query_id", "answer", "expected", F.array("context").alias("contexts"), F.array_join(F.slice(words, 1, 8), " ").alias("question"), some(1, 4).alias("entities"), some(5, 4).alias("keywords"))
    return E.answer_metrics(rows, "question", "answer", "contexts", "entities", "keywords", "expected")


def _inside(text, words):
    return f"CASE WHEN len({words}) = 0 THEN 1.0 ELSE CAST(len(list_filter({words}, lambda w: contains(lower({text}), lower(w)))) AS DOUBLE) / len({words}) END"


def _overlap(x, y):
    return f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 ELSE CAST(len(list_intersect({x}, {y})) AS DOUBLE) / greatest(len({x}), len({y})) END"


_METRICS = f"""{ANSWERS}, t AS (
    SELECT *, {tokens_sql("answer")} AS a, {tokens_sql("context")} AS c, {tokens_sql("expected")} AS e, {tokens_sql("array_to_string(string_split(expected, ' ')[1:8], ' ')")} AS q,
        list_filter(string_split(expected, ' ')[1:4], lambda w: w <> '') AS entities, list_filter(string_split(expected, ' ')[5:8], lambda w: w <> '') AS keywords FROM answers),
m AS (
    SELECT query_id, CASE WHEN len(a) = 0 THEN 0.0 ELSE CAST(len(list_intersect(a, c)) AS DOUBLE) / len(a) END AS f, {_overlap("q", "a")} AS r, {_inside("context", "entities")} AS p,
        {_inside("answer", "keywords")} AS k, CASE WHEN expected <> '' THEN {_overlap("c", "e")} END AS recall, CASE WHEN expected <> '' THEN {_overlap("a", "e")} END AS truth FROM t),
scored AS (
    SELECT query_id, round(f + 1e-9, 3) AS faithfulness, round(r + 1e-9, 3) AS answer_relevance, round(p + 1e-9, 3) AS context_precision, round(k + 1e-9, 3) AS keyword_score,
        round(recall + 1e-9, 3) AS context_recall, round(truth + 1e-9, 3) AS ground_truth_overlap, round(0.3::DOUBLE * f + 0.3::DOUBLE * r + 0.2::DOUBLE * p + 0.2::DOUBLE * k + 1e-9, 3) AS aggregate_score FROM m)"""


@query(f"WITH {_METRICS} SELECT * FROM scored")
def q_eval_score(spark, sf):
    return _scored(spark, sf).select("query_id", *E.METRICS)


_LEAST = "CASE metric WHEN 'aggregate_score' THEN 0.6 WHEN 'faithfulness' THEN 0.7 WHEN 'context_precision' THEN 0.6 WHEN 'success' THEN 1.0 END"
_OF_METRIC = " UNION ALL ".join(f"SELECT source, '{m}' AS metric, {m} AS value FROM s" for m in [*E.METRICS, "success"])


@query(f"""WITH {_METRICS}, s AS (SELECT scored.*, source, CAST(text IS NOT NULL AS INTEGER)::DOUBLE AS success FROM scored JOIN documents ON query_id = doc_id), u AS ({_OF_METRIC})
    SELECT coalesce(source, 'all') AS category, metric, count(value) AS n, round(avg(value), 6) AS mean, CASE WHEN {_LEAST} IS NULL THEN false WHEN avg(value) IS NULL THEN true ELSE round(avg(value), 6) < {_LEAST} END AS gate_failed
    FROM u GROUP BY GROUPING SETS ((source, metric), (metric))""")
def q_eval_rollup(spark, sf):
    """Means of every metric by category and over all, and the gates that fail."""
    source = read(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), "source", F.col("text").isNotNull().cast("double").alias("success"))
    return E.metric_means(_scored(spark, sf).join(source, "query_id"), "source", [*E.METRICS, "success"])


@query("""SELECT p_partkey, CAST(round(((CASE WHEN contains(p_name, 'small') AND contains(p_name, 'b') THEN 1 ELSE 0 END) + (CASE WHEN contains(p_name, 'hot') THEN 0 ELSE 1 END)
    + (CASE WHEN p_size BETWEEN 10 AND 20 THEN 1 ELSE 0 END)) / 3.0, 6) AS DOUBLE) AS score FROM part""")
def q_truth_checks(spark, sf):
    lit = lambda *x: F.array(*map(F.lit, x))
    score = E.truth_checks(F.col("p_name"), lit("Small", "b"), lit("hot", "zz"), F.col("p_size"), F.lit(10), F.lit(20))
    return read(spark, sf, "part").select("p_partkey", F.round(score, 6).alias("score"))


@query("""WITH c AS (SELECT p_partkey, string_split(p_name, ' ') AS got, contains(p_name, 'small') AND contains(p_name, 'b') AS must, contains(p_name, 'hot') AS bad, contains(p_name, CAST(p_size AS VARCHAR)) AS exact,
        p_size BETWEEN 10 AND 20 AS n, p_type IN ('SMALL', 'PROMO') AS kind FROM part),
    v AS (SELECT *, list_sort(list_filter(['small', 'hot'], lambda x: NOT list_contains(got, x))) AS missing, list_filter(got, lambda x: x NOT IN ('small', 'hot')) AS extra FROM c)
    SELECT p_partkey, array_to_string(list_filter(['small', 'hot'], lambda x: NOT list_contains(got, x)), ',') AS missing, CAST(len(list_distinct(extra)) AS INTEGER) AS n_extra,
        round((must::INTEGER + (NOT bad)::INTEGER + exact::INTEGER + n::INTEGER + kind::INTEGER + (len(missing) = 0 AND len(extra) = 0)::INTEGER) / 6.0::DOUBLE, 6) AS score FROM v""")
def q_truth_report(spark, sf):
    """All kinds of checks, with a part's name as the answer and its words as the values."""
    lit = lambda *x: F.array(*map(F.lit, x))
    report = E.truth_report(
        F.col("p_name"), lit("Small", "b"), lit("hot", "zz"), F.col("p_size").cast("string"), F.col("p_size"), F.lit(10), F.lit(20), F.lit("yes"),
        F.when(F.col("p_type").isin("SMALL", "PROMO"), lit("yes")).otherwise(lit("no")), lit("small", "hot"), F.split("p_name", " "),
    )
    held = read(spark, sf, "part").select("p_partkey", report.alias("r")).withColumn("v", F.get(F.filter("r", lambda c: c["check"] == "values"), F.lit(0)))
    return held.select("p_partkey", F.array_join("v.missing", ",").alias("missing"), F.size("v.extra").alias("n_extra"), F.round(E.truth_score(F.col("r")), 6).alias("score"))


def _runs(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    ok = F.col("event_type") != "error"
    return read(spark, sf, "events").select("event_id", (k % 5 + 1).alias("tier"), F.col("value").alias("latency"), ok.alias("success"), (ok & (k % 3 > 0)).alias("correct"))


_RUNS = "runs AS (SELECT event_id, CAST(props::json->>'k' AS INTEGER) % 5 + 1 AS tier, value AS latency, event_type <> 'error' AS success, event_type <> 'error' AND CAST(props::json->>'k' AS INTEGER) % 3 > 0 AS correct FROM events)"
_TIERS = f"""{_RUNS}, tiers AS (SELECT tier, count(*) AS total, count(*) FILTER (success) AS ok, round(CAST(count(*) FILTER (correct) AS DOUBLE) / count(*), 6) AS accuracy,
    round(avg(latency) FILTER (success), 6) AS mean, min(latency) FILTER (success) AS least, max(latency) FILTER (success) AS most FROM runs GROUP BY tier)"""


@query(f"WITH {_TIERS} SELECT * FROM tiers")
def q_tier_results(spark, sf):
    return E.tier_results(_runs(spark, sf))


@query(f"""WITH {_TIERS}, l AS (SELECT mean, coalesce(mean >= 0.5 * lag(mean) OVER (ORDER BY tier), true) AS fine FROM tiers),
    a AS (SELECT bool_and(fine) AS monotone, count(*) AS tiers, round(least(1.0, max(mean) / min(mean) / 5), 6) AS confidence FROM l) SELECT *, monotone AND tiers >= 2 AND confidence >= 0.6 AS passed FROM a""")
def q_tier_scaling(spark, sf):
    return E.tier_scaling(E.tier_results(_runs(spark, sf)))


@query(f"WITH {_RUNS}, a AS (SELECT CAST(min(latency) >= 50 AS INTEGER) AS floor, CAST(max(latency) > 1.2 * min(latency) AS INTEGER) AS spread, CAST(avg(latency) >= 100 AS INTEGER) AS mean FROM runs) SELECT *, floor + spread + mean >= 2 AS passed FROM a")
def q_latency_shape(spark, sf):
    return E.latency_shape(_runs(spark, sf))


@query(f"WITH {_RUNS}, a AS (SELECT count(*) AS n, CAST(count(*) FILTER (NOT success) AS DOUBLE) / count(*) AS rate FROM runs) SELECT n, round(rate, 6) AS rate, CAST(CASE WHEN rate = 0 THEN 0.7 WHEN rate <= 0.3 THEN 1.0 ELSE 0.85 END AS DOUBLE) AS confidence FROM a")
def q_failure_band(spark, sf):
    return E.failure_band(_runs(spark, sf))


@query(r"WITH a AS (SELECT round(CAST(count(DISTINCT md5(regexp_replace(lower(trim(text)), '\s+', ' ', 'g'))) AS DOUBLE) / count(*), 6) AS diversity FROM documents) SELECT diversity, round(least(1.0, 1.5 * diversity), 6) AS confidence, diversity >= 0.5 AS passed FROM a")
def q_output_diversity(spark, sf):
    return E.output_diversity(read(spark, sf, "documents").select(F.col("text").alias("answer")))


def _stage_log(spark, sf):
    """Five stages of each event; stage i fails where k % 23 is i + 1."""
    k = F.get_json_object("props", "$.k").cast("int")
    stages = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(s).alias("stage")) for i, s in enumerate(E.STAGES)])
    rows = read(spark, sf, "events").select(F.col("event_id").alias("run"), k.alias("k"), "value", F.explode(stages).alias("s"))
    return rows.select("run", "s.pos", "s.stage", (F.col("k") % 23 >= F.col("s.pos") + 18).alias("failed"), (F.col("value") * (F.col("s.pos") + 1)).alias("duration"))


_STAGES = ", ".join(f"({i}, '{s}')" for i, s in enumerate(E.STAGES))
_LOG = f"""log AS (SELECT event_id AS run, pos, stage, CAST(props::json->>'k' AS INTEGER) % 23 >= pos + 18 AS failed, value * (pos + 1) AS duration FROM events, (VALUES {_STAGES}) t(pos, stage)),
    m AS (SELECT *, coalesce(bool_or(failed) OVER (PARTITION BY run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS skipped FROM log),
    d AS (SELECT run, coalesce(arg_min(stage, pos) FILTER (failed), 'none') AS domain, count(*) FILTER (skipped) AS skipped, round(sum(CASE WHEN skipped THEN 0 ELSE duration END), 4) AS duration FROM m GROUP BY run)"""


@query(f"WITH {_LOG} SELECT * FROM d")
def q_failure_domain(spark, sf):
    return E.first_failures(_stage_log(spark, sf))


@query(f"WITH {_LOG} SELECT stage, count(run) AS n FROM (VALUES {_STAGES}) t(pos, stage) LEFT JOIN d ON domain = stage GROUP BY stage")
def q_failure_distribution(spark, sf):
    return E.distribution(E.first_failures(_stage_log(spark, sf)), "domain", E.STAGES)


@query(f"""WITH {_LOG}, c AS (SELECT stage, count(run) AS n FROM (VALUES {_STAGES}) t(pos, stage) LEFT JOIN d ON domain = stage GROUP BY stage),
    s AS (SELECT CAST(sum(n) AS DOUBLE) AS total, sum(n * n) * 5.0 / sum(n) - sum(n) AS x FROM c)
    SELECT CAST(round(x, 6) AS DOUBLE) AS statistic, 4 AS df, round(exp(-x / 2) * (1 + x / 2), 6) AS p, round(sqrt(x / (total * 4)), 6) AS cramer_v, total / 5 >= 5 AS enough FROM s""")
def q_chi_square(spark, sf):
    return E.chi_square(E.distribution(E.first_failures(_stage_log(spark, sf)), "domain", E.STAGES), len(E.STAGES))


_GAMMA = "1 - list_sum(list_transform(range(0, 600), lambda i: exp(-x / 2 + (5.5 + i) * ln(x / 2) - lgamma(6.5 + i))))"


@query(f"""WITH c AS (SELECT count(*) AS n FROM orders GROUP BY month(o_orderdate)), s AS (SELECT CAST(sum(n) AS DOUBLE) AS total, CAST(sum(n * n) AS DOUBLE) * 12 / sum(n) - sum(n) AS x FROM c)
    SELECT round(x, 6) AS statistic, 11 AS df, round({_GAMMA}, 6) AS p, round(sqrt(x / (total * 11)), 6) AS cramer_v, total / 12 >= 5 AS enough FROM s""")
def q_chi_square_months(spark, sf):
    """Orders by month against an even spread: odd degrees of freedom."""
    return E.chi_square(read(spark, sf, "orders").groupBy(F.month("o_orderdate")).agg(F.count("*").alias("n")), 12)


def _draws(rounds: int, seed: int) -> str:
    """A binomial draw after another in SQL: for each round, the number of k whose distribution is below the hash's uniform."""
    n = len(E.STAGES)
    pick = ", ".join(f"coalesce(sum(n) FILTER (stage = '{s}'), 0)::BIGINT AS c{i}" for i, s in enumerate(E.STAGES))
    steps = [f"w AS (SELECT {pick} FROM c)", f"b0 AS (SELECT *, {' + '.join(f'c{i}' for i in range(n))} AS trials, {' + '.join(f'c{i}' for i in range(n))} AS rest FROM w, (SELECT unnest(range(1, {rounds + 1})) AS round))"]
    for i in range(n - 1):
        u = f"(CAST(('0x' || substr(md5('{seed}:' || round || ':{i}'), 1, 8)) AS UBIGINT)::DOUBLE + 0.5) / 4294967296"
        steps.append(f"p{i} AS (SELECT *, CASE WHEN rest > 0 THEN c{i}::DOUBLE / rest ELSE 0 END AS p, {u} AS u FROM b{i})")
        steps.append(f"r{i} AS (SELECT *, greatest(0, floor(trials * p - 12 * sqrt(trials * p * (1 - p)) - 12))::BIGINT AS low, least(trials, ceil(trials * p + 12 * sqrt(trials * p * (1 - p)) + 12))::BIGINT AS high FROM p{i})")
        steps.append(f"k{i} AS (SELECT round, u, k, sum(exp(lgamma(trials + 1) - lgamma(k + 1) - lgamma(trials - k + 1) + k * ln(p) + (trials - k) * ln(1 - p))) OVER (PARTITION BY round ORDER BY k) AS cdf FROM (SELECT *, unnest(range(low, high + 1)) AS k FROM r{i} WHERE p > 0 AND p < 1 AND trials > 0))")
        steps.append(f"d{i} AS (SELECT round, count(*) FILTER (cdf < u) AS below FROM k{i} GROUP BY round)")
        steps.append(f"b{i + 1} AS (SELECT r.* EXCLUDE (p, u, low, high, trials, rest), m AS n{i}, trials - m AS trials, rest - c{i} AS rest FROM (SELECT r{i}.*, CASE WHEN p <= 0 THEN 0 WHEN p >= 1 THEN trials ELSE least(trials, low + coalesce(below, 0)) END::BIGINT AS m FROM r{i} LEFT JOIN d{i} USING (round)) r)".replace("r.* EXCLUDE (p, u, low, high, trials, rest)", "r.* EXCLUDE (p, u, low, high, trials, rest, m)"))
    return ", ".join(steps)


_LAST = len(E.STAGES) - 1
_SQUARES = " + ".join([*[f"n{i} * n{i}" for i in range(_LAST)], "trials * trials"])
_TOTAL = " + ".join([*[f"n{i}" for i in range(_LAST)], "trials"])


@query(f"""WITH {_LOG}, c AS (SELECT domain AS stage, count(*) AS n FROM d WHERE domain <> 'none' GROUP BY 1), {_draws(200, 7)},
    x AS (SELECT CAST({_SQUARES} AS DOUBLE) * 5 / ({_TOTAL}) - ({_TOTAL}) AS x FROM b{_LAST} WHERE {_TOTAL} > 0), v AS (SELECT exp(-x / 2) * (1 + x / 2) AS p FROM x)
    SELECT round(avg(p), 6) AS mean, round(median(p), 6) AS median, round(quantile_cont(p, 0.025), 6) AS low, round(quantile_cont(p, 0.975), 6) AS high,
        quantile_cont(p, 0.025) < 0.05 AND quantile_cont(p, 0.975) > 0.05 AS crosses FROM v""")
def q_bootstrap(spark, sf):
    """p-values of 200 resamples of the failing runs, drawn from the classes' counts."""
    failing = E.first_failures(_stage_log(spark, sf)).where("domain <> 'none'")
    return E.bootstrap(stored(failing.groupBy(F.col("domain").alias("stage")).agg(F.count("*").alias("n"))), E.STAGES)


@query("SELECT event_id, CAST(value >= (SELECT median(value) FROM events) AS INTEGER) AS y FROM events")
def q_median_label(spark, sf):
    return E.median_split(read(spark, sf, "events"), "value").select("event_id", "y")


def _median_rows(spark, sf):
    return stored(E.median_split(read(spark, sf, "events"), "value").select("value", (F.col("event_type") == "purchase").cast("int").alias("flag"), "y"))


@query()
def q_logistic_report(spark, sf):
    """Precision, recall and F1 of a logistic regression of the median split."""
    return E.logistic_report(_median_rows(spark, sf), ["value", "flag"])


@query()
def q_logistic_weights(spark, sf):
    """The weights of that regression."""
    return E.logistic_weights(_median_rows(spark, sf), ["value", "flag"])


def _log(spark, sf):
    return M.metric_rows(read(spark, sf, "events"), "event_type", "value", "ts", F.create_map(F.lit("k"), F.get_json_object("props", "$.k")))


@query("SELECT t.type, count(*) AS n, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000, 3) AS seconds FROM events, (VALUES ('latency'), ('all')) t(type) GROUP BY t.type")
def q_metric_summary(spark, sf):
    return M.summary(_log(spark, sf))


@query("SELECT epoch_us(ts) AS timestamp, value, props::json->>'k' AS k FROM events WHERE event_type = 'error'")
def q_metric_filter(spark, sf):
    return M.filter_metrics(_log(spark, sf), "latency", "error").select("timestamp", "value", F.col("metadata")["k"].alias("k"))


@query("""SELECT event_type AS name, count(*) AS n, round(sum(value), 2) AS total, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most,
    round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99 FROM events GROUP BY event_type""")
def q_latency_stats(spark, sf):
    return M.latency_stats(_log(spark, sf), "name")


_COST = "c AS (SELECT event_id, event_type, user_id % 4 AS g, round(value / 1000 * CASE event_type WHEN 'click' THEN 0.001 WHEN 'view' THEN 0.0005 WHEN 'purchase' THEN 0.01 ELSE 0.002 END, 9) AS cost FROM events)"


def _costs(spark, sf):
    rows = read(spark, sf, "events").withColumn("use_case", F.concat(F.lit("case"), (F.col("user_id") % 4).cast("string")))
    return M.cost_rows(rows, "event_type", F.col("value"))


@query(f"WITH {_COST} SELECT event_id, cost FROM c")
def q_cost_rows(spark, sf):
    return _costs(spark, sf).select("event_id", "cost")


@query(f"WITH {_COST} SELECT coalesce(event_type, '*') AS model, coalesce('case' || g, '*') AS use_case, round(sum(cost), 6) AS cost, count(*) AS calls FROM c GROUP BY GROUPING SETS ((event_type), (g), ())")
def q_cost_rollup(spark, sf):
    return M.cost_rollup(_costs(spark, sf), "event_type", "use_case")


@query("SELECT CAST(user_id % 10 AS BIGINT) AS category, count(*) AS n, round(CAST(count(*) FILTER (event_type <> 'error') AS DOUBLE) / count(*), 6) AS rate, round(avg(value), 4) AS mean FROM events GROUP BY 1")
def q_category_stats(spark, sf):
    rows = read(spark, sf, "events").select((F.col("user_id") % 10).alias("category"), (F.col("event_type") != "error").alias("success"), "value")
    return M.category_stats(rows, "category")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 5")
def q_slowest5(spark, sf):
    return M.slowest(read(spark, sf, "events").select("event_id", "value"), "value", "event_id", 5)


@query("SELECT event_id, round(value / sum(value) OVER (PARTITION BY user_id), 6) AS share FROM events")
def q_stage_share(spark, sf):
    return M.stage_share(read(spark, sf, "events"), "user_id", "value").select("event_id", "share")
