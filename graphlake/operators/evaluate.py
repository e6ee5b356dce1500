"""Scoring of answers, checks over runs, and statistics of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphlake.functions import text as T
from graphlake.operators import statistics as S

STAGES = ["embed", "search", "rerank", "traverse", "generate"]
#: The least means that pass, of the whole score, faithfulness, precision and success.
GATES = {"aggregate_score": 0.6, "faithfulness": 0.7, "context_precision": 0.6, "success": 1.0}


def share_of_tokens(answer: Column, contexts: Column) -> Column:
    """Share of the answer's tokens that any of the contexts has."""
    return T.share_of(T.tokens(answer), F.array_distinct(F.flatten(F.transform(contexts, T.tokens))))


def share_found(text: Column, wanted: Column) -> Column:
    """Share of the wanted strings inside the text, any case; 1 if none is wanted."""
    low = F.lower(text)
    found = F.size(F.filter(wanted, lambda w: F.contains(low, F.lower(w))))
    return F.when(F.size(wanted) == 0, 1.0).otherwise(found / F.size(wanted))


def not_found(text: Column, wanted: Column) -> Column:
    low = F.lower(text)
    return F.filter(wanted, lambda w: ~F.contains(low, F.lower(w)))


#: The weights of an answer's score.
WEIGHTS = {"faithfulness": 0.3, "answer_relevance": 0.3, "context_precision": 0.2, "keyword_score": 0.2}
METRICS = [*WEIGHTS, "context_recall", "ground_truth_overlap", "aggregate_score"]


def answer_metrics(rows: DataFrame, question: str, answer: str, contexts: str, entities: str, keywords: str, truth: str) -> DataFrame:
    """rows and METRICS, each to 3 digits: the share of the answer's tokens that the contexts have; overlap of question and answer;
    share of the entities inside the contexts and of the keywords inside the answer; overlap of contexts and of answer with
    the truth, null where there is none; and the weighted sum of the first four. Texts are tokenized once."""
    both = F.concat_ws(" ", contexts)
    words = {name: T.tokens(c) for name, c in (("q_", F.col(question)), ("a_", F.col(answer)), ("c_", both), ("t_", F.col(truth)))}
    held = rows.select("*", *[c.alias(n) for n, c in words.items()], share_found(both, F.col(entities)).alias("p_"), share_found(F.coalesce(answer, F.lit("")), F.col(keywords)).alias("k_"))
    grounded = F.when(F.size("a_") == 0, 0.0).otherwise(F.size(F.array_intersect("a_", "c_")) / F.size("a_"))
    known = lambda c: F.when(F.col(truth) != "", c)
    values = [grounded, T.overlap_of("q_", "a_"), F.col("p_"), F.col("k_"), known(T.overlap_of("c_", "t_")), known(T.overlap_of("a_", "t_"))]
    raw = held.select(*rows.columns, *[v.alias(f"{m}_") for m, v in zip(METRICS, values)])
    total = sum((w * F.col(f"{m}_") for m, w in WEIGHTS.items()), F.lit(0.0))
    # a billionth keeps halves on one side
    return raw.select(*rows.columns, *[F.round(v + 1e-9, 3).alias(m) for m, v in zip(METRICS, [*(F.col(f"{m}_") for m in METRICS[:-1]), total])])


def metric_means(rows: DataFrame, category: str, metrics: list[str]) -> DataFrame:
    """(category, metric, n, mean, gate_failed): means of each metric by category and, as `all`, over all; a metric with a least
    mean in GATES fails its gate below it, and without a mean."""
    held = rows.rollup(category).agg(*[F.struct(F.count(m).alias("n"), F.avg(m).alias("mean")).alias(m) for m in metrics])
    gate = F.lit(None).cast("double")
    for metric, least in GATES.items():
        gate = F.when(F.col("metric") == metric, least).otherwise(gate)
    flat = held.select(F.coalesce(category, F.lit("all")).alias("category"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])).alias("x"))
    flat = flat.select("category", "x.metric", "x.v.n", F.round("x.v.mean", 6).alias("mean"))
    return flat.withColumn("gate_failed", F.coalesce(F.col("mean") < gate, gate.isNotNull()))


def truth_checks(answer: Column, must: Column, forbidden: Column, count: Column, low: Column, high: Column) -> Column:
    """Share of the checks that an answer passes: it has all of `must`, none of `forbidden`, and a count within bounds."""
    text = F.lower(answer)
    checks = [F.forall(must, lambda m: F.contains(text, F.lower(m))), ~F.exists(forbidden, lambda m: F.contains(text, F.lower(m))), count.between(low, high)]
    return sum((F.when(c, 1.0).otherwise(0.0) for c in checks), F.lit(0.0)) / len(checks)


def truth_report(
    answer: Column, must: Column, forbidden: Column, exact: Column, count: Column, low: Column, high: Column, kind: Column, kinds: Column, expected: Column, values: Column
) -> Column:
    """Array of (check, passed, missing, extra) of the checks that a case states; a check whose condition is null is left out.

    contains: the answer has each of must (missing: those it lacks); forbidden: it has none of them (extra: those it has);
    exact: it has that text as it stands; count: within low and high, either of which may be null, given a count;
    entity_type: kind is one of kinds; values: the same set as expected (missing and extra: the differences).
    """
    text = F.lower(F.coalesce(answer, F.lit("")))
    none = F.array().cast("array<string>")
    lacking = F.filter(must, lambda m: ~F.contains(text, F.lower(m)))
    found = F.filter(forbidden, lambda m: F.contains(text, F.lower(m)))
    gone, more = F.array_except(expected, values), F.array_except(values, expected)
    check = lambda name, passed, missing=none, extra=none: F.struct(F.lit(name).alias("check"), passed.alias("passed"), missing.alias("missing"), extra.alias("extra"))
    bounded = F.coalesce(count >= low, F.lit(True)) & F.coalesce(count <= high, F.lit(True))
    checks = [
        F.when(must.isNotNull(), check("contains", F.size(lacking) == 0, lacking)),
        F.when(forbidden.isNotNull(), check("forbidden", F.size(found) == 0, extra=found)),
        F.when(exact.isNotNull(), check("exact", F.contains(F.coalesce(answer, F.lit("")), exact))),
        F.when(count.isNotNull() & (low.isNotNull() | high.isNotNull()), check("count", bounded)),
        F.when(kind.isNotNull(), check("entity_type", F.coalesce(F.array_contains(kinds, kind), F.lit(False)))),
        F.when(expected.isNotNull(), check("values", F.coalesce((F.size(gone) == 0) & (F.size(more) == 0), F.lit(False)), F.coalesce(gone, expected), F.coalesce(more, none))),
    ]
    return F.filter(F.array(*checks), lambda c: c.isNotNull())


def truth_score(report: Column) -> Column:
    """Share of the checks that passed; 0 without a check."""
    passed = F.size(F.filter(report, lambda c: c["passed"]))
    return F.when(F.size(report) > 0, passed / F.size(report)).otherwise(0.0)


def tier_results(rows: DataFrame) -> DataFrame:
    """rows (tier, latency, success, correct): totals, accuracy, and latency of the successes."""
    of_success = F.when(F.col("success"), F.col("latency"))
    return rows.groupBy("tier").agg(
        F.count("*").alias("total"), F.count_if("success").alias("ok"), F.round(F.count_if("correct") / F.count("*"), 6).alias("accuracy"),
        F.round(F.avg(of_success), 6).alias("mean"), F.min(of_success).alias("least"), F.max(of_success).alias("most"),
    )


def tier_scaling(tiers: DataFrame) -> DataFrame:
    """tiers (tier, mean), a few rows: each mean at least half the one below, and how far the means spread."""
    before = F.lag("mean").over(Window.orderBy("tier"))
    steps = tiers.withColumn("fine", F.coalesce(F.col("mean") >= 0.5 * before, F.lit(True)))
    confidence = F.least(F.lit(1.0), F.max("mean") / F.min("mean") / 5)
    return steps.agg(F.bool_and("fine").alias("monotone"), F.count("*").alias("tiers"), F.round(confidence, 6).alias("confidence")).withColumn(
        "passed", F.col("monotone") & (F.col("tiers") >= 2) & (F.col("confidence") >= 0.6)
    )


def latency_shape(rows: DataFrame) -> DataFrame:
    """Least over 50, largest over 1.2 times the least, mean over 100: two of three pass."""
    held = rows.agg((F.min("latency") >= 50).cast("int").alias("floor"), (F.max("latency") > 1.2 * F.min("latency")).cast("int").alias("spread"), (F.avg("latency") >= 100).cast("int").alias("mean"))
    return held.withColumn("passed", F.col("floor") + F.col("spread") + F.col("mean") >= 2)


def failure_band(rows: DataFrame) -> DataFrame:
    """The failure rate and the confidence of its band."""
    held = rows.agg(F.count("*").alias("n"), (F.count_if(~F.col("success")) / F.count("*")).alias("rate"))
    none = F.when(F.col("n") >= 10, 0.7).otherwise(0.8)
    band = F.when(F.col("n") == 0, 0.0).when(F.col("rate") == 0, none).when(F.col("rate") <= 0.3, 1.0).otherwise(0.85)
    return held.select("n", F.round("rate", 6).alias("rate"), band.alias("confidence"))


def output_diversity(answers: DataFrame) -> DataFrame:
    """Distinct normalised answers over all; passes at a half."""
    share = F.count_distinct(T.fingerprint(F.col("answer"))) / F.count("*")
    return answers.agg(F.round(share, 6).alias("diversity")).withColumn("confidence", F.round(F.least(F.lit(1.0), 1.5 * F.col("diversity")), 6)).withColumn("passed", F.col("diversity") >= 0.5)


def first_failures(log: DataFrame) -> DataFrame:
    """log (run, pos, stage, failed, duration): the first failing stage, the stages skipped after it, the time up to it."""
    before = F.coalesce(F.max(F.col("failed").cast("int")).over(Window.partitionBy("run").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = log.withColumn("skipped", before == 1)
    return marked.groupBy("run").agg(
        F.min_by("stage", F.when(F.col("failed"), F.col("pos"))).alias("domain_"), F.bool_or("failed").alias("any_"),
        F.count_if("skipped").alias("skipped"), F.round(F.sum(F.when(~F.col("skipped"), F.col("duration")).otherwise(0.0)), 4).alias("duration"),
    ).select("run", F.when(F.col("any_"), F.col("domain_")).otherwise("none").alias("domain"), "skipped", "duration")


def distribution(domains: DataFrame, column: str, classes: list[str]) -> DataFrame:
    """(stage, n) of every class, 0 where there is none."""
    table = domains.sparkSession.createDataFrame([(c,) for c in classes], "stage string")  # a fixed list
    counts = domains.groupBy(F.col(column).alias("stage")).agg(F.count("*").alias("n"))
    return F.broadcast(table).join(counts, "stage", "left").select("stage", F.coalesce("n", F.lit(0)).alias("n"))


def chi_square(counts: DataFrame, classes: int) -> DataFrame:
    """counts (n): the statistic against a uniform spread, its p-value for any degrees of freedom, Cramer's V, and whether every
    class expects 5 at least."""
    sums = counts.agg(F.sum("n").alias("total"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"))
    statistic = F.col("squares") * classes / F.col("total") - F.col("total")
    held = sums.withColumn("x", statistic)
    return held.select(
        F.round("x", 6).alias("statistic"), F.lit(classes - 1).alias("df"), F.round(S.chi_square_tail(F.col("x"), classes - 1), 6).alias("p"),
        F.round(F.sqrt(F.col("x") / (F.col("total") * (classes - 1))), 6).alias("cramer_v"), (F.col("total") / classes >= 5).alias("enough"),
    )


def bootstrap(counts: DataFrame, classes: list[str], rounds: int = 200, seed: int = 7) -> DataFrame:
    """Chi-square p-values of resamples of counts (stage, n): (mean, median, low, high, crosses).

    A resample draws as many rows as there are, with replacement: a number for each class and round, from hashes of round and
    class, so a rerun gives the same. No row is copied; a round is one row, and `rounds` of them are summed up.
    """
    drawn = S.resampled_counts(counts, classes, rounds, seed)
    names = [f"n{i}" for i in range(len(classes))]
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    squares = sum((F.col(n).cast("double") * F.col(n) for n in names), F.lit(0.0))
    held = drawn.withColumn("total", total).where("total > 0").withColumn("x", squares * len(classes) / F.col("total") - F.col("total"))
    p = held.select(S.chi_square_tail(F.col("x"), len(classes) - 1).alias("p"))
    ends = p.agg(F.avg("p").alias("mean"), F.median("p").alias("median"), F.percentile("p", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"))
    low, high = F.col("ci")[0], F.col("ci")[1]
    return ends.select(*[F.round(c, 6).alias(n) for n, c in (("mean", F.col("mean")), ("median", F.col("median")), ("low", low), ("high", high))], ((low < 0.05) & (high > 0.05)).alias("crosses"))


def median_split(rows: DataFrame, value: str) -> DataFrame:
    """Adds y: whether the value is at least the exact median of all. The median is one row, broadcast."""
    middle = S.quantiles(rows, [], value, [0.5]).select(F.get("q", F.lit(0)).alias("middle"))
    return rows.join(F.broadcast(middle), F.lit(True)).withColumn("y", (F.col(value) >= F.col("middle")).cast("int")).drop("middle")


def logistic_weights(rows: DataFrame, features: list[str]) -> DataFrame:
    """(name, weight) of the logistic regression of y on the features, and of its intercept."""
    weights = S.logistic(rows, features, "y")
    return rows.sparkSession.createDataFrame(list(zip([*features, "intercept"], weights)), "name string, weight double")


def logistic_report(rows: DataFrame, features: list[str]) -> DataFrame:
    """(label, precision, recall, f1, support) of a logistic regression on rows (features, y), fitted and judged on them."""
    *weights, intercept = S.logistic(rows, features, "y")
    z = sum((w * F.col(f).cast("double") for w, f in zip(weights, features)), F.lit(intercept))
    predicted = rows.select(F.col("y").cast("double").alias("label"), (z > 0).cast("double").alias("prediction")).dropna()
    cells = predicted.groupBy("label").agg(F.count("*").alias("support"), F.count_if(F.col("prediction") == F.col("label")).alias("hit"))
    named = predicted.groupBy(F.col("prediction").alias("label")).agg(F.count("*").alias("named"))
    both = cells.join(named, "label", "left")
    precision, recall = F.coalesce(F.col("hit") / F.col("named"), F.lit(0.0)), F.col("hit") / F.col("support")
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return both.select(F.col("label").cast("int").alias("label"), *[F.round(x, 4).alias(n) for n, x in (("precision", precision), ("recall", recall), ("f1", f1))], "support")
