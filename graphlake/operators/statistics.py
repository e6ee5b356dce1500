"""Exact quantiles by distributed selection, tails of chi-square, binomial draws and logistic regression, as aggregates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bins of a pass over a range; rows of a range that are ranked at once; rows of ranges that may be broadcast.
BINS, FEW, BROADCAST_ROWS = 1_024, 10_000, 100_000


def _kept(df: DataFrame) -> DataFrame:
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def order_statistics(rows: DataFrame, by: list[str], value: str, wanted: DataFrame) -> DataFrame:
    """(by, k, value): the value of rank k, from 0 in ascending order, of each group, for wanted (by, k long).

    Each pass counts a range's rows in BINS bins (a row a group, range and bin after a partial count) and narrows the range
    to the bin of the rank, from its least to its largest value; where a range holds one value that is it, and ranges of at
    most FEW rows are ranked. So nothing holds a group's values. Null and NaN values have no rank; groups are matched
    null-safely; ranks out of a group's rows are left out. by may be empty.
    """
    names = [f"g{i}_" for i in range(len(by))]
    table = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(by, names)], F.col(f"`{value}`").cast("double").alias("v_")).where("v_ is not null and not isnan(v_)")
    ends = table.groupBy(*names).agg(F.min("v_").alias("low"), F.max("v_").alias("high"), F.count("*").alias("rows"))
    asked = wanted.select(*[F.col(f"`{c}`").alias(f"a{n}") for c, n in zip(by, names)], F.col("k").cast("long").alias("k")).distinct()
    same = F.lit(True)
    for n in names:
        same = same & F.col(f"a{n}").eqNullSafe(F.col(n))
    ranges = asked.join(ends, same).drop(*[f"a{n}" for n in names]).where((F.col("k") >= 0) & (F.col("k") < F.col("rows"))).withColumn("before", F.lit(0).cast("long"))
    ranges, done = _kept(ranges), None
    while True:
        wide = ranges.where((F.col("low") < F.col("high")) & (F.col("rows") > FEW))
        settled = ranges.where((F.col("low") == F.col("high")) | (F.col("rows") <= FEW))
        done = settled if done is None else done.unionByName(settled)
        if not wide.take(1):
            break
        keys = [*names, "low", "high"]
        met = _meet(table, wide.select(*keys).distinct(), names)
        # halves before the difference, which could overflow
        place = F.least(F.lit(BINS - 1), F.floor((F.col("v_") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * BINS))
        bins = met.groupBy(*keys, place.alias("bin")).agg(F.min("v_").alias("least"), F.max("v_").alias("most"), F.count("*").alias("n"))
        so_far = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # BINS rows at most
        bins = bins.withColumn("under", F.coalesce(F.sum("n").over(so_far), F.lit(0))).select(*[F.col(c).alias(f"b{c}") for c in keys], "least", "most", "n", "under")
        same = F.lit(True)
        for c in keys:
            same = same & F.col(c).eqNullSafe(F.col(f"b{c}"))
        rank = F.col("k") - F.col("before")
        narrowed = wide.join(bins, same & (rank >= F.col("under")) & (rank < F.col("under") + F.col("n")))
        ranges = _kept(narrowed.select(*names, "k", F.col("least").alias("low"), F.col("most").alias("high"), F.col("n").alias("rows"), (F.col("before") + F.col("under")).alias("before")))
    done = _kept(done)
    exact = done.where("low = high").select(*names, "k", F.col("low").alias("value"))
    open_ranges = done.where("low < high")
    keys = [*names, "low", "high"]
    met = _meet(table, open_ranges.select(*keys).distinct(), names)
    order = Window.partitionBy(*keys).orderBy("v_")
    placed = met.withColumn("place", F.row_number().over(order) - 1).select(*[F.col(c).alias(f"b{c}") for c in keys], "v_", "place")
    same = F.col("k") - F.col("before") == F.col("place")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"b{c}"))
    found = exact.unionByName(open_ranges.join(placed, same).select(*names, "k", F.col("v_").alias("value")))
    return found.select(*[F.col(n).alias(c) for c, n in zip(by, names)], "k", "value")


def _meet(table: DataFrame, ranges: DataFrame, names: list[str]) -> DataFrame:
    """The rows inside ranges; the ranges, at most one for each wanted rank, are counted before they are broadcast."""
    some = ranges.select(*[F.col(n).alias(f"r{n}") for n in names], "low", "high")
    some = F.broadcast(some) if some.count() <= BROADCAST_ROWS else some
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"r{n}"))
    return table.join(some, same & F.col("v_").between(F.col("low"), F.col("high"))).select(*names, "v_", "low", "high")


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """(by, q array): the exact quantiles of each group, between two neighbouring values in proportion; groups without a value
    have no row."""
    held = rows.where(F.col(f"`{value}`").isNotNull() & ~F.isnan(F.col(f"`{value}`").cast("double"))).groupBy(*by).agg(F.count("*").alias("n_"))
    at = [F.struct(F.lit(i).alias("i"), (F.lit(float(q)) * (F.col("n_") - 1)).alias("at")) for i, q in enumerate(shares)]
    places = held.select(*by, F.explode(F.array(*at)).alias("p")).select(*by, "p.i", "p.at", F.floor("p.at").alias("k0"), F.ceil("p.at").alias("k1"))
    places = _kept(places)
    wanted = places.select(*by, F.explode(F.array("k0", "k1")).alias("k")).distinct()
    values = _kept(order_statistics(rows, by, value, wanted))

    def with_value(df: DataFrame, k: str, name: str) -> DataFrame:
        side = values.select(*[F.col(f"`{c}`").alias(f"s{i}_") for i, c in enumerate(by)], F.col("k").alias("sk_"), F.col("value").alias(name))
        same = F.col(k) == F.col("sk_")
        for i, c in enumerate(by):
            same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"s{i}_"))
        return df.join(side, same).drop("sk_", *[f"s{i}_" for i in range(len(by))])

    both = with_value(with_value(places, "k0", "v0"), "k1", "v1")
    between = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("at") - F.col("k0"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", between.alias("v")))), lambda x: x["v"])
    return both.groupBy(*by).agg(listed.alias("q"))


def gamma_tail(a: float, x: Column) -> Column:
    """Q(a, x), the regularised upper incomplete gamma function: one less the series where x < a + 1, else the continued fraction
    by its modified products. The number of terms follows from a, so both are exact to about 1e-13; 1 for x of 0 or less."""
    terms = 120 + int(12 * math.sqrt(a))
    front = F.exp(-x + a * F.log(x) - math.lgamma(a))
    steps = F.sequence(F.lit(1), F.lit(terms))
    add = lambda s, i: F.struct((s["term"] * x / (a + i)).alias("term"), (s["sum"] + s["term"] * x / (a + i)).alias("sum"))
    first = F.lit(1.0 / a)
    series = F.aggregate(steps, F.struct(first.alias("term"), first.alias("sum")), add, lambda s: s["sum"])

    def next_(s: Column, i: Column) -> Column:
        an, b = -i * (i - a), s["b"] + 2
        away = lambda v: F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)
        d, c = 1 / away(an * s["d"] + b), away(b + an / s["c"])
        return F.struct(b.alias("b"), c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    b0 = x + 1 - a
    start = F.struct(b0.alias("b"), F.lit(1e300).alias("c"), (1 / b0).alias("d"), (1 / b0).alias("h"))
    fraction = F.aggregate(steps, start, next_, lambda s: s["h"])
    return F.when(x <= 0, 1.0).when(x < a + 1, 1 - front * series).otherwise(front * fraction)


def chi_square_tail(x: Column, df: int) -> Column:
    """The p-value of a chi-square statistic with any degrees of freedom."""
    return gamma_tail(df / 2, x / 2)


def log_factorial(n: Column) -> Column:
    """ln n!: a table below 16, Stirling's series above, exact to about 1e-13."""
    small = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(16)])
    x = n.cast("double")
    large = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5))) - 1 / (1680 * F.pow(x, F.lit(7)))
    return F.when(n < 16, F.get(small, n.cast("int"))).otherwise(large)


def binomial(n: Column, p: Column, u: Column) -> Column:
    """The number of successes in n trials of chance p that a uniform u stands for: the least k whose distribution reaches u, looked
    for within 12 deviations of the mean (beyond is less likely than 1e-30), so its cost grows with the root of n."""
    mean, reach = n * p, 12 * F.sqrt(n * p * (1 - p)) + 12
    low, high = F.greatest(F.lit(0).cast("long"), F.floor(mean - reach)), F.least(n.cast("long"), F.ceil(mean + reach))
    start = F.exp(log_factorial(n) - log_factorial(low) - log_factorial(n - low) + low * F.log(p) + (n - low) * F.log(1 - p))

    def step(s: Column, k: Column) -> Column:
        more = s["pmf"] * (n - k) / (k + 1) * p / (1 - p)
        up = F.struct((k + 1).alias("k"), more.alias("pmf"), (s["cdf"] + more).alias("cdf"))
        return F.when(s["cdf"] < u, up).otherwise(s)

    walked = F.aggregate(F.sequence(low, F.greatest(low, high - 1)), F.struct(low.alias("k"), start.alias("pmf"), start.alias("cdf")), step, lambda s: s["k"])
    return F.when((p <= 0) | (n == 0), 0).when(p >= 1, n).otherwise(F.least(walked, n)).cast("long")


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the md5 of the parts, the same in every engine: 32 bits and a half."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 32)


def resampled_counts(counts: DataFrame, classes: list[str], rounds: int, seed: int) -> DataFrame:
    """(round, n0, n1, ...): for each round as many draws with replacement as counts (stage, n) has rows in all, by class: a
    multinomial of the classes' shares, one binomial of what is left after another. One row is exploded to `rounds` rows."""
    held = counts.agg(*[F.coalesce(F.sum(F.when(F.col("stage") == c, F.col("n"))), F.lit(0)).cast("long").alias(f"c{i}") for i, c in enumerate(classes)])
    at = held.select("*", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    names = [f"c{i}" for i in range(len(classes))]
    at = at.withColumn("trials", sum((F.col(c) for c in names[1:]), F.col(names[0]))).withColumn("rest", F.col("trials"))
    for i, c in enumerate(names[:-1]):
        p = F.when(F.col("rest") > 0, F.col(c) / F.col("rest")).otherwise(0.0)
        at = at.withColumns({"p_": p, "u_": uniform(F.lit(seed), F.col("round"), F.lit(i))})
        at = _kept(at).withColumn(f"n{i}", binomial(F.col("trials"), F.col("p_"), F.col("u_"))).drop("p_", "u_")
        at = _kept(at.withColumn("trials", F.col("trials") - F.col(f"n{i}")).withColumn("rest", F.col("rest") - F.col(c)))  # `rounds` rows; one draw's expression inside another's grows without end
    at = at.withColumn(f"n{len(names) - 1}", F.col("trials"))
    return at.select("round", *[f"n{i}" for i in range(len(names))])


def logistic(rows: DataFrame, features: list[str], label: str, most: int = 60, tolerance: float = 1e-10) -> list[float]:
    """Weights of the features and the intercept, last, of the logistic regression that minimises the summed loss and half the
    squared weights (not the intercept).

    Newton's steps: each is one aggregate of the loss, the gradient and the Hessian at the weights, sums of which the
    driver sees (1 + d + d * d numbers), whatever the rows; a step that raises the loss is halved. Rows with a null are left out.
    """
    columns = [F.col(f"`{f}`").cast("double") for f in features]
    y = F.col(f"`{label}`").cast("double")
    table = rows.select(*[c.alias(f"x{i}") for i, c in enumerate(columns)], y.alias("y")).dropna()
    names = [*[f"x{i}" for i in range(len(features))], None]
    d = len(names)
    x = [F.lit(1.0) if n is None else F.col(n) for n in names]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]

    def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        z = sum((F.lit(float(w[i])) * x[i] for i in range(d)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        loss = F.greatest(z, F.lit(0.0)) - z * F.col("y") + F.log1p(F.exp(-F.abs(z)))
        parts = [loss, *[(p - F.col("y")) * c for c in x], *[p * (1 - p) * x[i] * x[j] for i, j in pairs]]
        got = [v or 0.0 for v in table.agg(*[F.sum(c).alias(f"s{i}") for i, c in enumerate(parts)]).first()]
        ridge = np.append(np.ones(d - 1), 0.0)
        hessian = np.zeros((d, d))
        for (i, j), v in zip(pairs, got[1 + d :]):
            hessian[i, j] = hessian[j, i] = v
        return got[0] + 0.5 * float((ridge * w * w).sum()), np.array(got[1 : 1 + d]) + ridge * w, hessian + np.diag(ridge)

    w = np.zeros(d)
    loss, gradient, hessian = sums(w)
    for _ in range(most):
        step = np.linalg.solve(hessian + np.eye(d) * 1e-12, gradient)
        size = 1.0
        while True:
            at = w - size * step
            found = sums(at)
            if found[0] <= loss + 1e-12 * abs(loss) or size < 1e-6:
                break
            size /= 2
        done = abs(loss - found[0]) <= tolerance * max(1.0, abs(loss)) and size == 1.0
        w, (loss, gradient, hessian) = at, found
        if done:
            break
    return w.tolist()
