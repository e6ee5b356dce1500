import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphlake.operators import evaluate, statistics


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("bins,few", [(1_024, 10_000), (4, 3), (2, 1)])
def test_quantiles_of_odd_groups(spark, monkeypatch, bins, few):
    monkeypatch.setattr(statistics, "BINS", bins)
    monkeypatch.setattr(statistics, "FEW", few)
    rng = np.random.default_rng(1)
    groups = {"hot": [5.0] * 400 + rng.normal(size=300).tolist(), "one": [7.0], "same": [1.0] * 9, None: [3.0, -1e300, 1e300, 0.5], "far": [1e-12, 2e-12, 1.0, 1e9, -0.0]}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("hot", None), ("none", None), ("none", float("nan")), ("hot", float("nan"))]
    got = {r.g: r.q for r in statistics.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", [0.0, 0.5, 0.95, 1.0]).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert np.allclose(got[g], np.quantile(vs, [0, 0.5, 0.95, 1]), rtol=1e-12), g


def test_quantiles_of_all_rows_and_of_none(spark):
    table = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    assert statistics.quantiles(table, [], "v", [0.5]).first().q == [4.5]
    assert statistics.quantiles(table.where("v < 0"), [], "v", [0.5]).first().q == []
    assert evaluate.median_split(table.where("v < 0"), "v").count() == 0
    ranks = spark.createDataFrame([(0,), (9,), (10,), (-1,)], "k long")
    assert sorted(map(tuple, statistics.order_statistics(table, [], "v", ranks).collect())) == [(0, 0.0), (9, 9.0)]


def test_chi_square_tail(spark):
    """Against the finite sums: even degrees of freedom by powers, odd ones by the error function."""

    def tail(x, df):
        if df % 2 == 0:
            return math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(df // 2))
        return math.erfc(math.sqrt(x / 2)) + math.exp(-x / 2) * sum((x / 2) ** (i - 0.5) / math.gamma(i + 0.5) for i in range(1, (df + 1) // 2))

    for df in (1, 2, 3, 4, 7, 11, 30, 101):
        for x in (0.001, 0.5, df - 0.5, float(df), df + 3.0, 3.0 * df + 20):
            assert value(spark, statistics.chi_square_tail(F.lit(x), df)) == pytest.approx(tail(x, df), rel=1e-9, abs=1e-12)
    assert value(spark, statistics.chi_square_tail(F.lit(0.0), 5)) == 1.0
    assert value(spark, statistics.chi_square_tail(F.lit(9.488), 4)) == pytest.approx(0.05, abs=1e-5)
    row = evaluate.chi_square(spark.createDataFrame([(5,), (6,), (30,), (7,)], "n long"), 4).first()
    assert row.df == 3 and row.statistic == pytest.approx(36.166667) and row.p == 0.0


def test_binomial_is_the_inverse_of_its_distribution(spark):
    for n, p in ((1, 0.5), (12, 0.3), (200, 0.01), (1000, 0.97)):
        pmf = [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]
        us = [0.0001, 0.2, 0.5, 0.77, 0.9999]
        rows = spark.createDataFrame([(u,) for u in us], "u double").select("u", statistics.binomial(F.lit(n).cast("long"), F.lit(p), F.col("u")).alias("k"))
        assert {r.u: r.k for r in rows.collect()} == {u: int(np.searchsorted(np.cumsum(pmf), u)) for u in us}
    one = lambda n, p: value(spark, statistics.binomial(F.lit(n).cast("long"), F.lit(p), F.lit(0.4)))
    assert (one(9, 0.0), one(9, 1.0), one(0, 0.5)) == (0, 9, 0)
    assert abs(one(10**9, 0.25) - 25 * 10**7) < 10**5


def test_resamples_have_the_rows_and_the_shares(spark):
    counts = spark.createDataFrame([("a", 500), ("b", 300), ("d", 200)], "stage string, n long")
    rows = statistics.resampled_counts(counts, ["a", "b", "c", "d"], 400, 3).collect()
    table = np.array([[r.n0, r.n1, r.n2, r.n3] for r in rows])
    assert len(rows) == 400 and (table.sum(axis=1) == 1000).all() and (table[:, 2] == 0).all()
    assert np.allclose(table.mean(axis=0), [500, 300, 0, 200], atol=4) and np.allclose(table.var(axis=0), [250, 210, 0, 160], rtol=0.25)
    none = statistics.resampled_counts(counts.where("n < 0"), ["a", "b"], 2, 3).collect()
    assert [(r.n0, r.n1) for r in none] == [(0, 0)] * 2


def test_logistic_equals_newton_in_numpy(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=400) * 3, rng.integers(0, 2, 400)]).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [0.8, -1.2] + 0.3)))).astype(int)
    design, w = np.column_stack([x, np.ones(400)]), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        ridge = np.diag([1.0, 1.0, 0.0])
        w -= np.linalg.solve(design.T * (p * (1 - p)) @ design + ridge, design.T @ (p - y) + ridge @ w)
    table = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y)] + [(None, 1.0, 1)], "a double, b double, y int")
    assert np.allclose(statistics.logistic(table, ["a", "b"], "y"), w, atol=1e-8)
    hits = (design @ w > 0).astype(int)
    got = {r.label: r for r in evaluate.logistic_report(table, ["a", "b"]).collect()}
    for c in (0, 1):
        hit, named, held = ((hits == c) & (y == c)).sum(), (hits == c).sum(), (y == c).sum()
        assert (got[c].precision, got[c].recall, got[c].support) == (pytest.approx(hit / named, abs=1e-4), pytest.approx(hit / held, abs=1e-4), held)


def test_separable_rows_still_converge(spark):
    table = spark.createDataFrame([(float(i), int(i >= 50)) for i in range(100)], "x double, y int")
    slope, intercept = statistics.logistic(table, ["x"], "y")
    assert slope > 0 and 49 < -intercept / slope < 50
