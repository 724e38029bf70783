"""Quantiles by selection, values at ranks, and Newton fits against plain versions."""

import hashlib

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from docguard.operators import model as MO
from docguard.operators import newton as N
from docguard.operators import ranked


@pytest.fixture(scope="module")
def many(spark):
    rng = np.random.default_rng(3)
    n = 120_000
    tied = np.where(rng.random(n) < .4, 7.25, rng.normal(0, 1, n))
    far = np.concatenate([rng.normal(1e9, 1, n - 5), [np.inf, -np.inf, np.nan, 1e300, -1e300]])
    few = np.where(rng.random(n) < .999, np.nan, rng.random(n))
    rows = np.column_stack([tied, far, few])
    import pandas as pd
    return rows, spark.createDataFrame(pd.DataFrame(rows, columns=["tied", "far", "few"])).repartition(6).persist()


def test_quantiles_by_selection(many):
    rows, df = many
    wanted = {"p01": .01, "q25": .25, "q50": .5, "p95": .95, "p999": .999, "low": 0.0, "high": 1.0}
    got = {r.feature: r.asDict() for r in ranked.exact_quantiles(df, ["tied", "far", "few"], wanted).collect()}
    for i, name in enumerate(["tied", "far", "few"]):
        known = np.sort(rows[:, i][~np.isnan(rows[:, i])])
        for key, p in wanted.items():
            at = p * (len(known) - 1)
            low, high = known[int(np.floor(at))], known[int(np.ceil(at))]
            want = low if low == high else low + (high - low) * (at - np.floor(at))
            assert got[name][key] == pytest.approx(want, rel=1e-12) or got[name][key] == want


def test_only_values_near_the_ranks_are_ranked(many):
    rows, df = many
    counts = ranked.selected_counts(df, ["tied", "far"], [.5, .95])
    held = counts.groupBy("feature").agg(F.expr("sum(n) AS n"), F.expr("count_if(ranked) AS ranked"), F.expr("count_if(NOT ranked) AS gaps"))
    for r in held.collect():
        assert r.n == (~np.isnan(rows[:, 0 if r.feature == "tied" else 1])).sum()
        assert r.ranked < .02 * len(rows) and r.gaps <= 3
    # the ranges are cut before anything is sorted: windows read the counts, never the rows
    plan = ranked.exact_quantiles(df, ["far"], {"q50": .5})._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.rindex("Window"):]
    assert "percentile_approx" not in plan[:plan.index("Window")] and "Aggregate" in below


def test_value_at_rank(spark):
    texts = [hashlib.md5(str(i).encode()).hexdigest() for i in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts + texts[:50] + [None]], "h string")
    got = ranked.value_at_rank(df, "h", {"none": "0", "first": "1", "tenth": "ceil(n_total * 0.1D)", "last": "n_total"}).first()
    assert (got.none, got.first, got.tenth, got.last) == (None, min(texts), sorted(texts)[299], max(texts))
    assert ranked.value_at_rank(df.limit(0), "h", {"first": "1"}).first().first is None


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (900, 4))
    y = (rng.random(900) < 1 / (1 + np.exp(-(x @ [1.5, -1, .2, 0] - 1)))).astype(float)
    return spark.createDataFrame([(float(t), int(f), *map(float, v)) for t, f, v in zip(y, rng.integers(0, 3, 900), x)],
                                 "y double, fold int, z0 double, z1 double, z2 double, z3 double").persist()


def test_newton_equals_the_library(labelled):
    z = [f"z{i}" for i in range(4)]
    problems = [N.Problem(f, .7, 1.8, 1 / c) for f in range(3) for c in (.01, 1.0, 100.0)]
    fits = N.fit_logistic(labelled, z, problems)
    for q, fit in zip(problems, fits):
        assert fit.converged and fit.steps < 15
        rows = labelled.filter(f"fold <> {q.fold}").withColumn("w", F.expr(f"if(y = 1, {q.weight_of_1}D, {q.weight_of_0}D)"))
        total = rows.agg(F.expr("sum(w)")).first()[0]
        library = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=q.penalty / total, standardization=False,
                                     maxIter=500, tol=1e-14).fit(VectorAssembler(inputCols=z, outputCol="x").transform(rows))
        assert np.allclose(fit.weights, [*library.coefficients, library.intercept], atol=1e-6)


def test_sigmoids_meet_their_conditions(labelled):
    z = [f"z{i}" for i in range(4)]
    weights = [[1.0, -.5, .1, 0.0, -.3], [2.0, -2, 0.0, .5, 0.0], [.1, 0.0, 0.0, 0.0, 0.0]]
    rows = np.array(labelled.collect(), float)
    sizes = [((rows[:, 1] == f) & (rows[:, 0] == 1)).sum() for f in range(3)], [((rows[:, 1] == f) & (rows[:, 0] == 0)).sum() for f in range(3)]
    targets = [N.soft_targets(int(p), int(n)) for p, n in zip(*sizes)]
    for f, fit in enumerate(N.fit_sigmoids(labelled, z, weights, targets)):
        mine = rows[rows[:, 1] == f]
        m = mine[:, 2:] @ weights[f][:4] + weights[f][4]
        t = np.where(mine[:, 0] == 1, *targets[f])
        q = 1 / (1 + np.exp(-(fit.weights[0] * m + fit.weights[1])))
        assert fit.converged and abs((q - t).sum()) < 1e-6 and abs(((q - t) * m).sum()) < 1e-6


def test_separable_classes_stay_finite(spark):
    rows = spark.createDataFrame([(float(i % 2), i % 3, float(i % 2)) for i in range(60)], "y double, fold int, z0 double")
    fit, = N.fit_logistic(rows, ["z0"], [N.Problem(0, 1.0, 1.0, 1e-3)])
    assert fit.converged and all(np.isfinite(fit.weights))


def test_unknown_features_are_an_error(spark):
    rows = spark.createDataFrame([(1.0, 0, None), (0.0, 1, 1.0)], "y double, fold int, z0 double")
    with pytest.raises(Exception, match="NULL, NaN or infinite"):
        N.fit_logistic(rows, ["z0"], [N.Problem(None, 1.0, 1.0, 1.0)])


def test_one_class_is_an_error(spark):
    rows = spark.createDataFrame([(str(i), 1, float(i)) for i in range(30)], "sample_id string, label int, a double")
    with pytest.raises(ValueError, match="one class"):
        MO.fit_risk(rows, ["a"])
