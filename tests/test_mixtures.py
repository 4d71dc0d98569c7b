"""Mixtures that advance together, against MLlib's own fits."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskspark.operators import clustering as C

XY = ["x", "y"]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    rows = [(i, *map(float, rng.normal((0, 0) if i % 3 else (3, 1), 1.0)), float(1 + i % 4)) for i in range(300)]
    return spark.createDataFrame([*rows, (300, None, 1.0, 1.0)], "id long, x double, y double, w double").repartition(3, "id").persist()


def jobs(spark) -> set[int]:
    return set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))


@pytest.mark.parametrize("weight", [None, "w"])
def test_mixtures_are_those_of_mllib(points, weight):
    vec = C.assemble(points, XY)
    settings = [(2, 1), (3, 2)]
    columns = {"weightCol": weight} if weight else {}
    starts = C.mixture_starts(vec, settings, 2, **columns)
    found = C.expectation_maximization(C.point_blocks(vec, vector_to_array("features"), weight), starts, steps=15)
    for (k, seed), m in zip(settings, found):
        own = GaussianMixture(k=k, seed=seed, maxIter=15, **columns).fit(vec)
        at = own.gaussiansDF.collect()
        assert m.log_likelihood == pytest.approx(own.summary.logLikelihood, rel=1e-9)
        np.testing.assert_allclose(m.weights, own.weights, rtol=1e-7)
        np.testing.assert_allclose(m.means, [g["mean"].toArray() for g in at], rtol=1e-6, atol=1e-9)
        np.testing.assert_allclose(m.covariances, [g["cov"].toArray() for g in at], rtol=1e-6, atol=1e-9)


@pytest.mark.parametrize("weight", [None, "w"])
def test_mixture_labels_are_those_of_mllib(points, weight):
    columns = {"weightCol": weight} if weight else {}
    vec = C.assemble(points, XY)
    best = max((GaussianMixture(k=2, seed=42 + r, **columns).fit(vec) for r in range(3)), key=lambda m: m.summary.logLikelihood)
    found = C.mixture_labels(points, XY, 2, weight=weight, restarts=3)
    assert found.columns == [*points.columns, "cluster"] and dict(found.dtypes)["cluster"] == "int"
    both = found.join(best.transform(vec).select("id", "prediction"), "id")
    assert both.count() == 300 and both.filter(F.col("cluster") != F.col("prediction")).count() == 0


def test_singular_mixture_is_that_of_mllib(spark):
    rows = spark.createDataFrame([(float(i % 5), 2.0 * (i % 5)) for i in range(60)], "x double, y double")
    vec = C.assemble(rows, XY)
    found, = C.expectation_maximization(C.point_blocks(vec, vector_to_array("features")), C.mixture_starts(vec, [(2, 3)], 1), steps=10)
    own = GaussianMixture(k=2, seed=3, maxIter=10).fit(vec)
    assert found.log_likelihood == pytest.approx(own.summary.logLikelihood, rel=1e-6)
    np.testing.assert_allclose(found.weights, own.weights, rtol=1e-6)


def test_a_step_of_all_mixtures_is_one_job(spark, points):
    before = jobs(spark)
    C.mixture_sweep(points, XY, [2, 3], restarts=3, max_iter=15)
    assert len(jobs(spark) - before) < 80     # not 15 steps for each of the six
