"""Silhouettes of several labelings from the same distances."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.operators import clustering as C, neighbors as N

XY = ["x", "y"]


@pytest.mark.parametrize("odd", [None, float("inf")])
def test_silhouettes_of_several_labelings_are_those_of_each(spark, odd):
    rng = np.random.default_rng(5)
    # keys that repeat, with other points too, a null key, a cluster of one row and one without rows
    data = [(None if i == 7 else i % 80, float(rng.normal()) if i else odd or 0.0, float(i % 9), [i % 2, 0 if i == 3 else 1 + i % 2, 0]) for i in range(100)]
    rows = spark.createDataFrame(data, "id int, x double, y double, labels array<int>")
    alone = [C.silhouette(rows.withColumn("label", F.col("labels")[j]), XY, "id", "label", block_rows=8).first()[0] for j in range(3)]
    got = C.silhouettes(rows, XY, "id", "labels", [2, 4, 1], block_rows=8)
    np.testing.assert_allclose(got, alone, rtol=1e-12, equal_nan=True)


def test_sweep_works_out_distances_once(spark, monkeypatch):
    rows = spark.createDataFrame([(i, float(i % 7), float(i % 11)) for i in range(77)], "id int, x double, y double")
    calls = []
    for name in ("cluster_distance_sums", "labelled_distance_sums"):
        monkeypatch.setattr(C, name, lambda *a, of=getattr(N, name, None), **k: calls.append(1) or of(*a, **k), raising=False)
    board = C.kmeans_sweep(rows, XY, "id", [2, 3, 4], restarts=1, exact_silhouette=True).collect()
    assert len(calls) == 1 and all(r["silhouette"] > 0 for r in board)
