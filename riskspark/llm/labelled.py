"""What the two text classifiers share: the held-out rule, a bounded training sample, calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Most labelled documents a classifier is fitted on, those first by a hash of doc_id: 20,000 keys of 8 bytes
#: may be broadcast, and as many rows of features or scores reach the driver.
TRAINING_ROWS = 20_000


def remainder(doc_id: Column, modulus: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def training_labels(labels: DataFrame, column: str, modulus: int, held_out: int,
                    most: int = TRAINING_ROWS) -> DataFrame:
    """``doc_id, label`` of at most ``most`` labelled documents outside the held-out fold.

    Null ids or labels are left out; a document with several labels takes the smallest.
    """
    rows = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[column].cast("int").alias("label"))
    rows = rows.where("doc_id is not null and label in (0, 1)").where(
        remainder(F.col("doc_id"), modulus) != held_out)
    return rows.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(most)


def labelled_rows(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """``doc_id, text, label`` of the sampled documents; the sample is broadcast, being bounded."""
    return docs.join(F.broadcast(sample), "doc_id")


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fitted_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (last one the intercept) of a ridge logistic regression, by Newton steps."""
    z = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(z.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-6
    for _ in range(30):
        p = logistic(z @ w)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w
