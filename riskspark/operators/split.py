"""Stratified splits and folds by hash order, quantile strata, class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from riskspark.functions.columns import ident, number
from riskspark.operators.ranking import hash_part, quantile_values


def quantile_bins(df: DataFrame, column: str, bins: int = 5, name: str = "stratum",
                  rows_per_bucket: int | None = None) -> DataFrame:
    """Right-closed quantile bins with exact edges; equal edges merge."""
    values = quantile_values(df, [column], [i / bins for i in range(bins + 1)], rows_per_bucket)
    edges = sorted(set(values.get(column, [])))
    x = number(ident(column))
    out = F.lit(None).cast("int")
    for code in reversed(range(len(edges) - 1)):
        out = F.when(x <= edges[code + 1], F.lit(code)).otherwise(out)
    return df.withColumn(name, F.when(x.isNotNull(), out))


def stratified_split(df: DataFrame, key: Sequence[str], strata: Sequence[str], *, test_size: float = 0.2,
                     seed: int = 42, name: str = "is_test") -> DataFrame:
    """Exactly round(test_size * n) rows of each stratum are test rows, chosen by hash order."""
    def cut(total: Column) -> Column:
        return F.floor(total * F.lit(test_size) + F.lit(0.5)).cast("long")
    out = hash_part(df, key, strata, [cut], "_part", salt=str(seed))
    return out.withColumn(name, F.col("_part") == 0).drop("_part")


def stratified_folds(df: DataFrame, key: Sequence[str], strata: Sequence[str] = (), *, k: int = 5,
                     seed: int = 42, name: str = "fold") -> DataFrame:
    """Fold number 0..k-1 per row; sizes differ by at most one within a stratum."""
    def cut(j: int):
        return lambda total: F.ceil(total * F.lit(j) / F.lit(k)).cast("long")
    return hash_part(df, key, strata, [cut(j) for j in range(1, k)], name, salt=f"fold{seed}")


def class_weights(df: DataFrame, label: str) -> dict:
    """Balanced weights n / (k * n_class)."""
    rows = df.groupBy(ident(label)).agg(F.count("*").alias("n")).collect()
    total = sum(r["n"] for r in rows)
    return {r[label]: total / (len(rows) * r["n"]) for r in rows}


def with_class_weight(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    out = F.lit(1.0)
    for value, weight in class_weights(df, label).items():
        out = F.when(ident(label).eqNullSafe(F.lit(value)), F.lit(weight)).otherwise(out)
    return df.withColumn(name, out)
