"""Wide-to-long reshaping shared by the per-feature operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from riskspark.functions.columns import ident, number


def to_long(df: DataFrame, cols: Sequence[str], *, keep: Sequence[Column] = (),
            extra: dict[str, dict[str, Column]] | None = None, numeric: bool = True,
            keep_null: bool = False) -> DataFrame:
    """One row per (row, feature): ``feature``, ``value`` and, per feature, ``extra`` columns.

    Only the named columns are read; null values are left out unless ``keep_null``.
    """
    extra = extra or {}
    items = []
    for c in cols:
        value = number(ident(c)) if numeric else ident(c).cast("string")
        fields = [F.lit(c).alias("feature"), value.alias("value")]
        fields += [exprs[c].alias(name) for name, exprs in extra.items()]
        items.append(F.struct(*fields))
    names = ["feature", "value", *extra]
    out = df.select(*keep, F.explode(F.array(*items)).alias("_item"))
    kept = [c for c in out.columns if c != "_item"]
    long = out.select(*[ident(c) for c in kept], *[F.col("_item")[n].alias(n) for n in names])
    return long if keep_null else long.filter(F.col("value").isNotNull())


def row_to_long(stats: DataFrame, cols: Sequence[str], fields: Sequence[str],
                name: str = "feature") -> DataFrame:
    """Turn one row of ``<field>__<i>`` aggregates into one row per column."""
    items = [
        F.struct(F.lit(c).alias(name), *[F.col(f"{f}__{i}").alias(f) for f in fields])
        for i, c in enumerate(cols)
    ]
    return (stats.select(F.explode(F.array(*items)).alias("_item"))
            .select(*[F.col("_item")[n].alias(n) for n in (name, *fields)]))
