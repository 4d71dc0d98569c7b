"""Contingency tables: independence tests, residuals, agreement of two labelings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from riskspark.functions import tails
from riskspark.functions.columns import ident
from riskspark.operators.longform import to_long


def cell_counts(df: DataFrame, features: Sequence[str], against: str, weight: str | None = None,
                by: Sequence[str] = ()) -> DataFrame:
    """One aggregate for all features: [by], feature, x, y, n (nulls of either side left out)."""
    keep = [*[ident(b) for b in by], ident(against).cast("string").alias("y")]
    if weight:
        keep.append(ident(weight).alias("_w"))
    long = to_long(df.filter(ident(against).isNotNull()), features, keep=keep, numeric=False)
    n = F.sum("_w") if weight else F.count("*")
    return long.groupBy(*[ident(b) for b in by], "feature", F.col("value").alias("x"), "y").agg(n.alias("n"))


def with_margins(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cells with row total r, column total c, grand total and level counts.

    Joins of the small aggregates, so no task ever holds one whole feature.
    """
    keys = [*by, "feature"]
    rows = cells.groupBy(*keys, "x").agg(F.sum("n").alias("r"))
    cols = cells.groupBy(*keys, "y").agg(F.sum("n").alias("c"))
    row_side = rows.groupBy(*keys).agg(F.sum("r").alias("total"), F.count("*").alias("n_x"),
                                       F.sum(1 / F.col("r")).alias("inv_r"))
    col_side = cols.groupBy(*keys).agg(F.count("*").alias("n_y"), F.sum(1 / F.col("c")).alias("inv_c"))
    return (cells.join(rows, [*keys, "x"]).join(cols, [*keys, "y"])
            .join(row_side, keys).join(col_side, keys))


def chi_square(cells: DataFrame, *, yates: bool = True) -> DataFrame:
    """feature, chi2, dof, p_value; 2x2 tables get the continuity correction.

    Features with fewer than two rows or columns are left out.
    """
    m = with_margins(cells)
    n = F.col("n").cast("double")
    expected = F.col("r") * F.col("c") / F.col("total").cast("double")
    agg = m.groupBy("feature").agg(
        F.sum(n * n / F.col("r") / F.col("c")).alias("q"), F.max(F.abs(n - expected)).alias("dev"),
        F.first(F.col("total").cast("double")).alias("total"), F.first("n_x").alias("n_x"),
        F.first("n_y").alias("n_y"), F.first(F.col("inv_r") * F.col("inv_c")).alias("inv"))
    plain = F.col("total") * (F.col("q") - F.lit(1.0))
    dev = F.col("dev") - F.least(F.lit(0.5), F.col("dev"))
    corrected = dev * dev * F.col("total") * F.col("inv")
    two = (F.col("n_x") == 2) & (F.col("n_y") == 2) & F.lit(yates)
    out = (agg.filter("n_x > 1 AND n_y > 1")
           .select("feature", F.greatest(F.when(two, corrected).otherwise(plain), F.lit(0.0)).alias("chi2"),
                   ((F.col("n_x") - 1) * (F.col("n_y") - 1)).alias("dof")))
    return out.withColumn("p_value", tails.p_chi2(F.col("chi2"), F.col("dof")))


def residuals(cells: DataFrame, *, limit: float = 2.0) -> DataFrame:
    """(observed - expected) / sqrt(expected) for every cell of each feature's table."""
    rows = cells.groupBy("feature", "x").agg(F.sum("n").alias("r"))
    cols = cells.groupBy("feature", "y").agg(F.sum("n").alias("c"))
    total = rows.groupBy("feature").agg(F.sum("r").alias("total"))
    # the table of levels itself: rows x columns of one contingency table
    grid = rows.join(total, "feature").join(cols, "feature")
    full = grid.join(cells, ["feature", "x", "y"], "left").na.fill(0, ["n"])
    expected = F.col("r") * F.col("c") / F.col("total").cast("double")
    z = (F.col("n") - expected) / F.sqrt(expected)
    return full.select("feature", "x", "y", "n", z.alias("z")).withColumn(
        "direction", F.when(F.col("z") > limit, "over-represented").when(F.col("z") < -limit, "under-represented"))


def significant_pairs(cells: DataFrame, *, limit: float = 2.0) -> DataFrame:
    return (residuals(cells, limit=limit).filter(F.col("direction").isNotNull())
            .orderBy(F.desc(F.abs("z")), "x", "y"))


def agreement(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adjusted Rand index, mutual information (nats) and its arithmetic-mean normalisation.

    ``cells`` may carry a key (for example the resample) in ``by``: all keys are
    scored by the same aggregates.
    """
    keys = [*by, "feature"]
    n = F.col("n").cast("double")

    def pairs(c):
        return F.sum(c * (c - 1) / 2)

    def plogp(c, total):
        return F.sum(-(c / total) * F.ln(c / total))

    total = cells.groupBy(*keys).agg(F.sum(n).alias("total"))
    rows = cells.groupBy(*keys, "x").agg(F.sum(n).alias("r"))
    cols = cells.groupBy(*keys, "y").agg(F.sum(n).alias("c"))
    tot = F.col("total")
    row_side = rows.join(total, keys).groupBy(*keys).agg(
        pairs(F.col("r")).alias("pr"), plogp(F.col("r"), tot).alias("hr"))
    col_side = cols.join(total, keys).groupBy(*keys).agg(
        pairs(F.col("c")).alias("pc"), plogp(F.col("c"), tot).alias("hc"))
    inner = (cells.join(rows, [*keys, "x"]).join(cols, [*keys, "y"]).join(total, keys)
             .groupBy(*keys).agg(pairs(n).alias("pn"), F.first("total").alias("total"),
                                 F.sum(n / tot * F.ln(n * tot / (F.col("r") * F.col("c")))).alias("mi")))
    j = inner.join(row_side, keys).join(col_side, keys)
    every = tot * (tot - 1) / 2
    expected = F.try_divide(F.col("pr") * F.col("pc"), every)
    best = (F.col("pr") + F.col("pc")) / 2
    ari = F.when((F.col("pn") == F.col("pr")) & (F.col("pn") == F.col("pc")), F.lit(1.0)).otherwise(
        F.try_divide(F.col("pn") - expected, best - expected))
    mean_h = (F.col("hr") + F.col("hc")) / 2
    mi = F.greatest(F.col("mi"), F.lit(0.0))
    return j.select(*keys, ari.alias("ari"), mi.alias("mi"),
                    F.when(mean_h == 0, F.lit(1.0)).otherwise(F.try_divide(mi, mean_h)).alias("nmi"))


def compare_labelings(df: DataFrame, a: str, b: str) -> DataFrame:
    return agreement(cell_counts(df, [a], b)).drop("feature")
