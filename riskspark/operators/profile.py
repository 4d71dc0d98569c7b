"""Column profiles, group summaries, histograms, correlations, box statistics."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskspark.functions.columns import ident, number
from riskspark.operators.longform import row_to_long, to_long
from riskspark.operators.ranking import exact_quantiles
from riskspark.session import small_frame


def group_mean(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean per key; rows with a null key are left out."""
    keep = df.na.drop("any", subset=list(keys))
    return keep.groupBy(*[ident(k) for k in keys]).agg(*[F.avg(ident(v)).alias(v) for v in values])


def frequency(df: DataFrame, column: str) -> DataFrame:
    return (df.filter(ident(column).isNotNull()).groupBy(ident(column))
            .agg(F.count("*").alias("n")).orderBy(F.desc("n"), ident(column)))


def crosstab_long(df: DataFrame, row: str, col: str) -> DataFrame:
    """Counts with margins ('All') and row shares, long form."""
    cells = (df.select(ident(row).cast("string").alias("row"), ident(col).cast("string").alias("col"))
             .na.drop("any").cube("row", "col")
             .agg(F.count("*").alias("n"), F.grouping_id().alias("_g")))
    margins = (cells.filter(F.col("_g").isin(1, 3))
               .select(F.col("row").alias("_r"), F.col("n").alias("_m")))
    return (cells.join(margins, F.col("row").eqNullSafe(F.col("_r")))
            .select(F.coalesce("row", F.lit("All")).alias("row"), F.coalesce("col", F.lit("All")).alias("col"),
                    "n", (F.col("n") / F.col("_m")).alias("row_share")))


def crosstab(df: DataFrame, row: str, col: str, levels: Sequence) -> DataFrame:
    """Wide counts with a total column and an 'All' row; ``levels`` name the columns."""
    base = (df.select(ident(row).cast("string").alias("row"), ident(col).alias("_c")).na.drop("any"))
    return (base.rollup("row")
            .agg(*[F.count_if(F.col("_c") == v).alias(str(v)) for v in levels], F.count("*").alias("All"),
                 F.grouping("row").alias("_g"))
            .withColumn("row", F.when(F.col("_g") == 1, "All").otherwise(F.col("row"))).drop("_g"))


def cluster_profile(df: DataFrame, label: str, features: Sequence[str], *,
                    strata: Sequence[str] = ()) -> DataFrame:
    """Mean of every feature per cluster, noise (-1) removed.

    With ``strata`` the means are taken per stratum and cluster.
    """
    clean = df.filter(ident(label) != -1)
    return group_mean(clean, [*strata, label], features)


def level_summary(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: count, distinct values and the most common one (smallest on a tie)."""
    pairs = (df.filter(ident(key).isNotNull() & ident(value).isNotNull())
             .groupBy(ident(key), ident(value)).agg(F.count("*").alias("_n")))
    return (pairs.groupBy(ident(key))
            .agg(F.sum("_n").alias("n_samples"), F.count("*").alias("n_unique"),
                 F.min(F.struct(-F.col("_n"), ident(value).alias("v")))["v"].alias("most_common"))
            .orderBy(F.desc("n_samples"), ident(key)))


def describe_exact(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count/mean/std/min/quartiles/max per column, quartiles exact."""
    cols = list(cols)
    aggs = []
    for i, c in enumerate(cols):
        x = number(ident(c))
        aggs += [F.count(x).alias(f"n__{i}"), F.avg(x).alias(f"mean__{i}"),
                 F.stddev_samp(x).alias(f"std__{i}"), F.min(x).alias(f"min__{i}"),
                 F.max(x).alias(f"max__{i}")]
    basic = row_to_long(df.agg(*aggs), cols, ["n", "mean", "std", "min", "max"])
    quart = exact_quantiles(df, cols, [0.25, 0.5, 0.75]).select(
        "feature", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"))
    return (basic.join(quart, "feature", "left")
            .select("feature", "n", "mean", "std", "min", "q25", "q50", "q75", "max"))


def column_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean, population deviation and bias-corrected skewness; empty columns skipped."""
    cols = list(cols)
    aggs = []
    for i, c in enumerate(cols):
        x = number(ident(c))
        aggs += [F.count(x).cast("double").alias(f"n__{i}"), F.avg(x).alias(f"mean__{i}"),
                 F.stddev_pop(x).alias(f"std__{i}"), F.skewness(x).alias(f"g1__{i}")]
    long = row_to_long(df.agg(*aggs), cols, ["n", "mean", "std", "g1"])
    n = F.col("n")
    corrected = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(F.col("g1"))
    return long.filter(n > 0).select("feature", "mean", "std", corrected.alias("skewness"))


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Columns that hold nulls or NaN, with their counts."""
    cols = list(cols or df.columns)
    kinds = dict(df.dtypes)
    aggs = []
    for i, c in enumerate(cols):
        bad = ident(c).isNull()
        if kinds[c] in ("double", "float"):
            bad = bad | F.isnan(ident(c))
        aggs.append(F.count_if(bad).alias(f"n_null__{i}"))
    return row_to_long(df.agg(*aggs), cols, ["n_null"]).filter("n_null > 0")


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 20) -> DataFrame:
    """Equal-width counts per feature; the last bin is closed on the right."""
    cols = list(cols)
    bounds = df.agg(*[f(number(ident(c))).alias(f"{n}__{i}")
                      for i, c in enumerate(cols) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    span = {c: (bounds[f"lo__{i}"], bounds[f"hi__{i}"]) for i, c in enumerate(cols)
            if bounds[f"lo__{i}"] is not None}
    lo = {c: F.lit(v[0]) for c, v in span.items()}
    width = {c: F.lit((v[1] - v[0]) or 1.0) for c, v in span.items()}
    long = to_long(df, list(span), extra={"lo": lo, "width": width})
    step = F.floor((F.col("value") - F.col("lo")) / F.col("width") * bins)
    return (long.groupBy("feature", F.least(step, F.lit(bins - 1)).cast("int").alias("bin"))
            .agg(F.count("*").alias("n"),
                 F.first(F.col("lo")).alias("_lo"), F.first(F.col("width")).alias("_w"))
            .select("feature", "bin", (F.col("_lo") + F.col("_w") * F.col("bin") / bins).alias("left"), "n"))


def correlation_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson correlations in one aggregate, no reshaping."""
    cols = list(cols)
    pairs = list(combinations(range(len(cols)), 2))
    row = df.agg(*[F.corr(number(ident(cols[a])), number(ident(cols[b]))).alias(f"r__{i}")
                   for i, (a, b) in enumerate(pairs)])
    items = [F.struct(F.lit(cols[a]).alias("a"), F.lit(cols[b]).alias("b"), F.col(f"r__{i}").alias("r"))
             for i, (a, b) in enumerate(pairs)]
    return row.select(F.inline(F.array(*items)))


def box_stats(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """Quartiles, 1.5-IQR whiskers and outlier counts per group and feature."""
    base = df.filter(ident(group).isNotNull())
    quart = exact_quantiles(base, cols, [0.25, 0.5, 0.75], by=[group]).select(
        ident(group).alias("_g"), F.col("feature").alias("_f"), *[F.col("q")[i].alias(f"q{i}") for i in range(3)])
    quart, _ = small_frame(quart)
    long = to_long(base, cols, keep=[ident(group).alias("_key")])
    lo = F.col("q0") - 1.5 * (F.col("q2") - F.col("q0"))
    hi = F.col("q2") + 1.5 * (F.col("q2") - F.col("q0"))
    inside = F.col("value").between(lo, hi)
    joined = long.join(quart, (F.col("_key") == F.col("_g")) & (F.col("feature") == F.col("_f")))
    return joined.groupBy(F.col("_key").alias(group), "feature").agg(
        F.count("*").alias("n"), F.first("q0").alias("q25"), F.first("q1").alias("q50"),
        F.first("q2").alias("q75"),
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"))


def best_row(df: DataFrame, key: str, metric: str, *, largest: bool) -> DataFrame:
    """The row with the best metric per key, as one aggregate (no window sort)."""
    pick = F.max_by if largest else F.min_by
    rest = [c for c in df.columns if c != key]
    return (df.filter(ident(metric).isNotNull()).groupBy(ident(key))
            .agg(pick(F.struct(*[ident(c) for c in rest]), ident(metric)).alias("_best"))
            .select(ident(key), *[F.col("_best")[c].alias(c) for c in rest]))


def top_n(df: DataFrame, order: Sequence[Column], n: int, by: Sequence[str] = ()) -> DataFrame:
    """First n rows, overall or per key (the per-key form prunes before the shuffle)."""
    if not by:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*[ident(b) for b in by]).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def tagged_union(frames: dict[str, DataFrame], tag: str = "Dataset") -> DataFrame:
    """UNION ALL of named frames, the tag column first."""
    out = None
    for name, frame in frames.items():
        part = frame.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.select(tag, *[ident(c) for c in out.columns if c != tag])
