"""Univariate association tests: every predictor of a kind in one aggregate."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, functions as F, types as T

from riskspark.functions import tails
from riskspark.functions.columns import ident, number
from riskspark.operators.contingency import cell_counts, chi_square
from riskspark.operators.longform import row_to_long, to_long
from riskspark.operators.ranking import ranked_counts
from riskspark.spec import FeatureSpec

RECORD = T.StructType([
    T.StructField("predictor", T.StringType()), T.StructField("predictor_type", T.StringType()),
    T.StructField("test", T.StringType()), T.StructField("statistic_name", T.StringType()),
    T.StructField("statistic_value", T.DoubleType()), T.StructField("p_value", T.DoubleType()),
])


def record(df: DataFrame, test: str, name: Column | str, value: str, kind: Column | str,
           p: str | None = "p_value") -> DataFrame:
    """Shape a per-feature result as association records."""
    def lit(x):
        return x if isinstance(x, Column) else F.lit(x)
    return df.select(
        F.col("feature").alias("predictor"), lit(kind).alias("predictor_type"), F.lit(test).alias("test"),
        lit(name).alias("statistic_name"), F.col(value).alias("statistic_value"),
        (F.col(p) if p else F.lit(None).cast("double")).alias("p_value"))


def kind_of(spec: FeatureSpec) -> Column:
    pairs = [F.lit(x) for c, k in spec.items() for x in (c, k)]
    return F.try_element_at(F.create_map(*pairs), F.col("feature"))


# -- linear: Pearson, point-biserial, simple regression ------------------------
def linear_stats(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """n, r, slope, t and p per numeric predictor, from one wide aggregate row."""
    cols = list(features)
    y = number(ident(target))
    aggs = []
    for i, c in enumerate(cols):
        x = number(ident(c))
        both = x.isNotNull() & y.isNotNull()
        yy = F.when(both, y)
        aggs += [F.regr_count(y, x).cast("double").alias(f"n__{i}"), F.corr(x, y).alias(f"r__{i}"),
                 F.regr_slope(y, x).alias(f"slope__{i}"), F.regr_sxx(y, x).alias(f"sxx__{i}"),
                 F.regr_syy(y, x).alias(f"syy__{i}"),
                 F.min(F.when(both, x)).alias(f"x0__{i}"), F.max(F.when(both, x)).alias(f"x1__{i}"),
                 F.min(yy).alias(f"y0__{i}"), F.max(yy).alias(f"y1__{i}"),
                 F.count_if(both & (x != F.lit(0.0)) & (x != F.lit(1.0))).alias(f"odd__{i}")]
    long = row_to_long(df.agg(*aggs), cols,
                       ["n", "r", "slope", "sxx", "syy", "x0", "x1", "y0", "y1", "odd"])
    r2 = F.col("r") * F.col("r")
    t = F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, F.lit(1.0) - r2))
    exact = F.when(r2 >= 1, F.lit(float("inf"))).otherwise(t)
    out = (long.filter((F.col("n") > 0) & (F.col("x0") < F.col("x1")))
           .withColumn("t", F.when(F.col("n") > 2, exact)))
    return out.withColumn("p_value", tails.p_t(F.col("t"), F.col("n") - 2))


def two_valued(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Columns with exactly two distinct numeric values (count against min and max)."""
    if not features:
        return []
    lo_hi = df.agg(*[f(number(ident(c))).alias(f"{n}{i}") for i, c in enumerate(features)
                     for n, f in (("a", F.min), ("b", F.max))]).first()
    cand = [(i, c) for i, c in enumerate(features) if lo_hi[f"a{i}"] is not None and lo_hi[f"a{i}"] < lo_hi[f"b{i}"]]
    if not cand:
        return []
    other = df.agg(*[F.count_if(~number(ident(c)).isin(lo_hi[f"a{i}"], lo_hi[f"b{i}"])).alias(f"o{i}")
                     for i, c in cand]).first()
    return [c for i, c in cand if other[f"o{i}"] == 0]


def pearson(df, features, target, kind="continuous") -> DataFrame:
    return record(linear_stats(df, features, target), "Pearson correlation", "r", "r", kind)


def point_biserial(df, features, target) -> DataFrame:
    stats = linear_stats(df, features, target)
    keep = two_valued(df.filter(number(ident(target)).isNotNull()), features)
    return record(stats.filter(F.col("feature").isin(keep)), "Point-biserial correlation", "r_pb", "r", "binary")


def simple_regression(df, features, target, spec: FeatureSpec | None = None) -> DataFrame:
    stats = linear_stats(df, features, target).filter(F.col("y0") < F.col("y1"))
    name = F.concat(F.lit("coef["), F.col("feature"), F.lit("]"))
    return record(stats, "Univariate linear regression", name, "slope", kind_of(spec) if spec else "continuous")


def level_stats(df: DataFrame, features: Sequence[str], target: str, *, keep_null: bool = False) -> DataFrame:
    """feature, level, n, mean, var (population) of the target per level."""
    long = to_long(df.filter(number(ident(target)).isNotNull()), features,
                   keep=[number(ident(target)).alias("y")], numeric=False, keep_null=keep_null)
    return long.groupBy("feature", F.col("value").alias("level")).agg(
        F.count("*").cast("double").alias("n"), F.avg("y").alias("mean"), F.var_pop("y").alias("var"))


def dummy_regression(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Least squares on drop-first indicators: one record per level after the first.

    Missing levels count with the base level.
    """
    lv = level_stats(df, features, target, keep_null=True)
    base_name = lv.groupBy("feature").agg(F.min("level").alias("first"))
    lv = lv.join(base_name, "feature")
    is_base = F.col("level").isNull() | (F.col("level") == F.col("first"))
    merged = (lv.withColumn("level", F.when(is_base, F.col("first")).otherwise(F.col("level")))
              .withColumn("is_base", is_base)
              .groupBy("feature", "level", "is_base")
              .agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"),
                   F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("_q"),
                   F.sum(F.col("n") * F.col("var")).alias("_w")))
    merged = merged.withColumn(
        "within", F.col("_w") + F.greatest(F.col("_q") - F.col("n") * F.col("mean") * F.col("mean"), F.lit(0.0)))
    overall = merged.groupBy("feature").agg(F.sum("n").alias("total"), F.count("*").alias("k"),
                                            F.sum("within").alias("sse"))
    base = merged.filter("is_base").select("feature", F.col("mean").alias("m0"), F.col("n").alias("n0"))
    j = merged.filter("NOT is_base").join(overall, "feature").join(base, "feature")
    dof = F.col("total") - F.col("k")
    se = F.sqrt(F.try_divide(F.col("sse"), dof) * (1 / F.col("n") + 1 / F.col("n0")))
    out = (j.withColumn("coef", F.col("mean") - F.col("m0")).withColumn("dof", dof)
           .withColumn("t", F.try_divide(F.col("coef"), se)))
    out = out.withColumn("p_value", tails.p_t(F.col("t"), F.when(F.col("dof") > 0, F.col("dof"))))
    name = F.concat(F.lit("coef["), F.col("feature"), F.lit("_"), F.col("level"), F.lit("]"))
    return record(out, "Univariate linear regression", name, "coef", "categorical")


def anova(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """One-way F and p per categorical feature; levels with a single row are left out."""
    return _anova_of(level_stats(df, features, target).filter("n > 1"))


# -- ranks: Spearman, Kruskal-Wallis ------------------------------------------
def spearman_stats(df: DataFrame, features: Sequence[str], target: str,
                   rows_per_bucket: int | None = None) -> DataFrame:
    """rho, n and p per predictor over its pairwise-complete rows.

    Ranks come from value counts; (x, y) pairs are counted before they meet their
    ranks. Predictors without holes share one ranking of the target.
    """
    feats = list(features)
    y = number(ident(target))
    base = df.filter(y.isNotNull()).select(
        y.alias("_y"), *[number(ident(c)).alias(f"_x{i}") for i, c in enumerate(feats)])
    counts = base.agg(F.count("*").alias("n"), *[F.count(f"_x{i}").alias(f"n{i}") for i in range(len(feats))],
                      *[(F.min(f"_x{i}") < F.max(f"_x{i}")).alias(f"ok{i}") for i in range(len(feats))]).first()
    live = [i for i in range(len(feats)) if counts[f"n{i}"] > 2 and counts[f"ok{i}"]]
    if not live:
        return df.sparkSession.createDataFrame([], "feature string, n double, rho double, p_value double")
    partner = {i: "_y" if counts[f"n{i}"] == counts["n"] else f"_y{i}" for i in live}
    wide = base.withColumns({p: F.when(F.col(f"_x{i}").isNotNull(), F.col("_y"))
                             for i, p in partner.items() if p != "_y"})
    ranked = ranked_counts(wide, [f"_x{i}" for i in live] + sorted(set(partner.values())),
                           rows_per_bucket=rows_per_bucket).select("feature", "value", "avg_rank")
    pairs = (to_long(wide, [f"_x{i}" for i in live],
                     extra={"y": {f"_x{i}": F.col("_y") for i in live},
                            "partner": {f"_x{i}": F.lit(partner[i]) for i in live}})
             .groupBy("feature", "partner", F.col("value").alias("x"), "y").agg(F.count("*").alias("n")))
    rx = ranked.select("feature", F.col("value").alias("x"), F.col("avg_rank").alias("rx"))
    ry = ranked.select(F.col("feature").alias("partner"), F.col("value").alias("y"), F.col("avg_rank").alias("ry"))
    half = F.create_map(*[F.lit(v) for i in live for v in (f"_x{i}", (counts[f"n{i}"] + 1) / 2)])
    j = (pairs.join(rx, ["feature", "x"]).join(ry, ["partner", "y"])
         .withColumn("a", F.col("rx") - half[F.col("feature")]).withColumn("b", F.col("ry") - half[F.col("feature")]))
    n = F.col("n")
    out = j.groupBy("feature").agg(
        F.sum(n).cast("double").alias("n"), F.sum(n * F.col("a") * F.col("b")).alias("ab"),
        F.sum(n * F.col("a") * F.col("a")).alias("aa"), F.sum(n * F.col("b") * F.col("b")).alias("bb"))
    rho = F.try_divide(F.col("ab"), F.sqrt(F.col("aa")) * F.sqrt(F.col("bb")))
    names = F.create_map(*[F.lit(v) for i in live for v in (f"_x{i}", feats[i])])
    out = out.select(names[F.col("feature")].alias("feature"), "n", rho.alias("rho"))
    t = F.when(F.abs("rho") >= 1, F.lit(float("inf"))).otherwise(
        F.col("rho") * F.sqrt((F.col("n") - 2) / (F.lit(1.0) - F.col("rho") * F.col("rho"))))
    return (out.withColumn("_t", t).withColumn("p_value", tails.p_t(F.col("_t"), F.col("n") - 2)).drop("_t"))


def spearman(df, features, target) -> DataFrame:
    return record(spearman_stats(df, features, target), "Spearman correlation", "rho", "rho", "continuous")


def rank_sums(df: DataFrame, features: Sequence[str], label: str, rows_per_bucket: int | None = None) -> DataFrame:
    """feature, label, n, rank_sum, ties (sum of t^3 - t spread over the label's rows)."""
    ranked = ranked_counts(df.filter(ident(label).isNotNull()), features, by=[ident(label).alias("label")],
                           rows_per_bucket=rows_per_bucket)
    tie = F.col("tie").cast("double")
    return ranked.groupBy("feature", "label").agg(
        F.sum("n").cast("double").alias("n"), F.sum(F.col("n") * F.col("avg_rank")).alias("rank_sum"),
        F.sum(F.col("n") * (tie * tie - 1)).alias("ties"))


def kruskal(df: DataFrame, features: Sequence[str], label: str, rows_per_bucket: int | None = None) -> DataFrame:
    """H with tie correction, dof and p per feature."""
    s = rank_sums(df, features, label, rows_per_bucket)
    out = s.groupBy("feature").agg(
        F.sum("n").alias("total"), F.count("*").alias("k"), F.sum("ties").alias("ties"),
        F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("q")).filter("k > 1")
    n = F.col("total")
    h = F.lit(12.0) / (n * (n + 1)) * F.col("q") - 3 * (n + 1)
    out = out.withColumn("statistic", F.try_divide(h, F.lit(1.0) - F.col("ties") / (n * n * n - n)))
    return (out.withColumn("dof", F.col("k") - 1)
            .withColumn("p_value", tails.p_chi2(F.col("statistic"), F.col("dof")))
            .select("feature", "statistic", "dof", "p_value"))


def effect_size(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Between-group over within-group population variance."""
    long = to_long(df.filter(ident(label).isNotNull()), features, keep=[ident(label).alias("label")])
    g = long.groupBy("feature", "label").agg(F.count("*").cast("double").alias("n"), F.avg("value").alias("mean"),
                                             F.var_pop("value").alias("var"))
    grand = g.groupBy("feature").agg(F.sum("n").alias("total"),
                                     (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    gap = F.col("mean") - F.col("grand")
    return (g.join(grand, "feature").groupBy("feature")
            .agg((F.sum(F.col("n") * gap * gap) / F.first("total")).alias("between"),
                 (F.sum(F.col("n") * F.col("var")) / F.first("total")).alias("within"))
            .select("feature", (F.col("between") / (F.col("within") + F.lit(1e-10))).alias("effect_size")))


def feature_significance(df: DataFrame, features: Sequence[str], label: str, *, test: str = "kruskal",
                         alpha: float = 0.05) -> DataFrame:
    """Per feature: statistic, p, effect size and a flag, most significant first."""
    if test == "kruskal":
        stats = kruskal(df, features, label).select("feature", "statistic", "p_value")
    else:
        long = to_long(df.filter(ident(label).isNotNull()), features, keep=[ident(label).alias("label")])
        g = long.groupBy("feature", "label").agg(F.count("*").cast("double").alias("n"),
                                                 F.avg("value").alias("mean"), F.var_pop("value").alias("var"))
        stats = _anova_of(g).select("feature", F.col("F").alias("statistic"), "p_value")
    return (stats.join(effect_size(df, features, label), "feature")
            .withColumn("significant", F.col("p_value") < alpha)
            .orderBy(F.col("p_value").asc_nulls_last(), "feature"))


def _anova_of(g: DataFrame) -> DataFrame:
    grand = g.groupBy("feature").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    gap = F.col("mean") - F.col("grand")
    out = (g.join(grand, "feature").groupBy("feature")
           .agg(F.sum("n").alias("total"), F.count("*").cast("double").alias("k"),
                F.sum(F.col("n") * gap * gap).alias("ssb"), F.sum(F.col("n") * F.col("var")).alias("ssw"))
           .filter("k > 1"))
    d1, d2 = F.col("k") - 1, F.col("total") - F.col("k")
    f = F.when(F.col("ssw") > 0, (F.col("ssb") / d1) / (F.col("ssw") / d2)).when(F.col("ssb") > 0, F.lit(float("inf")))
    out = out.withColumn("F", f).withColumn("d1", d1).withColumn("d2", d2)
    return out.withColumn("p_value", tails.p_f(F.col("F"), F.col("d1"), F.col("d2")))


# -- univariate logistic ------------------------------------------------------
def univariate_logistic(df: DataFrame, features: Sequence[str], target: str, spec: FeatureSpec | None = None, *,
                        max_iter: int = 35, tol: float = 1e-10) -> DataFrame:
    """Odds ratio and Wald p per predictor with two values or more, the last estimate if it does not converge."""
    out = logistic_fits(df, features, target, max_iter=max_iter, tol=tol).withColumn("p_value", tails.p_z(F.col("z")))
    return record(out, "Univariate logistic regression", "odds_ratio", "odds_ratio",
                  kind_of(spec) if spec else "continuous")


def logistic_fits(df: DataFrame, features: Sequence[str], target: str, *, max_iter: int = 35, tol: float = 1e-10) -> DataFrame:
    """feature, beta, odds_ratio, z, converged of a logistic regression on each predictor alone.

    A predictor that separates the classes has no finite estimate: the last one is kept, with ``converged`` false and z as its
    curvature gives it (0 where that is singular). Newton steps for all predictors share one aggregate per iteration; only five
    sums per predictor reach the driver. Left out are predictors with one value, or rows of one class only.
    """
    spark = df.sparkSession
    schema = "feature string, beta double, odds_ratio double, z double, converged boolean"
    levels = df.filter(ident(target).isNotNull()).select(ident(target)).distinct().limit(3).collect()
    if len(levels) != 2 or not features:
        return spark.createDataFrame([], schema)
    positive = max(r[0] for r in levels)
    rows = df.filter(ident(target).isNotNull()).select(
        (ident(target) == F.lit(positive)).cast("double").alias("_y"),
        *[number(ident(c)).alias(f"_x{i}") for i, c in enumerate(features)])
    aggs = []
    for i in range(len(features)):
        x, seen = F.col(f"_x{i}"), F.col(f"_x{i}").isNotNull()
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}"),
                 F.avg(F.when(seen, F.col("_y"))).alias(f"p{i}")]
    base = rows.agg(*aggs).first()
    state, curve, results = {}, {}, []

    def keep(i: int, converged: bool):
        b, hess = state.pop(i), curve.get(i)
        beta = float(b[1] / base[f"s{i}"])
        var = np.linalg.inv(hess)[1, 1] if hess is not None else -1.0
        z = float(b[1] / math.sqrt(var)) if var > 0 and math.isfinite(var) else 0.0
        results.append((features[i], beta, math.exp(beta) if beta < 700 else math.inf, z, converged))

    for i in range(len(features)):
        mean, sd, prev = base[f"m{i}"], base[f"s{i}"], base[f"p{i}"]
        if sd and prev and 0 < prev < 1 and math.isfinite(sd):
            state[i] = np.array([math.log(prev / (1 - prev)), 0.0])
    for _ in range(max_iter):
        if not state:
            break
        aggs = []
        for i, b in state.items():
            u = (F.col(f"_x{i}") - F.lit(base[f"m{i}"])) / F.lit(base[f"s{i}"])
            p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(float(b[0])) + F.lit(float(b[1])) * u)))
            e, w = F.col("_y") - p, p * (F.lit(1.0) - p)
            aggs += [F.sum(F.when(u.isNotNull(), v)).alias(f"{n}{i}") for n, v in
                     (("g", e), ("h", e * u), ("a", w), ("b", w * u), ("c", w * u * u))]
        r = rows.agg(*aggs).first()
        for i in list(state):
            hess = np.array([[r[f"a{i}"], r[f"b{i}"]], [r[f"b{i}"], r[f"c{i}"]]])
            if not np.isfinite(hess).all() or abs(np.linalg.det(hess)) < 1e-12 * hess[0, 0] * hess[1, 1] or hess[0, 0] < 1e-8:
                keep(i, False)
                continue
            curve[i] = hess
            step = np.linalg.solve(hess, np.array([r[f"g{i}"], r[f"h{i}"]]))
            state[i] = state[i] + np.clip(step, -5, 5)
            if np.abs(step).max() < tol * (1 + np.abs(state[i]).max()):
                keep(i, True)
    for i in list(state):
        keep(i, False)
    return spark.createDataFrame(results, schema)


# -- collinearity -------------------------------------------------------------
def vif(df: DataFrame, features: Sequence[str]) -> list[tuple[str, float]]:
    """Variance inflation factor per column from one correlation pass; singular gives inf."""
    rows = df.select(*[number(ident(c)).alias(f"_x{i}") for i, c in enumerate(features)]).na.drop("any")
    if not features:
        return []
    r = rows.agg(F.count("*").alias("n"), *[(F.min(f"_x{i}") < F.max(f"_x{i}")).alias(f"v{i}")
                                           for i in range(len(features))]).first()
    live = [i for i in range(len(features)) if r[f"v{i}"]]
    if r["n"] <= 1 or len(live) <= 1:
        return []
    vec = VectorAssembler(inputCols=[f"_x{i}" for i in live], outputCol="v").transform(rows).select("v")
    corr = Correlation.corr(vec, "v").first()[0].toArray()
    out = []
    for pos, i in enumerate(live):
        rest = [q for q in range(len(live)) if q != pos]
        cross = corr[rest, pos]
        fit, *_ = np.linalg.lstsq(corr[np.ix_(rest, rest)], cross, rcond=1e-12)
        free = 1.0 - float(cross @ fit)
        out.append((features[i], 1.0 / free if free > 1e-12 else math.inf))
    return out


def vif_records(df: DataFrame, spec: FeatureSpec, target: str = "target") -> DataFrame:
    cols = [c for c in df.columns if spec.get(c) == "continuous" and c != target]
    rows = [(c, "continuous", "VIF", "VIF", float(v), None) for c, v in vif(df, cols)]
    return df.sparkSession.createDataFrame(rows, RECORD)


# -- dispatch -----------------------------------------------------------------
def _stack(frames: list[DataFrame], spark) -> DataFrame:
    out = spark.createDataFrame([], RECORD)
    for f in frames:
        out = out.unionByName(f)
    return out


def associations(df: DataFrame, spec: FeatureSpec, target: str = "target") -> DataFrame:
    """All univariate tests that fit the target's kind, smallest p first."""
    kind = spec["target"]
    names = [c for c in df.columns if c != target and c in spec]
    of = {k: [c for c in names if spec[c] == k] for k in ("continuous", "binary", "categorical")}
    frames: list[DataFrame] = []
    if kind == "binary":
        two = df.select(ident(target)).filter(ident(target).isNotNull()).distinct().limit(3).count() == 2
        if of["binary"] and two:
            chi = chi_square(cell_counts(df, of["binary"], target))
            frames.append(record(chi, "Chi-square", "chi2", "chi2", "binary"))
        frames.append(univariate_logistic(df, names, target, spec))
    elif kind == "continuous":
        numeric = of["continuous"] + of["binary"]
        if of["continuous"]:
            frames += [pearson(df, of["continuous"], target), spearman(df, of["continuous"], target)]
        if of["binary"]:
            frames.append(point_biserial(df, of["binary"], target))
        if numeric:
            frames.append(simple_regression(df, numeric, target, spec))
        if of["categorical"]:
            frames.append(dummy_regression(df, of["categorical"], target))
    else:
        raise ValueError(f"target kind {kind!r} is not supported")
    return _stack(frames, df.sparkSession).orderBy(F.col("p_value").asc_nulls_last(), "predictor", "test")


def categorical_associations(df: DataFrame, spec: FeatureSpec, target: str = "target") -> DataFrame:
    """ANOVA (continuous target) or chi-square (binary target) for categorical columns."""
    names = [c for c in df.columns if c != target and spec.get(c) == "categorical"]
    if not names or spec["target"] not in ("continuous", "binary"):
        return df.sparkSession.createDataFrame([], RECORD)
    if spec["target"] == "continuous":
        out = record(anova(df, names, target), "ANOVA", "F", "F", "categorical")
    else:
        out = record(chi_square(cell_counts(df, names, target)), "Chi-square", "chi2", "chi2", "categorical")
    return out.orderBy(F.col("p_value").asc_nulls_last(), "predictor")


def min_p(records: DataFrame) -> DataFrame:
    return records.groupBy("predictor").agg(F.min("p_value").alias("p_value"))


def passing_p(records: DataFrame, limit: float) -> DataFrame:
    """Predictors for which any test is at or under the limit."""
    return min_p(records).filter(F.col("p_value") <= limit)


def passing_vif(records: DataFrame, limit: float) -> DataFrame:
    return records.filter(F.col("statistic_value") <= limit)
