"""Classification and regression metrics, thresholds, reports - all as aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F

from riskspark.functions.columns import ident, number
from riskspark.operators.association import rank_sums
from riskspark.operators.ranking import quantile_values


SYMMETRIC_GAP = 0.05


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Accuracy, precision, recall, F1 of class 1; an empty denominator gives 0."""
    y, p = ident(label) == 1, ident(prediction) == 1
    c = df.agg(F.count("*").alias("n"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
               F.count_if(y & ~p).alias("fn"), F.count_if(y == p).alias("hit"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(_ratio(F.col("hit"), F.col("n")).alias("Accuracy"), _ratio(tp, tp + fp).alias("Precision"),
                    _ratio(tp, tp + fn).alias("Recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("F1"))


def roc_auc(df: DataFrame, label: str, score: str, rows_per_bucket: int | None = None) -> DataFrame:
    """Exact area from average ranks (ties count half); null with one class only."""
    s = rank_sums(df.select((ident(label) == 1).cast("int").alias("_y"), ident(score).alias("_s")), ["_s"], "_y",
                  rows_per_bucket)
    c = s.agg(F.sum(F.when(F.col("label") == 1, F.col("rank_sum"))).alias("r1"),
              F.sum(F.when(F.col("label") == 1, F.col("n"))).alias("n1"),
              F.sum(F.when(F.col("label") == 0, F.col("n"))).alias("n0"))
    n1, n0 = F.col("n1"), F.col("n0")
    return c.select(F.try_divide(F.col("r1") - n1 * (n1 + 1) / 2, n1 * n0).alias("ROC_AUC"))


def roc_auc_ovr(df: DataFrame, label: str, scores: dict, rows_per_bucket: int | None = None) -> float | None:
    """Support-weighted one-vs-rest area; ``scores`` maps class -> score column."""
    total = weighted = 0.0
    for value, column in scores.items():
        binary = df.select((ident(label) == value).cast("int").alias("y"), ident(column).alias("s"))
        n = binary.agg(F.sum("y")).first()[0] or 0
        auc = roc_auc(binary, "y", "s", rows_per_bucket).first()[0]
        if auc is None:
            return None
        total, weighted = total + n, weighted + n * auc
    return weighted / total if total else None


def confusion(df: DataFrame, actual: str, predicted: str, levels: Sequence, *, normalize: bool = False) -> DataFrame:
    out = df.groupBy(F.concat(F.lit("Actual_"), ident(actual).cast("string")).alias("actual")).agg(
        *[F.count_if(ident(predicted) == v).alias(f"Pred_{v}") for v in levels], F.count("*").alias("_n"))
    if normalize:
        out = out.withColumns({f"Pred_{v}": F.col(f"Pred_{v}") / F.col("_n") for v in levels})
    return out.drop("_n")


def class_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Per class: precision, recall, F1 and support."""
    cells = df.groupBy(ident(actual).alias("a"), ident(predicted).alias("p")).agg(F.count("*").alias("n"))
    hit = F.sum(F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0))
    by_actual = cells.groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("support"), hit.alias("tp"))
    by_pred = cells.groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("called"))
    j = by_actual.join(by_pred, "class", "outer").na.fill(0, ["support", "tp", "called"])
    tp = F.col("tp")
    return j.select("class", _ratio(tp, F.col("called")).alias("precision"), _ratio(tp, F.col("support")).alias("recall"),
                    _ratio(2 * tp, F.col("called") + F.col("support")).alias("f1"), "support")


def weighted_f1(report: DataFrame) -> DataFrame:
    return report.agg((F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
                      F.avg("f1").alias("f1_macro"))


def regression_metrics(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    e = ident(label) - ident(prediction)
    g = df.groupBy(*[ident(b) for b in by]) if by else df.groupBy()
    return g.agg(F.sqrt(F.avg(e * e)).alias("RMSE"), F.avg(F.abs(e)).alias("MAE"),
                 (F.lit(1.0) - F.try_divide(F.avg(e * e), F.var_pop(ident(label)))).alias("R2"))


def multi_output_r2(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Uniform average of R2 and root mean squared error over several outputs."""
    r2, mse = [], []
    for y, p in pairs:
        e = ident(y) - ident(p)
        mse.append(F.avg(e * e))
        r2.append(F.lit(1.0) - F.try_divide(F.avg(e * e), F.var_pop(ident(y))))
    return df.agg((sum(r2[1:], r2[0]) / len(pairs)).alias("r2"), F.sqrt(sum(mse[1:], mse[0]) / len(pairs)).alias("rmse"))


def residual_table(df: DataFrame, label: str, prediction: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*[ident(k) for k in keep], ident(prediction).alias("pred"),
                     (ident(label) - ident(prediction)).alias("resid"))


def threshold_curve(df: DataFrame, label: str, score: str, points: int = 101,
                    rows_per_bucket: int | None = None) -> DataFrame:
    """F1 of ``score >= threshold`` at each distinct score quantile.

    One pass counts labels between neighbouring thresholds; the running totals run
    over at most ``points`` numbers.
    """
    probs = [i / (points - 1) for i in range(points)]
    values = quantile_values(df, [score], probs, rows_per_bucket).get(score, [])
    edges = sorted({v for v in values if v is not None})
    spark = df.sparkSession
    if not edges:
        return spark.createDataFrame([], "threshold double, tp long, fp long, fn long, f1 double")
    rows = df.select(number(ident(score)).alias("_s"), (ident(label) == 1).cast("int").alias("_y")).na.drop("any")
    binned = Bucketizer(splits=[-math.inf, *edges, math.inf], inputCol="_s", outputCol="_b").transform(rows)
    counts = {(int(r["_b"]), r["_y"]): r["n"] for r in
              binned.groupBy("_b", "_y").agg(F.count("*").alias("n")).collect()}
    positives = sum(n for (_, y), n in counts.items() if y == 1)
    out, tp, fp = [], 0, 0
    for i in range(len(edges), 0, -1):
        tp += counts.get((i, 1), 0)
        fp += counts.get((i, 0), 0)
        fn = positives - tp
        out.append((float(edges[i - 1]), tp, fp, fn, 2 * tp / (2 * tp + fp + fn) if tp else 0.0))
    return spark.createDataFrame(out, "threshold double, tp long, fp long, fn long, f1 double")


def best_threshold(curve: DataFrame, default: float = 0.5) -> float:
    """Lowest threshold with the highest F1."""
    row = curve.orderBy(F.desc("f1"), F.asc("threshold")).first()
    return row["threshold"] if row else default


def relative_strength(coefs: DataFrame, by: Sequence[str] = ("Dataset", "model")) -> DataFrame:
    """|coef| over the mean |coef| of the same dataset and model (mean 0 gives 0)."""
    keys = [b for b in by if b in coefs.columns]
    mean = coefs.groupBy(*[ident(k) for k in keys]).agg(F.avg(F.abs("coefficient")).alias("_m"))
    j = coefs.join(mean, keys) if keys else coefs.withColumn("_m", F.lit(mean.first()["_m"]))
    return (j.withColumn("abs_coef", F.abs("coefficient"))
            .withColumn("rel_to_mean_abs", F.when(F.col("_m") == 0, F.lit(0.0)).otherwise(F.col("abs_coef") / F.col("_m")))
            .drop("_m"))


def linear_attributions(df: DataFrame, weights: dict[str, float], keep: Sequence[str] = ()) -> DataFrame:
    """Additive attributions w * (x - mean) per feature."""
    row = df.agg(*[F.avg(number(ident(c))).alias(f"m{i}") for i, c in enumerate(weights)]).first()
    return df.select(*[ident(k) for k in keep],
                     *[((number(ident(c)) - F.lit(row[f"m{i}"])) * F.lit(float(w))).alias(c)
                       for i, (c, w) in enumerate(weights.items())])


def mean_abs_attribution(attributions: DataFrame, features: Sequence[str]) -> DataFrame:
    row = attributions.agg(*[F.avg(F.abs(ident(c))).alias(c) for c in features])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), ident(c).alias("importance"))
                                         for c in features])))


def direction_summary(spark, forward: float, backward: float, names: Sequence[str], models: Sequence[str]) -> DataFrame:
    """Cross-view prediction in both directions with a verdict (gap under 0.05 is symmetric)."""
    gap = abs(forward - backward)
    if gap < SYMMETRIC_GAP:
        verdict = "symmetric"
    else:
        verdict = "forward is easier" if forward > backward else "backward is easier"
    rows = [(n, m, float(f), gap, verdict) for n, m, f in zip(names, models, (forward, backward))]
    return spark.createDataFrame(rows, "direction string, model string, f1 double, difference double, verdict string")
