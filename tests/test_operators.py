"""Edge frames, multi-bucket paths and numeric checks against plain NumPy."""

import math
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskspark.functions import columns as C, tails
from riskspark.operators import (association as A, balance as B, clustering as K, contingency as G, density as D,
                                 dimension as M, encode as E, evaluate as V, linear as L, neighbors as N, profile as P,
                                 ranking as R, split as S, tables as T, targets as TG)
from riskspark.operators.models import refined_grid
from riskspark.spec import Domains, FeatureSpec


def values(df, col):
    return [r[0] for r in df.select(col).collect()]


def points(spark, n=300, d=2, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x, spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["id"] + [f"x{j}" for j in range(d)])


# -- scalar functions ---------------------------------------------------------
def test_age_bands_on_dirty_text(spark):
    df = spark.createDataFrame([(v,) for v in ("5", "6", "11.9", "70", "inf", "-3", None, "x")], "age string")
    got = [None if v is None else v.split()[0] for v in values(E.add_age_band(df), "age_bin")]
    assert got == ["Early", "Children", "Children", "Older", None, "Early", None, None]


def test_row_maximum_skips_nulls(spark):
    df = spark.createDataFrame([(None, None), (1.0, 0.0), (float("nan"), 0.0)], "a double, b double")
    assert values(df.select(C.any_flag([F.col("a"), F.col("b")]).alias("m")), "m") == [None, 1.0, 0.0]


def test_bedtime_text(spark):
    df = spark.createDataFrame([("23:30",), ("7:05",), ("25:00",), ("late",)], "bedtime_hour string")
    assert values(E.encode_extras(df), "bedtime_hour") == [23.5, 7 + 5 / 60, None, None]


def test_half_even_and_clip(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (-2.0,), (3.0,)], "x double")
    assert values(df.select(C.half_even(F.col("x")).alias("r")), "r")[:2] == [0.12, 0.38]
    assert values(df.select(C.clip01(F.col("x")).alias("r")), "r") == [0.125, 0.375, 0.0, 1.0]


def test_names():
    assert C.safe_name_text("SVM (RBF)") == "SVM__RBF"
    assert C.tidy_header(" Length N-S ", hyphens=True) == "length_n_s"


# -- tails --------------------------------------------------------------------
def test_tail_probabilities():
    for x, k in ((3.0, 4), (50.0, 8), (400.0, 6)):
        h = x / 2
        exact = math.exp(-h) * sum(h ** i / math.factorial(i) for i in range(k // 2))
        assert tails.chi2_tail(x, k) == pytest.approx(exact, rel=1e-10)
    assert tails.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert tails.f_tail(7.5, 2, 30) == pytest.approx((1 + 15 / 30) ** -15, rel=1e-10)
    assert tails.t_two_sided(1.0, 1) == pytest.approx(0.5, rel=1e-10)
    assert tails.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, rel=1e-9)
    assert tails.z_two_sided(1.959963984540054) == pytest.approx(0.05, rel=1e-9)


# -- ranks and quantiles ------------------------------------------------------
@pytest.mark.parametrize("rows_per_bucket", [None, 40])
def test_exact_quantiles_and_ranks(spark, rows_per_bucket):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.full(150, 2.0), rng.normal(size=250).round(2)])
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    probs = [0, 0.1, 0.25, 0.5, 0.9, 1]
    got = R.quantile_values(df, ["v"], probs, rows_per_bucket)["v"]
    assert got == pytest.approx(list(np.quantile(x, probs)), abs=1e-12)
    ranks = {r["value"]: r["avg_rank"] for r in R.ranked_counts(df, ["v"], rows_per_bucket=rows_per_bucket).collect()}
    order = np.sort(x)
    for v in set(x.tolist()):
        where = np.flatnonzero(order == v) + 1
        assert ranks[v] == pytest.approx(where.mean())


def test_quantile_bins_merge_equal_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 1, 1, 2, 3, 4, 5, 6, 7, 8)], "y double")
    assert values(S.quantile_bins(df, "y"), "stratum") == [0, 0, 0, 0, 1, 1, 2, 2, 3, 3]


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (3.0,), (1.0,), (None,)], "flag double")
    out = E.impute(df, domains=Domains(continuous=(), categorical=(), binary=("flag",), target_sources={}))
    assert values(out, "flag")[-1] == 1.0


def test_impute_all_null_and_text(spark):
    df = spark.createDataFrame([(None, None, "7"), (None, None, "bad")], "b double, c string, n string")
    out = E.impute(df, domains=Domains(continuous=("n",), categorical=("c",), binary=("b",), target_sources={}))
    assert [tuple(r) for r in out.collect()] == [(0.0, "Unknown", 7.0), (0.0, "Unknown", 7.0)]


def test_skewness_is_corrected(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 2, 5, 5)], "x double")
    assert P.column_summary(df, ["x"]).first()["skewness"] == pytest.approx(0.38180, abs=1e-5)


# -- association --------------------------------------------------------------
def test_spearman_with_ties_and_holes(spark):
    pts = [(1, 2), (2, 2), (2, 5), (3, 1), (4, 9)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pts] + [(None, 100.0)], "x double, y double")
    row = A.spearman_stats(df.withColumn("z", F.coalesce("x", F.lit(0.0))), ["x", "z"], "y").filter("feature = 'x'").first()
    assert row["rho"] == pytest.approx(0.289474, abs=1e-6) and row["n"] == 5


def test_chi_square_two_by_two(spark):
    rows = [("a", 0)] * 10 + [("a", 1)] * 20 + [("b", 0)] * 30 + [("b", 1)] * 5
    df = spark.createDataFrame(rows, "x string, y int")
    cells = G.cell_counts(df, ["x"], "y")
    assert G.chi_square(cells, yates=False).first()["chi2"] == pytest.approx(18.7262, abs=1e-4)
    assert G.chi_square(cells).first()["chi2"] < 18.7


def test_logistic_newton_matches_score_equations(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=400)
    y = (rng.uniform(size=400) < 1 / (1 + np.exp(-(0.3 + 0.8 * x)))).astype(int)
    df = spark.createDataFrame([(float(a), int(b), float(b)) for a, b in zip(x, y)], "x double, y int, split double")
    flat = df.withColumn("flat", F.lit(1.0)).withColumn("partly", F.when(F.col("y") == 1, F.abs("x") + 1).otherwise(F.least(F.col("x"), F.lit(1.0))))
    out = sorted(A.univariate_logistic(flat, ["x", "split", "flat", "partly"], "y").collect(), key=lambda r: r["predictor"] != "x")
    assert {r["predictor"] for r in out} == {"x", "split", "partly"}  # separating predictors keep their last estimate
    fits = {r["feature"]: r for r in A.logistic_fits(flat, ["x", "split", "flat", "partly"], "y").collect()}
    assert fits["x"]["converged"] and not fits["split"]["converged"] and not fits["partly"]["converged"]
    assert all(fits[c]["beta"] > 5 and math.isfinite(fits[c]["z"]) for c in ("split", "partly")) and abs(fits["split"]["z"]) < 1
    assert all(0 <= r["p_value"] <= 1 for r in out)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(w[0] + w[1] * x)))
        g = np.array([(y - p).sum(), ((y - p) * x).sum()])
        v = p * (1 - p)
        w += np.linalg.solve(np.array([[v.sum(), (v * x).sum()], [(v * x).sum(), (v * x * x).sum()]]), g)
    assert out[0]["statistic_value"] == pytest.approx(math.exp(w[1]), rel=1e-8)


def test_vif_of_a_copy_is_infinite(spark):
    x, df = points(spark, 200, 2)
    got = dict(A.vif(df.withColumn("copy", F.col("x0") * 2).withColumn("flat", F.lit(1.0)), ["x0", "x1", "copy", "flat"]))
    assert math.isinf(got["x0"]) and math.isinf(got["copy"]) and 1 <= got["x1"] < 1.2 and "flat" not in got


# -- agreement and clusters ---------------------------------------------------
def test_agreement_is_label_free(spark):
    df = spark.createDataFrame([(i % 3, (i + 1) % 3, i % 2) for i in range(60)], "a int, b int, c int")
    same = K.agreement(G.cell_counts(df, ["a"], "b")).first()
    assert same["ari"] == pytest.approx(1.0) and same["nmi"] == pytest.approx(1.0)
    assert abs(G.compare_labelings(df, "a", "c").first()["ari"]) < 0.1


def brute_dbscan(x, eps, m):
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= eps * eps
    core = d.sum(axis=1) >= m
    label = np.where(core, np.arange(len(x)), -1)
    for _ in range(len(x)):
        low = np.array([min([label[i]] + [label[j] for j in np.flatnonzero(d[i] & core)]) if core[i] else -1 for i in range(len(x))])
        if (low == label).all():
            break
        label = low
    return [int(label[i]) if core[i] else min((int(label[j]) for j in np.flatnonzero(d[i] & core)), default=-1) for i in range(len(x))]


@pytest.mark.parametrize("d,eps", [(2, 0.25), (3, 0.5)])
def test_dbscan_against_brute_force(spark, d, eps):
    x, df = points(spark, 250, d, seed=7)
    crowd = np.concatenate([x, np.full((120, d), 0.01) + np.random.default_rng(2).normal(size=(120, d)) * 0.02])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(crowd)], ["id"] + [f"x{j}" for j in range(d)])
    got = {r["id"]: r["cluster"] for r in D.dbscan(df, [f"x{j}" for j in range(d)], "id", eps=eps, min_samples=5).collect()}
    assert [got[i] for i in range(len(crowd))] == brute_dbscan(crowd, eps, 5)


@pytest.mark.parametrize("block", [4096, 50])
def test_nearest_against_brute_force(spark, block):
    x, df = points(spark, 300, 3)
    got = {}
    for r in N.nearest(df, df, ["x0", "x1", "x2"], 4, query_key="id", base_key="id", exclude_self=True,
                       block_rows=block, pivots=8).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["base_id"]))
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1)[:, :4]
    assert all([b for _, b in sorted(got[i])] == list(want[i]) for i in range(300))


@pytest.mark.parametrize("kind", ["line", "levels", "wide"])
def test_nearest_over_many_cells(spark, kind):
    """Cells by their bounds, crowded ones of equal rows, and dimensions in which no cell is ruled out."""
    rng = np.random.default_rng(5)
    x = {"line": rng.normal(size=(900, 1)) + 1e6, "levels": rng.integers(0, 3, size=(900, 2)).astype(float), "wide": rng.normal(size=(900, 30))}[kind]
    names = [f"x{j}" for j in range(x.shape[1])]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["id", *names])
    got = N.nearest(df, df, names, 5, query_key="id", base_key="id", exclude_self=True, block_rows=40).orderBy("query_id", "rank").collect()
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    assert [r["base_id"] for r in got] == np.argsort(d, axis=1, kind="stable")[:, :5].ravel().tolist()


def test_nearest_holds_few_pairs_at_a_time():
    rng = np.random.default_rng(6)
    left, right = (pd.DataFrame({c: np.arange(4096), "v": list(rng.normal(size=(4096, 3)))}) for c in ("query_id", "base_id"))
    tracemalloc.start()
    r, c, d, rank = N._k_nearest(left, right, 5, False)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4096 * 4096 * 8 / 2 and rank.max() == 4 and len(r) == 5 * 4096
    gap = N.squared_distances(np.stack(left["v"][:50]), np.stack(right["v"]))
    assert c[:250].tolist() == np.argsort(gap, axis=1)[:, :5].ravel().tolist()


def test_silhouette_blocks_agree(spark):
    _, df = points(spark, 200, 2)
    df = df.withColumn("label", (F.col("x0") > 0).cast("int"))
    one = K.silhouette(df, ["x0", "x1"], "id", "label").first()[0]
    assert K.silhouette(df, ["x0", "x1"], "id", "label", block_rows=30).first()[0] == pytest.approx(one, abs=1e-12)


def test_silhouette_against_brute_force(spark):
    """Far from the origin, with equal rows, block by block."""
    x, _ = points(spark, 90, 3)
    x = np.concatenate([x, x[:20]]) + 1e4
    label = (x[:, 0] > 1e4).astype(int) + 2 * (x[:, 1] > 1e4)
    df = spark.createDataFrame([(i, *map(float, r), int(c)) for i, (r, c) in enumerate(zip(x, label))], "id long, x0 double, x1 double, x2 double, c int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = {(i, int(c)): d[i, label == c].sum() for i in range(len(x)) for c in np.unique(label)}
    for block in (4096, 5):
        sums = N.cluster_distance_sums(df, ["x0", "x1", "x2"], "id", "c", block_rows=block).collect()
        assert {(r["id"], r["cluster"]): r["total"] for r in sums} == pytest.approx(want, rel=1e-9)


def test_starts_of_kmeans_advance_together(spark):
    """As MLlib's own steps from the same start."""
    from pyspark.ml.clustering import KMeans
    _, df = points(spark, 400, 3)
    fits = {k: [KMeans(k=k, seed=42 + r, maxIter=100).fit(K.assemble(df, ["x0", "x1", "x2"])).summary.trainingCost for r in range(2)] for k in (3, 5)}
    got = K.kmeans_sweep(df, ["x0", "x1", "x2"], "id", [3, 5], restarts=2, parallelism=1).collect()
    assert [r["inertia"] for r in got] == pytest.approx([min(fits[k]) for k in (3, 5)], rel=1e-9)
    assert all(r["silhouette"] is None and 0 < r["silhouette_squared"] < 1 for r in got)


def test_ward_merge_separates_groups():
    c = np.array([[0, 0], [0, 1], [10, 10], [10, 11], [50, 0]], float)
    code = K.ward_merge(c, np.ones(5), 3)
    assert code[0] == code[1] and code[2] == code[3] and len(set(code)) == 3


# -- dimension, linear --------------------------------------------------------
def test_components_and_canonical(spark):
    x, df = points(spark, 300, 4)
    x[:, 3] = x[:, 0] + 0.1 * x[:, 3]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["id", "x0", "x1", "x2", "x3"])
    cols = ["x0", "x1", "x2", "x3"]
    parts = M.principal_components(df, cols, 4, keep=["id"])
    s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2
    assert parts.ratio == pytest.approx(list(s / s.sum()), rel=1e-8)
    can = M.canonical_correlation(df, ["x0", "x1"], ["x2", "x3"], 2, keep=["id"])
    a = np.array([[r["X1"], r["Y1"]] for r in can.variates.collect()])
    assert np.corrcoef(a.T)[0, 1] == pytest.approx(can.correlations[0], rel=1e-8)
    assert a.std(axis=0, ddof=1) == pytest.approx([1, 1], rel=1e-8)


def test_ridge_closed_form_and_cv(spark):
    x, df = points(spark, 200, 3)
    df = df.withColumn("y", F.col("x0") * 2 - F.col("x1") + 0.5)
    w, b = L.multi_ridge(df, ["x0", "x1", "x2"], ["y"], 3.0)
    xc = x - x.mean(axis=0)
    y = 2 * x[:, 0] - x[:, 1] + 0.5
    assert w[:, 0] == pytest.approx(np.linalg.solve(xc.T @ xc + 3 * np.eye(3), xc.T @ (y - y.mean())), rel=1e-8)
    cv = L.ridge_cv(S.stratified_folds(df, ["id"]), ["x0", "x1", "x2"], ["y"])
    assert cv.count() == 9 and cv.agg(F.max("mean_r2")).first()[0] > 0.999


# -- splits, balance, metrics -------------------------------------------------
def test_folds_and_split_are_even(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(100)], "id long, y int")
    sizes = S.stratified_folds(df, ["id"], ["y"]).groupBy("y", "fold").count().collect()
    for y in range(3):
        n = [r["count"] for r in sizes if r["y"] == y]
        assert len(n) == 5 and max(n) - min(n) <= 1
    assert S.stratified_split(df, ["id"], ["y"]).filter("is_test").count() == 7 + 7 + 7  # of 34, 33 and 33 rows


def test_balancing_evens_classes(spark):
    x, df = points(spark, 90, 2)
    df = df.withColumn("y", (F.col("id") % 9 == 0).cast("int"))
    for s in ("oversample", "undersample", "smote"):
        n = B.class_counts(B.balance(df, s, key="id", label="y", features=["x0", "x1"]), "y")
        assert n[0] == n[1]
    with pytest.raises(ValueError):
        B.balance(df, "adasyn", key="id", label="y", features=["x0"])


def test_metrics_zero_division(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "y int, p int")
    r = V.classification_metrics(df, "y", "p").first()
    assert (r["Precision"], r["Recall"], r["F1"], r["Accuracy"]) == (0, 0, 0, 0.5)


def test_refined_grid():
    assert refined_grid({"n_estimators": 100, "max_depth": None}) == {"n_estimators": [80, 90, 100, 110, 120], "max_depth": [None]}
    assert refined_grid({"n_neighbors": 3}) == {"n_neighbors": [1, 3, 5]}
    assert refined_grid({"gamma": "scale"}) == {"gamma": ["scale"]}


# -- targets, tables ----------------------------------------------------------
def test_target_rules(spark):
    df = spark.createDataFrame([(1.0, None), (None, None)], "i_united_heart double, GHQ12_case double")
    spec = FeatureSpec(i_united_heart="binary", GHQ12_case="binary")
    assert TG.derive_target(df, "cardiovascular", spec).df.count() == 1
    assert values(TG.derive_target(df, "mental_health", spec, drop_null_rows=False).df, "target") == [0.0, 0.0]
    with pytest.raises(ValueError):
        TG.derive_target(df, "teeth", spec)


def test_join_refuses_shared_columns(spark):
    a = spark.createDataFrame([(1, 2)], "k int, v int")
    with pytest.raises(ValueError):
        T.checked_join(a, a, "k")


def test_grid_has_168_rows_per_cell_and_no_join(spark):
    grid = spark.createDataFrame([(1, "A"), (2, "B")], "id int, typology string")
    out = T.with_socio_combinations(grid)
    assert out.count() == 336
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


# -- no caps ------------------------------------------------------------------
def test_three_thousand_levels_are_coded(spark):
    df = spark.range(6000).select("id", F.format_string("v%04d", F.col("id") % 3000).alias("v"))
    codes = E.LevelCodes.fit(df, ["v"])
    got = codes.transform(df).agg(F.countDistinct("v"), F.min("v"), F.max("v")).first()
    assert tuple(got) == (3000, 0, 2999)
    assert values(codes.transform(spark.createDataFrame([("nowhere",), (None,)], "v string")), "v") == [None, None]


def test_twelve_hundred_folds_all_count(spark):
    df = spark.range(6000).select(F.rand(1).alias("x"), (F.col("id") % 1200).alias("fold")).withColumn("y", 2 * F.col("x") + 1)
    got = {r["alpha"]: r["mean_r2"] for r in L.ridge_cv(df, ["x"], ["y"], alphas=[1e-6]).collect()}
    assert got[1e-6] > 0.999


def test_silhouette_of_one_cluster(spark):
    _, df = points(spark, 20)
    assert K.silhouette(df.withColumn("c", F.lit(0)), ["x0", "x1"], "id", "c").first()[0] == -1


def test_undefined_risk_is_null(spark):
    df = spark.createDataFrame([(float("nan"),), (2.0,), (-1.0,), (0.5,), (None,)], "x double")
    assert values(df.select(C.clip01(F.col("x")).alias("x")), "x") == [None, 1.0, 0.0, 0.5, None]
