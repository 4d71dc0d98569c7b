"""Splits, balancing, neighbours, metrics and fitted models."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from riskspark.operators import balance as B, evaluate as V, models as M, neighbors as N, split as S
from riskspark.queries.registry import Tables, component, query, rounded

DIMS = [f"d{i}" for i in range(4)]


def _points(t: Tables, n: int = 4):
    return component(t.embeddings.select("vec_id", "label", "embedding"), "embedding", range(n), "d").drop("embedding")


def _scored(t: Tables):
    """quality with a length-based score in [0, 1]."""
    docs = t.documents.select("doc_id", "n_chars")
    low, high = docs.agg(F.min("n_chars"), F.max("n_chars")).first()
    rows = t.labels.join(docs, "doc_id")
    return rows.select("doc_id", "quality", "toxic", ((F.col("n_chars") - low) / (high - low)).alias("score"))


_SCORED = """
b AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents),
s AS (SELECT doc_id, quality, toxic, (n_chars - lo) / (hi - lo)::double AS score FROM labels JOIN documents USING (doc_id), b)"""


@query("stratified_split", """
WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::varchar || '42'), doc_id::varchar) AS rn,
  count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT doc_id, quality, rn <= floor(n * 0.2 + 0.5) AS is_test FROM r""")
def stratified_split(t: Tables):
    return S.stratified_split(t.labels.select("doc_id", "quality"), ["doc_id"], ["quality"])


@query("stratified_folds", """
WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::varchar || 'fold42'), doc_id::varchar) AS rn,
  count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT doc_id, quality, ((rn - 1) * 5 // n)::int AS fold FROM r""")
def stratified_folds(t: Tables):
    return S.stratified_folds(t.labels.select("doc_id", "quality"), ["doc_id"], ["quality"])


@query("shuffled_folds", """
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey::varchar || 'fold42'), o_orderkey::varchar) AS rn, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, ((rn - 1) * 5 // n)::int AS fold FROM r""")
def shuffled_folds(t: Tables):
    return S.stratified_folds(t.orders.select("o_orderkey"), ["o_orderkey"])


@query("class_weights", """
SELECT doc_id, quality, round(count(*) OVER () / (2.0::double * count(*) OVER (PARTITION BY quality)), 6) AS weight FROM labels""")
def class_weights(t: Tables):
    return rounded(S.with_class_weight(t.labels.select("doc_id", "quality"), "quality"))


_OVER = """
WITH c AS (SELECT quality, count(*) AS n, max(count(*)) OVER () AS top FROM labels GROUP BY 1),
 r AS (SELECT doc_id, quality, n, top, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::varchar || '{salt}'), doc_id::varchar) AS rn FROM labels JOIN c USING (quality))"""


@query("oversample", _OVER.format(salt="over42") + """
SELECT doc_id, quality, unnest(generate_series(1, top // n + (rn <= top % n)::int))::int AS _copy FROM r""")
def oversample(t: Tables):
    return B.oversample(t.labels.select("doc_id", "quality"), ["doc_id"], "quality")


@query("undersample", _OVER.format(salt="under42") + """
SELECT doc_id, quality FROM r WHERE rn <= (SELECT min(n) FROM c)""")
def undersample(t: Tables):
    return B.undersample(t.labels.select("doc_id", "quality"), ["doc_id"], "quality")


_U = "('0x' || substr(md5({id}::varchar || '|' || c::varchar || '|{salt}42'), 1, 8))::bigint / 4294967296.0::double"


@query("smote_points", f"""
WITH p AS (SELECT vec_id, label, embedding[1]::double AS d0, embedding[2]::double AS d1, embedding[3]::double AS d2, embedding[4]::double AS d3 FROM embeddings),
 c AS (SELECT label, count(*) AS n, max(count(*)) OVER () AS top FROM p GROUP BY 1),
 r AS (SELECT p.*, n, top - n AS need, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::varchar || 'smote42'), vec_id::varchar) AS rn FROM p JOIN c USING (label)),
 w AS (SELECT *, unnest(generate_series(1, need // n + (rn <= need % n)::int)) AS c FROM r WHERE need > 0),
 nn AS (SELECT a.vec_id AS q, b.vec_id AS nb, b.d0, b.d1, b.d2, b.d3, row_number() OVER (PARTITION BY a.vec_id ORDER BY
   list_distance([a.d0, a.d1, a.d2, a.d3], [b.d0, b.d1, b.d2, b.d3]), b.vec_id) AS k FROM p a JOIN p b ON a.label = b.label AND a.vec_id <> b.vec_id),
 m AS (SELECT w.*, floor({_U.format(id='vec_id', salt='n')} * 5)::int + 1 AS k, {_U.format(id='vec_id', salt='u')} AS u FROM w)
SELECT vec_id, label, round(d0, 6) AS d0, round(d1, 6) AS d1, round(d2, 6) AS d2, round(d3, 6) AS d3, NULL::bigint AS base_id, NULL::bigint AS neighbor_id, NULL::double AS step FROM p
UNION ALL SELECT NULL, label, round(m.d0 + u * (nn.d0 - m.d0), 6), round(m.d1 + u * (nn.d1 - m.d1), 6), round(m.d2 + u * (nn.d2 - m.d2), 6),
  round(m.d3 + u * (nn.d3 - m.d3), 6), vec_id, nb, round(u, 6) FROM m JOIN nn ON nn.q = m.vec_id AND nn.k = m.k""")
def smote_points(t: Tables):
    return rounded(B.smote(_points(t), "vec_id", "label", DIMS))


_KNN = """
WITH p AS (SELECT vec_id, label, embedding::double[] AS v FROM embeddings),
 r AS (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::varchar || '42'), vec_id::varchar) <= floor(count(*) OVER (PARTITION BY label) * 0.2 + 0.5) AS is_test FROM p),
 n AS (SELECT a.vec_id AS query_id, b.label AS y, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS k
   FROM p a JOIN r ra ON ra.vec_id = a.vec_id AND ra.is_test, p b JOIN r rb ON rb.vec_id = b.vec_id AND NOT rb.is_test)"""


def _split_points(t: Tables):
    pts = _points(t, 64)
    parts = S.stratified_split(pts, ["vec_id"], ["label"])
    return parts.filter("is_test"), parts.filter("NOT is_test"), [f"d{i}" for i in range(64)]


@query("knn_vote", _KNN + """,
 c AS (SELECT query_id, y, count(*) AS n FROM n WHERE k <= 5 GROUP BY 1, 2)
SELECT query_id, (array_agg(y ORDER BY n DESC, y))[1] AS prediction, round(max(n) / sum(n)::double, 6) AS share FROM c GROUP BY 1""")
def knn_vote(t: Tables):
    test, train, dims = _split_points(t)
    return rounded(N.knn_vote(test, train, dims, "label", 5, query_key="vec_id", base_key="vec_id"))


@query("knn_mean", _KNN + "SELECT query_id, round(avg(y), 6) AS prediction FROM n WHERE k <= 7 GROUP BY 1")
def knn_mean(t: Tables):
    test, train, dims = _split_points(t)
    return rounded(N.knn_mean(test, train, dims, "label", 7, query_key="vec_id", base_key="vec_id"))


@query("threshold_curve", f"""
WITH {_SCORED},
 q AS (SELECT DISTINCT unnest(quantile_cont(score, [{', '.join(f'{i / 100}' for i in range(101))}])) AS threshold FROM s),
 c AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold AND quality = 1) AS tp, count(*) FILTER (WHERE score >= threshold AND quality = 0) AS fp,
   count(*) FILTER (WHERE score < threshold AND quality = 1) AS fn FROM q, s GROUP BY 1)
SELECT round(threshold, 6) AS threshold, tp, fp, fn, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 0), 6) AS f1 FROM c""")
def threshold_curve(t: Tables):
    return rounded(V.threshold_curve(_scored(t), "quality", "score"))


@query("threshold_best", f"""
WITH {_SCORED},
 q AS (SELECT DISTINCT unnest(quantile_cont(score, [{', '.join(f'{i / 100}' for i in range(101))}])) AS threshold FROM s),
 c AS (SELECT threshold, 2.0::double * count(*) FILTER (WHERE score >= threshold AND quality = 1) /
   (count(*) FILTER (WHERE score >= threshold) + (SELECT sum(quality) FROM s)) AS f1 FROM q, s GROUP BY 1)
SELECT round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM c ORDER BY c.f1 DESC, c.threshold LIMIT 1""")
def threshold_best(t: Tables):
    curve = V.threshold_curve(_scored(t), "quality", "score")
    return rounded(curve.orderBy(F.desc("f1"), "threshold").limit(1).select("threshold", "f1"))


@query("class_metrics", f"""
WITH {_SCORED}, p AS (SELECT quality AS y, (score >= 0.1)::int AS p FROM s),
 c AS (SELECT count(*)::double AS n, sum((y = p)::int) AS hit, sum(y * p) AS tp, sum((1 - y) * p) AS fp, sum(y * (1 - p)) AS fn FROM p)
SELECT round(hit / n, 6) AS "Accuracy", round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "Precision",
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS "Recall", round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS "F1" FROM c""")
def class_metrics(t: Tables):
    return rounded(V.classification_metrics(_scored(t).withColumn("p", (F.col("score") >= 0.1).cast("int")), "quality", "p"))


@query("roc_auc", f"""
WITH {_SCORED}, r AS (SELECT quality, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::double AS rk FROM s),
 c AS (SELECT sum(rk) FILTER (WHERE quality = 1) AS r1, count(*) FILTER (WHERE quality = 1)::double AS n1, count(*) FILTER (WHERE quality = 0)::double AS n0 FROM r)
SELECT round((r1 - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS "ROC_AUC" FROM c""")
def roc_auc(t: Tables):
    return rounded(V.roc_auc(_scored(t), "quality", "score"))


_CALL = "(o_totalprice > 250000)::int + (o_totalprice > 400000)::int"
_TRUTH = "CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END"


def _called(t: Tables):
    price = F.col("o_totalprice")
    truth = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return t.orders.select(truth.alias("y"), ((price > 250000).cast("int") + (price > 400000).cast("int")).alias("p"))


@query("confusion", f"""
SELECT 'Actual_' || y::varchar AS actual, count(*) FILTER (WHERE p = 0) AS "Pred_0", count(*) FILTER (WHERE p = 1) AS "Pred_1", count(*) FILTER (WHERE p = 2) AS "Pred_2"
FROM (SELECT {_TRUTH} AS y, {_CALL} AS p FROM orders) GROUP BY y""")
def confusion(t: Tables):
    return V.confusion(_called(t), "y", "p", [0, 1, 2])


@query("confusion_shares", f"""
SELECT 'Actual_' || y::varchar AS actual, round(avg((p = 0)::int), 6) AS "Pred_0", round(avg((p = 1)::int), 6) AS "Pred_1", round(avg((p = 2)::int), 6) AS "Pred_2"
FROM (SELECT {_TRUTH} AS y, {_CALL} AS p FROM orders) GROUP BY y""")
def confusion_shares(t: Tables):
    return rounded(V.confusion(_called(t), "y", "p", [0, 1, 2], normalize=True))


_REPORT = f"""
WITH c AS (SELECT {_TRUTH} AS y, {_CALL} AS p FROM orders),
 r AS (SELECT k AS class, count(*) FILTER (WHERE y = k AND p = k)::double AS tp, count(*) FILTER (WHERE p = k) AS called, count(*) FILTER (WHERE y = k) AS support
   FROM c, (VALUES (0), (1), (2)) v(k) GROUP BY k)"""


@query("class_report", _REPORT + """
SELECT class, round(coalesce(tp / nullif(called, 0), 0), 6) AS precision, round(coalesce(tp / nullif(support, 0), 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(called + support, 0), 0), 6) AS f1, support FROM r""")
def class_report(t: Tables):
    return rounded(V.class_report(_called(t), "y", "p"))


@query("weighted_f1", _REPORT + """
SELECT round(sum(2 * tp / (called + support) * support) / sum(support), 6) AS f1_weighted, round(avg(2 * tp / (called + support)), 6) AS f1_macro FROM r""")
def weighted_f1(t: Tables):
    return rounded(V.weighted_f1(V.class_report(_called(t), "y", "p")))


_OLS = "p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS y, m.b * l_quantity + m.a AS p FROM lineitem, (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem) m)"


def _ols(t: Tables):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.col("l_extendedprice").alias("y"))
    b, a = li.agg(F.regr_slope("y", "l_quantity"), F.regr_intercept("y", "l_quantity")).first()
    return li.withColumn("p", F.col("l_quantity") * b + a)


@query("regression_metrics", f"WITH {_OLS} SELECT round(sqrt(avg((y - p) ** 2)), 4) AS \"RMSE\", round(avg(abs(y - p)), 4) AS \"MAE\", round(1 - avg((y - p) ** 2) / var_pop(y), 4) AS \"R2\" FROM p")
def regression_metrics(t: Tables):
    return rounded(V.regression_metrics(_ols(t), "y", "p"), 4)


@query("residuals", f"WITH {_OLS} SELECT l_orderkey, l_linenumber, l_partkey, round(p, 3) AS pred, round(y - p, 3) AS resid FROM p")
def residuals(t: Tables):
    return rounded(V.residual_table(_ols(t), "y", "p", ["l_orderkey", "l_linenumber", "l_partkey"]), 3)


@query("multi_output_r2", """
WITH m AS (SELECT avg(l_tax) AS t, avg(l_discount) AS d FROM lineitem),
 e AS (SELECT l_tax, l_discount, t * (0.5::double + l_quantity / 50) AS pt, d * (1.5::double - l_quantity / 50) AS pd FROM lineitem, m)
SELECT round((1 - avg((l_tax - pt) ** 2) / var_pop(l_tax) + 1 - avg((l_discount - pd) ** 2) / var_pop(l_discount)) / 2, 6) AS r2,
  round(sqrt((avg((l_tax - pt) ** 2) + avg((l_discount - pd) ** 2)) / 2), 6) AS rmse FROM e""")
def multi_output_r2(t: Tables):
    li = t.lineitem.select("l_tax", "l_discount", "l_quantity")
    a, b = li.agg(F.avg("l_tax"), F.avg("l_discount")).first()
    rows = (li.withColumn("pt", F.lit(a) * (F.col("l_quantity") / 50 + 0.5))
            .withColumn("pd", F.lit(b) * (F.lit(1.5) - F.col("l_quantity") / 50)))
    return rounded(V.multi_output_r2(rows, [("l_tax", "pt"), ("l_discount", "pd")]))


_COEF = "c AS (SELECT l_returnflag AS \"Dataset\", l_linestatus AS model, l_linenumber::varchar AS feature, avg(l_discount) - 0.05::double AS coefficient FROM lineitem GROUP BY 1, 2, 3)"


def _coefs(t: Tables):
    return t.lineitem.groupBy(F.col("l_returnflag").alias("Dataset"), F.col("l_linestatus").alias("model"),
                              F.col("l_linenumber").cast("string").alias("feature")).agg(
        (F.avg("l_discount") - 0.05).alias("coefficient"))


@query("relative_strength", f"""
WITH {_COEF} SELECT "Dataset", model, feature, round(coefficient, 6) AS coefficient, round(abs(coefficient), 6) AS abs_coef,
 round(abs(coefficient) / avg(abs(coefficient)) OVER (PARTITION BY "Dataset", model), 4) AS rel_to_mean_abs FROM c""")
def relative_strength(t: Tables):
    out = V.relative_strength(_coefs(t))
    return out.withColumns({"coefficient": F.round("coefficient", 6), "abs_coef": F.round("abs_coef", 6),
                            "rel_to_mean_abs": F.round("rel_to_mean_abs", 4)})


_SHAP = "w AS (SELECT regr_slope(l_extendedprice, l_quantity) AS wq, regr_slope(l_extendedprice, l_discount) AS wd, avg(l_quantity) AS mq, avg(l_discount) AS md FROM lineitem)"


def _shap(t: Tables):
    wq, wd = t.lineitem.agg(F.regr_slope("l_extendedprice", "l_quantity"), F.regr_slope("l_extendedprice", "l_discount")).first()
    return V.linear_attributions(t.lineitem, {"l_quantity": wq, "l_discount": wd}, ["l_orderkey", "l_linenumber", "l_partkey"])


@query("linear_shap", f"WITH {_SHAP} SELECT l_orderkey, l_linenumber, l_partkey, round(wq * (l_quantity - mq), 3) AS l_quantity, round(wd * (l_discount - md), 3) AS l_discount FROM lineitem, w")
def linear_shap(t: Tables):
    return rounded(_shap(t), 3)


@query("shap_importance", f"""
WITH {_SHAP}, i AS (SELECT avg(abs(wq * (l_quantity - mq))) AS q, avg(abs(wd * (l_discount - md))) AS d FROM lineitem, w)
SELECT 'l_quantity' AS feature, round(q, 4) AS importance FROM i UNION ALL SELECT 'l_discount', round(d, 4) FROM i""")
def shap_importance(t: Tables):
    return rounded(V.mean_abs_attribution(_shap(t), ["l_quantity", "l_discount"]), 4)


@query("direction_summary", """
WITH f AS (SELECT avg((toxic = quality)::int)::double AS a, avg(quality)::double AS b FROM labels)
SELECT d AS direction, m AS model, round(CASE d WHEN 'x to y' THEN a ELSE b END, 6) AS f1, round(abs(a - b), 6) AS difference,
 CASE WHEN abs(a - b) < 0.05 THEN 'symmetric' WHEN a > b THEN 'forward is easier' ELSE 'backward is easier' END AS verdict
FROM f, (VALUES ('x to y', 'forest'), ('y to x', 'logistic')) v(d, m)""")
def direction_summary(t: Tables):
    a, b = t.labels.agg(F.avg((F.col("toxic") == F.col("quality")).cast("int")), F.avg("quality")).first()
    return rounded(V.direction_summary(t.spark, a, b, ["x to y", "y to x"], ["forest", "logistic"]))


# -- fitted models (checked by rows and by unit tests) --------------------------
def _doc_bundle(t: Tables, kind: str = "binary"):
    from riskspark.spec import Bundle, FeatureSpec
    docs = t.documents.select("doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars"),
                              (F.col("n_chars") / F.size(F.split("text", " "))).alias("word_length"))
    rows = t.labels.join(docs, "doc_id")
    if kind == "binary":
        spec = FeatureSpec(n_chars="continuous", word_length="continuous", toxic="binary", lang="categorical", target="binary")
        return Bundle(rows.select("doc_id", "n_chars", "word_length", "toxic", "lang", F.col("quality").alias("target")), spec)
    high = t.documents.agg(F.max("n_chars")).first()[0]
    spec = FeatureSpec(word_length="continuous", toxic="binary", quality="binary", lang="categorical", target="continuous")
    return Bundle(rows.select("doc_id", "word_length", "toxic", "quality", "lang", (F.col("n_chars") / high).alias("target")), spec)


@query("feature_selection")
def feature_selection(t: Tables):
    from riskspark.plans.selection import select_features
    picked = select_features(_doc_bundle(t))
    names = picked.bundle.spec.features
    return picked.associations.withColumn("kept", F.col("predictor").isin(names))


@query("classifier_suite")
def classifier_suite(t: Tables):
    """All six classifiers: whole grids, five folds, selection, refinement, thresholds."""
    from riskspark.plans.supervised import model_target
    return model_target(_doc_bundle(t), "doc_id")[0].leaderboard


@query("margin_and_neighbour_suite")
def margin_and_neighbour_suite(t: Tables):
    """Whole grids without selection, on oversampled classes."""
    from riskspark.plans.supervised import SuiteOptions, model_target
    return model_target(_doc_bundle(t), "doc_id", SuiteOptions(selection=False, balancing="oversample", models=(
        "SVM (Linear)", "SVM (RBF)", "k-NN Classifier")))[0].leaderboard


@query("regressor_suite")
def regressor_suite(t: Tables):
    """All seven regressors: whole grids, five folds, selection, refinement."""
    from riskspark.plans.supervised import model_target
    return model_target(_doc_bundle(t, "continuous"), "doc_id")[0].leaderboard


@query("logistic_search")
def logistic_search(t: Tables):
    """The whole grid, five folds and the refinement pass."""
    from riskspark.plans.supervised import SuiteOptions, model_target
    return model_target(_doc_bundle(t), "doc_id", SuiteOptions(models=(
        "Logistic Regression (Ridge)", "Logistic Regression (Lasso)")))[0].leaderboard


@query("linear_search")
def linear_search(t: Tables):
    from riskspark.plans.supervised import SuiteOptions, model_target
    return model_target(_doc_bundle(t, "continuous"), "doc_id", SuiteOptions(models=(
        "Linear Regression", "Ridge Regression", "Lasso Regression")))[0].leaderboard


def _fitted(t: Tables, kind: str, name: str, params: dict):
    """One fit on all rows and its score per document."""
    from riskspark.plans import supervised as P
    b, _ = P.encode_categories(_doc_bundle(t, kind))
    rows, _ = P.prepare_rows(b, "doc_id")
    registry = P.M.CLASSIFIERS if kind == "binary" else P.M.REGRESSORS
    pred, _, _ = P._Split(rows, rows, b.spec, P.SuiteOptions()).fit(registry[name], params)
    if kind == "binary":
        return P.M.with_score(pred).select(F.col("_key").alias("doc_id"), "score")
    return pred.select(F.col("_key").alias("doc_id"), "prediction")


@query("svm_rbf_scores")
def svm_rbf_scores(t: Tables):
    return _fitted(t, "binary", "SVM (RBF)", {"C": 1.0, "gamma": "scale"})


@query("svr_rbf_scores")
def svr_rbf_scores(t: Tables):
    return _fitted(t, "continuous", "SVR (RBF)", {"C": 1.0, "gamma": "scale"})


@query("kernel_ridge_scores")
def kernel_ridge_scores(t: Tables):
    return _fitted(t, "continuous", "Kernel Ridge", {"alpha": 1.0})


@query("knn_regressor_scores")
def knn_regressor_scores(t: Tables):
    return _fitted(t, "continuous", "k-NN Regressor", {"n_neighbors": 5})


@query("ablation_matrix")
def ablation_matrix(t: Tables):
    """Every ablation setting with every classifier, five folds."""
    from riskspark.plans.supervised import run_ablations
    return run_ablations(_doc_bundle(t), "doc_id")


@query("permutation_importance")
def permutation_importance(t: Tables):
    from riskspark.plans import supervised as P
    b, _ = P.encode_categories(_doc_bundle(t))
    rows, _ = P.prepare_rows(b, "doc_id")
    split = P._Split(rows, rows, b.spec, P.SuiteOptions())
    _, model, order = split.fit(P.M.CLASSIFIERS["Logistic Regression (Ridge)"], {"C": 1.0})
    return P.permutation_importance(model, rows, order, "binary")


@query("multi_output_ridge")
def multi_output_ridge(t: Tables):
    from riskspark.operators import linear as L
    rows = component(t.embeddings.select("vec_id", "embedding"), "embedding", range(12), "d").drop("embedding")
    x, y = [f"d{i}" for i in range(8)], [f"d{i}" for i in range(8, 12)]
    parts = S.stratified_split(rows, ["vec_id"], [])
    w, b = L.multi_ridge(parts.filter("NOT is_test"), x, y, 1.0)
    pred = L.predict_linear(parts.filter("is_test"), x, w, b, [f"p_{c}" for c in y])
    return V.multi_output_r2(pred, [(c, f"p_{c}") for c in y])


@query("ridge_cv")
def ridge_cv(t: Tables):
    from riskspark.operators import linear as L
    rows = component(t.embeddings.select("vec_id", "embedding"), "embedding", range(12), "d").drop("embedding")
    folds = S.stratified_folds(rows, ["vec_id"], k=5)
    return L.ridge_cv(folds, [f"d{i}" for i in range(8)], [f"d{i}" for i in range(8, 12)])


@query("component_regression")
def component_regression(t: Tables):
    from riskspark.plans.unsupervised import regress_components
    rows = component(t.embeddings.select("vec_id", "embedding"), "embedding", range(12), "d").drop("embedding")
    return regress_components(rows, [f"d{i}" for i in range(8)], [f"d{i}" for i in range(8, 12)], "vec_id")


@query("component_models")
def component_models(t: Tables):
    """Ridge and a forest of 400 trees on the components of the other view, five folds."""
    from riskspark.plans.unsupervised import compare_component_models
    rows = component(t.embeddings.select("vec_id", "embedding"), "embedding", range(21), "d").drop("embedding")
    return compare_component_models(rows, [f"d{i}" for i in range(8)], [f"d{i}" for i in range(8, 21)], "vec_id")


def _two_views(t: Tables):
    """Dimensions 0-7 stand for environment, 8-20 for morphology, each with its own clusters."""
    from riskspark.operators import clustering as C
    x, y = [f"d{i}" for i in range(8)], [f"d{i}" for i in range(8, 21)]
    rows = component(t.embeddings.select("vec_id", "label", "embedding"), "embedding", range(21), "d").drop("embedding").persist()
    for name, view in (("cx", x), ("cy", y)):
        rows = C.kmeans_labels(rows, view, 4, name=name).persist()
    return rows, x, y


@query("cluster_prediction")
def cluster_prediction(t: Tables):
    """All four models, five folds, both directions, 400 trees and 300 rounds."""
    from riskspark.plans.unsupervised import both_directions
    rows, x, y = _two_views(t)
    return both_directions(rows, x, y, "vec_id", "cx", "cy")


@query("boosted_trees")
def boosted_trees(t: Tables):
    """The 18 points of the boosting grid, 300 rounds, five folds: the true labels from the environment view."""
    from riskspark.plans.unsupervised import boosted_grid
    rows, x, _ = _two_views(t)
    return boosted_grid(rows, x, "vec_id", "label")[0]


@query("knn_vote_replicated", """
WITH b AS (SELECT s_suppkey AS id, s_acctbal AS v, s_nationkey % 2 AS y, unnest(range(0, 1 + s_suppkey % 3)) AS copy FROM supplier),
q AS (SELECT c_custkey, c_acctbal AS v FROM customer),
n AS (SELECT c_custkey, y, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(b.v - q.v), id, copy) AS r FROM q, b)
SELECT c_custkey, sum(y) AS ones, count(*) AS votes FROM n WHERE r <= 5 GROUP BY 1""")
def knn_vote_replicated(t: Tables):
    """Copies of a base row, as oversampling makes them, vote as rows."""
    base = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("v"), (F.col("s_nationkey") % 2).alias("y"),
                             F.explode(F.sequence(F.lit(0), F.col("s_suppkey") % 3)).alias("copy"))
    mean = N.knn_mean(t.customer.select("c_custkey", F.col("c_acctbal").alias("v")), base, ["v"], "y", 5, query_key="c_custkey", base_key="id")
    return mean.select(F.col("query_id").alias("c_custkey"), F.round(F.col("prediction") * 5).cast("long").alias("ones"), F.lit(5).cast("long").alias("votes"))


@query("ridge_logit_slope", """
WITH r AS (SELECT c_acctbal / 10000 AS x, ln(y / (1 - y)) AS z FROM (SELECT c_acctbal, 0.2::double + 0.05::double * (c_custkey % 11) AS y FROM customer)),
m AS (SELECT covar_pop(x, z) * count(*) AS sxz, var_pop(x) * count(*) AS sxx, avg(x) AS mx, avg(z) AS mz FROM r)
SELECT round(sxz / (sxx + 10), 5) AS slope, round(mz - mx * sxz / (sxx + 10), 5) AS intercept FROM m""")
def ridge_logit_slope(t: Tables):
    """The ridge penalty is scaled by the deviation of the label that is fitted, the logit."""
    y = F.lit(0.2) + F.lit(0.05) * (F.col("c_custkey") % 11)
    rows = VectorAssembler(inputCols=["x"], outputCol=M.FEATURES).transform(t.customer.select(
        F.col("c_custkey").cast("string").alias(M.KEY), (F.col("c_acctbal") / 10000).alias("x"), y.alias(M.LABEL), F.lit(1.0).alias(M.WEIGHT)))
    model = M.REGRESSORS["Ridge Regression"].build({"alpha": 10.0}, M.fit_context(rows)).fit(rows).stages[0]
    return rounded(t.spark.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "slope double, intercept double"), 5)
