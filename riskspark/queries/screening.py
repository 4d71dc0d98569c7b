"""Association tests, contingency statistics, collinearity."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark.functions import tails
from riskspark.operators import association as A, contingency as G
from riskspark.queries.registry import Tables, query, rounded
from riskspark.spec import FeatureSpec

MEASURES = ["l_quantity", "l_discount", "l_tax"]


def _doc_labels(t: Tables):
    docs = t.documents.select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"))
    return t.labels.join(docs, "doc_id")


_ORDER_CELLS = """
c AS (SELECT o_orderstatus AS x, o_orderpriority AS y, count(*)::double AS n FROM orders GROUP BY 1, 2),
m AS (SELECT *, sum(n) OVER (PARTITION BY x) AS r, sum(n) OVER (PARTITION BY y) AS s, sum(n) OVER () AS total FROM c)"""


@query("chi2_status_priority", f"""
WITH {_ORDER_CELLS},
k AS (SELECT sum((n - r * s / total) ** 2 / (r * s / total)) AS chi2 FROM m)
SELECT 'o_orderstatus' AS feature, round(chi2, 5) AS chi2, 8::bigint AS dof,
  round(exp(-chi2 / 2) * (1 + chi2 / 2 + (chi2 / 2) ** 2 / 2 + (chi2 / 2) ** 3 / 6), 6) AS p_value FROM k""")
def chi2_status_priority(t: Tables):
    out = G.chi_square(G.cell_counts(t.orders, ["o_orderstatus"], "o_orderpriority"))
    return out.select("feature", F.round("chi2", 5).alias("chi2"), "dof", F.round("p_value", 6).alias("p_value"))


@query("chi2_yates_quality_toxic", """
WITH c AS (SELECT count(*) FILTER (WHERE quality = 0 AND toxic = 0)::double a, count(*) FILTER (WHERE quality = 0 AND toxic = 1)::double b,
  count(*) FILTER (WHERE quality = 1 AND toxic = 0)::double c, count(*) FILTER (WHERE quality = 1 AND toxic = 1)::double d, count(*)::double n FROM labels)
SELECT 'quality' AS feature, round(n * greatest(abs(a * d - b * c) - n / 2, 0) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d)), 6) AS chi2, 1::bigint AS dof FROM c""")
def chi2_yates_quality_toxic(t: Tables):
    return rounded(G.chi_square(G.cell_counts(t.labels, ["quality"], "toxic")).drop("p_value"))


@query("chi2_residuals", f"""
WITH {_ORDER_CELLS}, z AS (SELECT x, y, n::bigint AS n, (n - r * s / total) / sqrt(r * s / total) AS z FROM m)
SELECT 'o_orderstatus' AS feature, x, y, n, round(z, 6) AS z, CASE WHEN z > 2 THEN 'over-represented' WHEN z < -2 THEN 'under-represented' END AS direction FROM z""")
def chi2_residuals(t: Tables):
    return rounded(G.residuals(G.cell_counts(t.orders, ["o_orderstatus"], "o_orderpriority")))


@query("residual_pairs", """
WITH c AS (SELECT l_returnflag AS x, (l_quantity > 25)::varchar || l_linestatus AS y, count(*)::double AS n FROM lineitem GROUP BY 1, 2),
m AS (SELECT *, sum(n) OVER (PARTITION BY x) AS r, sum(n) OVER (PARTITION BY y) AS s, sum(n) OVER () AS total FROM c),
z AS (SELECT x, y, n::bigint AS n, (n - r * s / total) / sqrt(r * s / total) AS z FROM m)
SELECT 'l_returnflag' AS feature, x, y, n, round(z, 6) AS z, CASE WHEN z > 0 THEN 'over-represented' ELSE 'under-represented' END AS direction
FROM z WHERE abs(z) > 0.5""")
def residual_pairs(t: Tables):
    rows = t.lineitem.select("l_returnflag", F.concat((F.col("l_quantity") > 25).cast("string"), "l_linestatus").alias("g"))
    return rounded(G.significant_pairs(G.cell_counts(rows, ["l_returnflag"], "g"), limit=0.5))


@query("independence_test_labelings", """
WITH c AS (SELECT event_type AS x, (user_id % 3)::varchar AS y, count(*)::double AS n FROM events GROUP BY 1, 2),
m AS (SELECT *, sum(n) OVER (PARTITION BY x) AS r, sum(n) OVER (PARTITION BY y) AS s, sum(n) OVER () AS total FROM c),
k AS (SELECT sum((n - r * s / total) ** 2 / (r * s / total)) AS q FROM m)
SELECT 'event_type' AS feature, round(q, 5) AS chi2, 8::bigint AS dof,
  round(exp(-q / 2) * (1 + q / 2 + (q / 2) ** 2 / 2 + (q / 2) ** 3 / 6), 6) AS p_value FROM k""")
def independence_test_labelings(t: Tables):
    rows = t.events.select("event_type", (F.col("user_id") % 3).alias("g"))
    out = G.chi_square(G.cell_counts(rows, ["event_type"], "g"))
    return out.select("feature", F.round("chi2", 5).alias("chi2"), "dof", F.round("p_value", 6).alias("p_value"))


def _linear_sql(select: str, cols=MEASURES, y="l_extendedprice") -> str:
    return " UNION ALL ".join(select.format(c=c, y=y) for c in cols)


@query("pearson_r", _linear_sql("""
SELECT '{c}' AS predictor, 'continuous' AS predictor_type, 'Pearson correlation' AS test, 'r' AS statistic_name, round(corr({c}, {y}), 6) AS statistic_value FROM lineitem"""))
def pearson_r(t: Tables):
    return rounded(A.pearson(t.lineitem, MEASURES, "l_extendedprice").drop("p_value"))


@query("spearman_pairs", " UNION ALL ".join(f"""
SELECT '{c}' AS feature, round(corr(a, b), 6) AS rho, count(*)::double AS n FROM (
 SELECT rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::double AS a,
        rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::double AS b FROM lineitem)"""
                                           for c in MEASURES))
def spearman_pairs(t: Tables):
    return rounded(A.spearman_stats(t.lineitem, MEASURES, "l_extendedprice").drop("p_value"))


@query("point_biserial", """
SELECT 'quality' AS predictor, 'binary' AS predictor_type, 'Point-biserial correlation' AS test, 'r_pb' AS statistic_name,
  round(corr(quality, n_chars), 6) AS statistic_value FROM labels JOIN documents USING (doc_id) UNION ALL
SELECT 'toxic', 'binary', 'Point-biserial correlation', 'r_pb', round(corr(toxic, n_chars), 6) FROM labels JOIN documents USING (doc_id)""")
def point_biserial(t: Tables):
    return rounded(A.point_biserial(_doc_labels(t), ["quality", "toxic"], "n_chars").drop("p_value"))


@query("ols_univariate", _linear_sql("""
SELECT '{c}' AS predictor, 'continuous' AS predictor_type, 'Univariate linear regression' AS test, 'coef[{c}]' AS statistic_name, round(regr_slope({y}, {c}), 4) AS statistic_value FROM lineitem"""))
def ols_univariate(t: Tables):
    return rounded(A.simple_regression(t.lineitem, MEASURES, "l_extendedprice").drop("p_value"), 4)


@query("ols_dummies", """
WITH g AS (SELECT o_orderpriority AS lv, avg(o_totalprice) AS m FROM orders GROUP BY 1), b AS (SELECT m AS m0 FROM g ORDER BY lv LIMIT 1)
SELECT 'o_orderpriority' AS predictor, 'categorical' AS predictor_type, 'Univariate linear regression' AS test,
  'coef[o_orderpriority_' || lv || ']' AS statistic_name, round(m - m0, 4) AS statistic_value FROM g, b WHERE lv <> (SELECT min(lv) FROM g)""")
def ols_dummies(t: Tables):
    return rounded(A.dummy_regression(t.orders, ["o_orderpriority"], "o_totalprice").drop("p_value"), 4)


@query("anova_status_price", """
WITH g AS (SELECT o_orderstatus AS lv, count(*)::double AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders GROUP BY 1),
 a AS (SELECT sum(n) AS total, sum(n * m) / sum(n) AS grand FROM g),
 f AS (SELECT total, (sum(n * (m - grand) ** 2) / 2) / (sum(n * v) / (total - 3)) AS f FROM g, a GROUP BY total)
SELECT 'o_orderstatus' AS predictor, 'categorical' AS predictor_type, 'ANOVA' AS test, 'F' AS statistic_name, round(f, 6) AS statistic_value,
  round((1 + 2 * f / (total - 3)) ** (-(total - 3) / 2), 6) AS p_value FROM f""")
def anova_status_price(t: Tables):
    spec = FeatureSpec(o_orderstatus="categorical", target="continuous")
    rows = t.orders.select("o_orderstatus", F.col("o_totalprice").alias("target"))
    return rounded(A.categorical_associations(rows, spec))


@query("categorical_screen_binary", """
WITH c AS (SELECT lang AS x, toxic AS y, count(*)::double AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2),
g AS (SELECT a.x, b.y, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT x FROM c) a CROSS JOIN (SELECT DISTINCT y FROM c) b LEFT JOIN c ON c.x = a.x AND c.y = b.y),
m AS (SELECT *, sum(n) OVER (PARTITION BY x) AS r, sum(n) OVER (PARTITION BY y) AS s, sum(n) OVER () AS total FROM g)
SELECT 'lang' AS predictor, 'categorical' AS predictor_type, 'Chi-square' AS test, 'chi2' AS statistic_name,
  round(sum((n - r * s / total) ** 2 / (r * s / total)), 6) AS statistic_value FROM m""")
def categorical_screen_binary(t: Tables):
    rows = _doc_labels(t).select("lang", F.col("toxic").alias("target"))
    return rounded(A.categorical_associations(rows, FeatureSpec(lang="categorical", target="binary")).drop("p_value"))


_KRUSKAL = """
WITH r AS (SELECT event_type AS g, value, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::double AS rk FROM events),
 s AS (SELECT g, count(*)::double AS n, sum(rk) AS rs FROM r GROUP BY 1), t AS (SELECT sum(c ** 3 - c) AS ties FROM (SELECT count(*)::double AS c FROM r GROUP BY value)),
 k AS (SELECT sum(n) AS total, sum(rs * rs / n) AS q FROM s),
 h AS (SELECT (12 / (total * (total + 1)) * q - 3 * (total + 1)) / (1 - ties / (total ** 3 - total)) AS h FROM k, t)"""


@query("kruskal_event_value", _KRUSKAL + """
SELECT 'value' AS feature, round(h, 4) AS statistic, 4::bigint AS dof, round(exp(-h / 2) * (1 + h / 2), 4) AS p_value FROM h""")
def kruskal_event_value(t: Tables):
    return rounded(A.kruskal(t.events, ["value"], "event_type", rows_per_bucket=4_000), 4)


_EFFECT = """
g AS (SELECT event_type AS lv, count(*)::double AS n, avg(value) AS m, var_pop(value) AS v FROM events GROUP BY 1),
 e AS (SELECT (sum(n * (m - (SELECT avg(value) FROM events)) ** 2) / sum(n)) / (sum(n * v) / sum(n) + 1e-10::double) AS e FROM g)"""


@query("effect_size", f"WITH {_EFFECT} SELECT 'value' AS feature, round(e, 9) AS effect_size FROM e")
def effect_size(t: Tables):
    return rounded(A.effect_size(t.events, ["value"], "event_type"), 9)


@query("feature_significance", _KRUSKAL + f", {_EFFECT}" + """
SELECT 'value' AS feature, round(h, 4) AS statistic, round(exp(-h / 2) * (1 + h / 2), 4) AS p_value, round(e, 4) AS effect_size,
  exp(-h / 2) * (1 + h / 2) < 0.05 AS significant FROM h, e""")
def feature_significance(t: Tables):
    return rounded(A.feature_significance(t.events, ["value"], "event_type"), 4)


@query("odds_ratio_binary", """
WITH c AS (SELECT count(*) FILTER (WHERE quality = 0 AND toxic = 0)::double a, count(*) FILTER (WHERE quality = 0 AND toxic = 1)::double b,
  count(*) FILTER (WHERE quality = 1 AND toxic = 0)::double c, count(*) FILTER (WHERE quality = 1 AND toxic = 1)::double d FROM labels)
SELECT 'quality' AS predictor, 'binary' AS predictor_type, 'Univariate logistic regression' AS test, 'odds_ratio' AS statistic_name,
  round(a * d / (b * c), 6) AS statistic_value FROM c WHERE least(a, b, c, d) > 0""")
def odds_ratio_binary(t: Tables):
    out = A.univariate_logistic(t.labels, ["quality"], "toxic", FeatureSpec(quality="binary", target="binary"))
    return rounded(out.drop("p_value"))


@query("vif_three", """
WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS ab, corr(l_quantity, l_discount) AS ac, corr(l_extendedprice, l_discount) AS bc FROM lineitem),
 d AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM r)
SELECT f AS predictor, 'continuous' AS predictor_type, 'VIF' AS test, 'VIF' AS statistic_name,
  round(CASE f WHEN 'l_quantity' THEN (1 - bc * bc) / det WHEN 'l_extendedprice' THEN (1 - ac * ac) / det ELSE (1 - ab * ab) / det END, 6) AS statistic_value,
  NULL::double AS p_value FROM d, (VALUES ('l_quantity'), ('l_extendedprice'), ('l_discount')) v(f)""")
def vif_three(t: Tables):
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    return rounded(A.vif_records(t.lineitem.select(*cols), FeatureSpec({c: "continuous" for c in cols})))


_P_SQL = """
WITH g AS (SELECT 'o_orderstatus' AS f, o_orderstatus AS lv, o_totalprice AS y FROM orders UNION ALL
           SELECT 'month', (month(o_orderdate) % 3)::varchar, o_totalprice FROM orders),
 s AS (SELECT f, lv, count(*)::double AS n, avg(y) AS m, var_pop(y) AS v FROM g GROUP BY 1, 2),
 a AS (SELECT f, sum(n) AS total, sum(n * m) / sum(n) AS grand FROM s GROUP BY 1),
 k AS (SELECT f, total, (sum(n * (m - grand) ** 2) / 2) / (sum(n * v) / (total - 3)) AS stat FROM s JOIN a USING (f) GROUP BY f, total)
SELECT f AS predictor, round((1 + 2 * stat / (total - 3)) ** (-(total - 3) / 2), 6) AS p_value FROM k"""


def _two_screens(t: Tables):
    rows = t.orders.select("o_orderstatus", (F.month("o_orderdate") % 3).alias("month"), F.col("o_totalprice").alias("target"))
    return A.categorical_associations(rows, FeatureSpec(o_orderstatus="categorical", month="categorical", target="continuous"))


@query("min_p_value", _P_SQL)
def min_p_value(t: Tables):
    return rounded(A.min_p(_two_screens(t)))


@query("p_value_filter", f"SELECT * FROM ({_P_SQL}) WHERE p_value <= 0.5")
def p_value_filter(t: Tables):
    return rounded(A.passing_p(_two_screens(t), 0.5))


@query("vif_filter", """
SELECT f AS predictor, round(1 / (1 - corr(l_quantity, l_discount) ** 2), 6) AS statistic_value FROM lineitem, (VALUES ('l_quantity'), ('l_discount')) v(f) GROUP BY f
HAVING 1 / (1 - corr(l_quantity, l_discount) ** 2) <= 50""")
def vif_filter(t: Tables):
    rows = t.lineitem.select("l_quantity", "l_discount")
    spec = FeatureSpec(l_quantity="continuous", l_discount="continuous")
    return rounded(A.passing_vif(A.vif_records(rows, spec), 50.0).select("predictor", "statistic_value"))


@query("associations_continuous")
def associations_continuous(t: Tables):
    rows = t.lineitem.select("l_quantity", "l_discount", "l_tax", (F.col("l_linestatus") == "F").cast("int").alias("open"),
                             "l_returnflag", F.col("l_extendedprice").alias("target"))
    return A.associations(rows, FeatureSpec(l_quantity="continuous", l_discount="continuous", l_tax="continuous",
                                            open="binary", l_returnflag="categorical", target="continuous"))


@query("associations_binary")
def associations_binary(t: Tables):
    rows = _doc_labels(t).select("n_chars", (F.col("lang") == "en").cast("int").alias("english"), "toxic", F.col("quality").alias("target"))
    return A.associations(rows, FeatureSpec(n_chars="continuous", english="binary", toxic="binary", target="binary"))
