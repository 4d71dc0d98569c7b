"""Unsupervised analysis: components, clusters, agreement, stability, anomalies."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark.operators import anomaly as AN, clustering as C, contingency as G, density as D, dimension as M
from riskspark.queries.registry import Tables, component, query, rounded

ENV = [f"e{i}" for i in range(8)]
MORPH = [f"m{i}" for i in range(8, 21)]


def _points(t: Tables, n: int = 64):
    return component(t.embeddings.select("vec_id", "label", "embedding"), "embedding", range(n), "d").drop("embedding")


def _views(t: Tables):
    """Dimensions 0-7 stand for environment, 8-20 for morphology."""
    both = component(component(t.embeddings, "embedding", range(8), "e"), "embedding", range(8, 21), "m")
    return both.drop("embedding")


DIMS = [f"d{i}" for i in range(64)]


@query("silhouette", """
WITH p AS (SELECT vec_id, label, embedding::double[] AS v FROM embeddings),
 s AS (SELECT a.vec_id, a.label AS own, b.label AS c, sum(list_distance(a.v, b.v)) AS total, count(*) AS n FROM p a, p b GROUP BY 1, 2, 3),
 x AS (SELECT vec_id, max(total / nullif(n - 1, 0)) FILTER (WHERE own = c) AS a, min(total / n) FILTER (WHERE own <> c) AS b, max(n) FILTER (WHERE own = c) AS k FROM s GROUP BY 1)
SELECT round(avg(CASE WHEN k = 1 THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END), 6) AS silhouette FROM x""")
def silhouette(t: Tables):
    return rounded(C.silhouette(_points(t), DIMS, "vec_id", "label"))


@query("silhouette_squared", """
WITH p AS (SELECT vec_id, label, embedding::double[] AS v FROM embeddings),
 s AS (SELECT a.vec_id, a.label AS own, b.label AS c, sum(list_distance(a.v, b.v) ** 2) AS total, count(*) AS n FROM p a, p b GROUP BY 1, 2, 3),
 x AS (SELECT vec_id, max(total / nullif(n - 1, 0)) FILTER (WHERE own = c) AS a, min(total / n) FILTER (WHERE own <> c) AS b, max(n) FILTER (WHERE own = c) AS k FROM s GROUP BY 1)
SELECT round(avg(CASE WHEN k = 1 THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END), 6) AS silhouette FROM x""")
def silhouette_squared(t: Tables):
    value = C.silhouette_squared(_points(t), DIMS, "label")
    return rounded(t.spark.createDataFrame([(float(value),)], "silhouette double"))


_D4 = "[embedding[1]::double, embedding[2]::double, embedding[3]::double, embedding[4]::double]"


@query("calinski_davies", f"""
WITH p AS (SELECT label, {_D4} AS v FROM embeddings),
 k AS (SELECT label, count(*)::double AS n, [avg(v[1]), avg(v[2]), avg(v[3]), avg(v[4])] AS c,
   (var_pop(v[1]) + var_pop(v[2]) + var_pop(v[3]) + var_pop(v[4])) * count(*) AS w FROM p GROUP BY 1),
 g AS (SELECT [avg(v[1]), avg(v[2]), avg(v[3]), avg(v[4])] AS c, count(*)::double AS n FROM p),
 ch AS (SELECT (sum(k.n * list_distance(k.c, g.c) ** 2) / (count(*) - 1)) / (sum(k.w) / (any_value(g.n) - count(*))) AS ch FROM k, g),
 s AS (SELECT p.label, avg(list_distance(p.v, k.c)) AS s FROM p JOIN k USING (label) GROUP BY 1),
 r AS (SELECT a.label, max((sa.s + sb.s) / list_distance(a.c, b.c)) AS r FROM k a JOIN k b ON a.label <> b.label JOIN s sa ON sa.label = a.label JOIN s sb ON sb.label = b.label GROUP BY 1)
SELECT round(any_value(ch), 6) AS calinski, round(avg(r), 6) AS davies_bouldin FROM r, ch""")
def calinski_davies(t: Tables):
    return rounded(C.calinski_davies(_points(t, 4), DIMS[:4], "label"))


@query("ari_mi_nmi", """
WITH c AS (SELECT l_returnflag AS a, l_linestatus || (l_quantity > 25)::varchar AS b, count(*)::double AS n FROM lineitem GROUP BY 1, 2),
 r AS (SELECT a, sum(n) AS n FROM c GROUP BY 1), s AS (SELECT b, sum(n) AS n FROM c GROUP BY 1), t AS (SELECT sum(n) AS n FROM c),
 p AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS pn, (SELECT sum(n * (n - 1) / 2) FROM r) AS pr, (SELECT sum(n * (n - 1) / 2) FROM s) AS pc, t.n * (t.n - 1) / 2 AS every FROM t),
 m AS (SELECT sum(c.n / t.n * ln(c.n * t.n / (r.n * s.n))) AS mi FROM c JOIN r USING (a) JOIN s USING (b), t),
 h AS (SELECT (SELECT -sum(r.n / t.n * ln(r.n / t.n)) FROM r, t) AS ha, (SELECT -sum(s.n / t.n * ln(s.n / t.n)) FROM s, t) AS hb)
SELECT round((pn - pr * pc / every) / ((pr + pc) / 2 - pr * pc / every), 6) AS ari, round(greatest(mi, 0), 6) AS mi, round(greatest(mi, 0) / ((ha + hb) / 2), 6) AS nmi FROM p, m, h""")
def ari_mi_nmi(t: Tables):
    rows = t.lineitem.select("l_returnflag", F.concat("l_linestatus", (F.col("l_quantity") > 25).cast("string")).alias("b"))
    return rounded(G.compare_labelings(rows, "l_returnflag", "b"))


_SUPP = """p AS (SELECT s_suppkey, (s_nationkey - avg(s_nationkey) OVER ()) / stddev_pop(s_nationkey) OVER () AS x,
   (s_acctbal - avg(s_acctbal) OVER ()) / stddev_pop(s_acctbal) OVER () AS y FROM supplier)"""
_DBSCAN = f"""
WITH RECURSIVE {_SUPP},
 e AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM p a, p b WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.3::double * 0.3::double),
 core AS (SELECT a AS id FROM e GROUP BY 1 HAVING count(*) >= 5),
 ce AS (SELECT a, b FROM e WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
 reach(id, low) AS (SELECT id, id FROM core UNION SELECT ce.b, reach.low FROM reach JOIN ce ON ce.a = reach.id),
 lab AS (SELECT id, min(low) AS label FROM reach GROUP BY 1),
 out AS (SELECT p.s_suppkey, coalesce(lab.label, (SELECT min(l.label) FROM e JOIN lab l ON l.id = e.b WHERE e.a = p.s_suppkey), -1) AS cluster FROM p LEFT JOIN lab ON lab.id = p.s_suppkey)"""


def _suppliers(t: Tables):
    from riskspark.operators.encode import standardize
    rows = t.supplier.select("s_suppkey", F.col("s_nationkey").cast("double").alias("x"), F.col("s_acctbal").alias("y"))
    return standardize(rows, ["x", "y"])


@query("dbscan_labels", _DBSCAN + " SELECT s_suppkey, cluster FROM out")
def dbscan_labels(t: Tables):
    return D.dbscan(_suppliers(t), ["x", "y"], "s_suppkey", eps=0.3, min_samples=5)


@query("dbscan_counts", _DBSCAN + " SELECT count(DISTINCT cluster) FILTER (WHERE cluster <> -1) AS n_clusters, count(*) FILTER (WHERE cluster = -1) AS n_noise FROM out")
def dbscan_counts(t: Tables):
    return D.cluster_counts(D.dbscan(_suppliers(t), ["x", "y"], "s_suppkey", eps=0.3, min_samples=5))


@query("pca_variance")
def pca_variance(t: Tables):
    return M.explained_variance(t.spark, M.principal_components(_views(t), MORPH, 0.90))


@query("pca_scores")
def pca_scores(t: Tables):
    return M.principal_components(_views(t), MORPH, 0.95, keep=["vec_id"]).scores


@query("cca_variates")
def cca_variates(t: Tables):
    return M.canonical_correlation(_views(t), ENV, MORPH, 2, keep=["vec_id"]).variates


@query("cca_loadings")
def cca_loadings(t: Tables):
    v = M.canonical_correlation(_views(t), ENV, MORPH, 1, keep=["vec_id", *ENV]).variates
    return M.loadings(v, ENV, "X1")


@query("map_coordinates")
def map_coordinates(t: Tables):
    return M.map_coordinates(_views(t), MORPH, color="label", keep=["vec_id"])


@query("kmeans_sweep")
def kmeans_sweep(t: Tables):
    return C.kmeans_sweep(_views(t), MORPH, "vec_id", exact_silhouette=True)


@query("mixture_sweep")
def mixture_sweep(t: Tables):
    return C.mixture_sweep(_views(t), ENV, range(2, 6), max_iter=30)


@query("mixture_clusters")
def mixture_clusters(t: Tables):
    out = C.mixture_labels(_views(t), ENV, 3)
    return out.groupBy("cluster").agg(F.count("*").alias("n"))


@query("ward_clusters")
def ward_clusters(t: Tables):
    out = C.ward_labels(_views(t), MORPH, 8, micro=60)
    return out.groupBy("cluster").agg(F.count("*").alias("n"))


@query("bootstrap_stability")
def bootstrap_stability(t: Tables):
    rows = C.ward_labels(_views(t), MORPH, 4, micro=20, name="base").select("vec_id", "base", *MORPH)
    scores = C.bootstrap_agreement(rows, "vec_id", "base", lambda f, w: C.ward_labels(f, MORPH, 4, micro=20, weight=w),
                                   resamples=4)
    return C.stability_summary(scores)


@query("anomalies")
def anomalies(t: Tables):
    return AN.anomalies(_views(t), ENV, "vec_id", trees=100).select("vec_id", "anomaly")
