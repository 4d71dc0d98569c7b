"""Profiles, group summaries, ranks and report-style selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark.operators import profile as P, ranking as K
from riskspark.queries.registry import Tables, component, query, rounded

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _union(template: str, cols) -> str:
    return " UNION ALL ".join(template.replace("{c}", c) for c in cols)


@query("group_mean_one_key", "SELECT c_nationkey, round(avg(c_acctbal), 6) AS c_acctbal FROM customer GROUP BY 1")
def group_mean_one_key(t: Tables):
    return rounded(P.group_mean(t.customer, ["c_nationkey"], ["c_acctbal"]))


@query("group_mean_two_keys", """
SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) AS l_extendedprice, round(avg(l_discount), 4) AS l_discount
FROM lineitem GROUP BY 1, 2""")
def group_mean_two_keys(t: Tables):
    return rounded(P.group_mean(t.lineitem, ["l_returnflag", "l_linestatus"], ["l_extendedprice", "l_discount"]), 4)


@query("frequency", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def frequency(t: Tables):
    return P.frequency(t.events, "event_type")


@query("crosstab_margins", """
WITH c AS (SELECT c_mktsegment AS row, c_nationkey::varchar AS col, count(*) AS n FROM customer GROUP BY CUBE (1, 2))
SELECT coalesce(c.row, 'All') AS row, coalesce(c.col, 'All') AS col, c.n, round(c.n / m.n::double, 6) AS row_share
FROM c JOIN c m ON m.col IS NULL AND m.row IS NOT DISTINCT FROM c.row""")
def crosstab_margins(t: Tables):
    return rounded(P.crosstab_long(t.customer, "c_mktsegment", "c_nationkey"))


@query("crosstab_wide", """
SELECT coalesce(l_returnflag, 'All') AS row, count(*) FILTER (WHERE l_linestatus = 'F') AS "F",
       count(*) FILTER (WHERE l_linestatus = 'O') AS "O", count(*) AS "All"
FROM lineitem GROUP BY ROLLUP (l_returnflag)""")
def crosstab_wide(t: Tables):
    return P.crosstab(t.lineitem, "l_returnflag", "l_linestatus", ["F", "O"])


@query("cluster_profile", """
SELECT label, round(avg(embedding[1]::double), 6) AS d0, round(avg(embedding[2]::double), 6) AS d1,
  round(avg(embedding[3]::double), 6) AS d2, round(avg(embedding[4]::double), 6) AS d3 FROM embeddings GROUP BY 1""")
def cluster_profile(t: Tables):
    rows = component(t.embeddings, "embedding", range(4), "d")
    return rounded(P.cluster_profile(rows, "label", ["d0", "d1", "d2", "d3"]))


@query("stratified_profile", """
SELECT vec_id % 3 AS typology, label, round(avg(embedding[1]::double), 6) AS d0, round(avg(embedding[2]::double), 6) AS d1
FROM embeddings GROUP BY 1, 2""")
def stratified_profile(t: Tables):
    rows = component(t.embeddings, "embedding", range(2), "d").withColumn("typology", F.col("vec_id") % 3)
    return rounded(P.cluster_profile(rows, "label", ["d0", "d1"], strata=["typology"]))


@query("type_summary", """
WITH p AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, sum(n)::bigint AS n_samples, count(*) AS n_unique, (array_agg(user_id ORDER BY n DESC, user_id))[1] AS most_common
FROM p GROUP BY 1""")
def type_summary(t: Tables):
    return P.level_summary(t.events, "event_type", "user_id")


@query("describe_exact", _union("""
SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min,
  round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75,
  round(max({c}), 4) AS max FROM lineitem""", MEASURES))
def describe_exact(t: Tables):
    return rounded(P.describe_exact(t.lineitem, MEASURES), 4)


@query("column_summary", _union("""
SELECT '{c}' AS feature, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std, round(skewness({c}), 4) AS skewness
FROM lineitem""", MEASURES))
def column_summary(t: Tables):
    return rounded(P.column_summary(t.lineitem, MEASURES), 4)


@query("histogram_20", _union("""
SELECT '{c}' AS feature, b AS bin, round(lo + w * b / 20, 4) AS left, count(*) AS n FROM
 (SELECT lo, hi - lo AS w, least(floor((v - lo) / (hi - lo) * 20), 19)::int AS b FROM
   (SELECT {c} AS v, min({c}) OVER () AS lo, max({c}) OVER () AS hi FROM lineitem)) GROUP BY lo, w, b""", MEASURES))
def histogram_20(t: Tables):
    return rounded(P.histogram(t.lineitem, MEASURES, 20), 4)


_PAIRS = [(a, b) for i, a in enumerate(MEASURES) for b in MEASURES[i + 1:]]


@query("corr_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in _PAIRS))
def corr_matrix(t: Tables):
    return rounded(P.correlation_pairs(t.lineitem, MEASURES))


@query("box_stats", """
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM events GROUP BY 1)
SELECT e.event_type, 'value' AS feature, count(*) AS n, round(any_value(a), 6) AS q25, round(any_value(b), 6) AS q50, round(any_value(c), 6) AS q75,
  round(min(value) FILTER (WHERE value BETWEEN a - 1.5::double * (c - a) AND c + 1.5::double * (c - a)), 6) AS whisker_low,
  round(max(value) FILTER (WHERE value BETWEEN a - 1.5::double * (c - a) AND c + 1.5::double * (c - a)), 6) AS whisker_high,
  count(*) FILTER (WHERE value NOT BETWEEN a - 1.5::double * (c - a) AND c + 1.5::double * (c - a)) AS n_outliers
FROM events e JOIN q USING (event_type) GROUP BY 1""")
def box_stats(t: Tables):
    return rounded(P.box_stats(t.events, "event_type", ["value"]))


@query("average_ranks", """
WITH v AS (SELECT l_quantity AS value, count(*) AS n FROM lineitem GROUP BY 1)
SELECT 'l_quantity' AS feature, value, n, n AS tie, sum(n) OVER (ORDER BY value) - n + (n + 1) / 2.0::double AS avg_rank FROM v""")
def average_ranks(t: Tables):
    return K.ranked_counts(t.lineitem, ["l_quantity"], rows_per_bucket=20_000)


@query("quintile_labels", """
WITH q AS (SELECT quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS c FROM orders)
SELECT o_orderkey, CASE WHEN o_totalprice <= c[1] THEN 0 WHEN o_totalprice <= c[2] THEN 1 WHEN o_totalprice <= c[3] THEN 2
  WHEN o_totalprice <= c[4] THEN 3 ELSE 4 END AS stratum FROM orders, q""")
def quintile_labels(t: Tables):
    from riskspark.operators.split import quantile_bins
    return quantile_bins(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 5, "stratum").drop("o_totalprice")


@query("best_per_group", """
SELECT l_returnflag, arg_max(k, l_extendedprice) AS best_key, round(max(l_extendedprice), 2) AS price
FROM (SELECT l_returnflag, l_extendedprice, l_orderkey * 10 + l_linenumber AS k FROM
  (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1)
GROUP BY 1""")
def best_per_group(t: Tables):
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]
    best = P.top_n(t.lineitem.select("l_returnflag", "l_extendedprice", "l_orderkey", "l_linenumber"), order, 1, ["l_returnflag"])
    return best.select("l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("best_key"),
                       F.round("l_extendedprice", 2).alias("price"))


@query("best_metric_row", """
SELECT c_mktsegment, round(max(m), 6) AS m, arg_max(c_nationkey, m) AS c_nationkey
FROM (SELECT c_mktsegment, c_nationkey, avg(c_acctbal) AS m FROM customer GROUP BY 1, 2) GROUP BY 1""")
def best_metric_row(t: Tables):
    means = t.customer.groupBy("c_mktsegment", "c_nationkey").agg(F.avg("c_acctbal").alias("m"))
    return rounded(P.best_row(means, "c_mktsegment", "m", largest=True))


@query("top_five", """
SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5""")
def top_five(t: Tables):
    rows = t.orders.select("o_orderkey", "o_totalprice")
    return rounded(P.top_n(rows, [F.desc("o_totalprice"), F.col("o_orderkey")], 5), 2)


@query("tagged_union", """
SELECT 'CUSTOMER' AS "Dataset", c_nationkey AS nation, round(avg(c_acctbal), 6) AS wealth, NULL::bigint AS n FROM customer GROUP BY 2 UNION ALL
SELECT 'SUPPLIER', s_nationkey, NULL, count(*) FROM supplier GROUP BY 2""")
def tagged_union(t: Tables):
    return rounded(P.tagged_union({
        "CUSTOMER": t.customer.groupBy(F.col("c_nationkey").alias("nation")).agg(F.avg("c_acctbal").alias("wealth")),
        "SUPPLIER": t.supplier.groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n"))}))
