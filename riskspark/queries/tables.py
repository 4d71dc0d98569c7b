"""Scans, projections, filters and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark.operators import profile as P, tables as R
from riskspark.queries.registry import Tables, component, nulled, query, rounded
from riskspark.session import new_shared_path
from riskspark.sources import files
from riskspark.spec import Bundle, Domains, FeatureSpec


@query("csv_scan", """
SELECT o_orderkey AS orderkey, o_orderstatus AS status, round(o_totalprice, 2) AS price FROM orders""")
def csv_scan(t: Tables):
    path = new_shared_path(t.spark, "csv")
    files.write_table(t.orders.select(F.col("o_orderkey").alias("orderkey"), F.col("o_orderstatus").alias("status"),
                                      F.col("o_totalprice").alias("price")), path, "csv")
    return rounded(files.read_csv(t.spark, path, "orderkey long, status string, price double"), 2)


@query("decimal_comma_scan", """
SELECT s_suppkey AS id, s_nationkey AS nation, round(s_acctbal, 2) AS balance FROM supplier""")
def decimal_comma_scan(t: Tables):
    path = new_shared_path(t.spark, "semicolon")
    files.write_decimal_comma(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"),
                                                F.col("s_acctbal").alias("balance")), path)
    rows = files.read_decimal_comma(t.spark, path, ["id", "nation", "balance"], ["balance"], skip_malformed=True)
    return rows.select(F.col("id").cast("long").alias("id"), F.col("nation").cast("int").alias("nation"),
                       F.round("balance", 2).alias("balance"))


@query("combined_dataset", """
SELECT n.n_nationkey AS neighborhood_id, n.n_name AS typology, c.c_custkey AS participant_id,
       c.c_mktsegment AS income, round(c.c_acctbal, 2) AS balance,
       o.o_orderkey AS visit, o.o_orderpriority AS severity
FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey""")
def combined_dataset(t: Tables):
    grid = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("typology"))
    socio = t.customer.select(F.col("c_custkey").alias("participant_id"), F.col("c_nationkey").alias("neighborhood_id"),
                              F.col("c_mktsegment").alias("income"), F.round("c_acctbal", 2).alias("balance"))
    clinical = t.orders.select(F.col("o_custkey").alias("participant_id"), F.col("o_orderkey").alias("visit"),
                               F.col("o_orderpriority").alias("severity"))
    return R.combine(grid, socio, clinical)


@query("tidy_names", """
SELECT p_partkey AS part_key, p_brand AS brand_name, p_size AS size_n_s FROM part""")
def tidy_names(t: Tables):
    raw = t.part.select(F.col("p_partkey").alias(" Part Key"), F.col("p_brand").alias("Brand Name "),
                        F.col("p_size").alias("size n-s"))
    return R.tidy_names(raw, hyphens=True)


@query("prefix_and_metadata_drop", """
SELECT l_orderkey AS id, l_quantity AS pc1, l_discount AS pc2 FROM lineitem""")
def prefix_and_metadata_drop(t: Tables):
    raw = t.lineitem.select(
        F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("pc1"), F.col("l_discount").alias("pc2"),
        F.col("l_tax").alias("bin_tax"), F.col("l_extendedprice").alias("left"), F.col("l_suppkey").alias("row_index"))
    return R.select_prefix(R.drop_prefix(R.drop_metadata(raw), "bin"), "pc", also=["id"])


@query("cardinality_prune_stats", """
WITH s AS (
  SELECT 'p_partkey' AS feature, count(DISTINCT p_partkey) AS n_distinct, count(*) AS n_rows FROM part UNION ALL
  SELECT 'p_name', count(DISTINCT p_name), count(*) FROM part UNION ALL
  SELECT 'p_brand', count(DISTINCT p_brand), count(*) FROM part UNION ALL
  SELECT 'p_type', count(DISTINCT p_type), count(*) FROM part UNION ALL
  SELECT 'p_size', count(DISTINCT p_size), count(*) FROM part UNION ALL
  SELECT 'p_retailprice', count(DISTINCT p_retailprice), count(*) FROM part UNION ALL
  SELECT 'city', count(DISTINCT 'Somewhere'), count(*) FROM part)
SELECT feature, n_distinct, n_rows, (n_distinct = n_rows OR n_distinct <= 1) AS prune FROM s""")
def cardinality_prune_stats(t: Tables):
    return R.cardinality_stats(t.part.withColumn("city", F.lit("Somewhere")))


@query("cardinality_pruned", """
SELECT p_name, p_brand, p_type, p_size FROM part""")
def cardinality_pruned(t: Tables):
    kept = R.prune_by_cardinality(t.part.withColumn("city", F.lit("Somewhere")).drop("p_retailprice"))
    return kept


@query("zero_variance_stats", """
WITH s AS (
  SELECT 'l_quantity' AS feature, stddev_samp(l_quantity) AS std FROM lineitem UNION ALL
  SELECT 'l_extendedprice', stddev_samp(l_extendedprice) FROM lineitem UNION ALL
  SELECT 'l_discount', stddev_samp(l_discount) FROM lineitem UNION ALL
  SELECT 'l_tax', stddev_samp(l_tax) FROM lineitem UNION ALL
  SELECT 'flat', stddev_samp(7.5::double) FROM lineitem)
SELECT feature, round(std, 6) AS std, std <= 1e-8 AS prune FROM s""")
def zero_variance_stats(t: Tables):
    rows = t.lineitem.select("l_quantity", "l_extendedprice", "l_discount", "l_tax").withColumn("flat", F.lit(7.5))
    return rounded(R.variance_stats(rows))


@query("zero_variance_pruned", """
SELECT l_orderkey, l_quantity, l_discount FROM lineitem""")
def zero_variance_pruned(t: Tables):
    return R.prune_constant(t.lineitem.select("l_orderkey", "l_quantity", "l_discount").withColumn("flat", F.lit(7.5)))


_DOC_DOMAINS = Domains(continuous=(), binary=(), categorical=("lang",), target_sources={})


@query("feature_types", """
WITH d AS (SELECT l.*, d.n_chars, d.lang FROM labels l JOIN documents d USING (doc_id))
SELECT 'doc_id' AS feature, CASE WHEN bool_and(doc_id IN (0,1)) THEN 'binary' ELSE 'continuous' END AS kind FROM d UNION ALL
SELECT 'quality', CASE WHEN bool_and(quality IN (0,1)) THEN 'binary' ELSE 'continuous' END FROM d UNION ALL
SELECT 'toxic', CASE WHEN bool_and(toxic IN (0,1)) THEN 'binary' ELSE 'continuous' END FROM d UNION ALL
SELECT 'n_chars', CASE WHEN bool_and(n_chars IN (0,1)) THEN 'binary' ELSE 'continuous' END FROM d UNION ALL
SELECT 'lang', 'categorical'""")
def feature_types(t: Tables):
    rows = t.labels.join(t.documents.select("doc_id", "n_chars", "lang"), "doc_id")
    return R.feature_kind_stats(rows, _DOC_DOMAINS)


@query("model_columns_only", """
SELECT o_orderpriority AS income, o_totalprice AS pm10_mean, o_orderstatus AS typology FROM orders""")
def model_columns_only(t: Tables):
    raw = t.orders.select(F.col("o_orderkey").alias("participant_id"), F.col("o_orderpriority").alias("income"),
                          F.col("o_totalprice").alias("pm10_mean"), F.col("o_orderstatus").alias("typology"),
                          F.lit(1).alias("i_united_heart"))
    return R.keep_model_columns(raw, exclude=["i_united_heart"])


@query("aligned_features", """
SELECT c_custkey AS id, c_acctbal AS noisenight, 0 AS typology_Z, c_nationkey AS intersections FROM customer""")
def aligned_features(t: Tables):
    raw = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("intersections"),
                            F.col("c_acctbal").alias("noisenight"), "c_mktsegment")
    return R.align_features(raw, ["noisenight", "typology_Z", "intersections"], keep=["id"])


@query("features_dropped_with_types", """
SELECT l_orderkey AS id, l_quantity FROM lineitem""")
def features_dropped_with_types(t: Tables):
    b = Bundle(t.lineitem.select(F.col("l_orderkey").alias("id"), "l_quantity", "l_tax", "l_discount"),
               FeatureSpec(l_quantity="continuous", l_tax="continuous", l_discount="continuous"))
    kept = R.drop_features(b, ["l_tax", "l_discount"])
    return kept.df.select("id", *kept.spec.features)


@query("complete_rows", """
SELECT c_custkey, round(c_acctbal, 2) AS balance, c_mktsegment AS segment FROM customer
WHERE c_custkey % 7 <> 0 AND c_custkey % 5 <> 1""")
def complete_rows(t: Tables):
    key = F.col("c_custkey")
    rows = t.customer.select(key, nulled(F.round("c_acctbal", 2), key, 7).alias("balance"),
                             nulled(F.col("c_mktsegment"), key, 5, 1).alias("segment"))
    return R.complete_rows(rows)


@query("rows_with_any_source", """
SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS a, CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END AS b
FROM customer WHERE NOT (c_custkey % 3 = 0 AND c_custkey % 5 = 0)""")
def rows_with_any_source(t: Tables):
    key = F.col("c_custkey")
    rows = t.customer.select(key, nulled(F.col("c_acctbal"), key, 3).alias("a"),
                             nulled(F.col("c_nationkey"), key, 5).alias("b"))
    return R.rows_with_any(rows, ["a", "b"])


@query("point_lookup", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey = 36""")
def point_lookup(t: Tables):
    return R.point_lookup(t.orders, "o_orderkey", 36)


@query("noise_removed", """
SELECT vec_id, CASE WHEN label = 3 THEN -1 ELSE label END AS label FROM embeddings WHERE label <> 3""")
def noise_removed(t: Tables):
    rows = t.embeddings.select("vec_id", F.when(F.col("label") == 3, -1).otherwise(F.col("label")).alias("label"))
    return R.without_noise(rows)


@query("socio_grid", """
SELECT n_nationkey AS id, i.income, e.education_level, a.age_bin, s.sex, n_regionkey AS typology
FROM nation,
 (VALUES ('<50k'),('50–100k'),('100–150k'),('>150k')) i(income),
 (VALUES ('primary'),('secondary'),('tertiary')) e(education_level),
 (VALUES ('Early Childhood (0-6y)'),('Children (6-12y)'),('Teenagers (12-18y)'),('Young Adults (18-30y)'),
         ('Adults (30-50y)'),('Middle-Aged Adults (50-70y)'),('Older Adults (70+y)')) a(age_bin),
 (VALUES ('M'),('F')) s(sex)""")
def socio_grid(t: Tables):
    return R.with_socio_combinations(t.nation.select(F.col("n_nationkey").alias("id"),
                                                     F.col("n_regionkey").alias("typology")))


@query("summaries_outer_merged", """
WITH a AS (SELECT c_nationkey AS typology, avg(c_acctbal) AS wealth FROM customer GROUP BY 1),
     b AS (SELECT s_nationkey + 5 AS typology, avg(s_acctbal) AS supply FROM supplier GROUP BY 1)
SELECT typology, round(wealth, 6) AS wealth, round(supply, 6) AS supply FROM a FULL JOIN b USING (typology)""")
def summaries_outer_merged(t: Tables):
    a = P.group_mean(t.customer.select(F.col("c_nationkey").alias("typology"),
                                                                 F.col("c_acctbal").alias("wealth")), ["typology"], ["wealth"])
    b = P.group_mean(t.supplier.select((F.col("s_nationkey") + 5).alias("typology"),
                                                                 F.col("s_acctbal").alias("supply")), ["typology"], ["supply"])
    return rounded(R.outer_merge([a, b], ["typology"]))


_VIEW_DOMAINS = Domains(environment=("e0", "e1"), morphology=("m-8", "m_9"))


@query("scaled_views", """
WITH s AS (SELECT vec_id, embedding[1]::double AS e0, embedding[2]::double AS e1, embedding[9]::double AS m_8,
                  embedding[10]::double AS m_9, label FROM embeddings)
SELECT vec_id, round((e0 - avg(e0) OVER ()) / stddev_pop(e0) OVER (), 6) AS e0,
       round((e1 - avg(e1) OVER ()) / stddev_pop(e1) OVER (), 6) AS e1,
       round((m_8 - avg(m_8) OVER ()) / stddev_pop(m_8) OVER (), 6) AS m_8,
       round((m_9 - avg(m_9) OVER ()) / stddev_pop(m_9) OVER (), 6) AS m_9, label AS typology
FROM s""")
def scaled_views(t: Tables):
    rows = component(component(t.embeddings, "embedding", (0, 1), "e"), "embedding", (8, 9), "m_")
    v = R.split_views(rows.withColumnRenamed("label", "typology"), "vec_id", domains=_VIEW_DOMAINS, meta=("typology",))
    return rounded(v.environment.join(v.morphology, "vec_id").join(v.meta, "vec_id"))
