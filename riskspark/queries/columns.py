"""Scalar functions, encodings, imputation and target derivation."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark.functions import columns as C
from riskspark.operators import encode as E, profile as P, targets as T
from riskspark.queries.registry import Tables, nulled, query, rounded
from riskspark.spec import Domains, FeatureSpec

_AGE_CASE = """CASE WHEN p_size < 6 THEN 'Early Childhood (0-6y)' WHEN p_size < 12 THEN 'Children (6-12y)'
 WHEN p_size < 18 THEN 'Teenagers (12-18y)' WHEN p_size < 30 THEN 'Young Adults (18-30y)'
 WHEN p_size < 50 THEN 'Adults (30-50y)' WHEN p_size < 70 THEN 'Middle-Aged Adults (50-70y)'
 ELSE 'Older Adults (70+y)' END"""


@query("numeric_parse", """
SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN round(value, 6) END AS value FROM events""")
def numeric_parse(t: Tables):
    key = F.col("event_id")
    text = F.when(key % 7 == 0, F.when(key % 2 == 0, "n/a").otherwise("NaN")).otherwise(F.col("value").cast("string"))
    return t.events.select(key, F.round(C.number(text), 6).alias("value"))


@query("age_bins", f"SELECT p_partkey, {_AGE_CASE} AS age_bin FROM part")
def age_bins(t: Tables):
    return E.add_age_band(t.part.select("p_partkey", F.col("p_size").alias("age"))).drop("age")


@query("age_bin_counts", f"SELECT {_AGE_CASE} AS age_bin, count(*) AS n FROM part GROUP BY 1")
def age_bin_counts(t: Tables):
    return P.frequency(E.add_age_band(t.part.select(F.col("p_size").alias("age"))), "age_bin")


_PRIORITIES = ("5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH")
_ORDINALS = Domains(socio={"income": _PRIORITIES, "sex": ("F", "O")})


@query("ordinal_codes", """
SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '4-NOT SPECIFIED' THEN 1 WHEN '3-MEDIUM' THEN 2
  WHEN '2-HIGH' THEN 3 END AS income, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS sex FROM orders""")
def ordinal_codes(t: Tables):
    rows = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("income"), F.col("o_orderstatus").alias("sex"))
    return E.encode_extras(E.encode_ordinals(rows, _ORDINALS, ["income"]), _ORDINALS)


@query("hhmm_hours", """
SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN round(hour(ts) + minute(ts) / 60.0::double, 6) END AS bedtime_hour FROM events""")
def hhmm_hours(t: Tables):
    key = F.col("event_id")
    text = F.when(key % 7 == 0, F.lit("25:00")).otherwise(F.date_format("ts", "HH:mm"))
    return rounded(E.encode_extras(t.events.select(key, text.alias("bedtime_hour"))))


@query("clip_undefined", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE least(1, greatest(0, o_totalprice / 100000 - 1)) END AS unit FROM orders""")
def clip_undefined(t: Tables):
    """NaN is no risk of 1."""
    x = F.when(F.col("o_orderkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice") / 100000 - 1)
    return t.orders.select("o_orderkey", C.clip01(x).alias("unit"))


@query("clip_unit", """
SELECT l_orderkey, l_linenumber, l_partkey, round(least(greatest(l_quantity / 25.0::double - 0.5::double, 0), 1), 6) AS risk FROM lineitem""")
def clip_unit(t: Tables):
    risk = C.clip01(F.col("l_quantity") / 25.0 - 0.5)
    return rounded(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", risk.alias("risk")))


@query("squeeze_logit", """
WITH n AS (SELECT count(*) AS n FROM lineitem),
     s AS (SELECT l_orderkey, l_linenumber, l_partkey, ((l_discount / 0.1::double) * (n - 1) + 0.5::double) / n AS y FROM lineitem, n)
SELECT l_orderkey, l_linenumber, l_partkey, round(y, 9) AS y, round(ln(y / (1 - y)), 5) AS z,
       round(1 / (1 + exp(-ln(y / (1 - y)))), 9) AS back FROM s""")
def squeeze_logit(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_discount") / 0.1).alias("y"))
    n = F.lit(rows.count())
    sq = rows.withColumn("y", C.squeeze(F.col("y"), n)).withColumn("z", C.logit(F.col("y")))
    return (sq.withColumn("back", F.round(C.expit(F.col("z")), 9))
            .withColumn("y", F.round("y", 9)).withColumn("z", F.round("z", 5)))


@query("half_even_two_places", """
SELECT c_custkey, round_even(c_acctbal * 12.5::double, 0) / 100.0::double AS z FROM customer""")
def half_even_two_places(t: Tables):
    return t.customer.select("c_custkey", C.half_even(F.col("c_acctbal") / 8, 2).alias("z"))


@query("safe_names", r"""
SELECT p_partkey, trim(regexp_replace('(' || p_name || ') ' || p_brand, '[^\p{L}\p{N}]', '_', 'g'), '_') AS name FROM part""")
def safe_names(t: Tables):
    raw = F.concat(F.lit("("), F.col("p_name"), F.lit(") "), F.col("p_brand"))
    return t.part.select("p_partkey", C.safe_name(raw).alias("name"))


@query("one_hot", """
SELECT c_custkey, (s IS NOT NULL AND s = 'AUTOMOBILE')::int AS segment_AUTOMOBILE, (s IS NOT NULL AND s = 'BUILDING')::int AS segment_BUILDING,
  (s IS NOT NULL AND s = 'FURNITURE')::int AS segment_FURNITURE, (s IS NOT NULL AND s = 'HOUSEHOLD')::int AS segment_HOUSEHOLD,
  (s IS NOT NULL AND s = 'MACHINERY')::int AS segment_MACHINERY, (s IS NULL)::int AS segment_nan
FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS s FROM customer)""")
def one_hot(t: Tables):
    rows = t.customer.select("c_custkey", nulled(F.col("c_mktsegment"), F.col("c_custkey"), 7).alias("segment"))
    return E.one_hot(rows, FeatureSpec(segment="categorical"), ["segment"])[0]


@query("level_codes", """
SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN dense_rank() OVER (PARTITION BY c_custkey % 7 = 0 ORDER BY c_mktsegment) - 1 END AS segment
FROM customer""")
def level_codes(t: Tables):
    rows = t.customer.select("c_custkey", nulled(F.col("c_mktsegment"), F.col("c_custkey"), 7).alias("segment"))
    return E.level_codes(rows, ["segment"])


@query("scale_population", """
SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS l_quantity,
  round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER (), 6) AS l_extendedprice, 0.0::double AS flat
FROM lineitem""")
def scale_population(t: Tables):
    rows = (t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
            .withColumn("flat", F.lit(3.0)))
    return rounded(E.standardize(rows, ["l_quantity", "l_extendedprice", "flat"]))


_IMPUTE = Domains(continuous=("value",), categorical=("event_type",), binary=("weekend",), target_sources={})


@query("impute_all", """
WITH e AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value,
                  CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type,
                  CASE WHEN event_id % 3 <> 0 THEN (isodow(ts) >= 6)::int END AS weekend FROM events),
 m AS (SELECT median(value) AS md FROM e),
 c AS (SELECT event_type AS v FROM e WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
 b AS (SELECT weekend AS v FROM e WHERE weekend IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT event_id, round(coalesce(value, md), 6) AS value, coalesce(event_type, c.v) AS event_type, coalesce(weekend, b.v) AS weekend
FROM e, m, c, b""")
def impute_all(t: Tables):
    key = F.col("event_id")
    rows = t.events.select(key, nulled(F.col("value"), key, 7).alias("value"),
                           nulled(F.col("event_type"), key, 5).alias("event_type"),
                           nulled((F.weekday("ts") >= 5).cast("int"), key, 3).alias("weekend"))
    return rounded(E.impute(rows, domains=_IMPUTE))


@query("null_counts", """
SELECT 'value' AS feature, count(*) FILTER (WHERE event_id % 7 = 0) AS n_null FROM events UNION ALL
SELECT 'event_type', count(*) FILTER (WHERE event_id % 5 = 0) FROM events""")
def null_counts(t: Tables):
    key = F.col("event_id")
    return P.null_counts(t.events.select(key, nulled(F.col("value"), key, 7).alias("value"),
                                         nulled(F.col("event_type"), key, 5).alias("event_type")))


@query("table_shape", "SELECT count(*) AS n_rows, 11 AS n_cols FROM lineitem")
def table_shape(t: Tables):
    return P.shape(t.lineitem)


_FLAGS = Domains(target_sources={"cardiovascular": ("a", "b"), "mental_health": ("a",), "respiratory": ("b",),
                                 "sleep_disorder": ()})


@query("target_max_flags", """
WITH l AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN quality END AS a, CASE WHEN doc_id % 5 <> 0 THEN toxic END AS b FROM labels)
SELECT doc_id, greatest(a, b)::double AS target FROM l WHERE a IS NOT NULL OR b IS NOT NULL""")
def target_max_flags(t: Tables):
    key = F.col("doc_id")
    rows = t.labels.select(key, nulled(F.col("quality"), key, 3).alias("a"), nulled(F.col("toxic"), key, 5).alias("b"))
    spec = FeatureSpec(doc_id="continuous", a="binary", b="binary")
    return T.derive_target(rows, "cardiovascular", spec, domains=_FLAGS).df


@query("target_null_as_zero", """
SELECT doc_id, coalesce(CASE WHEN doc_id % 3 <> 0 THEN quality END, 0)::double AS target FROM labels""")
def target_null_as_zero(t: Tables):
    key = F.col("doc_id")
    rows = t.labels.select(key, nulled(F.col("quality"), key, 3).alias("a"))
    return T.derive_target(rows, "mental_health", FeatureSpec(doc_id="continuous", a="binary"),
                           drop_null_rows=False, domains=_FLAGS).df


def _sleepers(t: Tables):
    key = F.col("p_partkey")
    rows = t.part.select(
        key, F.col("p_size").alias("age"),
        nulled(F.pmod(key * 7, F.lit(13)).cast("double"), key, 11).alias("sleeping_hours"),
        (F.pmod(key, F.lit(2)) == 0).cast("int").alias("sleep_disorder_hot"),
        nulled(F.pmod(key, F.lit(5)) / 4.0, key, 9).alias("points_sleep_deprivation"))
    return E.add_age_band(rows).drop("age")


_SLEEP_SQL = """
WITH s AS (SELECT p_partkey, {expected} AS expected,
    CASE WHEN p_partkey % 11 <> 0 THEN (p_partkey * 7) % 13 END::double AS h,
    (p_partkey % 2 = 0)::int AS hot, CASE WHEN p_partkey % 9 <> 0 THEN (p_partkey % 5) / 4.0::double END AS dep FROM part),
 r AS (SELECT p_partkey, coalesce(1 - exp(-(h - expected) * (h - expected) / 8.0::double), 0) AS d,
    greatest(hot * 0.5::double, coalesce(dep, 0) * 0.7::double) AS f FROM s)
SELECT p_partkey, round(least(greatest(f + (1 - f) * d, 0), 1), 6) AS target FROM r"""
_EXPECTED = """CASE WHEN p_size < 6 THEN 12 WHEN p_size < 12 THEN 10 WHEN p_size < 18 THEN 9 WHEN p_size < 70 THEN 8 ELSE 7 END"""


@query("target_sleep_label", _SLEEP_SQL.format(expected=_EXPECTED))
def target_sleep_label(t: Tables):
    return rounded(_sleepers(t).select("p_partkey", T.sleep_target(_sleepers(t)).alias("target")))


@query("target_sleep_code", _SLEEP_SQL.format(expected="NULL::double"))
def target_sleep_code(t: Tables):
    rows = E.encode_ordinals(_sleepers(t), columns=["age_bin"])
    return rounded(rows.select("p_partkey", T.sleep_target(rows, age_bin_domain="code").alias("target")))
