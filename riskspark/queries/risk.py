"""Preprocessing, grid scoring and risk reports over derived neighbourhoods."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark.operators import encode as E, profile as P, tables as R
from riskspark.plans import preprocess as PP, risk as K
from riskspark.queries.registry import Tables, nulled, query, rounded
from riskspark.spec import Domains, FeatureSpec

# scaled per-nation averages stand in for exposure; fixed weights for a fitted model
_SPEC = FeatureSpec(noise=("continuous"), income="continuous", age_bin="continuous", target="binary")
_DOMAINS = Domains(continuous=("noise", "spend", "income", "age_bin", "education_level"), categorical=("typology",),
                   binary=(), target_sources={})
_HEART = K.LinearScore({"noise": 0.8, "income": -0.3, "age_bin": 0.4}, -1.0)
_LUNG = K.LinearScore({"spend": 0.6, "education_level": -0.5, "typology_2": 0.7, "typology_9": 5.0}, -0.5)
_LUNG_SPEC = FeatureSpec(spend="continuous", education_level="continuous", typology_2="binary", typology_9="binary", target="binary")


def _grid(t: Tables):
    """nation as neighbourhoods: noise and spend are averages of its customers and orders."""
    wealth = t.customer.groupBy(F.col("c_nationkey").alias("id")).agg((F.avg("c_acctbal") / 5000 - 1).alias("noise"))
    spend = (t.customer.select(F.col("c_nationkey").alias("id"), "c_custkey")
             .join(t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_totalprice"), "c_custkey")
             .groupBy("id").agg((F.avg("o_totalprice") / 250000 - 1).alias("spend")))
    nation = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").cast("string").alias("typology"))
    return nation.join(wealth, "id").join(spend, "id")


def _models(t: Tables):
    return {"heart": K.RiskModel(_SPEC, _HEART.transform),
            "lung": K.RiskModel(_LUNG_SPEC, _LUNG.transform, E.OneHot({"typology": ["0", "1", "2", "3", "4"]}))}


_GRID = """
g AS (SELECT n_nationkey AS id, n_regionkey::varchar AS typology, w.noise, s.spend FROM nation
  JOIN (SELECT c_nationkey, avg(c_acctbal) / 5000 - 1 AS noise FROM customer GROUP BY 1) w ON w.c_nationkey = n_nationkey
  JOIN (SELECT c_nationkey, avg(o_totalprice) / 250000 - 1 AS spend FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1) s ON s.c_nationkey = n_nationkey),
inc AS (SELECT * FROM (VALUES ('<50k', 0), ('50–100k', 1), ('100–150k', 2), ('>150k', 3)) v(income, ic)),
edu AS (SELECT * FROM (VALUES ('primary', 0), ('secondary', 1), ('tertiary', 2)) v(education_level, ec)),
age AS (SELECT * FROM (VALUES ('Early Childhood (0-6y)', 0), ('Children (6-12y)', 1), ('Teenagers (12-18y)', 2), ('Young Adults (18-30y)', 3),
  ('Adults (30-50y)', 4), ('Middle-Aged Adults (50-70y)', 5), ('Older Adults (70+y)', 6)) v(age_bin, ac)),
r AS (SELECT id, income, education_level, age_bin, sex, typology,
  1 / (1 + exp(-(-1.0::double + noise * 0.8::double + ic * -0.3::double + ac * 0.4::double))) AS risk_heart,
  1 / (1 + exp(-(-0.5::double + spend * 0.6::double + ec * -0.5::double + (typology = '2')::int * 0.7::double))) AS risk_lung
  FROM g, inc, edu, age, (VALUES ('M'), ('F')) v(sex))"""
_FLAGS = """
l AS (SELECT 'heart' AS target, {keys}, heart AS risk FROM m UNION ALL SELECT 'lung', {keys}, lung FROM m),
z AS (SELECT *, round_even((risk - avg(risk) OVER (PARTITION BY target)) / stddev_samp(risk) OVER (PARTITION BY target) * 100, 0) / 100::double AS zscore FROM l)
SELECT target, {keys}, round(risk, 6) AS risk, zscore, CASE WHEN zscore >= 1.5 THEN 'high' WHEN zscore <= -1.5 THEN 'low' END AS flag FROM z"""


@query("risk_grid_scored", f"WITH {_GRID} SELECT id, income, education_level, age_bin, sex, round(risk_heart, 6) AS risk_heart, round(risk_lung, 6) AS risk_lung, typology FROM r")
def risk_grid_scored(t: Tables):
    return rounded(K.score_grid(_grid(t), _models(t), key="id", domains=_DOMAINS).drop("noise", "spend"))


@query("risk_by_type", f"WITH {_GRID} SELECT typology, round(avg(risk_heart), 6) AS heart, round(avg(risk_lung), 6) AS lung FROM r GROUP BY 1")
def risk_by_type(t: Tables):
    return rounded(K.average_risk(K.score_grid(_grid(t), _models(t), key="id", domains=_DOMAINS), ["typology"], ["heart", "lung"]))


@query("risk_by_type_age", f"WITH {_GRID} SELECT typology, age_bin, round(avg(risk_heart), 6) AS heart, round(avg(risk_lung), 6) AS lung FROM r GROUP BY 1, 2")
def risk_by_type_age(t: Tables):
    return rounded(K.average_risk(K.score_grid(_grid(t), _models(t), key="id", domains=_DOMAINS),
                                  ["typology", "age_bin"], ["heart", "lung"]))


def _flags(t: Tables, keys):
    risks = K.score_grid(_grid(t), _models(t), key="id", domains=_DOMAINS)
    out = K.risk_flags(K.average_risk(risks, keys, ["heart", "lung"]), keys, ["heart", "lung"])
    return out.withColumn("risk", F.round("risk", 6))


@query("risk_by_type_flags", f"WITH {_GRID}, m AS (SELECT typology, avg(risk_heart) AS heart, avg(risk_lung) AS lung FROM r GROUP BY 1)," + _FLAGS.format(keys="typology"))
def risk_by_type_flags(t: Tables):
    return _flags(t, ["typology"])


@query("risk_by_type_age_flags", f"WITH {_GRID}, m AS (SELECT typology, age_bin, avg(risk_heart) AS heart, avg(risk_lung) AS lung FROM r GROUP BY 1, 2)," + _FLAGS.format(keys="typology, age_bin"))
def risk_by_type_age_flags(t: Tables):
    return _flags(t, ["typology", "age_bin"])


@query("neighbourhood_lookup", f"WITH {_GRID} SELECT id, income, education_level, age_bin, sex, round(risk_heart, 6) AS risk_heart FROM r WHERE id = 7")
def neighbourhood_lookup(t: Tables):
    risks = K.score_grid(_grid(t), _models(t), key="id", domains=_DOMAINS)
    return rounded(R.point_lookup(risks, "id", 7))


@query("scoring_preprocess", """
SELECT o_orderkey AS id, CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '3-MEDIUM' THEN 1 END AS income, o_totalprice AS pm10_mean FROM orders""")
def scoring_preprocess(t: Tables):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("income"),
                           F.col("o_totalprice").alias("pm10_mean"), F.col("o_orderstatus").alias("note"))
    dom = Domains(socio={"income": ("5-LOW", "3-MEDIUM"), "sex": ("M", "F")})
    return R.column_order(PP.preprocess_for_scoring(rows, dom, keep=["id"]), ["id"])


_PRE = Domains(continuous=("age_bin", "income", "price"), categorical=("typology",), binary=("hot",), target_sources={},
               socio={"income": ("5-LOW", "3-MEDIUM", "1-URGENT"), "age_bin": tuple(Domains().socio["age_bin"]), "sex": ("M", "F")})


@query("preprocessed_participants", """
WITH p AS (SELECT o_orderkey AS participant_id, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price,
   CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 END::double AS income,
   CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS typology, CASE WHEN o_orderkey % 3 <> 0 THEN (o_totalprice > 250000)::int END AS hot,
   (CASE WHEN o_orderkey % 90 < 6 THEN 0 WHEN o_orderkey % 90 < 12 THEN 1 WHEN o_orderkey % 90 < 18 THEN 2 WHEN o_orderkey % 90 < 30 THEN 3
     WHEN o_orderkey % 90 < 50 THEN 4 WHEN o_orderkey % 90 < 70 THEN 5 ELSE 6 END)::double AS age_bin FROM orders),
 m AS (SELECT median(price) AS mp, median(income) AS mi FROM p),
 c AS (SELECT typology AS v FROM p WHERE typology IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
 b AS (SELECT hot AS v FROM p WHERE hot IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT participant_id, round(coalesce(price, mp), 2) AS price, coalesce(income, mi) AS income, coalesce(typology, c.v) AS typology, coalesce(hot, b.v) AS hot, age_bin FROM p, m, c, b""")
def preprocessed_participants(t: Tables):
    key = F.col("o_orderkey")
    rows = t.orders.select(key.alias("participant_id"), nulled(F.col("o_totalprice"), key, 7).alias("price"),
                           F.col("o_orderpriority").alias("income"), nulled(F.col("o_orderstatus"), key, 5).alias("typology"),
                           nulled((F.col("o_totalprice") > 250000).cast("int"), key, 3).alias("hot"),
                           F.pmod(key, F.lit(90)).alias("age"))
    out = PP.preprocess(rows, domains=_PRE, keep=["participant_id"])
    return rounded(out, 2)


@query("cleaned_grid", """
SELECT p_partkey AS id, p_brand AS typology, p_type AS kind, p_size AS noise_night FROM part WHERE p_partkey % 11 <> 0""")
def cleaned_grid(t: Tables):
    key = F.col("p_partkey")
    raw = t.part.select(key.alias("ID"), F.lit("Somewhere").alias("City"), nulled(F.col("p_brand"), key, 11).alias("Typology"),
                        F.col("p_type").alias(" Kind"), F.col("p_size").alias("Noise Night"), F.lit(3).alias("flat"),
                        (key + 0.5).alias("unique_measure"), F.col("p_size").alias("Left"), F.col("p_size").alias("bin_noise"),
                        *[F.col("p_size").alias(c) for c in ("top", "right", "bottom", "row_index", "col_index", "q_cluster", "z_distance")])
    return PP.clean_grid(raw)


@query("risk_grid_repeated_keys", f"""WITH {_GRID},
k AS (SELECT id AS old, CASE WHEN id % 3 = 0 THEN NULL ELSE id // 2 END AS id FROM g)
SELECT k.id, income, education_level, age_bin, sex, round(risk_heart, 6) AS risk_heart, round(risk_lung, 6) AS risk_lung, typology
FROM r JOIN k ON r.id = k.old""")
def risk_grid_repeated_keys(t: Tables):
    """Keys that repeat or are null: every grid row keeps its own combinations."""
    grid = _grid(t).withColumn("id", F.when(F.col("id") % 3 != 0, F.floor(F.col("id") / 2)))
    return rounded(K.score_grid(grid, _models(t), key="id", domains=_DOMAINS).drop("noise", "spend"))


@query("risk_level_coded", """
WITH lv AS (SELECT *, row_number() OVER (ORDER BY p_brand) - 1 AS c FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand < 'Brand#4'))
SELECT p_partkey, round(1 / (1 + exp(-(0.1::double * c - 1.0::double))), 6) AS score FROM part LEFT JOIN lv USING (p_brand)""")
def risk_level_coded(t: Tables):
    """Levels fitted on some rows code all rows; a level not seen there is null, and so is its score."""
    codes = E.LevelCodes.fit(t.part.filter("p_brand < 'Brand#4'"), ["p_brand"])
    coded = codes.transform(t.part.select("p_partkey", "p_brand"))
    return rounded(K.LinearScore({"p_brand": 0.1}, -1.0).transform(coded).select("p_partkey", "score"))
