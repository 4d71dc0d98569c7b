"""Reading, storing, scoring."""

import tempfile

from oracle import folder
from pyspark.sql import functions as F

from riskspark.plans import risk as K, supervised as P
from riskspark.queries import modelling as Q
from riskspark.queries.registry import Tables
from riskspark.sources import artifacts, files
from riskspark.spec import Bundle, FeatureSpec


def test_malformed_lines(spark):
    path = tempfile.mkdtemp(prefix="riskspark-csv-")
    with open(f"{path}/grid.csv", "w") as f:
        f.write("id;noise\n1;0,5\n2;1,5;extra\n3\n4;n/a\n")
    rows = files.read_decimal_comma(spark, path, ["id", "noise"], ["noise"], skip_malformed=True).collect()
    assert [(r["id"], r["noise"]) for r in rows] == [("1", 0.5), ("3", None), ("4", None)]


def test_suite_stores_and_scores(spark):
    t = Tables(spark, folder("0.001"))
    grid = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").cast("double").alias("pm10_mean"),
                           (F.col("n_nationkey") % 3).cast("string").alias("typology"))
    people = (t.customer.join(grid, F.col("c_nationkey") == F.col("id"))
              .select("c_custkey", "pm10_mean", (F.col("c_custkey") % 4).cast("double").alias("income"),
                      (F.col("c_acctbal") > 4000).cast("int").alias("target")))
    bundle = Bundle(people, FeatureSpec(pm10_mean="continuous", income="continuous", target="binary"))
    name = "Logistic Regression (Ridge)"
    result = P.run_suite(bundle, "c_custkey", P.SuiteOptions(folds=2, refine=False, models=(name,), grids={name: {"C": [1.0]}}))
    assert result.best_name == name and 0 <= result.threshold <= 1
    assert {r["feature"] for r in result.coefficients.collect()} == {"pm10_mean", "income"}
    root = tempfile.mkdtemp(prefix="riskspark-out-")
    artifacts.save_result(result, root, "heart")
    assert artifacts.discover(spark, root) == ["heart"] and artifacts.load_config(spark, root, "lungs") is None
    models = artifacts.load_risk_models(spark, root)
    risks = K.score_grid(grid, models, key="id")
    assert risks.count() == 25 * 168 and risks.filter("risk_heart < 0 OR risk_heart > 1 OR risk_heart IS NULL").isEmpty()
    fresh = K.score_grid(grid, {"heart": result.risk_model()}, key="id")
    gap = risks.join(fresh.select("id", "income", "education_level", "age_bin", "sex", F.col("risk_heart").alias("r2")),
                     ["id", "income", "education_level", "age_bin", "sex"]).agg(F.max(F.abs(F.col("risk_heart") - F.col("r2"))))
    assert gap.first()[0] < 1e-12


def test_flagship_runs(spark):
    import __spark_entry__ as entry
    out = entry.queries()[entry.FLAGSHIP](spark, folder("0.001"))
    assert out.count() == 10 and set(entry.oracle_sql()) <= set(entry.queries())
    assert Q is not None
