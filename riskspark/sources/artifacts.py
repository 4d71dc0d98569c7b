"""Fitted models and their configuration on shared storage."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from riskspark.functions.columns import safe_name_text
from riskspark.operators.encode import LevelCodes, OneHot
from riskspark.operators.models import NearestRowsModel
from riskspark.plans.risk import RiskModel
from riskspark.plans.supervised import SuiteResult
from riskspark.spec import FeatureSpec

CONFIG = ("model string, model_file string, dataset_name string, threshold double, feature_types map<string,string>, "
          "enable_ohe boolean, levels map<string,array<string>>, neighbours struct<k:int,kind:string,output:string,at:int>")


def save_result(result: SuiteResult, root: str, dataset: str, encoder: OneHot | LevelCodes | None = None) -> str:
    """Model directory and a one-row JSON configuration under ``root/<dataset>``."""
    spark = result.leaderboard.sparkSession
    folder = f"{root.rstrip('/')}/{safe_name_text(dataset)}"
    file = safe_name_text(result.best_name)
    stages = list(result.model.stages)
    near = next(((i, s) for i, s in enumerate(stages) if isinstance(s, NearestRowsModel)), None)
    neighbours = None
    if near:
        i, s = near
        PipelineModel(stages[:i]).write().overwrite().save(f"{folder}/{file}/before")
        PipelineModel(stages[i + 1:]).write().overwrite().save(f"{folder}/{file}/after")
        s.rows.write.mode("overwrite").parquet(f"{folder}/{file}/rows")
        neighbours = (s.k, s.kind, s.output, i)
    else:
        result.model.write().overwrite().save(f"{folder}/{file}")
    row = (result.best_name, file, dataset, result.threshold, dict(result.spec), isinstance(encoder, OneHot),
           encoder.levels if encoder else None, neighbours)
    spark.createDataFrame([row], CONFIG).coalesce(1).write.mode("overwrite").json(f"{folder}/config")
    return folder


def load_config(spark: SparkSession, root: str, dataset: str) -> dict | None:
    """The configuration, or None where it is missing or unreadable."""
    path = f"{root.rstrip('/')}/{safe_name_text(dataset)}/config"
    try:
        row = spark.read.schema(CONFIG).json(path).first()
    except AnalysisException:
        return None
    return row.asDict(recursive=True) if row and row["model"] else None


def discover(spark: SparkSession, root: str) -> list[str]:
    """Datasets with a configuration under the root folder."""
    try:
        rows = spark.read.schema(CONFIG).json(f"{root.rstrip('/')}/*/config")
    except AnalysisException:
        return []
    return [r[0] for r in rows.filter("dataset_name IS NOT NULL").select("dataset_name").distinct()
            .orderBy("dataset_name").collect()]


def load_model(spark: SparkSession, root: str, config: dict) -> PipelineModel | None:
    path = f"{root.rstrip('/')}/{safe_name_text(config['dataset_name'])}/{config['model_file']}"
    try:
        near = config.get("neighbours")
        if not near:
            return PipelineModel.load(path)
        before, after = PipelineModel.load(f"{path}/before"), PipelineModel.load(f"{path}/after")
        knn = NearestRowsModel(spark.read.parquet(f"{path}/rows"), near["k"], near["kind"], near["output"])
        return PipelineModel([*before.stages, knn, *after.stages])
    except Exception:  # a missing or broken model means the target is left out
        return None


def load_risk_models(spark: SparkSession, root: str) -> dict[str, RiskModel]:
    """Every stored target that can still be scored."""
    out = {}
    for name in discover(spark, root):
        cfg = load_config(spark, root, name)
        model = load_model(spark, root, cfg) if cfg else None
        if model is None or not cfg["feature_types"]:
            continue
        spec = FeatureSpec(cfg["feature_types"])
        kind = OneHot if cfg["enable_ohe"] else LevelCodes
        enc = kind({k: list(v) for k, v in cfg["levels"].items()}) if cfg["levels"] else None
        shell = SuiteResult(None, cfg["model"], {}, cfg["threshold"], model, spec.features, None, {}, {}, spec)
        out[name] = shell.risk_model(enc)
    return out
