"""Session settings the library relies on, and the shared folder it may write to."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "riskspark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; a temporary one only where none is set."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="riskspark-"))
        current = sc.getCheckpointDir()
    return current


def new_shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives executor loss."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def rewritten(df: DataFrame, label: str, old: str | None = None) -> tuple[DataFrame, str]:
    """``df`` from a table of its own in the shared folder, and the path; the table at ``old``, which ``df`` may have read, goes."""
    spark = df.sparkSession
    path = new_shared_path(spark, label)
    df.write.parquet(path)
    if old:
        at = spark._jvm.org.apache.hadoop.fs.Path(old)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return spark.read.schema(df.schema).parquet(path), path


def released(spark: SparkSession) -> None:
    """Let Spark free the shuffles and broadcasts nothing refers to any more, which it does when the collectors find them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_frame(df: DataFrame, limit: int = 20_000) -> tuple[DataFrame, bool]:
    """Check a statistic's size: up to ``limit`` rows become a broadcastable local frame.

    Beyond the limit the frame is written to the shared folder and joined by
    shuffle instead (second element False).
    """
    from pyspark.sql import functions as F

    rows = df.limit(limit + 1).collect()
    spark = df.sparkSession
    if len(rows) <= limit:
        return F.broadcast(spark.createDataFrame(rows, df.schema)), True
    return cut_lineage(df), False
