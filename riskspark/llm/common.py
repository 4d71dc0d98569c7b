"""Shared helpers of the corpus operators: staging, frames with clashing columns, bounded filters."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskspark.session import new_shared_path

#: Most keys that ``only`` sends to every executor (8 bytes each); beyond it the filter is a shuffle join.
BROADCAST_KEYS = 500_000


#: Bytes of an Arrow batch of whole texts; 10,000 texts, Spark's measure, are held several times on both sides of the pipe.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def staged(df: DataFrame, label: str, batch_bytes: int | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors.

    With ``batch_bytes`` the write hands its Python steps Arrow batches of about that many bytes, whatever the session's limit.
    """
    spark, path = df.sparkSession, new_shared_path(df.sparkSession, label)
    before = None if batch_bytes is None else spark.conf.get(_BATCH)
    if batch_bytes is not None:
        spark.conf.set(_BATCH, batch_bytes)
    try:
        df.write.parquet(path)
    finally:
        if batch_bytes is not None:
            spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def only(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is among ``keys`` (distinct, same column name).

    The keys are broadcast when a count has shown that there are few; otherwise
    they are shuffled. Both ways return the same rows.
    """
    return df.join(_sized(keys), column, "left_semi")


def without(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is not among ``keys``; as ``only`` otherwise."""
    return df.join(_sized(keys), column, "left_anti")


def _sized(keys: DataFrame) -> DataFrame:
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return F.broadcast(keys) if few else keys.hint("shuffle_merge")


def released(spark: SparkSession) -> None:
    """Give back what earlier stages left on the driver: broadcasts, shuffles and plans nothing refers to any more.

    Spark frees them when the collector finds them; between stages of a long job that may be never.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Just the key as long and the text as string, whatever else the table holds."""
    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))


def fresh(docs: DataFrame, name: str) -> str:
    """A column name no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name
