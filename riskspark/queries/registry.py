"""Name -> (query, equivalent SQL) registry and helpers shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskspark.functions.columns import ident
from riskspark.sources.files import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Attribute access to the parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under a stable name."""
    def add(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn
    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double so both engines agree on the printed value."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(ident(c), places).alias(c) if kinds[c] in ("double", "float") else ident(c)
                       for c in df.columns])


def component(df: DataFrame, array: str, positions, prefix: str) -> DataFrame:
    """Double columns ``<prefix><i>`` from a float array column."""
    return df.withColumns({f"{prefix}{i}": F.element_at(ident(array), i + 1).cast("double") for i in positions})


def nulled(value: Column, key: Column, every: int, rest: int = 0) -> Column:
    """The value with a hole in every ``every``-th row: the tables hold no nulls of their own."""
    return F.when(F.pmod(key, F.lit(every)) != rest, value)
