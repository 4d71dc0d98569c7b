"""Delimited and columnar files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from riskspark.functions.columns import ident

_BAD = "_malformed_line"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Comma-separated with header; the schema is given, never inferred."""
    return spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE")


def read_decimal_comma(spark: SparkSession, path: str, columns: Sequence[str], numeric: Sequence[str], *,
                       skip_malformed: bool = False) -> DataFrame:
    """``;``-separated grid export with decimal commas; malformed lines may be skipped."""
    fields = [T.StructField(c, T.StringType()) for c in columns]
    if skip_malformed:
        fields.append(T.StructField(_BAD, T.StringType()))
    rows = spark.read.csv(path, header=True, sep=";", schema=T.StructType(fields), mode="PERMISSIVE",
                          columnNameOfCorruptRecord=_BAD)
    if skip_malformed:
        # a line with too many fields goes; a short line stays, padded with nulls
        too_long = F.size(F.split(F.col(_BAD), ";")) > len(columns)
        rows = rows.filter(F.col(_BAD).isNull() | ~too_long).drop(_BAD)
    return rows.withColumns({
        c: F.when(F.trim(ident(c)) != "", F.replace(F.trim(ident(c)), F.lit(","), F.lit(".")))
        .try_cast("double") for c in numeric})


def read_participants(spark: SparkSession, folder: str, socio: str = "SocioDemograph",
                      clinical: str = "HEALTH") -> tuple[DataFrame, DataFrame]:
    """The two participant tables; a sheet is a table of that name."""
    return read_table(spark, folder, socio), read_table(spark, folder, clinical)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.csv(path, header=True)
    else:
        writer.format(fmt).save(path)


def write_decimal_comma(df: DataFrame, path: str) -> None:
    kinds = dict(df.dtypes)
    cols = [F.replace(ident(c).cast("string"), F.lit("."), F.lit(",")).alias(c)
            if kinds[c] in ("double", "float") else ident(c) for c in df.columns]
    df.select(*cols).write.mode("overwrite").csv(path, header=True, sep=";")
