"""Projections, pruning, row filters and joins on neighbourhood and participant tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F, types as T

from riskspark.functions.columns import ident, tidy_header
from riskspark.operators.longform import row_to_long
from riskspark.spec import DEFAULT_DOMAINS, GRID_METADATA, Bundle, Domains, FeatureSpec

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


# -- names and projections ----------------------------------------------------
def with_key_name(df: DataFrame, old: str = "id", new: str = "neighborhood_id") -> DataFrame:
    return df.withColumnRenamed(old, new) if old in df.columns and new not in df.columns else df


def tidy_names(df: DataFrame, *, hyphens: bool = False) -> DataFrame:
    return df.toDF(*[tidy_header(c, hyphens=hyphens) for c in df.columns])


def drop_metadata(df: DataFrame, columns: Iterable[str] = GRID_METADATA) -> DataFrame:
    return df.drop(*columns)


def drop_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def select_prefix(df: DataFrame, prefix: str, also: Sequence[str] = ()) -> DataFrame:
    return df.select(*[ident(c) for c in df.columns if c in also or c.startswith(prefix)])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC)]


def keep_model_columns(df: DataFrame, *, exclude: Iterable[str] = (),
                       domains: Domains = DEFAULT_DOMAINS, also: Iterable[str] = ()) -> DataFrame:
    allowed = (domains.model_columns | set(also)) - set(exclude)
    return df.select(*[ident(c) for c in df.columns if c in allowed])


def drop_features(bundle: Bundle, names: Iterable[str]) -> Bundle:
    names = list(names)
    return Bundle(bundle.df.drop(*names), bundle.spec.without(names)) if names else bundle


def column_order(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """Leading columns first, the others in their order."""
    return df.select(*[ident(c) for c in first], *[ident(c) for c in df.columns if c not in first])


def align_features(df: DataFrame, expected: Sequence[str], *, keep: Sequence[str] = ()) -> DataFrame:
    """The model's columns in the model's order: missing ones are 0, others go."""
    have = set(df.columns)
    return df.select(*[ident(c) for c in keep],
                     *[ident(c) if c in have else F.lit(0).alias(c) for c in expected])


# -- pruning ------------------------------------------------------------------
def cardinality_stats(df: DataFrame, cols: Sequence[str] | None = None, *,
                      protect: Sequence[str] = ("id",)) -> DataFrame:
    """Exact distinct count per column and whether pruning would drop it."""
    cols = [c for c in (cols or df.columns) if c not in protect]
    row = df.agg(F.count("*").alias("n"), *[F.count_distinct(ident(c)).alias(f"distinct__{i}")
                                           for i, c in enumerate(cols)])
    long = row.select("n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"distinct__{i}").alias("n_distinct"))
        for i, c in enumerate(cols)])).alias("s")).select("s.feature", "s.n_distinct", "n")
    return long.select("feature", "n_distinct", F.col("n").alias("n_rows"),
                       ((F.col("n_distinct") == F.col("n")) | (F.col("n_distinct") <= 1)).alias("prune"))


def prune_by_cardinality(df: DataFrame, *, protect: Sequence[str] = ("id",)) -> DataFrame:
    """Drop all-distinct and constant columns.

    A min/max and sketch pass clears almost every column; only columns whose
    sketch is near the row count pay for an exact distinct count.
    """
    cols = [c for c in df.columns if c not in protect]
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(cols):
        x = ident(c)
        aggs += [F.count(x).alias(f"k{i}"), (F.min(x).eqNullSafe(F.max(x))).alias(f"same{i}"),
                 F.approx_count_distinct(x, 0.02).alias(f"d{i}")]
    r = df.agg(*aggs).first()
    drop = [c for i, c in enumerate(cols) if r[f"same{i}"]]
    near = [c for i, c in enumerate(cols)
            if c not in drop and r[f"k{i}"] == r["n"] and r[f"d{i}"] > 0.8 * r["n"]]
    for c in near:
        if df.groupBy(ident(c)).count().filter("count > 1").isEmpty():
            drop.append(c)
    return df.drop(*drop)


def variance_stats(df: DataFrame, cols: Sequence[str] | None = None, tol: float = 1e-8) -> DataFrame:
    cols = list(cols or numeric_columns(df))
    row = df.agg(*[F.stddev_samp(ident(c).cast("double")).alias(f"std__{i}") for i, c in enumerate(cols)])
    return row_to_long(row, cols, ["std"]).withColumn(
        "prune", F.coalesce(F.col("std") <= tol, F.lit(False)))


def prune_constant(df: DataFrame, tol: float = 1e-8) -> DataFrame:
    cols = numeric_columns(df)
    r = df.agg(*[F.stddev_samp(ident(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return df.drop(*[c for i, c in enumerate(cols) if r[f"s{i}"] is not None and r[f"s{i}"] <= tol])


def feature_kind_stats(df: DataFrame, domains: Domains = DEFAULT_DOMAINS) -> DataFrame:
    """Kind of every column: configured lists first, then 0/1 content, else continuous."""
    known = {**{c: "binary" for c in domains.binary}, **{c: "categorical" for c in domains.categorical},
             **{c: "continuous" for c in domains.continuous}}
    cols = df.columns
    aggs = []
    for i, c in enumerate(cols):
        x = ident(c).try_cast("double")
        zero_one = F.coalesce(x.isin(0.0, 1.0), F.lit(False))
        ok = F.bool_and(F.when(ident(c).isNotNull(), zero_one))
        kind = F.lit(known[c]) if c in known else F.when(ok, "binary").otherwise("continuous")
        aggs.append((F.first(kind) if c in known else kind).alias(f"kind__{i}"))
    return row_to_long(df.agg(*aggs), cols, ["kind"])


def infer_spec(df: DataFrame, domains: Domains = DEFAULT_DOMAINS) -> FeatureSpec:
    kinds = {r["feature"]: r["kind"] for r in feature_kind_stats(df, domains).collect()}
    return FeatureSpec({c: kinds[c] or "continuous" for c in df.columns})


# -- row filters --------------------------------------------------------------
def complete_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(subset) if subset else None)


def rows_with_any(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Drop rows in which every listed column is null or NaN."""
    return df.na.drop("all", subset=list(subset))


def without_noise(df: DataFrame, label: str = "label") -> DataFrame:
    return df.filter(ident(label) != -1)


def point_lookup(df: DataFrame, key: str, value, n_columns: int = 6) -> DataFrame:
    return df.filter(ident(key) == value).select(*[ident(c) for c in df.columns[:n_columns]])


# -- joins --------------------------------------------------------------------
def checked_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on one key; null keys match nothing, other shared names are refused."""
    shared = (set(left.columns) & set(right.columns)) - {key}
    if shared:
        raise ValueError(f"columns on both sides: {sorted(shared)}")
    return left.join(right, key, "inner")


def combine(grid: DataFrame, socio: DataFrame, clinical: DataFrame) -> DataFrame:
    """Participants (socio x clinical) with their neighbourhood's columns.

    No hints: the small grid is broadcast by Catalyst when its size allows, and a
    neighbourhood that holds a large share of participants is split by AQE.
    """
    people = checked_join(socio, clinical, "participant_id")
    return checked_join(people, with_key_name(grid), "neighborhood_id")


def with_socio_combinations(grid: DataFrame, domains: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Every row times every combination of the fixed domains, without a join."""
    domains = domains or DEFAULT_DOMAINS.socio
    first, rest = grid.columns[0], [c for c in grid.columns[1:] if c not in domains]
    out = grid.select(ident(first), *[ident(c) for c in rest])
    for name, values in domains.items():
        out = out.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return out.select(ident(first), *[ident(c) for c in domains], *[ident(c) for c in rest])


def outer_merge(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer join of summaries on their keys, in key order."""
    out = frames[0]
    for other in frames[1:]:
        out = out.join(other, list(keys), "outer")
    return out.orderBy(*[ident(k) for k in keys])


# -- views --------------------------------------------------------------------
class Views(NamedTuple):
    environment: DataFrame
    morphology: DataFrame
    meta: DataFrame


def split_views(df: DataFrame, key: str, *, drop_na: bool = True, scale: bool = True,
                domains: Domains = DEFAULT_DOMAINS, match_hyphens: bool = True,
                meta: Sequence[str] = ("typology", "q_cluster")) -> Views:
    """Environment, morphology and metadata projections of one frame, keyed by ``key``."""
    from riskspark.operators.encode import standardize

    def named(cols):
        return [tidy_header(c, hyphens=True) if match_hyphens else c for c in cols]

    env = [c for c in named(domains.environment) if c in df.columns]
    morph = [c for c in named(domains.morphology) if c in df.columns]
    if not env or not morph:
        raise ValueError("no environment or no morphology columns in the table")
    rows = complete_rows(df, env + morph) if drop_na else df
    numeric = set(numeric_columns(df))
    env, morph = [c for c in env if c in numeric], [c for c in morph if c in numeric]
    pcs = [c for c in df.columns if c.startswith("pc")]
    both = standardize(rows, env + morph) if scale else rows
    return Views(both.select(ident(key), *[ident(c) for c in env]),
                 both.select(ident(key), *[ident(c) for c in morph]),
                 rows.select(ident(key), *[ident(c) for c in meta], *[ident(c) for c in pcs]))
