"""Ordinal codes, one-hot columns, scaling and imputation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from riskspark.functions.columns import age_band, code_of, hours_of, ident, number
from riskspark.operators.longform import to_long
from riskspark.operators.ranking import quantile_values
from riskspark.spec import DEFAULT_DOMAINS, ORDINAL, Domains, FeatureSpec



def add_age_band(df: DataFrame, source: str = "age", name: str = "age_bin") -> DataFrame:
    if source not in df.columns:
        return df.withColumn(name, F.lit(None).cast("string"))
    return df.withColumn(name, age_band(ident(source)))


def encode_ordinals(df: DataFrame, domains: Domains = DEFAULT_DOMAINS,
                    columns: Sequence[str] = ORDINAL) -> DataFrame:
    return df.withColumns({c: code_of(ident(c), domains.socio[c]) for c in columns if c in df.columns})


def encode_extras(df: DataFrame, domains: Domains = DEFAULT_DOMAINS) -> DataFrame:
    """Bedtime text to hours, sex to 0/1."""
    out = {}
    if "bedtime_hour" in df.columns:
        out["bedtime_hour"] = hours_of(ident("bedtime_hour"))
    if "sex" in df.columns:
        out["sex"] = code_of(ident("sex"), domains.socio["sex"])
    return df.withColumns(out) if out else df


def level_lists(df: DataFrame, columns: Sequence[str]) -> dict[str, list]:
    """Sorted distinct levels per categorical column (None last when nulls occur).

    One aggregate for all columns.
    """
    if not columns:
        return {}
    items = F.array(*[F.struct(F.lit(c).alias("c"), ident(c).cast("string").alias("v")) for c in columns])
    rows = df.select(F.inline(items)).distinct().collect()  # levels, not rows
    levels: dict[str, list] = {c: [] for c in columns}
    for r in rows:
        levels[r["c"]].append(r["v"])
    for c, vs in levels.items():
        levels[c] = sorted(v for v in vs if v is not None) + ([None] if None in vs else [])
    return levels


@dataclass(frozen=True)
class OneHot:
    """Fitted levels; the same object encodes training and inference rows."""

    levels: dict[str, list]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> "OneHot":
        return cls(level_lists(df, [c for c in columns if c in df.columns]))

    def names(self, column: str) -> list[str]:
        return [f"{column}_{'nan' if v is None else v}" for v in self.levels[column]]

    def transform(self, df: DataFrame) -> DataFrame:
        for c, levels in self.levels.items():
            if c not in df.columns:
                continue
            text = ident(c).cast("string")
            hot = {n: text.eqNullSafe(F.lit(v)).cast("int") for n, v in zip(self.names(c), levels)}
            df = df.withColumns(hot).drop(c)
        return df

    def update(self, spec: FeatureSpec) -> FeatureSpec:
        out = FeatureSpec(spec)
        for c in self.levels:
            if out.pop(c, None) is not None:
                out.update({n: "binary" for n in self.names(c)})
        return out


def one_hot(df: DataFrame, spec: FeatureSpec, columns: Sequence[str]) -> tuple[DataFrame, FeatureSpec]:
    enc = OneHot.fit(df, columns)
    return enc.transform(df), enc.update(spec)


@dataclass(frozen=True)
class LevelCodes:
    """Ablation without one-hot: position in the sorted levels; null and unseen levels are null.

    The fitted levels encode training and inference rows alike.
    """

    levels: dict[str, list]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> "LevelCodes":
        lists = level_lists(df, [c for c in columns if c in df.columns])
        return cls({c: [v for v in levels if v is not None] for c, levels in lists.items()})

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, levels in self.levels.items():
            if c in df.columns:
                code = F.array_position(F.array(*[F.lit(v) for v in levels]).cast("array<string>"), ident(c).cast("string"))
                out[c] = F.when(code > 0, (code - 1).cast("int"))
        return df.withColumns(out) if out else df


def level_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return LevelCodes.fit(df, columns).transform(df)


# -- scaling ------------------------------------------------------------------
@dataclass(frozen=True)
class Scaler:
    """Means and population deviations from one aggregate over the fitting rows."""

    mean: dict[str, float]
    scale: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> "Scaler":
        aggs = [f(number(ident(c))).alias(f"{n}{i}") for i, c in enumerate(columns)
                for n, f in (("m", F.avg), ("s", F.stddev_pop))]
        row = df.agg(*aggs).first() if aggs else {}
        return cls({c: row[f"m{i}"] or 0.0 for i, c in enumerate(columns)},
                   {c: row[f"s{i}"] or 1.0 for i, c in enumerate(columns)})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (number(ident(c)) - F.lit(m)) / F.lit(self.scale[c])
                               for c, m in self.mean.items()})


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return Scaler.fit(df, columns).transform(df)


def scaler_for(df_train: DataFrame, spec: FeatureSpec, *, enabled: bool = True) -> Scaler | None:
    """Scale all features but the binary ones, with statistics of the training rows only."""
    cols = [c for c in spec.features if spec[c] != "binary"]
    return Scaler.fit(df_train, cols) if enabled and cols else None


# -- imputation ---------------------------------------------------------------
def mode_values(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent value per column as text, smallest on a tie."""
    if not columns:
        return {}
    kinds = dict(df.dtypes)

    def key(c: str) -> Column:
        return number(ident(c)) if kinds[c] != "string" else F.lit(None).cast("double")

    counts = (to_long(df, columns, numeric=False, extra={"num": {c: key(c) for c in columns}})
              .groupBy("feature", "value", "num").agg(F.count("*").alias("n")))
    best = counts.groupBy("feature").agg(
        F.min(F.struct(-F.col("n"), F.col("num"), F.col("value")))["value"].alias("v"))
    return {r["feature"]: r["v"] for r in best.collect()}


def impute(df: DataFrame, *, exclude: Iterable[str] = (), domains: Domains = DEFAULT_DOMAINS,
           rows_per_bucket: int | None = None) -> DataFrame:
    """Median, mode or 0 by configured kind; columns without nulls are only cast."""
    skip = set(exclude)
    have = [c for c in df.columns if c not in skip]
    kinds = dict(df.dtypes)
    cont = [c for c in have if c in domains.continuous]
    cat = [c for c in have if c in domains.categorical]
    binary = [c for c in have if c in domains.binary and c not in cont]
    if not (cont or cat or binary):
        return df
    holes = df.agg(*[F.count_if(number(ident(c)).isNull() if c in cont else ident(c).isNull()).alias(f"h{i}")
                     for i, c in enumerate(cont + cat + binary)]).first()
    missing = {c for i, c in enumerate(cont + cat + binary) if holes[f"h{i}"]}
    want = [c for c in cont if c in missing]
    medians = {c: v[0] for c, v in quantile_values(df, want, [0.5], rows_per_bucket).items()} if want else {}
    modes = mode_values(df, [c for c in cat + binary if c in missing])
    out = {}
    for c in cont:
        x = number(ident(c))
        out[c] = F.coalesce(x, F.lit(medians[c])) if c in medians else x
    for c in cat + binary:
        if c in missing:
            fill = modes.get(c, "Unknown" if c in cat else "0")
            out[c] = F.coalesce(ident(c), F.lit(fill).cast(kinds[c]))
    return df.withColumns(out)
