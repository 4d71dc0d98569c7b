"""The four health targets as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskspark import spec as S
from riskspark.functions.columns import any_flag, clip01, ident, lookup, number
from riskspark.operators.tables import rows_with_any
from riskspark.spec import DEFAULT_DOMAINS, TARGET_KIND, Bundle, Domains, FeatureSpec


def flag_target(df: DataFrame, columns, *, null_as_zero: bool = False) -> Column:
    cols = [number(ident(c)) for c in columns]
    if null_as_zero:
        cols = [F.coalesce(c, F.lit(0.0)) for c in cols]
    return any_flag(cols)


def sleep_risk(hours: Column, expected: Column, hot: Column, deprivation: Column) -> Column:
    """Deviation from the expected hours, lifted over a floor from complaints; in [0,1]."""
    gap = number(hours) - expected
    spread = F.lit(2 * S.SLEEP_HOURS_SPREAD ** 2)
    deviation = F.coalesce(F.lit(1.0) - F.exp(-(gap * gap) / spread), F.lit(0.0))
    floor = F.greatest(F.coalesce(number(hot), F.lit(0.0)) * S.HOT_MONTH_FLOOR,
                       F.coalesce(number(deprivation), F.lit(0.0)) * S.DEPRIVATION_FLOOR)
    return clip01(floor + (F.lit(1.0) - floor) * deviation)


def _or_null(df: DataFrame, name: str) -> Column:
    return ident(name) if name in df.columns else F.lit(None).cast("double")


def sleep_target(df: DataFrame, *, age_bin_domain: str = "label", age_column: str = "age_bin",
                 domains: Domains = DEFAULT_DOMAINS) -> Column:
    """``label`` looks expected hours up by age-band label; ``code`` is for an age
    column already coded as integers, which matches no label, so deviation is 0."""
    if age_bin_domain not in ("label", "code"):
        raise ValueError("age_bin_domain is 'label' or 'code'")
    live = age_bin_domain == "label" and age_column in df.columns
    expected = lookup(ident(age_column), domains.expected_sleep) if live else F.lit(None).cast("double")
    return sleep_risk(_or_null(df, "sleeping_hours"), expected,
                      _or_null(df, "sleep_disorder_hot"), _or_null(df, "points_sleep_deprivation"))


def derive_target(df: DataFrame, target: str, spec: FeatureSpec, *, drop_null_rows: bool = True,
                  age_bin_domain: str = "label", age_column: str = "age_bin",
                  domains: Domains = DEFAULT_DOMAINS) -> Bundle:
    """Add ``target``, drop all source columns, keep the feature map in step."""
    if target not in TARGET_KIND:
        raise ValueError(f"unknown target {target!r}")
    sources = domains.target_sources[target]
    rows = rows_with_any(df, [c for c in sources if c in df.columns]) if drop_null_rows else df
    if target == "sleep_disorder":
        value = sleep_target(rows, age_bin_domain=age_bin_domain, age_column=age_column, domains=domains)
    else:
        value = flag_target(rows, sources, null_as_zero=target == "mental_health")
    gone = [c for c in domains.all_target_sources if c in df.columns]
    kinds = spec.without(gone)
    kinds["target"] = TARGET_KIND[target]
    return Bundle(rows.withColumn("target", value).drop(*gone), kinds)
