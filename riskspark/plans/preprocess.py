"""Raw grid clean-up and participant preprocessing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from riskspark.operators import encode as E, tables as R
from riskspark.spec import DEFAULT_DOMAINS, Domains


def clean_grid(raw: DataFrame, *, duplicate: str = "City", key: str = "id") -> DataFrame:
    """Names, cardinality, metadata, binned copies, incomplete rows, constant columns."""
    df = R.tidy_names(raw.drop(duplicate))
    df = R.prune_by_cardinality(df, protect=(key,))
    df = R.drop_prefix(R.drop_metadata(df), "bin")
    return R.prune_constant(R.complete_rows(df))


def preprocess(df: DataFrame, *, exclude_from_imputation: Iterable[str] = (), domains: Domains = DEFAULT_DOMAINS,
               keep: Iterable[str] = ("participant_id", "age_label")) -> DataFrame:
    """Age bands, codes, whitelist, imputation - lazy but for one statistics pass.

    The band label stays next to its code so the sleep target can read either.
    """
    out = E.add_age_band(df)
    out = out.withColumn("age_label", out["age_bin"])
    out = E.encode_extras(E.encode_ordinals(out, domains), domains)
    out = R.keep_model_columns(out, domains=domains, also=keep)
    return E.impute(out, exclude=exclude_from_imputation, domains=domains)


def preprocess_for_scoring(df: DataFrame, domains: Domains = DEFAULT_DOMAINS, keep: Iterable[str] = ()) -> DataFrame:
    """The same codes for grid rows: no banding, no imputation."""
    return R.keep_model_columns(E.encode_extras(E.encode_ordinals(df, domains), domains), domains=domains, also=keep)
