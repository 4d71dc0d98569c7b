"""Column groups, ordered domains and the feature-type map that travels with a DataFrame."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame

# --- Fixed values: names and labels the results depend on -------------------
ENVIRONMENT = (
    "lst_mean", "solar_summ", "solar_wint", "pm10_mean",
    "pm25_mean", "no2_mean", "noiseday_m", "noisenight",
)
MORPHOLOGY = (
    "building_height", "height_varability", "sky_view_factor", "frontal_area_index",
    "water_cover_fraction", "impervious_surface_cover_fraction",
    "building_cover_fraction", "pervious_surface_cover_fraction",
    "aspect_ratio", "intersections",
    "length_n-s", "length_ne-sw", "length_se-nw", "length_e-w",
    "length_primary_road", "length_secondary_road", "length_railway",
    "neighbourhood_type",
)
ORDINAL = ("income", "education_level", "age_bin")
CATEGORICAL = ("typology", "neighbourhood_type")
BINARY = ("GHQ12_case", "points_sleep_deprivation", "sleep_disorder_hot")
CONTINUOUS = (
    ENVIRONMENT + ("sleeping_hours",) + ORDINAL
    + tuple(c for c in MORPHOLOGY if c != "neighbourhood_type")
)
TARGET_SOURCES = {
    "cardiovascular": ("i_united_heart",),
    "sleep_disorder": ("points_sleep_deprivation", "sleeping_hours", "sleep_disorder_hot"),
    "mental_health": ("GHQ12_case",),
    "respiratory": ("i_united_breath",),
}
AGE_EDGES = (6.0, 12.0, 18.0, 30.0, 50.0, 70.0)
EXPECTED_SLEEP_HOURS = {
    "Early Childhood (0-6y)": 12,
    "Children (6-12y)": 10,
    "Teenagers (12-18y)": 9,
    "Young Adults (18-30y)": 8,
    "Adults (30-50y)": 8,
    "Middle-Aged Adults (50-70y)": 8,
    "Older Adults (70+y)": 7,
}
SOCIO_DOMAINS = {
    "income": ("<50k", "50–100k", "100–150k", ">150k"),
    "education_level": ("primary", "secondary", "tertiary"),
    "age_bin": tuple(EXPECTED_SLEEP_HOURS),
    "sex": ("M", "F"),
}
GRID_METADATA = (
    "left", "top", "right", "bottom", "row_index", "col_index", "q_cluster", "z_distance",
)
P_VALUE_LIMIT = 0.5
VIF_LIMIT = 50.0
SLEEP_HOURS_SPREAD = 2.0
HOT_MONTH_FLOOR = 0.5
DEPRIVATION_FLOOR = 0.7
RISK_FLAG_Z = 1.5
# ----------------------------------------------------------------------------

TARGET_KIND = {
    "cardiovascular": "binary",
    "sleep_disorder": "continuous",
    "mental_health": "binary",
    "respiratory": "binary",
}


@dataclass(frozen=True)
class Domains:
    """The configuration every operator reads; override it to run on other tables."""

    environment: tuple[str, ...] = ENVIRONMENT
    morphology: tuple[str, ...] = MORPHOLOGY
    continuous: tuple[str, ...] = CONTINUOUS
    categorical: tuple[str, ...] = CATEGORICAL
    binary: tuple[str, ...] = BINARY
    target_sources: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: dict(TARGET_SOURCES))
    socio: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: dict(SOCIO_DOMAINS))
    expected_sleep: Mapping[str, int] = field(default_factory=lambda: dict(EXPECTED_SLEEP_HOURS))

    @property
    def all_target_sources(self) -> tuple[str, ...]:
        out: list[str] = []
        for cols in self.target_sources.values():
            out.extend(c for c in cols if c not in out)
        return tuple(out)

    @property
    def model_columns(self) -> set[str]:
        return {*self.categorical, *self.binary, *self.continuous, *self.all_target_sources}


DEFAULT_DOMAINS = Domains()


class FeatureSpec(dict):
    """Ordered ``{column: "continuous" | "binary" | "categorical"}`` map."""

    def of_kind(self, kind: str, *, skip: Iterable[str] = ("target",)) -> list[str]:
        return [c for c, k in self.items() if k == kind and c not in set(skip)]

    def without(self, names: Iterable[str]) -> "FeatureSpec":
        gone = set(names)
        return FeatureSpec({c: k for c, k in self.items() if c not in gone})

    def with_kinds(self, **kinds: str) -> "FeatureSpec":
        return FeatureSpec({**self, **kinds})

    @property
    def features(self) -> list[str]:
        return [c for c in self if c != "target"]


class Bundle(NamedTuple):
    """A dataset for one target: the rows and what its columns mean."""

    df: DataFrame
    spec: FeatureSpec
