"""Scalar column functions: parsing, coding, clipping, links, names."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, functions as F

from riskspark import spec


def ident(name: str) -> Column:
    """Column by literal name, safe for names with ``-`` or ``.``."""
    return F.col("`" + name.replace("`", "``") + "`")


def number(col: Column) -> Column:
    """Coercing parse to double: unparsable text and NaN become null."""
    return F.nanvl(col.try_cast("double"), F.lit(None).cast("double"))


def code_of(col: Column, labels: Sequence[str]) -> Column:
    """Position of a label in its ordered list, null when unknown."""
    out = F.lit(None).cast("int")
    for position, label in reversed(list(enumerate(labels))):
        out = F.when(col == label, F.lit(position)).otherwise(out)
    return out


def lookup(col: Column, table: Mapping[str, float]) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in (kv[0], float(kv[1]))]
    return F.try_element_at(F.create_map(*pairs), col)


def hours_of(col: Column) -> Column:
    """``HH:MM`` text to fractional hours; anything else is null."""
    ts = F.try_to_timestamp(col, F.lit("H:m"))
    return F.hour(ts) + F.minute(ts) / F.lit(60.0).cast("double")


def age_band(col: Column, edges: Sequence[float] = spec.AGE_EDGES,
             labels: Sequence[str] = tuple(spec.EXPECTED_SLEEP_HOURS)) -> Column:
    """Left-closed age bands; +inf falls in none, as in a half-open last band."""
    x = number(col)
    out = F.when(x < F.lit(float("inf")), F.lit(labels[-1]))
    for edge, label in reversed(list(zip(edges, labels))):
        out = F.when(x < edge, F.lit(label)).otherwise(out)
    return out


def clip01(col: Column) -> Column:
    """Into [0, 1]; an undefined value (NaN) is null, not 1."""
    return F.when(F.isnan(col), F.lit(None)).when(col < 0, F.lit(0.0)).when(col > 1, F.lit(1.0)).otherwise(col)


def logit(col: Column) -> Column:
    y = col.cast("double")
    return F.ln(F.try_divide(y, F.lit(1.0).cast("double") - y))


def expit(col: Column) -> Column:
    one = F.lit(1.0).cast("double")
    return one / (one + F.exp(-col))


def squeeze(col: Column, n: Column) -> Column:
    """Map [0,1] into the open interval, for a sample of n."""
    return (col * (n - 1) + F.lit(0.5).cast("double")) / n


def any_flag(cols: Iterable[Column]) -> Column:
    """Row maximum that skips nulls and NaN."""
    clean = [number(c) for c in cols]
    return clean[0] if len(clean) == 1 else F.greatest(*clean)


def half_even(col: Column, places: int = 2) -> Column:
    """Scale, round to the nearest even integer, scale back (binary ties included)."""
    power = F.lit(10.0 ** places)
    return F.rint(col * power) / power


def safe_name(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"[^\p{L}\p{N}]", "_"), F.lit("_"))


def safe_name_text(name: str) -> str:
    return re.sub(r"[\W]", "_", name, flags=re.UNICODE).strip("_")


def tidy_header(name: str, *, hyphens: bool = False) -> str:
    out = name.strip().lower().replace(" ", "_")
    return out.replace("-", "_") if hyphens else out


def hash_unit(*cols: Column, salt: str = "") -> Column:
    """Deterministic uniform [0,1) from md5 (first 32 bits)."""
    text = F.concat_ws("|", *[c.cast("string") for c in cols], F.lit(salt))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0).cast("double")
