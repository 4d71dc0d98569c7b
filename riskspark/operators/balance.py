"""Class balancing of training rows: replicate, thin out, or synthesize between neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from riskspark.functions.columns import hash_unit, ident, number
from riskspark.operators.neighbors import nearest
from riskspark.operators.ranking import hash_part
from riskspark.operators.split import with_class_weight

STRATEGIES = ("none", "class_weight", "oversample", "undersample", "smote")


def class_counts(df: DataFrame, label: str) -> dict:
    return {r[label]: r["n"] for r in df.groupBy(ident(label)).agg(F.count("*").alias("n")).collect()}


def _by_class(label: str, values: dict) -> Column:
    out = F.lit(0)
    for k, v in values.items():
        out = F.when(ident(label).eqNullSafe(F.lit(k)), F.lit(v)).otherwise(out)
    return out


def _copies(df: DataFrame, key: Sequence[str], label: str, wanted: dict, salt: str) -> DataFrame:
    """Column ``_copies``: class totals add up to ``wanted``, the remainder in hash order."""
    sizes = class_counts(df, label)
    whole = {c: wanted.get(c, 0) // n for c, n in sizes.items()}
    spare = {c: wanted.get(c, 0) % n for c, n in sizes.items()}
    # classes of equal size want equally many rows, so the total names the remainder
    by_total = {n: max(spare[c] for c in sizes if sizes[c] == n) for n in sizes.values()}

    def cut(total: Column) -> Column:
        out = F.lit(0).cast("long")
        for n, rest in by_total.items():
            out = F.when(total == n, F.lit(rest).cast("long")).otherwise(out)
        return out

    part = hash_part(df, key, [label], [cut], "_part", salt=salt)
    extra = F.when((F.col("_part") == 0) & (_by_class(label, spare) > 0), 1).otherwise(0)
    return part.withColumn("_copies", _by_class(label, whole) + extra).drop("_part")


def oversample(df: DataFrame, key: Sequence[str], label: str, seed: int = 42) -> DataFrame:
    """Replicate smaller classes up to the largest one; ``_copy`` numbers the copies."""
    sizes = class_counts(df, label)
    top = max(sizes.values())
    out = _copies(df, key, label, {c: top for c in sizes}, f"over{seed}")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies")


def undersample(df: DataFrame, key: Sequence[str], label: str, seed: int = 42) -> DataFrame:
    """Keep as many rows of each class as the smallest one has, first in hash order."""
    low = min(class_counts(df, label).values())
    part = hash_part(df, key, [label], [lambda total: F.lit(low).cast("long")], "_part", salt=f"under{seed}")
    return part.filter(F.col("_part") == 0).drop("_part")


def smote(df: DataFrame, key: str, label: str, features: Sequence[str], *, k: int = 5, seed: int = 42,
          block_rows: int = 4096) -> DataFrame:
    """Original rows plus synthetic ones on segments to near neighbours of the same class.

    Columns: key (null for synthetic rows), label, features, base_id, neighbor_id, step.
    """
    sizes = class_counts(df, label)
    top = max(sizes.values())
    need = {c: top - n for c, n in sizes.items() if n < top}
    key_type = df.schema[key].dataType
    feats = [number(ident(f)).alias(f) for f in features]
    real = df.select(ident(key), ident(label), *feats, F.lit(None).cast(key_type).alias("base_id"),
                     F.lit(None).cast(key_type).alias("neighbor_id"), F.lit(None).cast("double").alias("step"))
    if not need:
        return real
    if min(sizes[c] for c in need) < 2:
        raise ValueError("a class with a single row has no neighbours to synthesize from")
    kk = _by_class(label, {c: min(k, sizes[c] - 1) for c in need})
    # one extra coordinate sets classes further apart than any two points are,
    # so one neighbour search serves all classes
    spread = df.agg(*[F.max(number(ident(f))) - F.min(number(ident(f))) for f in features]).first()
    apart = 1.0 + 2.0 * sum((v or 0.0) ** 2 for v in spread) ** 0.5
    offset = {c: i * apart for i, c in enumerate(sorted(need))}
    rows = (df.filter(ident(label).isin(list(need))).select(ident(key), ident(label), *feats)
            .withColumn("_class", _by_class(label, offset).cast("double")))
    draws = (_copies(rows, [key], label, need, f"smote{seed}").filter(F.col("_copies") > 0)
             .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
             .withColumn("rank", (F.floor(hash_unit(ident(key), F.col("_copy"), salt=f"n{seed}") * kk) + 1).cast("int"))
             .withColumn("step", hash_unit(ident(key), F.col("_copy"), salt=f"u{seed}")))
    near = nearest(rows, rows, [*features, "_class"], min(k, max(sizes[c] for c in need) - 1), query_key=key,
                   base_key=key, exclude_self=True, block_rows=block_rows)
    near = near.select(F.col("query_id").alias("_q"), F.col("base_id").alias("neighbor_id"), F.col("rank").alias("_r"))
    picked = draws.join(near, (draws[key] == near["_q"]) & (draws["rank"] == near["_r"]))
    other = rows.select(ident(key).alias("_o"), *[ident(f).alias(f"_n_{f}") for f in features])
    made = (picked.join(other, picked["neighbor_id"] == other["_o"])
            .select(F.lit(None).cast(key_type).alias(key), ident(label),
                    *[(ident(f) + F.col("step") * (ident(f"_n_{f}") - ident(f))).alias(f) for f in features],
                    draws[key].alias("base_id"), "neighbor_id", "step"))
    return real.unionByName(made)


def balance(df: DataFrame, strategy: str, *, key: str, label: str, features: Sequence[str],
            seed: int = 42, weight: str = "weight") -> DataFrame:
    """Training rows balanced by one of STRATEGIES; always carries a weight column."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown balancing strategy {strategy!r}; one of {STRATEGIES}")
    if strategy == "class_weight":
        return with_class_weight(df, label, weight)
    if strategy == "oversample":
        df = oversample(df, [key], label, seed).drop("_copy")
    elif strategy == "undersample":
        df = undersample(df, [key], label, seed)
    elif strategy == "smote":
        made = smote(df, key, label, features, seed=seed)
        name = F.concat_ws("-", F.lit("synthetic"), "base_id", "neighbor_id", "step")
        df = made.select(F.coalesce(ident(key).cast("string"), name).alias(key), ident(label), *[ident(f) for f in features])
    return df.withColumn(weight, F.lit(1.0))
