"""Ranks, exact quantiles and exact hash-ordered cuts without a single-task sort.

Values are first cut into range buckets (approximate quantile sketch, one pass);
each bucket is ordered on its own and lifted by the number of rows in the buckets
below it. Equal values are counted before the shuffle, so a value that fills a
third of the table is one row. Quantiles then read only the buckets that hold a
wanted position.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskspark.functions.columns import ident, number
from riskspark.operators.longform import to_long
from riskspark.session import small_frame

ROWS_PER_BUCKET = 200_000
MAX_BUCKETS = 4096


def bucket_edges(df: DataFrame, cols: Sequence[str],
                 rows_per_bucket: int | None = None) -> list[list[float]]:
    """Inner bucket edges per column; empty when one bucket is enough."""
    rows_per_bucket = rows_per_bucket or ROWS_PER_BUCKET
    rows = df.count()
    buckets = min(MAX_BUCKETS, math.ceil(rows / rows_per_bucket))
    if buckets <= 1:
        return [[] for _ in cols]
    probs = [i / buckets for i in range(1, buckets)]
    sketch = df.select([
        F.percentile_approx(number(ident(c)), probs, 20 * buckets).alias(f"e{i}")
        for i, c in enumerate(cols)
    ]).first()
    return [sorted(set(edges or [])) for edges in sketch]


def bucketed_long(df: DataFrame, cols: Sequence[str], *, keep: Sequence[Column] = (),
                  rows_per_bucket: int | None = None) -> DataFrame:
    """Long frame (feature, bucket, value) with buckets ordered like the values."""
    cols = list(cols)
    edges = bucket_edges(df, cols, rows_per_bucket)
    if not any(edges):
        return to_long(df, cols, keep=keep).withColumn("bucket", F.lit(0.0))
    wide = df.select(*keep, *[number(ident(c)).alias(f"_v{i}") for i, c in enumerate(cols)])
    kept = [c for c in wide.columns if not c.startswith("_v")]
    bucket = {}
    for i, inner in enumerate(edges):
        if inner:
            wide = Bucketizer(splits=[-math.inf, *inner, math.inf], inputCol=f"_v{i}",
                              outputCol=f"_b{i}", handleInvalid="keep").transform(wide)
            bucket[f"_v{i}"] = F.col(f"_b{i}")
        else:
            bucket[f"_v{i}"] = F.lit(0.0)
    long = to_long(wide, list(bucket), keep=[ident(c) for c in kept], extra={"bucket": bucket})
    names = F.create_map(*[F.lit(x) for i, c in enumerate(cols) for x in (f"_v{i}", c)])
    return long.withColumn("feature", names[F.col("feature")])


def ranked_counts(df: DataFrame, cols: Sequence[str], *, by: Sequence[Column] = (),
                  rows_per_bucket: int | None = None) -> DataFrame:
    """Per (feature, value[, by]) count ``n`` with average rank over all rows of the feature.

    Columns: feature, [by], value, n, tie, avg_rank.
    """
    long = bucketed_long(df, cols, keep=by, rows_per_bucket=rows_per_bucket)
    extra = [c for c in long.columns if c not in ("feature", "bucket", "value")]
    counts = long.groupBy("feature", "bucket", "value", *extra).agg(F.count("*").alias("n"))
    inside = Window.partitionBy("feature", "bucket")
    ranked = (counts
              .withColumn("upto", F.sum("n").over(inside.orderBy("value")))
              .withColumn("tie", F.sum("n").over(Window.partitionBy("feature", "bucket", "value"))))
    # at most columns x MAX_BUCKETS rows
    below = (counts.groupBy("feature", "bucket").agg(F.sum("n").alias("in_bucket"))
             .withColumn("offset", F.sum("in_bucket").over(
                 Window.partitionBy("feature").orderBy("bucket")) - F.col("in_bucket"))
             .select("feature", "bucket", "offset"))
    two = F.lit(2.0).cast("double")
    return (ranked.join(F.broadcast(below), ["feature", "bucket"])
            .select("feature", *extra, "value", "n", "tie",
                    (F.col("offset") + F.col("upto") - F.col("tie") + (F.col("tie") + 1) / two)
                    .alias("avg_rank")))


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], *,
                    by: Sequence[str] = (), rows_per_bucket: int | None = None) -> DataFrame:
    """Linear-interpolated quantiles, exact: [by], feature, total, q (array, one per probability)."""
    by = list(by)
    long = bucketed_long(df, cols, keep=[ident(c) for c in by], rows_per_bucket=rows_per_bucket)
    keys = [*by, "feature"]
    group = Window.partitionBy(*[ident(k) for k in keys])
    per_bucket = (long.groupBy(*[ident(k) for k in keys], "bucket").agg(F.count("*").alias("in_bucket"))
                  .withColumn("offset", F.sum("in_bucket").over(group.orderBy("bucket")) - F.col("in_bucket"))
                  .withColumn("total", F.sum("in_bucket").over(group)))

    grid = F.lit([float(p) for p in probs])

    def place(p: Column) -> Column:
        return (F.col("total") - 1).cast("double") * p

    wanted = F.array_distinct(F.flatten(F.transform(
        grid, lambda p: F.array(F.floor(place(p)), F.ceil(place(p))))))
    needed = (per_bucket
              .filter(F.exists(wanted, lambda x: (x >= F.col("offset"))
                               & (x < F.col("offset") + F.col("in_bucket"))))
              .select(*[ident(k) for k in keys], "bucket", "offset", "total"))
    needed, _ = small_frame(needed, 100_000)
    null_safe = [long[k].eqNullSafe(needed[k]) for k in (*keys, "bucket")]
    narrow = (long.join(needed, null_safe)
              .select(*[long[k] for k in keys], long["bucket"], "value", "offset", "total")
              .groupBy(*[ident(k) for k in keys], "bucket", "value")
              .agg(F.count("*").alias("n"), F.first("offset").alias("offset"),
                   F.first("total").alias("total")))
    inside = Window.partitionBy(*[ident(k) for k in keys], "bucket").orderBy("value")
    ordered = narrow.withColumn("upto", F.col("offset") + F.sum("n").over(inside))

    # (position, value) pairs: at most two per probability and group
    at = F.map_from_entries(F.collect_list(F.struct("_pos", "value")))
    picked = (ordered
              .select(*[ident(k) for k in keys], "total", "value", F.explode(F.filter(
                  wanted, lambda x: (x >= F.col("upto") - F.col("n")) & (x < F.col("upto"))))
                  .alias("_pos"))
              .groupBy(*[ident(k) for k in keys]).agg(F.first("total").alias("total"), at.alias("_at")))

    def value(p: Column) -> Column:
        low, high = F.col("_at")[F.floor(place(p))], F.col("_at")[F.ceil(place(p))]
        return low + (high - low) * (place(p) - F.floor(place(p)))

    return picked.select(*[ident(k) for k in keys], "total", F.transform(grid, value).alias("q"))


def quantile_values(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    rows_per_bucket: int | None = None) -> dict[str, list[float]]:
    """The same, as driver values: columns x probs numbers."""
    rows = exact_quantiles(df, cols, probs, rows_per_bucket=rows_per_bucket).collect()
    return {r["feature"]: list(r["q"]) for r in rows}


def hash_order(key: Sequence[str], salt: str = "") -> Column:
    """Total order of rows by md5 of their key (the key itself breaks collisions)."""
    text = F.concat_ws("|", *[ident(k).cast("string") for k in key])
    return F.concat(F.md5(F.concat(text, F.lit(salt))), F.lit("|"), text)


def hash_cuts(df: DataFrame, key: Sequence[str], strata: Sequence[str],
              positions: Sequence, *, salt: str = "") -> tuple[DataFrame, bool]:
    """Hash of the m-th row per stratum for each position m(total): strata, cut0..

    Only the md5-prefix buckets that hold a wanted position are ordered.
    """
    keys = [ident(s) for s in strata]
    rows = df.select(*keys, hash_order(key, salt).alias("_h"))
    rows = rows.withColumn("_b", F.substring("_h", 1, 3))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    per_bucket = (rows.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
                  .withColumn("_off", F.sum("_n").over(group.orderBy("_b")) - F.col("_n"))
                  .withColumn("_tot", F.sum("_n").over(group)))
    spots = [p(F.col("_tot")) for p in positions]
    needed = per_bucket.filter(F.exists(
        F.array(*spots), lambda m: (m > F.col("_off")) & (m <= F.col("_off") + F.col("_n"))))
    needed, _ = small_frame(needed.drop("_n"), 100_000)
    on = [rows[s].eqNullSafe(needed[s]) for s in strata] + [rows["_b"] == needed["_b"]]
    narrow = rows.join(needed, on).select(*[rows[s] for s in strata], rows["_b"], "_h", "_off", "_tot")
    numbered = narrow.withColumn(
        "_rn", F.col("_off") + F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_h")))
    cuts = numbered.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_rn") == spot, F.col("_h"))).alias(f"cut{i}")
        for i, spot in enumerate(spots)])
    return small_frame(cuts)


def hash_part(df: DataFrame, key: Sequence[str], strata: Sequence[str], positions: Sequence,
              name: str, *, salt: str = "") -> DataFrame:
    """Add ``name``: how many of the cut positions lie before the row in hash order."""
    cuts, _ = hash_cuts(df, key, strata, positions, salt=salt)
    for s in strata:
        cuts = cuts.withColumnRenamed(s, f"_s_{s}")
    if strata:
        rows = df.join(cuts, [df[s].eqNullSafe(cuts[f"_s_{s}"]) for s in strata], "left")
        limits = [F.col(f"cut{i}") for i in range(len(positions))]
    else:
        rows, only = df, cuts.first()
        limits = [F.lit(only[f"cut{i}"] if only else None).cast("string") for i in range(len(positions))]
    h = hash_order(key, salt)
    part = sum((F.when((h > limit) | limit.isNull(), 1).otherwise(0) for limit in limits), F.lit(0))
    return rows.withColumn(name, part).select(*[ident(c) for c in df.columns], name)
