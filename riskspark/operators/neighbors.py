"""Exact nearest neighbours and pairwise-distance summaries in bounded blocks.

Base rows go to the nearest of a few pivots, whose number grows with the table; a query's distance to the k-th row it meets
in its own cell bounds the cells that can hold a nearer one (Lu et al., "Efficient processing of k nearest neighbor joins
using MapReduce", 2012). Where that rules out few cells, as with many dimensions, all rows are compared. Cells are
hashed into blocks of at most ``block_rows`` rows per side, so a crowded one is many small tasks, and a block
gives back k rows per query - never its pairs, which exist for ``QUERIES_AT_ONCE`` queries at a time. Matrix products tell
which pairs can count; distances that are given back or ordered by are sums of squared gaps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskspark.functions.columns import ident, number

BLOCK_ROWS = 4096
WIDE_ROWS = 4           # blocks a side where all rows are compared, and where distances are added up
PIVOTS = 32             # at least, where there is more than one block of base rows
MOST_PIVOTS = 1024
CELL_ROWS = 1024
QUERIES_AT_ONCE = 256
TRIED = 1 << 14         # queries that tell how many cells are met; any number gives the same result
WORTH = 0.3             # share of the pairs beyond which cells do not pay
ROUNDING = 1e-12        # relative error of a squared distance from a matrix product, and more


def _vector(features: Sequence[str] | str) -> Column:
    """Array of the named columns, or the one array column named."""
    if isinstance(features, str):
        return ident(features).cast("array<double>")
    return F.array(*[F.coalesce(number(ident(f)), F.lit(0.0)) for f in features])


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = a[:, j, None] - b[None, :, j]
        out += gap * gap
    return out


def paired_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As ``squared_distances``, of row i with row i."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        gap = a[:, j] - b[:, j]
        out += gap * gap
    return out


def rough_distances(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, squared distances to all of ``b``, their possible error by row) of some rows of ``a`` at a time."""
    if not len(a) or not len(b):
        return
    with np.errstate(all="ignore"):
        good = np.isfinite(b).all(1)
        center = b[good].mean(0) if good.any() else 0.0
        b = b - center
        norm_b = (b * b).sum(1)
        far = norm_b[good].max(initial=0.0)
        for at in range(0, len(a), QUERIES_AT_ONCE):
            part = a[at: at + QUERIES_AT_ONCE] - center
            norm = (part * part).sum(1)
            gap = part @ b.T
            gap *= -2
            gap += norm[:, None]
            gap += norm_b
            yield at, gap, ROUNDING * (norm + far)


def _stacked(v: pd.Series, width: int = 0) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(float, copy=False) if len(v) else np.zeros((0, width))


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, distances to the pivots) of some rows at a time; what is no number is infinitely far."""
    for at in range(0, len(x), QUERIES_AT_ONCE):
        with np.errstate(all="ignore"):
            d = np.sqrt(squared_distances(x[at: at + QUERIES_AT_ONCE], pivots))
        yield at, np.where(np.isnan(d), np.inf, d)


def _nearest_pivot(pivots: np.ndarray):
    def assign(v: pd.Series) -> pd.DataFrame:
        cell, far = np.zeros(len(v), "int32"), np.zeros(len(v))
        for at, d in _to_pivots(_stacked(v, pivots.shape[1]), pivots):
            own = d.argmin(axis=1)
            cell[at: at + len(d)], far[at: at + len(d)] = own, d[np.arange(len(d)), own]
        return pd.DataFrame({"cell": cell, "d": far})
    # marked non-deterministic so that no filter inferred from the join repeats it below
    return F.pandas_udf(assign, "cell int, d double").asNondeterministic()


def _first_of_equal(x: np.ndarray, most: int) -> np.ndarray:
    """Rows without those that equal ``most`` rows before them."""
    order = np.lexsort(x.T[::-1])
    new = np.ones(len(x), bool)
    new[1:] = (x[order[1:]] != x[order[:-1]]).any(1)
    start = np.flatnonzero(new)
    place = np.arange(len(x)) - np.repeat(start, np.diff(np.append(start, len(x))))
    return np.sort(order[place < most])


def _k_nearest(left: pd.DataFrame, right: pd.DataFrame, k: int, exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``left``, row of ``right``, squared distance, rank from 0) of the k nearest of ``right``, which is ordered by id."""
    ids, x = right["base_id"], _stacked(right["v"])
    if x.shape[1] and (not exclude_self or ids.is_unique):
        # of equal vectors the first k are all a query can need, and its own row
        some = _first_of_equal(x, k + exclude_self)
    else:
        some = np.arange(len(x))
    some = some[np.isfinite(x[some]).all(1)]
    ids, x, q = ids.iloc[some], x[some], _stacked(left["v"])
    own = np.zeros((2, 0), int)
    if exclude_self:
        same = pd.merge(pd.DataFrame({"id": left["query_id"].to_numpy(), "r": np.arange(len(q))}).dropna(),
                        pd.DataFrame({"id": ids.to_numpy(), "c": np.arange(len(x))}).dropna(), on="id").sort_values("r")
        own = same[["r", "c"]].to_numpy(int).T
    found = []
    for at, gap, error in rough_distances(q, x):
        here = slice(*np.searchsorted(own[0], (at, at + len(gap))))
        gap[own[0, here] - at, own[1, here]] = np.inf
        if k < len(x):
            limit = np.partition(gap, k - 1, axis=1)[:, k - 1] + 2 * error
            r, c = np.nonzero((gap <= limit[:, None]) & (gap < np.inf))
        else:
            r, c = np.nonzero(gap < np.inf)
        with np.errstate(all="ignore"):
            d = paired_distances(q[at + r], x[c])
        keep = np.isfinite(d)
        r, c, d = r[keep], c[keep], d[keep]
        order = np.lexsort((c, d, r))
        r, c, d = r[order], c[order], d[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        keep = rank < k
        found.append((at + r[keep], some[c[keep]], d[keep], rank[keep]))
    if not found:
        return tuple(np.zeros(0, t) for t in (int, int, float, int))
    return tuple(np.concatenate(v) for v in zip(*found))


def _sizes(rows: DataFrame) -> dict[int, tuple[int, float]]:
    return {r["cell"]: (r["n"], r["far"]) for r in
            rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("far")).collect()}


def _met_cells(q: DataFrame, b: DataFrame, centers: np.ndarray, cells: dict[int, tuple[int, float]], k: int, exclude_self: bool,
               ratio: float, block_rows: int) -> DataFrame:
    """Queries with the cells that can hold one of their k nearest: ``query_id, v, cells``.

    A query is compared with one block of its own cell. There are about ``ratio`` queries for a base row.
    """
    used = np.array(sorted(cells))
    far = np.array([cells[c][1] for c in used], float)
    with np.errstate(all="ignore"):
        between = np.sqrt(squared_distances(centers, centers))
    def parts(each: float) -> Column:
        return F.coalesce(F.create_map(*[F.lit(int(v)) for c, (n, _) in cells.items() for v in (c, math.ceil(n * each / block_rows))])[F.col("cell")], F.lit(1))

    q = q.withColumn("q_part", F.pmod(F.xxhash64("query_id"), parts(ratio)).cast("int"))
    b = (b.filter(F.pmod(F.xxhash64("base_id"), parts(1.0)) == 0)
         .withColumn("q_part", F.explode(F.sequence(F.lit(0), parts(ratio) - 1))))

    def route(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left):
            own, x = int(left["cell"].iloc[0]), _stacked(left["v"])
            bound = np.full(len(x), np.inf)
            if len(right):
                r, _, d, rank = _k_nearest(left, right.sort_values("base_id", kind="stable"), k, exclude_self)
                bound[r[rank == k - 1]] = np.sqrt(d[rank == k - 1])
            for at, d in _to_pivots(x, centers):
                to, home = d[:, used], d[:, own, None]
                with np.errstate(all="ignore"):
                    apart = between[own, used]
                    # a cell's rows are nearer to its pivot than to this one, and not beyond its farthest row
                    ball, side = to - far, (to * to - home * home) / (2 * apart)
                    ball -= 1e-9 * (1 + to + far)
                    side -= 1e-9 * (1 + to + to * to / apart)
                    least = bound[at: at + len(d), None]
                    out += [used[w].tolist() for w in ~((ball > least) | ((side > least) & (apart > 0)))]
        return pd.DataFrame({"query_id": left["query_id"], "v": left["v"], "cells": pd.Series(out, index=left.index, dtype=object)})

    kind = q.schema["query_id"].dataType.simpleString()
    return (q.groupBy("cell", "q_part").cogroup(b.select("cell", "q_part", "base_id", "v").groupBy("cell", "q_part"))
            .applyInPandas(route, f"query_id {kind}, v array<double>, cells array<int>"))


def nearest(queries: DataFrame, base: DataFrame, features: Sequence[str], k: int, *, query_key: str,
            base_key: str, exclude_self: bool = False, block_rows: int = BLOCK_ROWS,
            pivots: int = PIVOTS) -> DataFrame:
    """k nearest base rows per query: query_id, base_id, dist, rank (ties by base id)."""
    q = queries.select(ident(query_key).alias("query_id"), _vector(features).alias("v"))
    b = base.select(ident(base_key).alias("base_id"), _vector(features).alias("v"))
    n_b, n_q = b.count(), q.count()
    if not n_b:
        return (q.select("query_id", F.lit(None).cast(b.schema["base_id"].dataType).alias("base_id"),
                         F.lit(None).cast("double").alias("dist"), F.lit(1).alias("rank")).limit(0))
    every, cells, visits = F.array(F.lit(0)), {0: (n_b, math.inf)}, {0: n_q}
    if n_b > block_rows:
        wanted = min(MOST_PIVOTS, max(pivots, math.ceil(n_b / CELL_ROWS)))
        picked = b.orderBy(F.md5(F.col("base_id").cast("string"))).limit(wanted).collect()
        centers = np.unique(np.array([r["v"] for r in picked], dtype=float), axis=0)
        near = _nearest_pivot(centers)
        placed_q = q.withColumn("_p", near("v")).select("query_id", "v", F.col("_p.cell").alias("cell"))
        placed = b.withColumn("_p", near("v")).select("base_id", "v", F.col("_p.cell").alias("cell"), F.col("_p.d").alias("d"))
        sizes = _sizes(placed)
        share = max(1, n_q // TRIED)

        def met(rows: DataFrame, n: int) -> DataFrame:
            return _met_cells(rows, placed, centers, sizes, k, exclude_self, max(n, 1) / n_b, block_rows)

        tried = met(placed_q.filter(F.pmod(F.xxhash64("query_id", F.lit("tried")), F.lit(share)) == 0), TRIED)
        seen = {r["cell"]: r["n"] * share for r in tried.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect()}
        if sum(n * sizes[c][0] for c, n in seen.items()) <= WORTH * n_q * n_b:
            every, cells, visits = None, sizes, seen
    if every is None:
        q, b = met(placed_q, n_q), placed.select("base_id", "v", F.col("cell").alias("target"))
    else:
        q, b = q.withColumn("cells", every), b.withColumn("target", F.lit(0))
        block_rows *= WIDE_ROWS

    spark = base.sparkSession
    blocks = spark.createDataFrame([(int(c), math.ceil(visits.get(c, 1) / block_rows) or 1, math.ceil(n / block_rows)) for c, (n, _) in cells.items()],
                                   "target int, q_parts int, b_parts int")

    def dealt(rows: DataFrame, key: str, own: str, other: str) -> DataFrame:
        """Each row in its part of the one side, for all parts of the other."""
        return (rows.join(F.broadcast(blocks), "target").withColumn(own, F.pmod(F.xxhash64(key), F.col(f"{own}s")).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1))).select("target", "q_part", "b_part", key, "v"))

    q_blocks = dealt(q.select("query_id", "v", F.explode("cells").alias("target")), "query_id", "q_part", "b_part")
    b_blocks = dealt(b, "base_id", "b_part", "q_part")

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": left["query_id"][:0], "base_id": right["base_id"][:0], "dist": []})
        right = right.sort_values("base_id", kind="stable")
        r, c, d, _ = _k_nearest(left, right, k, exclude_self)
        return pd.DataFrame({"query_id": left["query_id"].to_numpy()[r], "base_id": right["base_id"].to_numpy()[c], "dist": np.sqrt(d)})

    id_types = (q.schema["query_id"].dataType.simpleString(), b.schema["base_id"].dataType.simpleString())
    keys = ["target", "q_part", "b_part"]
    part = (q_blocks.groupBy(*keys).cogroup(b_blocks.groupBy(*keys))
            .applyInPandas(best, f"query_id {id_types[0]}, base_id {id_types[1]}, dist double"))
    w = Window.partitionBy("query_id").orderBy("dist", "base_id")
    return part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def counted_votes(near: DataFrame, labelled: DataFrame, k: int) -> DataFrame:
    """``query_id, y, votes``: of k nearest rows with ``labelled(base_id, y, copies)``, copies counted as rows.

    ``near`` holds the k nearest different rows by rank; the last one that fits votes with the copies left.
    """
    before = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    met = near.join(labelled, "base_id").withColumn("_before", F.coalesce(F.sum("copies").over(before), F.lit(0)))
    return met.select("query_id", "y", F.least("copies", F.lit(k) - F.col("_before")).alias("votes")).filter("votes > 0")


def _neighbour_votes(queries, base, features, label, k, query_key, base_key, kw) -> DataFrame:
    cols = [features] if isinstance(features, str) else list(features)
    # rows that share the key are copies of one row
    rows = base.groupBy(ident(base_key)).agg(*[F.first(ident(c)).alias(c) for c in dict.fromkeys(cols) if c != base_key],
                                             F.first(label).alias("y"), F.count("*").alias("copies"))
    near = nearest(queries, rows, features, k, query_key=query_key, base_key=base_key, **kw)
    return counted_votes(near, rows.select(ident(base_key).alias("base_id"), "y", "copies"), k)


def knn_vote(queries: DataFrame, base: DataFrame, features: Sequence[str], label: str, k: int = 5, *,
             query_key: str, base_key: str, **kw) -> DataFrame:
    """Majority class of the k nearest (smallest on a tie) and its share per query."""
    votes = _neighbour_votes(queries, base, features, ident(label), k, query_key, base_key, kw)
    votes = votes.groupBy("query_id", "y").agg(F.sum("votes").alias("n"))
    return votes.groupBy("query_id").agg(
        F.min(F.struct(-F.col("n"), F.col("y")))["y"].alias("prediction"),
        (F.max("n") / F.sum("n")).alias("share"))


def knn_mean(queries: DataFrame, base: DataFrame, features: Sequence[str], label: str, k: int = 5, *,
             query_key: str, base_key: str, **kw) -> DataFrame:
    votes = _neighbour_votes(queries, base, features, number(ident(label)), k, query_key, base_key, kw)
    return votes.groupBy("query_id").agg((F.sum(F.col("y") * F.col("votes")) / F.sum("votes")).alias("prediction"))


def cluster_distance_sums(df: DataFrame, features: Sequence[str], key: str, label: str, *,
                          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per row and cluster the sum of Euclidean distances: id, label, cluster, total.

    Work is quadratic by definition; each block pair is met once and returns rows x clusters sums for both sides.
    """
    rows = df.select(ident(key).alias("id"), ident(label).alias("label"), _vector(features).alias("v"))
    parts = max(1, math.ceil(rows.count() / (WIDE_ROWS * block_rows)))
    side = rows.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    left = side.withColumnRenamed("_part", "a").withColumn("b", F.explode(F.sequence(F.col("a"), F.lit(parts - 1))))
    right = side.withColumnRenamed("_part", "b").withColumn("a", F.explode(F.sequence(F.lit(0), F.col("b"))))

    def grouped(x: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
        groups, code = np.unique(x["label"].to_numpy(), return_inverse=True)
        order = np.argsort(code, kind="stable")
        x = x.iloc[order]
        return x, _stacked(x["v"]), groups, code[order]

    def listed(x: pd.DataFrame, groups: np.ndarray, total: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"id": np.repeat(x["id"].to_numpy(), len(groups)), "label": np.repeat(x["label"].to_numpy(), len(groups)),
                             "cluster": np.tile(groups, len(x)), "total": total.ravel()})

    def sums(key, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"id": x["id"][:0], "label": x["label"][:0], "cluster": y["label"][:0], "total": []})
        (x, vx, groups_x, code), (y, vy, groups_y, code_y) = grouped(x), grouped(y)
        start = np.searchsorted(code_y, np.arange(len(groups_y)))
        to_y, to_x = np.zeros((len(x), len(groups_y))), np.zeros((len(groups_x), len(y)))
        for at, gap, error in rough_distances(vx, vy):
            # little differences of large numbers are added up again
            r, c = np.nonzero(~(gap > 1e4 * error[:, None]))
            with np.errstate(all="ignore"):
                gap[r, c] = paired_distances(vx[at + r], vy[c])
                d = np.sqrt(gap, out=gap)
            to_y[at: at + len(d)] = np.add.reduceat(d, start, axis=1)
            if key[0] != key[1]:
                first = np.flatnonzero(np.diff(code[at: at + len(d)], prepend=-1))
                to_x[code[at + first]] += np.add.reduceat(d, first, axis=0)
        out = listed(x, groups_y, to_y)
        return out if key[0] == key[1] else pd.concat([out, listed(y, groups_x, to_x.T)])

    kinds = {c: side.schema[c].dataType.simpleString() for c in ("id", "label")}
    out = (left.groupBy("a", "b").cogroup(right.groupBy("a", "b"))
           .applyInPandas(sums, f"id {kinds['id']}, label {kinds['label']}, cluster {kinds['label']}, total double"))
    return out.groupBy("id", "label", "cluster").agg(F.sum("total").alias("total"))


def labelled_distance_sums(df: DataFrame, features: Sequence[str], key: str, labels: str, sizes: Sequence[int], *,
                           block_rows: int = BLOCK_ROWS) -> DataFrame:
    """As ``cluster_distance_sums`` for several labelings, all from the same distances: id, labels, and totals ``t0 ...``.

    ``labels`` is an array with a row's cluster (0 to ``sizes[j]`` - 1) in labeling j; the totals list the clusters of the first labeling, then
    those of the next ones. Rows of one key and equal labels are added up.
    """
    rows = df.select(ident(key).alias("id"), ident(labels).cast("array<int>").alias("labels"), _vector(features).alias("v"))
    parts = max(1, math.ceil(rows.count() / (WIDE_ROWS * block_rows)))
    side = rows.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    left = side.withColumnRenamed("_part", "a").withColumn("b", F.explode(F.sequence(F.col("a"), F.lit(parts - 1))))
    right = side.withColumnRenamed("_part", "b").withColumn("a", F.explode(F.sequence(F.lit(0), F.col("b"))))
    first, width = np.cumsum([0, *sizes[:-1]]), int(sum(sizes))
    names = [f"t{i}" for i in range(width)]

    def members(x: pd.DataFrame) -> np.ndarray:
        out = np.zeros((len(x), width))
        np.put_along_axis(out, np.stack(x["labels"].to_numpy()).astype(int) + first, 1.0, 1)
        return out

    def added(d: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Sums of the columns of ``d`` by cluster; distances that are no numbers stay within theirs."""
        if np.isfinite(d.sum()):
            return d @ of
        return np.stack([d[:, c > 0].sum(1) for c in of.T], 1)

    def listed(x: pd.DataFrame, total: np.ndarray) -> pd.DataFrame:
        return pd.concat([x[["id", "labels"]].reset_index(drop=True), pd.DataFrame(total, columns=names)], axis=1)

    def sums(key, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return listed(x[:0], np.zeros((0, width)))
        vx, vy, of_x, of_y = _stacked(x["v"]), _stacked(y["v"]), members(x), members(y)
        to_y, to_x = np.zeros((len(x), width)), np.zeros((len(y), width))
        for at, gap, error in rough_distances(vx, vy):
            # little differences of large numbers are added up again
            r, c = np.nonzero(~(gap > 1e4 * error[:, None]))
            with np.errstate(all="ignore"):
                gap[r, c] = paired_distances(vx[at + r], vy[c])
                d = np.sqrt(gap, out=gap)
                to_y[at: at + len(d)] = added(d, of_y)
                if key[0] != key[1]:
                    to_x += added(d.T, of_x[at: at + len(d)])
        out = listed(x, to_y)
        return out if key[0] == key[1] else pd.concat([out, listed(y, to_x)])

    out = (left.groupBy("a", "b").cogroup(right.groupBy("a", "b"))
           .applyInPandas(sums, f"id {side.schema['id'].dataType.simpleString()}, labels array<int>, " + ", ".join(f"{c} double" for c in names)))
    return out.groupBy("id", "labels").agg(*[F.sum(c).alias(c) for c in names])
