"""Isolation forest: trees grown in tasks from hash samples, rows scored in place.

Liu, Ting & Zhou, "Isolation Forest" (2008). Every tree sees a bounded sample, so the
grown forest is bounded by trees x sample size and travels to the scoring tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from riskspark.functions.columns import ident, number
from riskspark.operators.ranking import quantile_values


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _grow(x: np.ndarray, depth: int, limit: int, rng, rows: list) -> int:
    """Nodes as (feature, cut, left, right, depth + expected rest); feature -1 is a leaf."""
    me = len(rows)
    rows.append(None)
    lo, hi = x.min(axis=0), x.max(axis=0)
    open_axes = np.flatnonzero(hi > lo)
    if depth >= limit or len(x) <= 1 or not len(open_axes):
        rows[me] = (-1, 0.0, -1, -1, depth + average_path(len(x)))
        return me
    f = int(rng.choice(open_axes))
    cut = float(rng.uniform(lo[f], hi[f]))
    left = _grow(x[x[:, f] <= cut], depth + 1, limit, rng, rows)
    right = _grow(x[x[:, f] > cut], depth + 1, limit, rng, rows)
    rows[me] = (f, cut, left, right, 0.0)
    return me


def isolation_scores(df: DataFrame, features: Sequence[str], key: str, *, trees: int = 100, sample: int = 256,
                     seed: int = 42) -> DataFrame:
    """key, score in (0,1): higher is easier to isolate."""
    rows = df.select(ident(key).alias("id"), F.array(*[F.coalesce(number(ident(f)), F.lit(0.0)) for f in features]).alias("x"))
    n = rows.count()
    take = min(sample, n)
    # a margin over the wanted share, then the first ``take`` by hash within the tree
    share = min(1.0, (take + 4 * math.sqrt(take)) / max(n, 1))
    cut = int(share * 2 ** 31)
    chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)),
                      lambda t: F.pmod(F.xxhash64("id", t, F.lit(seed)), F.lit(2 ** 31)) < cut)
    drawn = (rows.withColumn("tree", F.explode(chosen))
             .withColumn("h", F.xxhash64("id", "tree", F.lit(seed))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h").head(take)
        nodes: list = []
        rng = np.random.default_rng([seed, int(pdf["tree"].iloc[0])])
        _grow(np.stack(pdf["x"].to_numpy()), 0, math.ceil(math.log2(max(take, 2))), rng, nodes)
        out = pd.DataFrame(nodes, columns=["f", "cut", "l", "r", "depth"])
        out.insert(0, "node", range(len(out)))
        out.insert(0, "tree", int(pdf["tree"].iloc[0]))
        return out

    forest = (drawn.groupBy("tree").applyInPandas(
        grow, "tree int, node int, f int, cut double, l int, r int, depth double").collect())
    grown = {}
    for r in forest:
        grown.setdefault(r["tree"], []).append((r["node"], r["f"], r["cut"], r["l"], r["r"], r["depth"]))
    packed = []
    for nodes in grown.values():
        nodes.sort()
        packed.append(tuple(np.array(c) for c in list(zip(*nodes))[1:]))
    shared = df.sparkSession.sparkContext.broadcast(packed)
    norm = average_path(take) or 1.0

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if pdf.empty:
                yield pd.DataFrame({"id": pdf["id"], "score": []})
                continue
            x = np.stack(pdf["x"].to_numpy())
            total = np.zeros(len(x))
            for f, c, left, right, depth in shared.value:
                at = np.zeros(len(x), int)
                live = f[at] >= 0
                while live.any():
                    i = np.flatnonzero(live)
                    node = at[i]
                    at[i] = np.where(x[i, f[node]] <= c[node], left[node], right[node])
                    live[i] = f[at[i]] >= 0
                total += depth[at]
            yield pd.DataFrame({"id": pdf["id"], "score": 2.0 ** (-total / len(shared.value) / norm)})

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(score, f"id {kind}, score double").withColumnRenamed("id", key)


def anomalies(df: DataFrame, features: Sequence[str], key: str, *, contamination: float = 0.05, trees: int = 100,
              sample: int = 256, seed: int = 42) -> DataFrame:
    """Input rows with ``anomaly`` -1 (most isolated share) or 1."""
    scores = isolation_scores(df, features, key, trees=trees, sample=sample, seed=seed)
    limit = quantile_values(scores, ["score"], [1 - contamination])["score"][0]
    marked = scores.select(ident(key), F.when(F.col("score") > limit, -1).otherwise(1).alias("anomaly"))
    return df.join(marked, key)
