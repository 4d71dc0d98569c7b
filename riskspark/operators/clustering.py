"""Clustering on MLlib, its quality measures, stability under resampling."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from riskspark.functions.columns import hash_unit, ident, number
from riskspark.operators.contingency import agreement
from riskspark.operators.neighbors import BLOCK_ROWS, cluster_distance_sums, labelled_distance_sums
from riskspark.session import small_frame

POINTS = 1 << 13        # rows of a block that small scans read
LEAST_POINTS = 1 << 10  # rows for which a task of its own pays
STABILITY_BANDS = ((0.8, "EXCELLENT"), (0.6, "GOOD"), (0.4, "MODERATE"))


def assemble(df: DataFrame, features: Sequence[str], name: str = "features") -> DataFrame:
    # numeric columns go in as they are: wrapping each in an alias would multiply the
    # optimizer's constraints when frames are assembled more than once
    kinds = dict(df.dtypes)
    text = [f for f in features if kinds[f] == "string"]
    wide = df.withColumns({f"_n_{f}": number(ident(f)) for f in text}) if text else df
    cols = [f"_n_{f}" if f in text else f for f in features]
    out = VectorAssembler(inputCols=cols, outputCol=name, handleInvalid="skip").transform(wide)
    return out.drop(*[f"_n_{f}" for f in text])


# -- quality ------------------------------------------------------------------
def silhouette(df: DataFrame, features: Sequence[str], key: str, label: str, *, drop_noise: bool = False,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean Euclidean silhouette, exact (quadratic work in bounded blocks); -1 for fewer than two clusters.

    Use ``silhouette_squared`` where the table is too large for that.
    """
    rows = df.filter(ident(label) != -1) if drop_noise else df
    sizes = rows.groupBy(ident(label).alias("cluster")).agg(F.count("*").alias("size"))
    sums = cluster_distance_sums(rows, features, key, label, block_rows=block_rows)
    sizes, _ = small_frame(sizes)
    j = sums.join(sizes, "cluster")
    own = F.col("cluster") == F.col("label")
    per = j.groupBy("id").agg(
        F.max(F.when(own, F.col("size"))).alias("n_own"),
        F.max(F.when(own, F.try_divide(F.col("total"), F.col("size") - 1))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("size"))).alias("b"))
    return per.agg(_mean_silhouette())


def _mean_silhouette() -> Column:
    """Of ``n_own``, ``a`` and ``b`` by row."""
    s = F.when(F.col("n_own") == 1, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return F.when(F.max("b").isNotNull(), F.avg(s)).otherwise(-1.0).alias("silhouette")


def silhouettes(df: DataFrame, features: Sequence[str], key: str, labels: str, sizes: Sequence[int], *, block_rows: int = BLOCK_ROWS) -> list[float]:
    """``silhouette`` of several labelings: ``labels`` is an array with a row's cluster in each, ``sizes`` their numbers of clusters.

    Distances, the quadratic part, are worked out once for all of them.
    """
    count = {(r["j"], r["c"]): r["n"] for r in df.select(F.posexplode(ident(labels)).alias("j", "c")).groupBy("j", "c").agg(F.count("*").alias("n")).collect()}
    sums = labelled_distance_sums(df, features, key, labels, sizes, block_rows=block_rows)
    firsts, own = np.cumsum([0, *sizes[:-1]]).tolist(), F.col("label")
    each = sums.select("id", F.inline(F.array(*[F.struct(
        F.lit(j).alias("j"), F.col("labels")[j].alias("label"), F.array(*[F.col(f"t{a + c}") for c in range(k)]).alias("totals"),
        F.array(*[F.lit(count.get((j, c), 0)).cast("long") for c in range(k)]).alias("size")) for j, (a, k) in enumerate(zip(firsts, sizes))])))
    none = F.transform("size", lambda n: F.lit(0.0))
    each = each.groupBy("j", "id", "label", "size").agg(F.collect_list("totals").alias("all")).withColumn(
        "totals", F.aggregate("all", none, lambda x, y: F.zip_with(x, y, lambda a, b: a + b)))
    other = F.transform("totals", lambda t, i: F.when((i != own) & (F.col("size")[i] > 0), t / F.col("size")[i]))
    per = each.groupBy("j", "id").agg(F.max(F.col("size")[own]).alias("n_own"), F.max(F.try_divide(F.col("totals")[own], F.col("size")[own] - 1)).alias("a"),
                                      F.min(F.array_min(other)).alias("b"))
    found = dict(per.groupBy("j").agg(_mean_silhouette()).collect())
    return [found.get(j, -1.0) for j in range(len(sizes))]


def silhouette_squared(df: DataFrame, features: Sequence[str], label: str) -> float:
    """Silhouette with squared distances from cluster moments: linear in the rows."""
    vec = assemble(df.select(ident(label).cast("double").alias("prediction"), *[ident(f) for f in features]), features)
    return ClusteringEvaluator(metricName="silhouette", distanceMeasure="squaredEuclidean").evaluate(vec)


def centroid_table(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """label, n, centroid array, within (sum of squared deviations) - one aggregate."""
    xs = [number(ident(f)) for f in features]
    out = df.groupBy(ident(label).alias("label")).agg(
        F.count("*").alias("n"), F.array(*[F.avg(x) for x in xs]).alias("centroid"),
        (sum([F.var_pop(x) for x in xs][1:], F.var_pop(xs[0])) * F.count("*")).alias("within"))
    return out


def calinski_davies(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin; fewer than two clusters give -1."""
    spark = df.sparkSession
    table = centroid_table(df, features, label)
    small, fits = small_frame(table)
    if not fits:
        raise ValueError("more clusters than a clustering has")
    rows = small.collect()
    n_labels = len([r for r in rows if r["label"] != -1])
    schema = "calinski double, davies_bouldin double"
    if n_labels < 2:
        return spark.createDataFrame([(-1.0, -1.0)], schema)
    sizes = np.array([r["n"] for r in rows], float)
    centers = np.array([r["centroid"] for r in rows], float)
    grand = (sizes[:, None] * centers).sum(axis=0) / sizes.sum()
    between = float((sizes * ((centers - grand) ** 2).sum(axis=1)).sum())
    within = float(sum(r["within"] for r in rows))
    k, n = len(rows), sizes.sum()
    ch = between / (k - 1) / (within / (n - k)) if within > 0 else 1.0
    cen = F.col("centroid")
    sq = sum(((number(ident(f)) - cen[i]) * (number(ident(f)) - cen[i]) for i, f in enumerate(features)), F.lit(0.0))
    spread = (df.select(ident(label).alias("label"), *[ident(f) for f in features if f != "label"])
              .join(F.broadcast(small.select("label", "centroid")), "label")
              .groupBy("label").agg(F.avg(F.sqrt(sq)).alias("s")))
    by_label = {r["label"]: r["s"] for r in spread.collect()}
    s = np.array([by_label[r["label"]] for r in rows])
    apart = np.sqrt(((centers[:, None] - centers[None]) ** 2).sum(axis=2))
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = (s[:, None] + s[None]) / apart
    np.fill_diagonal(ratio, -np.inf)
    ratio[~np.isfinite(ratio)] = 0
    return spark.createDataFrame([(float(ch), float(ratio.max(axis=1).mean()))], schema)


# -- fits ---------------------------------------------------------------------
def _nearest_center(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    gap = x @ centers.T
    gap *= -2
    return (gap + (centers * centers).sum(1)).argmin(1)


def point_blocks(rows: DataFrame, x: Column, weight: str | None = None) -> RDD:
    """(array ``x`` of rows x features, weights) of at most ``POINTS`` rows each, dealt to all cores and kept: what many small scans read."""
    w = ident(weight).cast("double") if weight else F.lit(1.0)

    def pack(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, POINTS):
                part = batch.slice(a, POINTS)
                raw = [part["x"].flatten().to_numpy(zero_copy_only=False).tobytes(), part["w"].to_numpy(zero_copy_only=False).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in raw], names=["x", "w"])

    def arrays(r) -> tuple[np.ndarray, np.ndarray]:
        w = np.frombuffer(r["w"])
        return np.frombuffer(r["x"]).reshape(len(w), -1), w

    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(cores, n // LEAST_POINTS), n // (8 * POINTS))
    packed = rows.select(x.alias("x"), w.alias("w")).mapInArrow(pack, "x binary, w binary").rdd
    dealt = packed.mapPartitionsWithIndex(lambda i, it: ((i + j, r) for j, r in enumerate(it))).partitionBy(parts, lambda i: i)
    return dealt.values().map(arrays).persist(StorageLevel.MEMORY_AND_DISK)


def summed(points: RDD, add: Callable[[tuple[np.ndarray, np.ndarray]], Iterator[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
    """Sums of the arrays ``add`` gives for each block, by number: added up per task, of which the driver gets one dictionary each."""
    def both(a: dict, b: dict) -> dict:
        return a | {i: a[i] + v if i in a else v for i, v in b.items()}

    def work(blocks):
        total: dict = {}
        for b in blocks:
            total = both(total, dict(add(b)))
        yield total

    return points.mapPartitions(work).reduce(both)


def lloyd(rows: DataFrame, starts: Sequence[np.ndarray], *, steps: int = 100, tol: float = 1e-4) -> list[tuple[np.ndarray, float]]:
    """Centers from each of ``starts`` and the cost the last step met; a step of all of them is one scan of the arrays ``x`` of ``rows``.

    A start is done when no center moves farther than ``tol``; a center without rows stays.
    """
    centers, cost, going = [c.copy() for c in starts], [0.0] * len(starts), list(range(len(starts)))
    points = point_blocks(rows, F.col("x"))
    for _ in range(steps):
        if not going:
            break
        at = {i: centers[i] for i in going}

        def add(b: tuple[np.ndarray, np.ndarray], at=at):
            x, w = b
            for i, c in at.items():
                own = _nearest_center(x, c)
                sums = [np.bincount(own, v, len(c)) for v in (w, *x.T)]
                gap = x - c[own]
                yield i, np.append(np.concatenate(sums), (gap * gap).sum())

        found = summed(points, add)
        for i in list(going):
            if i not in found:
                going.remove(i)
                continue
            k = len(centers[i])
            n, total, cost[i] = found[i][:k], found[i][k: -1].reshape(-1, k).T, float(found[i][-1])
            new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centers[i])
            if (((new - centers[i]) ** 2).sum(1) <= tol * tol).all():
                going.remove(i)
            centers[i] = new
    points.unpersist()
    return list(zip(centers, cost))


def kmeans_sweep(df: DataFrame, features: Sequence[str], key: str, ks: Sequence[int] = range(2, 11), *,
                 restarts: int = 10, seed: int = 42, exact_silhouette: bool = False, parallelism: int = 8) -> DataFrame:
    """k, inertia and silhouettes per k; best of ``restarts`` starts.

    MLlib chooses the starts, side by side; then all of them advance together. ``silhouette`` is the Euclidean one, quadratic in
    the rows and null unless ``exact_silhouette``; ``silhouette_squared`` uses squared distances and is linear.
    """
    vec = assemble(df.select(ident(key), *[ident(f) for f in features]), features).persist(StorageLevel.MEMORY_AND_DISK)
    rows = vec.select(vector_to_array("features").alias("x"))
    ks = list(ks)

    def start(k: int, r: int) -> np.ndarray:
        return np.array(KMeans(k=k, seed=seed + r, maxIter=0).fit(vec).clusterCenters())

    def squared(j: int) -> float:
        return float(ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(labelled.select("features", F.col("_labels")[j].alias("prediction"))))

    labelled = None
    try:
        vec.count()     # kept before many read it
        with ThreadPoolExecutor(parallelism) as pool:
            starts = list(pool.map(start, np.repeat(ks, restarts).tolist(), list(range(restarts)) * len(ks)))
            fits = lloyd(rows, starts)
            best = [min(fits[i * restarts: (i + 1) * restarts], key=lambda f: f[1]) for i in range(len(ks))]
            centers = [c for c, _ in best]
            call = F.pandas_udf(lambda v: pd.Series(list(np.column_stack([_nearest_center(np.stack(v.to_numpy()), c) for c in centers]).astype(np.int32))
                                                    if len(v) else [], dtype=object), "array<int>")
            labelled = vec.withColumn("_labels", call(vector_to_array("features"))).persist(StorageLevel.MEMORY_AND_DISK)
            exact = silhouettes(labelled, features, key, "_labels", [len(c) for c in centers]) if exact_silhouette else [None] * len(ks)
            board = [(int(k), cost, e, q) for k, (_, cost), e, q in zip(ks, best, exact, pool.map(squared, range(len(ks))))]
    finally:
        if labelled is not None:
            labelled.unpersist()
        vec.unpersist()
    return df.sparkSession.createDataFrame(board, "k int, inertia double, silhouette double, silhouette_squared double")


def kmeans_labels(df: DataFrame, features: Sequence[str], k: int, *, seed: int = 42, name: str = "cluster") -> DataFrame:
    """Rows with the number of their k-means cluster on the features as they are."""
    vec = assemble(df, features)
    return KMeans(k=k, seed=seed, predictionCol=name).fit(vec.select("features")).transform(vec).drop("features")


def mixture_scores(log_likelihood: float, k: int, d: int, n: int) -> tuple[float, float]:
    """BIC and AIC of a full-covariance mixture."""
    free = k - 1 + k * d + k * d * (d + 1) / 2
    return -2 * log_likelihood + free * math.log(n), -2 * log_likelihood + 2 * free


@dataclass(frozen=True)
class Mixture:
    """Weights, means and full covariances of the components, and the log likelihood the last step met."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    log_likelihood: float = -np.inf

    def shares(self) -> Callable[[np.ndarray], np.ndarray]:
        """Rows -> weighted density of each component, as MLlib has it: the pseudo-inverse of a singular covariance, never zero."""
        values, vectors = np.linalg.eigh(self.covariances)
        k, d = self.means.shape
        kept = values > np.finfo(float).eps * d * values.max(1)[:, None]
        root = vectors * np.sqrt(np.divide(1.0, values, out=np.zeros_like(values), where=kept))[:, None, :]
        top = -0.5 * (d * math.log(2 * math.pi) + np.log(values, out=np.zeros_like(values), where=kept).sum(1))
        to, shift = root.transpose(1, 0, 2).reshape(d, k * d), np.einsum("ki,kij->kj", self.means, root).ravel()

        def of(x: np.ndarray) -> np.ndarray:
            gap = x @ to - shift
            return np.finfo(float).eps + self.weights * np.exp(top - 0.5 * (gap * gap).reshape(len(x), k, d).sum(2))

        return of


def mixture_starts(vec: DataFrame, settings: Sequence[tuple[int, int]], parallelism: int, **columns) -> list[Mixture]:
    """The mixture MLlib starts from for each (k, seed), chosen side by side."""
    def start(k: int, seed: int) -> Mixture:
        model = GaussianMixture(k=k, seed=seed, maxIter=0, **columns).fit(vec)
        found = model.gaussiansDF.collect()
        return Mixture(np.array(model.weights), np.array([g["mean"].toArray() for g in found]), np.array([g["cov"].toArray() for g in found]))

    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(start, *zip(*settings)))


def expectation_maximization(points: RDD, starts: Sequence[Mixture], *, steps: int = 100, tol: float = 0.01) -> list[Mixture]:
    """All mixtures of ``starts`` after MLlib's steps; a step of all of them is one scan of ``points`` (``point_blocks``).

    A mixture is done when its log likelihood changes by ``tol`` at most.
    """
    found, before, going = list(starts), [0.0] * len(starts), list(range(len(starts)))
    total = [0.0] * len(starts)
    for _ in range(steps):
        if not going:
            break
        shares = {i: found[i].shares for i in going}

        def add(b: tuple[np.ndarray, np.ndarray], shares=shares):
            x, w = b
            pairs = np.triu_indices(x.shape[1])
            products = np.hstack((np.ones((len(x), 1)), x, x[:, pairs[0]] * x[:, pairs[1]]))
            for i, make in shares.items():
                p = make()(x)
                whole = p.sum(1)
                yield i, np.append((p * (w / whole)[:, None]).T @ products, w @ np.log(whole))

        sums = summed(points, add)
        for i in list(going):
            k, d = found[i].means.shape
            if i not in sums:
                going.remove(i)
                continue
            *table, value = sums[i]
            table = np.array(table).reshape(k, -1)
            n, means = table[:, 0], table[:, 1: 1 + d] / table[:, :1]
            total[i] = total[i] or n.sum()
            covariances, pairs = np.zeros((k, d, d)), np.triu_indices(d)
            covariances[:, pairs[0], pairs[1]] = covariances[:, pairs[1], pairs[0]] = (
                table[:, 1 + d:] - n[:, None] * means[:, pairs[0]] * means[:, pairs[1]]) / n[:, None]
            found[i] = Mixture(n / total[i], means, covariances, float(value))
            if abs(value - before[i]) <= tol:
                going.remove(i)
            before[i] = float(value)
    return found


def mixture_sweep(df: DataFrame, features: Sequence[str], ks: Sequence[int] = range(2, 11), *,
                  restarts: int = 5, seed: int = 42, max_iter: int = 100, parallelism: int = 8) -> DataFrame:
    """n, bic, aic per component count; best likelihood of ``restarts`` starts. MLlib chooses the starts; all of them advance together."""
    vec = assemble(df.select(*[ident(f) for f in features]), features).persist(StorageLevel.MEMORY_AND_DISK)
    points, ks = point_blocks(vec, vector_to_array("features")), list(ks)
    try:
        n = vec.count()
        starts = mixture_starts(vec, [(k, seed + r) for k in ks for r in range(restarts)], parallelism)
        fits = expectation_maximization(points, starts, steps=max_iter)
        rows = [(int(k), *map(float, mixture_scores(max(f.log_likelihood for f in fits[i * restarts: (i + 1) * restarts]), k, len(features), n)))
                for i, k in enumerate(ks)]
    finally:
        points.unpersist()
        vec.unpersist()
    return df.sparkSession.createDataFrame(rows, "n int, bic double, aic double")


def best_components(sweep: DataFrame, score: str = "bic") -> int:
    return sweep.orderBy(score, "n").first()["n"]


def mixture_labels(df: DataFrame, features: Sequence[str], k: int, *, seed: int = 42, name: str = "cluster",
                   weight: str | None = None, restarts: int = 5, parallelism: int = 8) -> DataFrame:
    """Component of each row in the likeliest of ``restarts`` mixtures, which advance together from MLlib's starts."""
    wide = assemble(df, features, "_vec")
    vec = wide.select("_vec", *([ident(weight)] if weight else [])).persist(StorageLevel.MEMORY_AND_DISK)
    points = point_blocks(vec, vector_to_array("_vec"), weight)
    try:
        columns = {"featuresCol": "_vec"} | ({"weightCol": weight} if weight else {})
        starts = mixture_starts(vec, [(k, seed + r) for r in range(restarts)], parallelism, **columns)
        best = max(expectation_maximization(points, starts), key=lambda m: m.log_likelihood)
    finally:
        points.unpersist()
        vec.unpersist()

    call = F.pandas_udf(lambda v: pd.Series(best.shares()(np.stack(v.to_numpy())).argmax(1) if len(v) else [], dtype="int32"), "int")
    return wide.withColumn(name, call(vector_to_array("_vec"))).drop("_vec")


def ward_merge(centers: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Ward agglomeration of a bounded set of weighted centroids down to k groups."""
    groups = [[i] for i in range(len(centers))]
    c, n = centers.astype(float).copy(), sizes.astype(float).copy()
    gap = ((c[:, None] - c[None]) ** 2).sum(axis=2)
    cost = n[:, None] * n[None] / (n[:, None] + n[None]) * gap
    np.fill_diagonal(cost, np.inf)
    alive = np.ones(len(c), bool)
    for _ in range(len(c) - k):
        a, b = np.unravel_index(np.argmin(cost), cost.shape)
        c[a] = (n[a] * c[a] + n[b] * c[b]) / (n[a] + n[b])
        n[a] += n[b]
        groups[a] += groups[b]
        alive[b] = False
        cost[b, :] = cost[:, b] = np.inf
        row = n[a] * n / (n[a] + n) * ((c - c[a]) ** 2).sum(axis=1)
        row[~alive] = np.inf
        row[a] = np.inf
        cost[a, :] = cost[:, a] = row
    out = np.zeros(len(centers), int)
    for new, i in enumerate(np.flatnonzero(alive)):
        out[groups[i]] = new
    return out


def ward_labels(df: DataFrame, features: Sequence[str], k: int = 8, *, micro: int = 200, seed: int = 42,
                name: str = "cluster", weight: str | None = None) -> DataFrame:
    """Ward clusters over k-means micro-clusters (at most ``micro`` weighted centroids)."""
    vec = assemble(df, features, "_vec")
    km = KMeans(k=micro, seed=seed, featuresCol="_vec", predictionCol="_micro", maxIter=20)
    if weight:
        km = km.setWeightCol(weight)
    model = km.fit(vec)
    centers = np.array(model.clusterCenters())
    labelled = model.transform(vec)
    w = F.sum(ident(weight)) if weight else F.count("*")
    sizes = {r["_micro"]: float(r["w"]) for r in labelled.groupBy("_micro").agg(w.alias("w")).collect()}
    used = [i for i in range(len(centers)) if sizes.get(i, 0) > 0]
    code = ward_merge(centers[used], np.array([sizes[i] for i in used]), min(k, len(used)))
    # a row of weight 0 may sit in an empty micro-cluster: it follows the nearest used one
    near = {i: used[int(((centers[used] - centers[i]) ** 2).sum(axis=1).argmin())] for i in range(len(centers))}
    merged = dict(zip(used, code))
    lookup = F.create_map(*[F.lit(int(v)) for i in range(len(centers)) for v in (i, merged[near[i]])])
    return labelled.withColumn(name, lookup[F.col("_micro")]).drop("_vec", "_micro")


# -- stability ----------------------------------------------------------------
def poisson_weight(u: Column, most: int = 12) -> Column:
    """Poisson(1) draw from a uniform: how often a row occurs in a resample of the same size."""
    total, p = 0.0, math.exp(-1)
    out = F.lit(most)
    steps = []
    for m in range(most):
        total += p
        steps.append((m, total))
        p /= m + 1
    for m, edge in reversed(steps):
        out = F.when(u < edge, F.lit(m)).otherwise(out)
    return out


def bootstrap_agreement(df: DataFrame, key: str, label: str, cluster, *, resamples: int = 100, seed: int = 0,
                        parallelism: int = 4) -> DataFrame:
    """Adjusted Rand index between given labels and a re-clustering, per resample.

    A resample is a weight per row (Poisson bootstrap, Chamandy et al. 2012) from the
    row's hash, so nothing is drawn or joined. ``cluster(frame, weight_column)`` gives
    back the frame with a ``cluster`` column; refits run side by side on the driver's
    thread pool and give back one contingency table each.
    """
    def one(i: int):
        u = hash_unit(ident(key), salt=f"boot{seed}-{i}")
        drawn = df.withColumn("_w", poisson_weight(u).cast("double")).filter(F.col("_w") > 0)
        table = (cluster(drawn, "_w").groupBy(ident(label).cast("string").alias("x"),
                                              F.col("cluster").cast("string").alias("y")).agg(F.sum("_w").alias("n")))
        # clusters x clusters numbers per resample
        return [(i, "clusters", r["x"], r["y"], r["n"]) for r in table.collect()]

    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        with ThreadPoolExecutor(parallelism) as pool:
            rows = [r for part in pool.map(one, range(resamples)) for r in part]
    finally:
        df.unpersist()
    cells = df.sparkSession.createDataFrame(rows, "resample int, feature string, x string, y string, n double")
    return agreement(cells, ["resample"]).select("resample", "ari")


def stability_summary(scores: DataFrame) -> DataFrame:
    """Mean, deviation, median and range of the index with its band."""
    s = scores.agg(F.avg("ari").alias("mean"), F.stddev_pop("ari").alias("std"), F.median("ari").alias("median"),
                   F.min("ari").alias("min"), F.max("ari").alias("max"))
    band = F.lit("POOR")
    for edge, text in reversed(STABILITY_BANDS):
        band = F.when(F.col("mean") > edge, text).otherwise(band)
    return s.withColumn("band", band)
