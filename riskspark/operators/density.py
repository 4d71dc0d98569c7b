"""Density clustering on a grid: exact DBSCAN without pairing up crowded cells.

Cells have side eps/sqrt(d), so all points of a cell are neighbours of each other. A
cell with ``min_samples`` points is therefore all core and needs no pair inside it;
only the fewer than ``min_samples`` points of a thin cell look their neighbours up one
by one. Whether two core cells touch is settled on representatives of ever finer
sub-cells, and components join by label propagation over cells.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from riskspark.functions.columns import ident, number
from riskspark.session import cut_lineage

NOISE = -1
SUB_STEPS = 8
MAX_LEVELS = 4


def _gap2(a: str, b: str) -> Column:
    """Squared distance of two array columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def _box_gap2(a: Column, b: Column, side: float) -> Column:
    """Squared least distance of two grid cells given their integer corners."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.greatest(F.abs(x - y) - 1, F.lit(0)).cast("double")),
                       F.lit(0.0), lambda s, v: s + v * v) * (side * side)


def _near_cells(cells: DataFrame, others: DataFrame, side: float, eps: float) -> DataFrame:
    """Pairs (a, b) of occupied cells within eps, found through coarse blocks of their first axes."""
    reach = math.ceil(eps / side) + 1
    axes = (0, 1)

    def block(cell: Column, shift=(0, 0)) -> list[Column]:
        return [(F.floor(F.try_element_at(cell, F.lit(i + 1)) / reach) + shift[i]).alias(f"k{i}") for i in axes]

    shifts = F.array(*[F.array(F.lit(x), F.lit(y)) for x in (-1, 0, 1) for y in (-1, 0, 1)])
    left = (cells.select(F.col("cell").alias("a"), F.explode(shifts).alias("_s"))
            .select("a", *[(F.coalesce(F.floor(F.try_element_at("a", F.lit(i + 1)) / reach), F.lit(0)) + F.col("_s")[i]).alias(f"k{i}")
                           for i in axes]).distinct())
    right = others.select(F.col("cell").alias("b"), *[F.coalesce(c, F.lit(0)).alias(f"k{i}")
                                                     for i, c in enumerate(block(F.col("cell")))])
    return (left.join(right, ["k0", "k1"]).filter(_box_gap2(F.col("a"), F.col("b"), side) <= eps * eps * (1 + 1e-12))
            .select("a", "b").distinct())


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Smallest reachable node per node (node, label) by min-label rounds with jumps."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut_lineage(both)
    labels = cut_lineage(nodes.select("node", F.col("node").alias("label")))
    while True:
        seen = (both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node"))
                .agg(F.min("label").alias("low")))
        step = labels.join(seen, "node", "left").select(
            "node", "label", F.least("label", F.coalesce("low", "label")).alias("low"))
        # jump: follow the label of the label
        hop = step.select(F.col("node").alias("_n"), F.col("low").alias("_l"))
        step = step.join(hop, step["low"] == hop["_n"], "left").select(
            "node", "label", F.least("low", F.coalesce("_l", "low")).alias("next"))
        step = cut_lineage(step)
        if step.filter("next < label").isEmpty():
            return step.select("node", F.col("next").alias("label"))
        labels = step.select("node", F.col("next").alias("label"))


def _touching(core: DataFrame, pairs: DataFrame, eps: float, side: float) -> DataFrame:
    """Pairs of core cells with two core points within eps of each other, exact."""
    done = None
    # a point per sub-cell stands for it; its pair decides "yes", otherwise both sub-cells split further
    open_pairs = pairs.select("a", "b", F.col("a").alias("sa"), F.col("b").alias("sb"))
    step = side
    points = core.select("cell", "x", F.col("cell").alias("sub"))
    for level in range(MAX_LEVELS + 1):
        last = level == MAX_LEVELS
        reps = points if last else points.groupBy("cell", "sub").agg(F.min("x").alias("x"))
        left = reps.select(F.col("cell").alias("a"), F.col("sub").alias("sa"), F.col("x").alias("xa"))
        right = reps.select(F.col("cell").alias("b"), F.col("sub").alias("sb"), F.col("x").alias("xb"))
        tried = open_pairs.join(left, ["a", "sa"]).join(right, ["b", "sb"])
        hit = tried.filter(_gap2("xa", "xb") <= eps * eps).select("a", "b").distinct()
        hit = cut_lineage(hit)
        done = hit if done is None else done.union(hit)
        if last:
            break
        rest = open_pairs.join(hit, ["a", "b"], "left_anti")
        if rest.isEmpty():
            break
        parts = [c for c in (rest.select(F.col("a").alias("cell"), F.col("sa").alias("sub")),
                             rest.select(F.col("b").alias("cell"), F.col("sb").alias("sub")))]
        live = parts[0].union(parts[1]).distinct()
        step = step / SUB_STEPS
        finer = (points.join(live, ["cell", "sub"], "left_semi")
                 .withColumn("fine", F.transform("x", lambda v: F.floor(v / step))))
        kids = finer.select(F.col("cell"), "sub", "fine").distinct()
        ka = kids.select(F.col("cell").alias("a"), F.col("sub").alias("sa"), F.col("fine").alias("fa"))
        kb = kids.select(F.col("cell").alias("b"), F.col("sub").alias("sb"), F.col("fine").alias("fb"))
        open_pairs = (rest.join(ka, ["a", "sa"]).join(kb, ["b", "sb"])
                      .filter(_box_gap2(F.col("fa"), F.col("fb"), step) <= eps * eps * (1 + 1e-12))
                      .select("a", "b", F.col("fa").alias("sa"), F.col("fb").alias("sb")))
        open_pairs = cut_lineage(open_pairs)
        points = cut_lineage(finer.select("cell", "x", F.col("fine").alias("sub")))
        if open_pairs.isEmpty():
            break
    return done


def dbscan(df: DataFrame, features: Sequence[str], key: str, *, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """key, cluster: the smallest core key of the point's cluster, or -1 for noise.

    A border point within reach of several clusters takes the smallest label.
    """
    side = eps / math.sqrt(len(features))
    pts = df.select(ident(key).alias("id"), F.array(*[number(ident(f)) for f in features]).alias("x"))
    pts = pts.withColumn("cell", F.transform("x", lambda v: F.floor(v / side)))
    pts = cut_lineage(pts)
    cells = pts.groupBy("cell").agg(F.count("*").alias("n"))
    cells = cut_lineage(cells)
    thin = cells.filter(F.col("n") < min_samples)
    near_thin = cut_lineage(_near_cells(thin, cells, side, eps))
    sparse = pts.join(thin.select("cell"), "cell", "left_semi")
    looks = (sparse.select(F.col("cell").alias("a"), F.col("id").alias("p"), F.col("x").alias("xp")).join(near_thin, "a"))
    found = (looks.join(pts.select(F.col("cell").alias("b"), F.col("x").alias("xq")), "b")
             .filter(_gap2("xp", "xq") <= eps * eps).groupBy("p").agg(F.count("*").alias("n")))
    thin_core = found.filter(F.col("n") >= min_samples).select(F.col("p").alias("id"))
    core = (pts.join(cells.filter(F.col("n") >= min_samples).select("cell"), "cell", "left_semi")
            .unionByName(sparse.join(thin_core, "id", "left_semi")))
    core = cut_lineage(core.select("id", "cell", "x"))
    # a cell is named by its smallest core key
    names = core.groupBy("cell").agg(F.min("id").alias("node"))
    names = cut_lineage(names)
    pairs = _near_cells(names.select("cell"), names.select("cell"), side, eps)
    pairs = pairs.join(names.select(F.col("cell").alias("a"), F.col("node").alias("na")), "a").join(
        names.select(F.col("cell").alias("b"), F.col("node").alias("nb")), "b").filter("na < nb").select("a", "b")
    touching = _touching(core, cut_lineage(pairs), eps, side)
    edges = (touching.join(names.select(F.col("cell").alias("a"), F.col("node").alias("na")), "a")
             .join(names.select(F.col("cell").alias("b"), F.col("node").alias("nb")), "b")
             .select(F.col("na").alias("a"), F.col("nb").alias("b")))
    comp = components(edges, names.select("node"))
    cell_label = cut_lineage(names.join(comp, "node").select("cell", "label"))
    core_labels = core.join(cell_label, "cell").select("id", "label")
    border = (looks.join(core_labels.join(core, "id").select(F.col("cell").alias("b"), F.col("x").alias("xq"), "label"), "b")
              .filter(_gap2("xp", "xq") <= eps * eps).groupBy(F.col("p").alias("id")).agg(F.min("label").alias("near")))
    out = pts.select("id").join(core_labels, "id", "left").join(border, "id", "left")
    return out.select(F.col("id").alias(key), F.coalesce("label", "near", F.lit(NOISE)).alias("cluster"))


def cluster_counts(labels: DataFrame) -> DataFrame:
    """Number of clusters and of noise points."""
    return labels.agg(F.count_distinct(F.when(F.col("cluster") != NOISE, F.col("cluster"))).alias("n_clusters"),
                      F.count_if(F.col("cluster") == NOISE).alias("n_noise"))
