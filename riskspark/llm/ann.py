"""Approximate nearest neighbours by a forest of hash-prefix trees.

A tree's hash string of a vector is the signs of its products with random directions; a
tree is the sorted array of those strings, and a subtree the run of strings with a common
prefix. A query descends to its longest prefixes, then ascends in all trees together until
enough candidates stand below; these are compared exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from riskspark.llm.common import staged

TREES = 24
DEPTH = 24          # bits of a hash string
#: Candidates to ascend for: this share of all vectors, counted once per tree they come from, or LEAST if more.
SHARE = 0.55
LEAST = 2_000
#: Vectors of one subtree that one task holds; a larger subtree is dealt out over several.
BLOCK = 20_000
NEAREST = 20


def _planes(dim: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, TREES * DEPTH))


def hash_strings(vectors: np.ndarray, norm: float) -> np.ndarray:
    """``TREES`` hash strings per vector, as whole numbers with the first bit on top.

    For inner products a vector is lengthened to a common norm by one more coordinate,
    so the nearest by angle are those of the largest product; queries get none.
    """
    room = np.sqrt(np.maximum(norm * norm - (vectors ** 2).sum(1), 0))
    bits = np.column_stack((vectors, room)) @ _planes(vectors.shape[1] + 1) > 0
    return bits.reshape(len(vectors), TREES, DEPTH) @ (1 << np.arange(DEPTH - 1, -1, -1))


def _usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` of the rows whose vector is whole, finite and not zero, as doubles."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), v.alias("v"))
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where("vec_id is not null").where(F.col("v").isNotNull() & ok)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _prefix_counts(own: np.ndarray, query: np.ndarray, shift: int) -> np.ndarray:
    """For each query string: how many of the sorted strings share its first 1, 2, ... bits past ``shift``."""
    out = np.zeros((len(query), DEPTH + 1), np.int64)
    for bits in range(shift, DEPTH + 1):
        low = query >> (DEPTH - bits) << (DEPTH - bits)
        out[:, bits] = np.searchsorted(own, low + (1 << (DEPTH - bits))) - np.searchsorted(own, low)
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the ``k`` rows found with the largest inner product.

    A query is a row of ``queries`` (same columns) and never its own neighbour. Products are of the
    given vectors in double precision, ties go to the smaller vec_id. Vectors that are null, zero, hold a
    null or non-finite entry, or differ in length from most, take no part, nor do rows without vec_id;
    an empty side gives no rows. Equal vectors are one entry of the trees, which keeps the ``k`` + 1
    smallest ids: no query needs more of them. Rows that share a vec_id and vector count once.

    Each tree's sorted array is cut at a prefix length into subtrees large enough to ascend in; subtrees
    beyond ``BLOCK`` vectors are dealt out, and their counts and bests are added up. A query whose
    candidates do not suffice there goes on to the subtrees above. With no structure in the vectors, ``share``
    sets recall; clustered vectors reach it with ``share`` 0 and ``least``.
    """
    spark = vectors.sparkSession
    rows = _usable(vectors)
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = dims["d"]
    keys = [F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2")]
    rows = rows.where(F.size("v") == dim).select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v")).distinct()
    rows = rows.select("vec_id", "v", *keys)
    first = Window.partitionBy("k1", "k2").orderBy("vec_id")
    copies = staged(rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1), "vectors")
    ids = copies.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    own = staged(copies.where("n = 1").join(ids, ["k1", "k2"]).select(F.col("vec_id").alias("id"), "ids", "v"), "vectors")
    n, norm = own.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    asked = staged(_usable(queries).where(F.size("v") == dim).select(
        F.col("vec_id").alias("query_id"), F.transform("v", lambda x: x + F.lit(0.0)).alias("v")).distinct().select(
        "query_id", "v", *keys), "queries")
    lookups = staged(asked.groupBy("k1", "k2").agg(F.first("v").alias("v")), "lookups")
    wanted = min(max(int(share * n), least, k + 1), n * TREES)
    depth = max(0, int(np.log2(max(1.0, n * TREES / wanted))) - 1)

    def hashed(df, columns, with_norm):
        def run(batches):
            for batch in batches:
                x = _matrix(batch["v"])
                h = hash_strings(x, norm) if with_norm else hash_strings(x, float(0))
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c] for c in columns), pa.array(list(h), pa.list_(pa.int64()))], names=[*columns, "h"])
        kinds = dict(df.dtypes)
        return df.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", h array<bigint>")

    trees = staged(hashed(own, ["id", "ids", "v"], True), "trees")
    left = hashed(lookups, ["k1", "k2", "v"], False)
    done, parts = None, []
    while True:
        place = lambda df: df.select("*", F.posexplode("h").alias("tree", "s")).drop("h").withColumn(
            "top", F.shiftright("s", DEPTH - depth) if depth else F.lit(0).cast("long"))
        items = place(trees)
        sizes = items.groupBy("tree", "top").count()
        blocks = sizes.select("tree", "top", F.greatest(F.lit(1), F.ceil(F.col("count") / BLOCK)).cast("int").alias("blocks"))
        items = items.join(blocks, ["tree", "top"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
        asked_here = place(left).join(blocks, ["tree", "top"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

        # descend: how many strings share 1, 2, ... bits with the query's, in every tree
        def count(_, table, other):
            own_s = np.sort(table["s"].to_numpy())
            c = _prefix_counts(own_s, other["s"].to_numpy(), depth)
            return pa.Table.from_arrays([other["k1"], other["k2"], pa.array(list(c), pa.list_(pa.int64()))], names=["k1", "k2", "c"])

        counts = items.select("tree", "top", "block", "s").groupBy("tree", "top", "block").cogroup(
            asked_here.select("tree", "top", "block", "s", "k1", "k2").groupBy("tree", "top", "block")).applyInArrow(
            count, "k1 long, k2 long, c array<bigint>")
        # ascend together: the longest common prefix length at which all trees hold enough
        summed = counts.groupBy("k1", "k2").agg(F.array(*(F.sum(F.col("c")[i]) for i in range(DEPTH + 1))).alias("c"))
        stop = summed.select("k1", "k2", F.array_max(F.transform(
            "c", lambda x, i: F.when((x >= wanted) & (i >= depth), i))).alias("bits"))
        stop = staged(stop.withColumn("bits", F.coalesce("bits", F.lit(depth if depth == 0 else -1))), "levels")

        def compare(_, table, other):
            x, ids_, s = _matrix(table["v"].combine_chunks()), table["ids"].to_pylist(), table["s"].to_numpy()
            q, qs, bits = _matrix(other["v"].combine_chunks()), other["s"].to_numpy(), other["bits"].to_numpy()
            out_ids, out_scores = [], []
            for a in range(0, len(q), 256):
                score = q[a: a + 256] @ x.T if len(x) else np.zeros((len(q[a: a + 256]), 0))
                far = (s[None, :] >> (DEPTH - bits[a: a + 256, None])) != (qs[a: a + 256, None] >> (DEPTH - bits[a: a + 256, None]))
                score[far] = -np.inf
                for row in score:
                    near = np.argpartition(-row, k)[: k + 1] if len(row) > k + 1 else np.arange(len(row))
                    # all that tie with the last one count
                    near = np.flatnonzero(row >= row[near].min()) if len(near) else near
                    near = near[np.isfinite(row[near])]
                    got = sorted((-row[j], i) for j in near.tolist() for i in ids_[j])[: k + 1]
                    out_ids.append([i for _, i in got])
                    out_scores.append([-x_ for x_, _ in got])
            return pa.Table.from_arrays([other["k1"], other["k2"], pa.array(out_ids, pa.list_(pa.int64())),
                                         pa.array(out_scores, pa.list_(pa.float64()))], names=["k1", "k2", "ids", "scores"])

        ready = asked_here.join(stop.where("bits >= 0"), ["k1", "k2"])
        best = items.select("tree", "top", "block", "s", "ids", "v").groupBy("tree", "top", "block").cogroup(
            ready.select("tree", "top", "block", "s", "k1", "k2", "v", "bits").groupBy("tree", "top", "block")).applyInArrow(
            compare, "k1 long, k2 long, ids array<bigint>, scores array<double>")
        parts.append(best)
        more = stop.where("bits < 0").select("k1", "k2")
        if depth == 0 or not more.take(1):
            break
        left = staged(left.join(more, ["k1", "k2"]), "above")
        depth = max(0, depth - 2)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    pairs = found.select("k1", "k2", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select(
        "k1", "k2", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    pairs = pairs.groupBy("k1", "k2", "vec_id").agg(F.max("score").alias("score"))
    top = Window.partitionBy("k1", "k2").orderBy(F.desc("score"), "vec_id")
    lists = pairs.withColumn("n", F.row_number().over(top)).where(F.col("n") <= k + 1).groupBy("k1", "k2").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("found"))
    met = asked.select("query_id", "k1", "k2").join(lists, ["k1", "k2"])
    kept = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return met.select("query_id", F.posexplode(kept).alias("p", "x")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
