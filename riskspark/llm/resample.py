"""Importance resampling towards a target distribution: hashed features, numeric cutoff by counting, ranks by range."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskspark.llm.common import staged, text_rows
from riskspark.llm.words import ALNUM, Run, runs

BUCKETS = 10_000    # also bounds what the driver collects and every task receives (8 bytes each)
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
CUTS = 15           # thresholds one counting job tries
LONG = 64           # bytes; longer words take the library's crc32 one by one

SCORED = "doc_id long, n_words long, n_features long, weight long"


def _crc_steps() -> np.ndarray:
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, (steps >> 1) ^ np.uint32(0xEDB88320), steps >> 1).astype(np.uint32)
    return steps


_STEPS = _crc_steps()


def _read(register: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each crc32 register after the bytes ``data[start:end]``, all words of a length class at once."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    state, at, length = register[order], starts[order], size[order]
    many = int(np.searchsorted(-length, -LONG, "left"))
    for i in range(many):
        word = data[at[i]: at[i] + length[i]].tobytes()
        state[i] = zlib.crc32(word, int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    step = 0
    while True:
        last = int(np.searchsorted(-length, -step, "left"))     # words longer than ``step`` come first
        if last <= many:
            break
        byte = data[at[many:last] + step]
        part = state[many:last]
        state[many:last] = _STEPS[(part ^ byte) & np.uint32(0xFF)] ^ (part >> np.uint32(8))
        step += 1
    out = np.empty_like(state)
    out[order] = state
    return out


def feature_buckets(run: Run, buckets: int, longest: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every run of 1 to ``longest`` words (joined by one space), repeats included."""
    n = len(run.starts)
    register = np.full(n, 0xFFFFFFFF, np.uint32)
    found, owner = [], []
    for k in range(longest):
        m = max(n - k, 0)
        register = register[:m]
        if k:
            register = _STEPS[(register ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (register >> np.uint32(8))
        register = _read(register, run.data, run.starts[k:], run.ends[k:])
        inside = run.doc[:m] == run.doc[k:]
        found.append(((register ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets))[inside].astype(np.int64))
        owner.append(run.doc[:m][inside])
    return np.concatenate(found), np.concatenate(owner)


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS, longest: int = 1) -> np.ndarray:
    """Features of all texts in each bucket; every task adds up its own before the shuffle."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, run in runs(batch["text"], ALNUM):
                total += np.bincount(feature_buckets(run, buckets, longest)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares, rounded down."""
    b, big_s, big_t = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (big_s + b) / ((s + 1.0) * (big_t + b))))
                     for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def weighted(rows: DataFrame, gains: np.ndarray, longest: int = 1) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every text, from the gains array."""
    buckets = len(gains)

    def weigh(batches):
        for batch in batches:
            n = batch.num_rows
            words, features, weight = (np.zeros(n, np.int64) for _ in range(3))
            for a, b, run in runs(batch["text"], ALNUM):
                bucket, doc = feature_buckets(run, buckets, longest)
                order = np.argsort(doc, kind="stable")
                total = np.concatenate(([0], np.cumsum(gains[bucket[order]])))
                many = np.bincount(doc, minlength=b - a)
                end = np.cumsum(many)
                words[a:b], features[a:b] = run.counts, many
                weight[a:b] = total[end] - total[end - many]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *map(pa.array, (words, features, weight))],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(weigh, SCORED)


def noisy(weight: Column, doc_id: Column, seed: int = SEED) -> Column:
    """The weight and a Gumbel number that the id alone decides; null without an id."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256), 1, 8)
    share = (F.conv(head, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return weight + F.floor(F.lit(-1000.0) * F.log(-F.log(share))).cast("long")


def _least_covering(rows: DataFrame, value: Column, wanted: int) -> tuple[int, int, int]:
    """(v, below, at): the least v with ``wanted`` rows of ``value <= v``, rows under v and rows at v.

    Bisection: each job counts, exactly, the rows up to some thresholds inside the range still open.
    """
    lo, hi = rows.agg(F.min(value), F.max(value)).first()
    below = 0                                   # rows under lo
    while lo < hi:
        cuts = sorted({lo + (hi - lo) * i // (CUTS + 1) for i in range(1, CUTS + 1)} | {lo})
        cuts = [c for c in cuts if c < hi]
        inside = rows.where((value >= lo) & (value <= hi))
        got = inside.agg(*(F.count(F.when(value <= c, 1)) for c in cuts)).first()
        for c, k in zip(cuts, got):
            if below + k >= wanted:
                hi = c
                break
            start, passed = c + 1, k
        if hi == lo:
            break
        lo, below = start, below + passed
    return hi, below, rows.where(value == hi).count()


def cutoff(rows: DataFrame, order: list[Column], wanted: int) -> Column:
    """Whether a row is among the first ``wanted`` in ``order`` (ascending longs; the last one tells all rows apart)."""
    value, *more = order
    v, below, at = _least_covering(rows, value, wanted)
    if below + at == wanted or not more:
        return value <= v
    return (value < v) | ((value == v) & cutoff(rows.where(value == v), more, wanted - below))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
              buckets: int = BUCKETS, longest: int = 1, seed: int = SEED) -> DataFrame:
    """Every document's ``doc_id, n_features, weight, score, rank``; rank is null for those not drawn.

    Features are runs of 1 to ``longest`` words, hashed to ``buckets``; a bucket's gain is the log ratio of
    its smoothed share in ``target`` to that in ``docs``, and a document's weight the sum of its gains. With
    Gumbel noise by id, the best ``percent`` of the documents of ``least_words`` words or more are a sample
    without replacement in proportion to exp(weight / 1000). Ties go to the smaller doc_id; rows that
    repeat a doc_id are drawn one by one, in the order they are read. Null or empty text has no features
    and weight 0. Rows without doc_id have no score, are not counted and are never drawn. Without documents
    nothing returns; without target texts the gains are those of an empty target.

    The gains (``buckets`` numbers) are all that is sent to the tasks. Nothing is sorted as a whole: a
    cutoff over the stored scores is found by counting, and only the rows drawn are range-partitioned for ranks.
    """
    rows = text_rows(docs)
    goal = target.select(target["text"].cast("string").alias("text"))
    gains = bucket_gains(bucket_counts(rows, buckets, longest), bucket_counts(goal, buckets, longest))
    scored = weighted(rows, gains, longest).withColumn("score", noisy(F.col("weight"), F.col("doc_id"), seed))
    scored = staged(scored.withColumn("row", F.monotonically_increasing_id()), "resample-scores")
    # a row without id has no score and is not eligible
    eligible = scored.where((F.col("n_words") >= least_words) & F.col("score").isNotNull())
    wanted = eligible.count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if not wanted:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    order = [-F.col("score"), F.col("doc_id"), F.col("row")]
    drawn = (F.col("n_words") >= least_words) & F.col("score").isNotNull() & cutoff(eligible, order, wanted)
    return ranked(scored.where(drawn), order, columns).unionByName(
        scored.where(~F.coalesce(drawn, F.lit(False))).select(*columns, F.lit(None).cast("long").alias("rank")))


def ranked(rows: DataFrame, order: list[Column], columns: list[str]) -> DataFrame:
    """``columns`` and the 1-based rank: range partitions are sorted each and lifted by the rows before them.

    One number per partition reaches the driver.
    """
    spark = rows.sparkSession
    placed = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        *columns, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")), "resample-ranks")
    sizes, total = [], 0
    for r in placed.groupBy("part").count().orderBy("part").collect():
        sizes.append((r["part"], total))
        total += r["count"]
    before = F.broadcast(spark.createDataFrame(sizes, "part int, before long"))
    return placed.join(before, "part").select(*columns, (F.col("before") + F.col("at") + 1).alias("rank"))


_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")


def crc32_sql(value: str) -> str:
    """DuckDB SQL of the unsigned crc32 of a string's UTF-8 bytes, four bits at a time."""
    table = []
    for i in range(16):
        for _ in range(4):
            i = (i >> 1) ^ 0xEDB88320 if i & 1 else i >> 1
        table.append(i)
    digits = f"hex(encode({value}))"
    nibbles = (f"list_transform(range(0, length({digits})), lambda i: "
               f"(instr('0123456789ABCDEF', substr({digits}, (i + 2 - 2 * (i % 2))::int, 1)) - 1)::bigint)")
    return (f"xor(list_reduce({nibbles}, lambda c, x: xor(c >> 4, list_extract({table}::bigint[], (xor(c, x) & 15) + 1)), "
            f"4294967295::bigint), 4294967295::bigint)")


SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT {_WORDS} AS w FROM benchmark),
words AS (SELECT DISTINCT unnest(w) AS x FROM (SELECT w FROM d UNION ALL SELECT w FROM b)),
named AS (SELECT x, {crc32_sql('x')} % {BUCKETS} AS k FROM words),
dw AS (SELECT doc_id, k FROM (SELECT doc_id, unnest(w) AS x FROM d) JOIN named USING (x)),
bw AS (SELECT k FROM (SELECT unnest(w) AS x FROM b) JOIN named USING (x)),
s AS (SELECT k, count(*) AS s FROM dw GROUP BY k), t AS (SELECT k, count(*) AS t FROM bw GROUP BY k),
z AS (SELECT (SELECT count(*) FROM dw)::double AS sn, (SELECT count(*) FROM bw)::double AS tn),
g AS (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1.0::double) * (sn + {BUCKETS}) / ((s + 1.0::double) * (tn + {BUCKETS}))))::bigint AS g
  FROM s LEFT JOIN t USING (k), z),
wt AS (SELECT doc_id, sum(g)::bigint AS weight FROM dw JOIN g USING (k) GROUP BY doc_id),
sc AS (SELECT doc_id, len(w)::bigint AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
  (('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint AS score
  FROM d LEFT JOIN wt USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM sc WHERE n_features >= {LEAST_WORDS})
SELECT sc.*, CASE WHEN r <= {PERCENT} * n // 100 THEN r END AS rank FROM sc LEFT JOIN r USING (doc_id)
"""
