"""N-gram Jaccard join: count vectors of hashed shingle groups in R-trees, bounds by summed minima, exact check.

Every distinct set is cut into as many hash ranges as two linked sets can differ in
tokens, and some more, so that two linked sets agree in at least one whole range; sets are
brought together by equal ranges. What meets there is joined through an R-tree over the
vectors of group counts, whose summed coordinate minima bound the overlap, and survivors
are verified on the sets themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from riskspark.llm.common import BATCH_BYTES, only, staged, text_rows, without
from riskspark.llm.graph import components
from riskspark.llm.words import NOT_SPACE, mix, runs, shingle_sets

SIZE = 5
#: Two sets link when LINK[1] * intersection >= LINK[0] * union.
LINK = (80, 100)
#: Coordinates of a count vector; counts above 255 are held as 255 with the bound adjusted.
GROUPS = 256
LEAF = 16
#: The first pass over meeting places takes one in so many.
FEW = 16
#: Members of one meeting place that one task joins at once; a larger one is joined in pairs of blocks.
BLOCK = 2048
#: Bytes of text whose sets a task holds at once when it verifies pairs.
PIECE = 4_000_000


def _levels(top: int) -> np.ndarray:
    """Largest set size of each size level: sizes of linked sets differ by a factor of 1.25 at most."""
    out, low = [0], 1
    while low <= top:
        out.append(low * 5 // 4)
        low = out[-1] + 1
    return np.array(out, np.int64)


_LEVELS = _levels(1 << 40)


def ranges_of(level: np.ndarray) -> np.ndarray:
    """Hash ranges at a level: one more than linked sets can differ by, and spare ones for empty ranges."""
    differ = _LEVELS[level] // 4
    return np.where(differ == 0, 1, differ + 2 + -(-differ // 20))


def range_keys(sets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set number, 64-bit key) of every non-empty range of every set, at its own level and the one below.

    At level L linked sets differ in at most D = size // 4 tokens, so of m > D ranges m - D or more
    agree. If fewer than m - D ranges are empty one of those that agree has tokens; a set with more empty
    ranges gives keys for its empty ranges, too, so that two such sets also meet.
    """
    n = np.diff(offsets)
    own = np.searchsorted(_LEVELS, n)
    doc_out, key_out = [], []
    owner = np.repeat(np.arange(len(n)), n)
    high = sets >> np.uint64(32)
    for down in (0, 1):
        level = own - down
        use = (n > 0) & (level > 0) & (_LEVELS[level] * 5 >= n * 4)
        if not use.any():
            continue
        m = ranges_of(np.maximum(level, 1))
        picked = np.flatnonzero(use[owner])
        if not len(picked):
            continue
        who = owner[picked]
        at = ((high[picked] * m[who].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (at[1:] != at[:-1]))))
        total = np.add.reduceat(mix(sets[picked]), begin)
        where = (level[who[begin]].astype(np.uint64) << np.uint64(40)) + at[begin].astype(np.uint64)
        doc_out.append(who[begin])
        key_out.append(mix(total + mix(where)))
        filled = np.bincount(who[begin], minlength=len(n))
        most = np.minimum(n, _LEVELS[level]) // 4
        for d in np.flatnonzero(use & (filled <= most)):
            full = np.zeros(m[d], bool)
            full[at[begin][who[begin] == d]] = True
            empty = np.flatnonzero(~full).astype(np.uint64)
            doc_out.append(np.full(len(empty), d))
            key_out.append(mix(mix((np.uint64(level[d]) << np.uint64(40)) + empty) + np.uint64(1)))
    if not doc_out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(doc_out), np.concatenate(key_out)


def count_vectors(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Tokens per group (by low hash bits) of each set; a count beyond 255 is held as 255."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    cell = owner * GROUPS + (sets & np.uint64(GROUPS - 1)).astype(np.int64)
    return np.minimum(np.bincount(cell, minlength=n * GROUPS), 255).astype(np.uint8).reshape(n, GROUPS)


def _may_link(overlap, a, b):
    return LINK[1] * overlap >= LINK[0] * (a + b - overlap)


def _overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a, b).sum(-1, dtype=np.int64)


def rtree_pairs(points: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (one of ``left``, one of ``right``) whose summed coordinate minima allow a link.

    Both sides are bulk-loaded into R-trees by recursive median splits (first on size, then on the
    widest coordinate); nodes hold the coordinate maxima and the size range. A pair of nodes is
    dropped if the summed minima of its maxima, or the sizes, bar every link below it.
    """
    excess = sizes - points.sum(1, dtype=np.int64)      # tokens beyond counts held as 255: may all be shared

    def build(rows, depth=0):
        top = points[rows].max(0)
        node = (top, sizes[rows].min(), sizes[rows].max(), excess[rows].max(), rows)
        if len(rows) <= LEAF:
            return (*node, None)
        by = sizes[rows] if depth < 2 else points[rows, int((top - points[rows].min(0)).argmax())]
        order = rows[np.argsort(by, kind="stable")]
        half = len(order) // 2
        return (*node, (build(order[:half], depth + 1), build(order[half:], depth + 1)))

    found, stack = [(left[:0], right[:0])], [(build(left), build(right))] if len(left) and len(right) else []
    while stack:
        x, y = stack.pop()
        # the overlap is at most the smaller size, so linked sizes are within LINK of each other
        if LINK[0] * x[1] > LINK[1] * y[2] or LINK[0] * y[1] > LINK[1] * x[2]:
            continue
        bound = min(int(_overlap(x[0], y[0])) + min(x[3], y[3]), x[2], y[2])
        if not _may_link(bound, x[1], y[1]):
            continue
        if x[5] is None and y[5] is None:
            a, b = x[4], y[4]
            over = _overlap(points[a][:, None, :], points[b][None, :, :]) + np.minimum(excess[a][:, None], excess[b][None, :])
            i, j = np.nonzero(_may_link(over, sizes[a][:, None], sizes[b][None, :]))
            found.append((a[i], b[j]))
        elif y[5] is None or x[5] is not None and len(x[4]) >= len(y[4]):
            stack += [(c, y) for c in x[5]]
        else:
            stack += [(x, c) for c in y[5]]
    return tuple(np.concatenate(x) for x in zip(*found))


def group_pairs(group: np.ndarray, points: np.ndarray, sizes: np.ndarray, part: np.ndarray,
                side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of one group and different parts whose count vectors allow a link.

    Rows come sorted by ``group``. ``side`` is 0 in a group joined with itself, else 1 or 2 and pairs are
    of both sides. Small groups, which are single leaves, are taken together.
    """
    excess = sizes - points.sum(1, dtype=np.int64)
    begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    n = np.diff(np.append(begin, len(group)))
    small = np.repeat(n <= LEAF, n)
    found = []
    for d in range(1, min(LEAF, len(group))):
        i = np.flatnonzero(small[:-d] & (group[:-d] == group[d:]) & (part[:-d] != part[d:])
                           & ((side[:-d] == 0) | (side[:-d] != side[d:]))
                           & (LINK[0] * np.minimum(sizes[:-d], sizes[d:]) <= LINK[1] * np.maximum(sizes[:-d], sizes[d:])))
        if not len(i):
            continue
        over = _overlap(points[i], points[i + d]) + np.minimum(excess[i], excess[i + d])
        ok = _may_link(over, sizes[i], sizes[i + d])
        found.append((i[ok], i[ok] + d))
    for a, k in zip(begin[n > LEAF].tolist(), n[n > LEAF].tolist()):
        rows = np.arange(a, a + k)
        if side[a]:
            left, right = rows[side[rows] == 1], rows[side[rows] == 2]
        else:       # pairs within the largest part are not wanted
            parts, count = np.unique(part[rows], return_counts=True)
            left, right = rows[part[rows] != parts[count.argmax()]], rows
        i, j = rtree_pairs(points, sizes, left, right)
        ok = part[i] != part[j]
        found.append((i[ok], j[ok]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _read_sets(batches, emit):
    for batch in batches:
        for a, b, run in runs(batch["text"], NOT_SPACE):
            yield emit(batch.slice(a, b - a), *shingle_sets(run, SIZE))
    pa.default_memory_pool().release_unused()


def _sets(rows: DataFrame) -> DataFrame:
    """Per row: the set's size, two hash sums that identify it, and its count vector."""
    def sums(batches):
        def emit(part, sets, offsets):
            k = [np.zeros(part.num_rows, np.uint64) for _ in range(2)]
            some = np.flatnonzero(np.diff(offsets))
            for i in range(2):
                if len(some):
                    k[i][some] = np.add.reduceat(mix(sets + np.uint64(i)), offsets[some])
            vectors = count_vectors(sets, offsets)
            return pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array(np.diff(offsets)), pa.array(k[0].astype(np.int64)), pa.array(k[1].astype(np.int64)),
                 pa.array([v.tobytes() for v in vectors], pa.binary())],
                names=["doc_id", "n_shingles", "k1", "k2", "vector"])
        yield from _read_sets(batches, emit)

    return rows.mapInArrow(sums, "doc_id long, n_shingles long, k1 long, k2 long, vector binary")


def _range_rows(reps: DataFrame) -> DataFrame:
    def keys(batches):
        def emit(part, sets, offsets):
            doc, key = range_keys(sets, offsets)
            ids = part["doc_id"].to_numpy(zero_copy_only=False)
            return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(ids[doc].astype(np.int64))],
                                              names=["key", "id"])
        yield from _read_sets(batches, emit)

    return reps.mapInArrow(keys, "key long, id long")


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets link, by intersection of the whole sets."""
    def check(batches):
        for batch in batches:
            size = pc.add(pc.binary_length(batch["text_a"]), pc.binary_length(batch["text_b"])).to_numpy(zero_copy_only=False)
            piece = (np.cumsum(size, dtype=np.int64) - size) // PIECE
            cuts = np.flatnonzero(np.diff(piece)) + 1
            for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                yield linking(batch.slice(x, y - x))
        pa.default_memory_pool().release_unused()

    def linking(rows):
        """The rows whose sets link; the sets of a few megabytes of text are held at once."""
        keep = np.zeros(rows.num_rows, bool)
        left = [x for part in runs(rows["text_a"], NOT_SPACE) for x in _split(part)]
        right = [x for part in runs(rows["text_b"], NOT_SPACE) for x in _split(part)]
        for i, (x, y) in enumerate(zip(left, right)):
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep[i] = both > 0 and _may_link(both, len(x), len(y))
        return rows.select(["a", "b"]).filter(pa.array(keep))

    def _split(part):
        sets, offsets = shingle_sets(part[2], SIZE)
        return [sets[a:b] for a, b in zip(offsets[:-1], offsets[1:])]

    a, b = (texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def _meetings(met: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pairs of different components that meet at a key and whose count vectors allow a link.

    ``met(key, id, component)``. A key with more than ``BLOCK`` members is joined in pairs of blocks,
    each of which is a group of bounded size.
    """
    size = met.groupBy("key").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks.cast("long")).cast("int")
    rows = met.join(size, "key").withColumns({"blocks": blocks, "own": own})
    rows = rows.select("key", "id", "component", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("place"), "id", "component",
                       F.when(F.col("own") == F.col("other"), F.lit(0)).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"))
    # a block meets itself in a place of its own, and every other block in one
    rows = rows.join(vectors, "id").repartition("place").sortWithinPartitions("place")

    def join(batches):
        held = None
        for batch in batches:
            table = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            place = table["place"].to_numpy()
            whole = int(np.flatnonzero(place == place[-1])[0]) if len(place) else 0
            held = table.slice(whole)
            yield pairs(table.slice(0, whole))
        if held is not None:
            yield pairs(held)

    def pairs(table):
        n = table.num_rows
        points = np.frombuffer(b"".join(table["vector"].to_pylist()), np.uint8).reshape(n, GROUPS)
        place, ids, part, sizes, side = (table[c].to_numpy() for c in ("place", "id", "component", "n_shingles", "side"))
        i, j = group_pairs(place, points, sizes, part, side) if n else (np.zeros(0, np.int64),) * 2
        a, b = np.maximum(ids[i], ids[j]), np.minimum(ids[i], ids[j])
        ab = np.unique(np.stack((a, b), 1)[a != b], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])

    return rows.mapInArrow(join, "a long, b long").distinct()


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: components of documents whose 5-word shingle
    sets have a Jaccard similarity of 0.8 or more.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a text of fewer than five words is
    one shingle. Null, empty or wordless texts have no shingles and link with nothing. Rows of equal sets
    are one node, named by their smallest doc_id, so copies cost nothing from there on. A row without
    doc_id takes part in nothing and has a null component; rows that share a doc_id are one document.
    """
    rows = text_rows(docs)
    sets = staged(_sets(rows), "sets", BATCH_BYTES)
    some = sets.where("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy("k1", "k2").agg(F.min("doc_id").alias("id"))
    reps = staged(some.join(classes, ["k1", "k2"]).where("doc_id = id").groupBy("id", "k1", "k2").agg(
        F.first("n_shingles").alias("n_shingles"), F.first("vector").alias("vector")), "classes")
    copies = staged(some.join(reps.select("id", "k1", "k2"), ["k1", "k2"]).where("doc_id <> id").select("doc_id").distinct(),
                    "copies")
    own = without(rows.where("doc_id is not null"), copies, "doc_id")

    # 1: everyone at a meeting place against its smallest id; each document tries its smallest partner
    place = Window.partitionBy("key")
    met = staged(_range_rows(own).select("key", "id", F.min("id").over(place).alias("low"), F.max("id").over(place).alias("high"))
                 .where("low < high").select("key", "id", "low"), "met", BATCH_BYTES)
    star = met.where("low < id").groupBy(F.col("id").alias("a")).agg(F.min("low").alias("b"))
    needed = met.select(F.col("id").alias("doc_id")).distinct()
    texts = staged(only(own, needed, "doc_id"), "texts")
    first = staged(_linked(star, texts), "links-1", BATCH_BYTES)
    label = components(first).select(F.col("node").alias("id"), "component")

    # 2: what still meets across components, through the R-trees: at one place in sixteen first, where
    # sets that agree in most ranges are all but sure to meet, then at all places with what is left
    vectors, links = reps.select("id", "n_shingles", "vector"), first
    for places in (F.pmod(F.col("key"), F.lit(FEW)) == 0, F.lit(True)):
        named = met.where(places).join(label, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
        crossing = named.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2")
        rest = staged(_meetings(named.join(crossing.select("key"), "key"), vectors), "rest")
        links = staged(links.unionByName(_linked(rest, texts)), "links", BATCH_BYTES)
        label = components(links).select(F.col("node").alias("id"), "component")
    final = label.withColumnRenamed("id", "node")

    named = reps.select("id", "k1", "k2").join(final, reps["id"] == final["node"], "left").select(
        "k1", "k2", F.coalesce("component", "id").alias("component_id"))
    return sets.join(named.hint("shuffle_merge"), ["k1", "k2"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.when(
            F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))).alias("component_id"))


def one_per_component(docs: DataFrame) -> DataFrame:
    """The documents that name their component, with their own columns; rows without words stay."""
    kept = jaccard_components(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_copy")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long") == kept["_copy"], "left_anti")
