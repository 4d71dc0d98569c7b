"""Benchmark decontamination: broadcast hash sets of test n-grams, scanned by word windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskspark.llm.common import fresh, staged, text_rows
from riskspark.llm.words import ALNUM, as_bytes, run_of, runs, window_hashes

WINDOW = 10
BITS = 20       # of a hash that the first look-up reads
#: Most bytes of benchmark text sent to executors at once; a larger benchmark is scanned in parts of this size. The look-up
#: tables take about 130 bytes in each process for a byte of text.
PART_BYTES = 2 << 20

RESULT = ("doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
          "hit_starts array<long>, hit_ends array<long>")


class Windows:
    """The n-grams of some test items by hash, with their words for verification."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        self.size, self.items = size, items
        self._build()

    def _build(self):
        size, by = self.size, {}
        for item, text in self.items:
            raw = np.frombuffer(text.encode(), np.uint8)
            run = run_of(raw, np.array([0, len(raw)]), ALNUM)
            n = len(run.hashes)
            if not n:
                continue
            words = tuple(run.data[a:b].tobytes() for a, b in zip(run.starts, run.ends))
            k = min(size, n)
            for i, h in enumerate(window_hashes(run.hashes, k).tolist()):
                found = by.setdefault((k, h), {})
                found.setdefault(words[i: i + k], set()).add(item)
        self.by = by
        self._index()

    def __getstate__(self):
        # the items travel, many times smaller than the windows, which are made anew where they arrive
        return self.size, self.items

    def __setstate__(self, state):
        self.size, self.items = state
        self._build()

    def _index(self):
        by = self.by
        self.hashes = {k: np.array(sorted(h for s, h in by if s == k), np.uint64) for k in {s for s, _ in by}}
        # a bit per low hash value lets nearly every window pass by one look-up
        self.bits = {}
        for k, hashes in self.hashes.items():
            bits = np.zeros(1 << BITS, bool)
            bits[(hashes & np.uint64((1 << BITS) - 1)).astype(np.int64)] = True
            self.bits[k] = bits

    def scan(self, run) -> Iterator[tuple[int, int, int, set]]:
        """(text number, first word, word after the last, items) of every verified window."""
        first = run.first
        for k, hashes in self.hashes.items():
            wide = window_hashes(run.hashes, k)
            near = np.flatnonzero(self.bits[k][(wide & np.uint64((1 << BITS) - 1)).astype(np.int64)])
            near = near[run.doc[near] == run.doc[near + k - 1]]
            at = np.searchsorted(hashes, wide[near])
            near = near[(at < len(hashes)) & (hashes[np.minimum(at, len(hashes) - 1)] == wide[near])]
            for i in near.tolist():
                words = tuple(run.data[run.starts[j]: run.ends[j]].tobytes() for j in range(i, i + k))
                items = self.by[k, int(wide[i])].get(words)
                if items:
                    d = int(run.doc[i])
                    yield d, i - int(first[d]), i - int(first[d]) + k, items


def _merged(pieces: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(pieces):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _verdict(n_words, pieces, items):
    names = sorted(items)
    hit = sum(b - a for a, b in pieces)
    digest = hashlib.sha256(",".join(names).encode()).hexdigest()
    return n_words, hit, len(names), digest, hit > 0, [a for a, _ in pieces], [b for _, b in pieces]


def _parts(benchmark: DataFrame, most: int) -> Iterator[list[tuple[str, str]]]:
    """The items as lists of bounded size, streamed to the driver one partition at a time."""
    held, size = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where(
            "item_id is not null and text is not null").distinct().toLocalIterator():
        n = len(text.encode())
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append((item, text))
        size += n
    yield held


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW,
                  part_bytes: int = PART_BYTES) -> DataFrame:
    """What of each document stands in a test item, one row per input row.

    Words are runs of digits, letters a-z (after lower-casing A-Z) and characters beyond
    ASCII. A window is ``size`` consecutive words of an item, or all words of a shorter one.
    ``hit_starts``/``hit_ends`` give the covered word spans, merged. Null or empty text has no
    words; null item texts or ids and items without words give no window; repeated rows of
    either table are each judged; an empty benchmark leaves every document clean.

    The windows of at most ``part_bytes`` of item text are broadcast at once. A benchmark
    within that bound needs one map-only pass; a larger one is scanned part by part and the
    spans are united per document.
    """
    rows, spark = text_rows(docs), docs.sparkSession
    parts = _parts(benchmark, part_bytes)
    part, more = next(parts), next(parts, None)
    if more is None:
        shared = spark.sparkContext.broadcast(Windows(part, size))

        def judge(batches):
            for batch in batches:
                cols = [[] for _ in range(8)]
                for a, b, run in runs(batch["text"], ALNUM):
                    hits: dict[int, list] = {}
                    for d, i, j, items in shared.value.scan(run):
                        hits.setdefault(d, []).append((i, j, items))
                    for d in range(b - a):
                        got = hits.get(d, ())
                        found = _verdict(int(run.counts[d]), _merged([(i, j) for i, j, _ in got]),
                                         set().union(*(x for _, _, x in got)))
                        for c, v in zip(cols[1:], found):
                            c.append(v)
                cols[0] = batch["doc_id"]
                kinds = [pa.int64()] * 4 + [pa.string(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols, kinds)],
                    names=[x.split()[0] for x in RESULT.split(", ")])

        return rows.mapInArrow(judge, RESULT)
    return _in_parts(rows, [part, more], parts, size)


def _keys(doc_id, text) -> list:
    """Two hashes that tell (doc_id, text) pairs apart: rows that repeat both share their verdict."""
    return [F.xxhash64(doc_id, text), F.xxhash64(F.lit(7), text, doc_id)]


def _hits(keyed: DataFrame, begun, parts, size) -> DataFrame:
    """``k1, k2, i, j, item`` of every hit: one scan for each part of the benchmark."""
    spark = keyed.sparkSession

    def found(part):
        shared = spark.sparkContext.broadcast(Windows(part, size))

        def scan(batches):
            for batch in batches:
                out = []
                for a, _, run in runs(batch["text"], ALNUM):
                    for d, i, j, items in shared.value.scan(run):
                        out.extend((batch["k1"][a + d].as_py(), batch["k2"][a + d].as_py(), i, j, x) for x in items)
                cols = list(zip(*out)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 4 + [pa.string()])],
                    names=["k1", "k2", "i", "j", "item"])

        return staged(keyed.mapInArrow(scan, "k1 long, k2 long, i long, j long, item string").distinct(), "hits")

    hits = None
    for part in [*begun, *parts]:
        got = found(part)
        hits = got if hits is None else hits.unionByName(got)
    return hits


def _in_parts(rows: DataFrame, begun, parts, size) -> DataFrame:
    """The same verdicts for a benchmark beyond one broadcast: the spans of all parts united."""
    keyed = rows.withColumns(dict(zip(("k1", "k2"), _keys(F.col("doc_id"), F.col("text")))))
    united = _hits(keyed, begun, parts, size).groupBy("k1", "k2").agg(F.collect_set(F.struct("i", "j")).alias("spans"),
                                          F.collect_set("item").alias("items"))

    def judge(batches):
        for batch in batches:
            counts = [int(c) for _, _, run in runs(batch["text"], ALNUM) for c in run.counts]
            cols = [[] for _ in range(7)]
            for n, s, x in zip(counts, batch["spans"].to_pylist(), batch["items"].to_pylist()):
                for c, v in zip(cols, _verdict(n, _merged([(y["i"], y["j"]) for y in s or ()]), x or ())):
                    c.append(v)
            kinds = [pa.int64()] * 3 + [pa.string(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, k) for c, k in zip(cols, kinds))],
                                             names=[x.split()[0] for x in RESULT.split(", ")])

    return keyed.join(united, ["k1", "k2"], "left").mapInArrow(judge, RESULT)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW,
                         part_bytes: int = PART_BYTES) -> DataFrame:
    """Documents no window of the benchmark occurs in, with their own columns.

    A benchmark within one broadcast is judged where the row is read, without a shuffle; a
    larger one by an anti-join on doc_id and text; both keep the same rows. Rows of null text stay.
    """
    parts = _parts(benchmark, part_bytes)
    part, more = next(parts), next(parts, None)
    if more is not None:
        names = [fresh(docs, "k1"), fresh(docs, "k2")]
        keyed = text_rows(docs).withColumns(dict(zip(("k1", "k2"), _keys(F.col("doc_id"), F.col("text")))))
        bad = _hits(keyed, [part, more], parts, size).select(F.col("k1").alias(names[0]), F.col("k2").alias(names[1])).distinct()
        own = _keys(docs["doc_id"].cast("long"), docs["text"].cast("string"))
        return docs.join(bad, (own[0] == bad[names[0]]) & (own[1] == bad[names[1]]), "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(Windows(part, size))
    at = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for a, _, run in runs(batch.column(at), ALNUM):
                clean[[a + d for d, *_ in shared.value.scan(run)]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(keep, docs.schema)
