"""Fuzzy line dedup: MinHash signatures of character shingles, banding, exact check, union-find."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from riskspark.llm.common import fresh, only, staged, text_rows
from riskspark.llm.graph import components
from riskspark.llm.words import LOWER, as_bytes, mix, spans

SHINGLE = 8        # characters (bytes of the folded line)
BANDS, ROWS = 8, 3  # a pair at similarity 0.8 shares a band with probability 0.997
LEAST = 1          # shorter lines (bytes), and blank ones, are always kept
SIMILARITY = 0.8
#: Lines, and bytes of them, that one task compares all with all; a fuller band is compared in pairs of blocks.
BLOCK, BLOCK_BYTES = 1024, 1 << 21
REMEMBERED = 1 << 20    # keys

_RNG = np.random.default_rng(20_240_101)
_MUL = (_RNG.integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint32) * 2 + 1).astype(np.uint32)
_ADD = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_B8 = np.uint64(0x9E3779B97F4A7C15)


def _shingle_codes(data: np.ndarray) -> np.ndarray:
    """The ``SHINGLE`` bytes from each position on, as one 64-bit value."""
    n = len(data) - SHINGLE + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(SHINGLE):
        out = (out << np.uint64(8)) | data[i: i + len(out)]
    return out


def signatures(lines: pa.Array) -> np.ndarray:
    """``BANDS`` 64-bit band values per line of ``SHINGLE`` bytes or more; other rows are zero."""
    raw, offsets = as_bytes(lines)
    out = np.zeros((len(lines), BANDS), np.uint64)
    for a, b in spans(offsets):
        at = offsets[a: b + 1] - offsets[a]
        rows = np.flatnonzero(np.diff(at) >= SHINGLE)
        if not len(rows):
            continue
        codes = (mix(_shingle_codes(LOWER[raw[offsets[a]: offsets[b]]])) >> np.uint64(32)).astype(np.uint32)
        # begin and end of each line's shingles; reduceat takes the stretches between, too, which are dropped
        cut = np.stack((at[rows], at[rows + 1] - SHINGLE + 1), 1).ravel()
        cut = cut[:-1] if cut[-1] >= len(codes) else cut
        bands = np.zeros((len(rows), BANDS), np.uint64)
        for i, (m, c) in enumerate(zip(_MUL, _ADD)):
            low = np.minimum.reduceat(codes * m + c, cut)[::2].astype(np.uint64)
            bands[:, i // ROWS] = mix(bands[:, i // ROWS] + low * _B8 + np.uint64(i))
        out[a + rows] = bands
    return out


def _cut(lines: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingles of each line; the codes of all lines are made at once."""
    raw, offsets = as_bytes(pa.array(lines, pa.large_string()))
    codes, out = _shingle_codes(LOWER[raw]), []
    for a, b in zip(offsets[:-1].tolist(), (offsets[1:] - SHINGLE + 1).tolist()):
        s = np.sort(codes[a: max(a, b)])
        new = s[1:] != s[:-1]
        out.append(s if new.all() else np.append(s[:1], s[1:][new]))
    return out


class _Shingles:
    """Shingle sets by line; lines that come in many pairs are cut once, within bounded memory."""

    KEPT = 1 << 22      # shingles

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}
        self.size = 0

    def __call__(self, lines: list[str]) -> list[np.ndarray]:
        got = {x: self.held.get(x) for x in lines}
        new = [x for x, s in got.items() if s is None]
        got.update(zip(new, _cut(new)))
        size = sum(len(got[x]) for x in new)
        if self.size + size > self.KEPT:
            self.held, self.size = {}, 0
        if size <= self.KEPT:
            self.held.update((x, got[x]) for x in new)
            self.size += size
        return [got[x] for x in lines]


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    # the smaller set looks itself up in the larger one
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(small):
        return 0.0
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return both / (len(x) + len(y) - both)


def _near(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether the sets are that similar; sizes too far apart settle it."""
    small, large = sorted((len(x), len(y)))
    return large > 0 and small / large >= similarity and _jaccard(x, y) >= similarity


def _joined(sets: list[np.ndarray], part: np.ndarray, side: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that join the parts of lines which any near-equal pair of different parts and sides joins (side 0 goes with 0)."""
    sizes = np.array([len(s) for s in sets])
    shingle, at = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(sizes) - sizes
    ends, held, part, found = np.append(0, np.cumsum(sizes)), np.zeros(len(shingle), bool), part.copy(), []
    for i in np.flatnonzero((side < 2) & (sizes > 0)).tolist():
        other = (part != part[i]) & ((side[i] == 0) | (side != side[i]))
        other &= (np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i]))
        rows = np.flatnonzero(other)
        if not len(rows):
            continue
        mine = at[begin[i]: begin[i] + sizes[i]]
        held[mine] = True
        # shared shingles of each such line: one pass over all lines where most are wanted, else line by line
        if 4 * len(rows) >= len(sizes):
            total = np.append(0, np.cumsum(held[at], dtype=np.int64))[ends]
            both = (total[1:] - total[:-1])[rows]
        else:
            both = np.array([np.count_nonzero(held[at[begin[j]: begin[j] + sizes[j]]]) for j in rows.tolist()])
        for j in rows[both / (sizes[i] + sizes[rows] - both) >= similarity].tolist():
            if part[j] != part[i]:
                found.append((i, j))
                part[part == part[j]] = part[i]
        held[mine] = False
    return found


def _rest(met: DataFrame, label: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links between lines that share a band, are neither its smallest nor its largest key, and lie in different components.

    The lines of a full band are dealt into blocks; every two blocks, and every block with itself, are a
    group of bounded size. Of each group come the links that join its components, fewer than its lines.
    """
    rows = met.where("key <> low and key <> high").select("key", "place").join(
        label.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    rows = rows.join(texts.select("key", F.octet_length("line").cast("long").alias("bytes")), "key")
    full = rows.groupBy("place").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.greatest(
        F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).alias("blocks")).where("c1 < c2")
    rows = rows.join(full.select("place", "blocks"), "place").withColumn("own", F.pmod(F.xxhash64("key"), "blocks"))
    rows = rows.select("place", "key", "component", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    rows = rows.select(
        F.xxhash64("place", F.least("own", "other"), F.greatest("own", "other")).alias("place"), "key", "component",
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"))
    rows = rows.join(texts, "key").repartition("place").sortWithinPartitions("place", "key")

    def join(batches):
        sets, held = _Shingles(), None
        for batch in batches:
            table = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            place = table["place"].to_numpy()
            whole = int(np.searchsorted(place, place[-1])) if len(place) else 0
            held = table.slice(whole)
            yield links(table.slice(0, whole), sets)
        if held is not None:
            yield links(held, sets)

    def links(table, sets):
        place, key, part, side = (table[c].to_numpy() for c in ("place", "key", "component", "side"))
        ends = np.append(np.flatnonzero(place[1:] != place[:-1]) + 1, len(place))
        a, b, begin = [], [], 0
        for end in ends.tolist() if len(place) else []:
            if end - begin > 1 and (part[begin: end] != part[begin]).any():
                lines = sets(table["line"].slice(begin, end - begin).to_pylist())
                for i, j in _joined(lines, part[begin: end], side[begin: end], similarity):
                    a.append(key[begin + i])
                    b.append(key[begin + j])
            begin = end
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(join, "a long, b long")


def _lines(rows: DataFrame, least: int) -> DataFrame:
    return rows.where("doc_id is not null").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(
        (F.octet_length("line") >= least) & F.col("line").rlike("\\S"))


#: Lines are known by a 64-bit hash of their folded text: at 10^12 lines, a line meets another's by chance once in 10^7.
def _keyed(lines: DataFrame) -> DataFrame:
    """Lines with their key. Folding only A-Z is a slow look-up by character, so letters beyond ASCII are read byte by byte, as Latin-1.

    Lower-casing moves the bytes C0-DE, too, by 32: the first bytes of two-byte characters onto those of longer ones. How many bytes above
    7F follow still tells them apart, so lines fold alike exactly if only the case of A-Z differs.
    """
    return lines.withColumn("key", F.xxhash64(F.lower(F.decode(F.col("line").cast("binary"), "ISO-8859-1"))))


def line_classes(docs: DataFrame, similarity: float = SIMILARITY, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(occurrences, classes): ``(doc_id, pos, key)`` of every line of ``least`` bytes or more that is not
    blank, and for each key ``(key, component, keep_doc, keep_pos, n)`` of the lines that repeat.

    Equal lines (A-Z folded) come together by their key first, so a line that fills a third
    of the table is one row from there on. Lines under ``SHINGLE`` bytes go no further. Distinct lines that share a band are compared with
    the smallest and the largest key of the band, exactly, by their shingle sets; verified
    pairs are joined to components. Then the other lines of the band are compared with each
    other as far as they lie in different components.
    """
    rows = text_rows(docs)

    def sign(batches):
        # one row of a key carries the values; zero, which other rows have, counts as none
        seen: set[int] = set()
        for batch in batches:
            key, at = np.unique(batch["key"].to_numpy(), return_index=True)
            at = np.sort(at[[k not in seen for k in key.tolist()]])
            if len(seen) > REMEMBERED:
                seen.clear()
            seen.update(key.tolist())
            bands = np.zeros((batch.num_rows, BANDS), np.int64)
            if len(at):
                bands[at] = signatures(batch["line"].take(pa.array(at))).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["pos"], batch["key"], *(pa.array(bands[:, i], mask=bands[:, i] == 0) for i in range(BANDS))],
                names=["doc_id", "pos", "key", *(f"b{i}" for i in range(BANDS))])

    signed = staged(_keyed(_lines(rows, least)).mapInArrow(
        sign, "doc_id long, pos int, key long, " + ", ".join(f"b{i} long" for i in range(BANDS))), "lines")
    distinct = signed.groupBy("key").agg(*(F.min(f"b{i}").alias(f"b{i}") for i in range(BANDS)))
    # the band's number is part of its value, so the value alone names the meeting place
    banded = distinct.select("key", F.explode(F.array(*(f"b{i}" for i in range(BANDS)))).alias("place")).where("place is not null")
    ends = banded.groupBy("place").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high")
    met = staged(banded.join(ends, "place"), "line-met")
    pairs = (met.select(F.col("key").alias("a"), F.explode(F.array("low", "high")).alias("b"))
             .where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    texts = staged(only(_keyed(_lines(rows, least)), met.select("key").distinct(), "key").groupBy("key").agg(
        F.min("line").alias("line")), "line-texts")

    def verify(batches):
        sets = _Shingles()
        for batch in batches:
            ends = np.cumsum(pc.add(pc.binary_length(batch["line_a"]), pc.binary_length(batch["line_b"])).to_numpy(), dtype=np.int64)
            for x, y in spans(np.concatenate(([0], ends))):
                part = batch.slice(x, y - x)
                cut = sets(part["line_a"].to_pylist() + part["line_b"].to_pylist())
                near = [_near(u, v, similarity) for u, v in zip(cut[: y - x], cut[y - x:])]
                yield part.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    a, b = (texts.select(F.col("key").alias(c), F.col("line").alias(f"line_{c}")) for c in "ab")
    label = components(pairs.join(a, "a").join(b, "b").select("a", "b", "line_a", "line_b").mapInArrow(
        verify, "a long, b long"))
    rest = staged(_rest(met, label, texts, similarity), "line-rest")
    linked = components(rest.unionByName(label.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    first = signed.groupBy("key").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n"))
    named = first.join(linked, first["key"] == linked["node"], "left").select(
        "key", F.coalesce("component", "key").alias("component"), "first", "n", F.col("node").isNotNull().alias("linked"))
    fuzzy = named.where("linked")
    kept = fuzzy.groupBy("component").agg(F.min("first").alias("keep"), F.sum("n").alias("n"))
    classes = fuzzy.select("key", "component").join(kept, "component").select("key", "component", "keep", "n").unionByName(
        named.where("not linked and n > 1").select("key", "component", F.col("first").alias("keep"), "n"))
    return signed.select("doc_id", "pos", "key"), classes.select(
        "key", "component", F.col("keep.doc_id").alias("keep_doc"), F.col("keep.pos").alias("keep_pos"), "n")


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, counts: bool | tuple[str, str] = False, least: int = LEAST) -> DataFrame:
    """Documents whose repeated lines are gone: of each component of near-equal lines the first stays.

    Two lines are near-equal when the Jaccard similarity of their 8-byte shingles (A-Z folded) is
    ``similarity`` or more, lines under 8 bytes only if they are equal; first means smallest doc_id, then
    earliest line. Blank lines, and those under ``least`` bytes, stay as they are.
    ``text`` is rewritten, ``n_chars`` too if there is one, other columns stay, whatever their names;
    with ``counts``, ``n_lines`` and ``n_removed`` (or the two names given) follow, in place of columns called so. Null or
    empty texts and rows without doc_id stay unchanged; rows that share a doc_id keep or lose their lines by
    position together, so a repeated row stays a repeated row; ties and an empty table need no special case.
    """
    occurrences, classes = line_classes(docs, similarity, least)
    gone_name, doc_name = fresh(docs, "gone"), fresh(docs, "gone_doc")
    gone = occurrences.join(classes, "key").where("doc_id <> keep_doc or pos <> keep_pos").groupBy("doc_id").agg(
        F.collect_set("pos").alias(gone_name)).withColumnRenamed("doc_id", doc_name)
    met = docs.join(gone, docs["doc_id"].cast("long") == gone[doc_name], "left")
    lines = F.split(docs["text"], "\n")
    text = F.when(F.col(gone_name).isNull(), docs["text"]).otherwise(F.array_join(
        F.filter(lines, lambda x, i: ~F.array_contains(gone_name, i)), "\n"))
    columns = {"text": text}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.char_length(text).cast(docs.schema["n_chars"].dataType)
    named = () if not counts else ("n_lines", "n_removed") if counts is True else counts
    out = [columns[c].alias(c) if c in columns else docs[c] for c in docs.columns if c not in named]
    if named:
        out += [F.coalesce(F.size(lines), F.lit(0)).alias(named[0]),
                F.when(docs["text"].isNull(), 0).otherwise(F.coalesce(F.size(gone_name), F.lit(0))).alias(named[1])]
    return met.select(*out)
