"""Near-duplicate operators against brute force over all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from riskspark.llm import jaccard as J, linededup as L
from riskspark.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def fold(t):
    return t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", fold(t or ""))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def united(nodes, linked):
    name = {d: d for d in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(name[a], name[b])
            if name[a] != low or name[b] != low:
                name[a] = name[b] = low
                changed = True
    return name


def corpus(seed=5, base=12, copies=14):
    rng = random.Random(seed)
    words = [f"w{i}é" for i in range(400)]
    out = []
    for _ in range(base):
        text = [rng.choice(words) for _ in range(rng.choice([3, 4, 5, 6, 9, 20, 60, 200]))]
        out.append(" ".join(text))
        for _ in range(rng.randrange(copies)):
            changed = list(text)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                changed[rng.randrange(len(changed))] = rng.choice(words)
            cut = rng.choice([0, 0, 1, 3])
            out.append(("\t" if rng.random() < .2 else " ").join(changed[: len(changed) - cut] or changed).upper())
    out += [None, "", "   ", "a", "A", "one two three four five", "ONE two three four  five", "x" * 70_000 + " y z"]
    rng.shuffle(out)
    return list(enumerate(out, 10))


def test_jaccard_components_equal_all_pairs(spark):
    docs = corpus()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_components(
        spark.createDataFrame([(d, t, "en", None, None) for d, t in docs], DOCS)).collect()}
    sets = {d: shingles(t) for d, t in docs}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
              and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(linked) > 20
    name = united(sets, linked)
    assert got == {d: (len(sets[d]), name[d]) for d in sets}


@pytest.mark.parametrize("size", [4, 5, 9, 30, 121, 500])
def test_sets_at_the_threshold_always_share_a_range(size):
    rng = np.random.default_rng(size)
    for _ in range(60):
        common = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        spare = size // 4
        a = np.unique(np.concatenate((common, rng.integers(0, 1 << 63, rng.integers(0, spare + 1), dtype=np.uint64))))
        left = spare - (len(a) - size)
        b = np.unique(np.concatenate((common, rng.integers(0, 1 << 63, left, dtype=np.uint64))))
        assert 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
        doc, key = J.range_keys(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
        assert set(key[doc == 0].tolist()) & set(key[doc == 1].tolist())


def test_rtree_keeps_every_pair_the_bound_allows():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 6, (40, J.GROUPS))
    points = np.concatenate((base, np.maximum(0, base + rng.integers(-1, 2, base.shape)))).astype(np.uint8)
    sizes = points.sum(1).astype(np.int64)
    all_rows = np.arange(len(points))
    got = set(zip(*(x.tolist() for x in J.rtree_pairs(points, sizes, all_rows, all_rows))))
    over = np.minimum(points[:, None], points[None]).sum(2, dtype=np.int64)
    i, j = np.nonzero(100 * over >= 80 * (sizes[:, None] + sizes[None] - over))
    assert got == set(zip(i.tolist(), j.tolist())) and len(got) < 80 * 80
    # rows of several groups at once, small and large, in parts
    group = np.repeat([1, 2, 3], [10, 50, 20])
    part = rng.integers(0, 5, 80)
    i, j = J.group_pairs(group, points, sizes, part, np.zeros(80, np.int64))
    want = {(a, b) for a, b in got if a < b and group[a] == group[b] and part[a] != part[b]}
    assert {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())} == want


def test_staged_texts_come_in_small_batches(spark):
    """A write may bound the bytes of its Arrow batches; the session's own limit stays."""
    from riskspark.llm.common import staged
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["bytes"])

    docs = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat(cast(id as string), 500) AS text")
    most = [staged(docs.mapInArrow(sizes, "bytes long"), "sizes", b).agg({"bytes": "max"}).first()[0] for b in (None, 1 << 18)]
    assert most[0] > 2_000_000 and most[1] < 400_000 and spark.conf.get(name) == before


def test_jaccard_edges(spark):
    empty = J.jaccard_components(spark.createDataFrame([], DOCS))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_shingles", "component_id"]
    rows = [(None, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (2, "", None, None, 0)]
    got = sorted((tuple(r) for r in J.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == sorted([(None, 2, None), (1, 2, 1), (1, 2, 1), (2, 0, 2)], key=str)


def test_one_per_component_keeps_columns(spark):
    rows = [(3, "a b c d e f g", "en", "s", 13), (5, "A b c d e f g", "en", "t", 13), (7, None, "de", "s", None)]
    kept = J.one_per_component(spark.createDataFrame(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 7]


def char_sets(line):
    b = fold(line).encode()
    return {b[i:i + L.SHINGLE] for i in range(len(b) - L.SHINGLE + 1)}


def test_line_dedup_equals_all_pairs(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnop é") for _ in range(7)) for _ in range(60)]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 30))) for _ in range(40)]
    for line in lines[:25]:
        at = rng.randrange(len(line) - 1)
        lines.append(line[:at] + rng.choice("xyz") + line[at + 1:])
        lines.append(line.upper() if rng.random() < .5 else line)
    rng.shuffle(lines)
    docs = [(i, "\n".join(lines[i * 3: i * 3 + 3] + ["short", ""]), "en", "s", 0) for i in range(len(lines) // 3)]
    docs += [(900, None, "en", "s", None), (901, "", "en", "s", 0)]
    at = [(d, p, x) for d, t, *_ in docs if t for p, x in enumerate(t.split("\n")) if len(x.encode()) >= L.LEAST]
    sets = [char_sets(x) for _, _, x in at]
    linked = [(i, j) for i in range(len(at)) for j in range(i) if len(sets[i] & sets[j]) >= L.SIMILARITY * len(sets[i] | sets[j])]
    name = united(range(len(at)), linked)
    order = sorted(range(len(at)), key=lambda i: at[i][:2])
    keep = {}
    for i in order:
        keep.setdefault(name[i], i)
    gone = {at[i][:2] for i in order if keep[name[i]] != i}
    assert len(gone) > 20
    got = {r["doc_id"]: r for r in L.dedup_lines(spark.createDataFrame(docs, DOCS), counts=True).collect()}
    for d, t, *_ in docs:
        want = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (d, p) not in gone)
        assert got[d]["text"] == want
        assert got[d]["n_chars"] == (None if want is None else len(want))
        assert got[d]["n_removed"] == sum(x == d for x, _ in gone)


@pytest.mark.parametrize("block", [1024, 30])
def test_families_of_lines_that_share_bands(spark, monkeypatch, block):
    """Near-equal lines link though the ends of every band they share belong to other families."""
    monkeypatch.setattr(L, "BLOCK", block)
    rng = random.Random(3)

    def text(n):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))

    common = text(160)
    lines = []
    for _ in range(150):
        own = text(36)
        lines += [common + own, common + own[:-10] + text(10)]
    sets = [char_sets(x) for x in lines]
    linked = [(i, j) for i in range(len(lines)) for j in range(i) if len(sets[i] & sets[j]) >= L.SIMILARITY * len(sets[i] | sets[j])]
    assert linked == [(i + 1, i) for i in range(0, 300, 2)]
    docs = spark.createDataFrame([(i, x, "en", "s", 0) for i, x in enumerate(lines)], DOCS)
    gone = {r["doc_id"] for r in L.dedup_lines(docs, counts=True).collect() if r["n_removed"]}
    assert gone == set(range(1, 300, 2))


def test_line_dedup_edges(spark):
    assert L.dedup_lines(spark.createDataFrame([], DOCS)).collect() == []
    line = "the same long line that comes again and again"
    rows = [(None, line, "en", "s", 1), (4, line, "en", "s", 1), (4, line, "en", "s", 1), (5, "x\n" + line, "en", "s", 1)]
    got = sorted(((r["doc_id"], r["text"]) for r in L.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == sorted([(None, line), (4, line), (4, line), (5, "x")], key=str)


def test_lines_fold_only_ascii_and_are_cut_together(spark):
    """Keys agree exactly where A-Z folded lines do, whatever the bytes; the sets of many lines are made at once."""
    import re
    chars = [chr(c) for c in [*range(0x20, 0x180), 0x3a3, 0x3c2, 0x3c3, 0x410, 0x430, 0x3000, 0x3040, 0xd7ff, 0xe000, 0xffff, 0x10000, 0x1f600, 0x10ffff]]
    lines = [x + y for x in chars[::7] for y in ("", "A", "a", "É", "é", "\u3000")] + chars
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    keys = {r["i"]: r["key"] for r in L._keyed(frame).collect()}
    folded = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in lines]
    assert len(set(keys.values())) == len(set(folded)) == len(set(zip(folded, (keys[i] for i in range(len(lines))))))
    texts = ["one two THREE four", "", "short", "ÄÖÜ and some more ÄÖÜ and some more", "one two three four"]
    together = L._Shingles()(texts)
    for x, got in zip(texts, together):
        b = re.sub(rb"[A-Z]", lambda m: m[0].lower(), x.encode())
        assert got.tolist() == sorted({int.from_bytes(b[i: i + 8], "big") for i in range(len(b) - 7)})


def test_short_lines_are_deduplicated(spark):
    rows = [(1, "ok\n\nAll rights reserved.\n \nno"), (2, "OK\n\nall rights reserved.\n \nyes"), (3, "ok\nAll rights reserved\n\r\n\r\né")]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], DOCS)
    got = {r["doc_id"]: r["text"] for r in L.dedup_lines(docs).collect()}
    assert got == {1: rows[0][1], 2: "\n \nyes", 3: "\r\n\r\né"}     # blank lines stay
    assert {r["doc_id"]: r["text"] for r in L.dedup_lines(docs, least=30).collect()} == dict(rows)


def test_components_of_chains_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == united(sorted({x for link in links for x in link}), links)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
