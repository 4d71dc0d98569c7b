"""Resampling, the manifest and best-fit packing against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskspark.llm import bestfit as B, merkle as M, resample as R

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


# -- resampling -------------------------------------------------------------------
def features(text, longest):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    return len(w), [" ".join(w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def plain_draw(docs, items, percent, least, buckets, longest):
    at = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(at(f) for _, t in docs for f in features(t, longest)[1])
    g = Counter(at(f) for t in items for f in features(t, longest)[1])
    big_s, big_t = sum(s.values()), sum(g.values())
    gain = [math.floor(1000 * math.log((g[k] + 1) * (big_s + buckets) / ((s[k] + 1) * (big_t + buckets)))) for k in range(buckets)]
    rows = []
    for i, (d, t) in enumerate(docs):
        n, f = features(t, longest)
        weight = sum(gain[at(x)] for x in f)
        h = int(sha(f"2024:{d}")[:8], 16)
        score = None if d is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([d, len(f), weight, score, n, i])
    good = sorted((r for r in rows if r[4] >= least and r[3] is not None), key=lambda r: (-r[3], r[0], r[5]))
    rank = {r[5]: k for k, r in enumerate(good[:percent * len(good) // 100], 1)}
    return sorted(((*r[:4], rank.get(r[5])) for r in rows), key=str)


WORDS = ["alpha", "Beta", "été", "x1", "данные", "zz" * 90, "omega"]


@pytest.mark.parametrize("percent,longest", [(10, 1), (50, 2), (100, 3), (0, 1)])
def test_draw_equals_plain(spark, percent, longest):
    rng = np.random.default_rng(percent)
    docs = [(int(i), "".join(str(rng.choice(WORDS)) + str(rng.choice([" ", ", ", "-"])) for _ in range(rng.integers(0, 40)))) for i in rng.permutation(300)]
    docs += [(900, None), (901, ""), (902, "!?"), (None, "alpha " * 30), (None, None), (903, "long words " * 20_000)]
    items = ["alpha beta omega " * 20, "été été", None, "", "x1"]
    rows = R.resampled(spark.createDataFrame([(d, t, "en", "s", 1) for d, t in docs], DOCS).withColumn("weight", F.lit("clash")),
                       spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, score int"),
                       percent=percent, least_words=20, buckets=97, longest=longest)
    assert rows.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in rows.collect()), key=str) == plain_draw(docs, items, percent, 20, 97, longest)


def test_draw_with_ties_and_repeats(spark):
    """All rows of one id tie in everything but the order they are read in; exactly the wanted number is drawn."""
    docs = spark.createDataFrame([(7, "word " * 25, "en", "s", 1)] * 40 + [(8, "word " * 25, "en", "s", 1)] * 3, DOCS)
    got = R.resampled(docs, docs.limit(0), percent=50, buckets=10).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 22)) and len(got) == 43
    assert len({(r["doc_id"], r["score"]) for r in got}) == 2
    assert R.resampled(docs.limit(0), docs).collect() == []


def test_cutoff_counts(spark):
    rng = np.random.default_rng(1)
    rows = [(int(a), int(b), i) for i, (a, b) in enumerate(zip(rng.integers(-3, 3, 200) * 10 ** 12, rng.integers(0, 4, 200)))]
    df = spark.createDataFrame(rows, "a long, b long, c long")
    for k in (1, 7, 100, 199, 200):
        got = {r["c"] for r in df.where(R.cutoff(df, [-F.col("a"), F.col("b"), F.col("c")], k)).collect()}
        assert got == {r[2] for r in sorted(rows, key=lambda r: (-r[0], r[1], r[2]))[:k]}


# -- manifest ---------------------------------------------------------------------
def plain_tree(nodes):
    """(root, proofs): siblings of each node from the leaves up."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            a = p // 16 * 16
            proofs[i].append(("".join(nodes[a:p]), "".join(nodes[p + 1:a + 16])))
        nodes = [sha("".join(nodes[a:a + 16])) for a in range(0, len(nodes), 16)]
        at = [p // 16 for p in at]
    return nodes[0], proofs


def plain_manifest(docs):
    def leaf(d):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d[0], d[3], d[2], d[4], d[1])))

    by = defaultdict(list)
    for d in docs:
        by[d[3]].append(d)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees, rows = {}, []
    for s in names:
        by[s].sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))
        trees[s] = plain_tree([leaf(d) for d in by[s]])
    root, up = plain_tree([trees[s][0] for s in names])
    for s, above in zip(names, up):
        for d, own in zip(by[s], trees[s][1]):
            path = own + above
            t = d[1].translate(FOLD) if d[1] is not None and d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0 else d[1]
            here = leaf((d[0], t, *d[2:]))
            for left, right in path:
                here = sha(left + here + right)
            rows.append((d[0], leaf(d), trees[s][0], root, sha("".join(a + b for a, b in path)), here, here == root))
    return sorted(rows, key=str)


@pytest.mark.parametrize("n,sources,height", [(1, 1, 3), (3, 2, 3), (300, 1, 1), (300, 40, 1), (4500, 3, 3), (700, 20, 2)])
def test_manifest_equals_plain(spark, monkeypatch, n, sources, height):
    monkeypatch.setattr(M, "HEIGHT", height)
    # a third of the rows are of one source, one source is null
    docs = [(i if i % 97 else None, f"Text {i % 50} É" if i % 7 else (None, "")[i % 2], ("en", None)[i % 3 == 0],
             ("hot" if i % 3 == 0 else f"s{i % sources}" if i % sources else None), None if i % 5 == 0 else i) for i in range(n)]
    docs += docs[:2]        # repeated rows
    df = spark.createDataFrame(docs, DOCS).withColumn("leaf", F.lit("clash")).withColumn("name", F.lit(1)).repartition(5)
    got = M.manifest_rows(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_manifest(docs)


def test_manifest_of_nothing_and_long_text(spark):
    empty = spark.createDataFrame([], DOCS)
    assert M.manifest_rows(empty).collect() == []
    docs = [(5, "Aa " * 400_000, "en", "s", 1), (6, None, None, None, None)]
    assert sorted((tuple(r) for r in M.manifest_rows(spark.createDataFrame(docs, DOCS)).collect()), key=str) == plain_manifest(docs)


@given(st.integers(1, 5000))
@settings(max_examples=60, deadline=None)
def test_layout_places_every_node_once_and_splits_at_half_height(count):
    levels = M.levels_of(count, True)
    places = M.layout(count, levels)
    assert [len(a) for a in places] == [M._up(count, levels - 1 - d) for d in range(levels)]
    assert sorted(np.concatenate(places).tolist()) == list(range(sum(map(len, places))))
    if levels == 4:     # two levels above, the first subtree of the lower two right behind them
        size = len(places[0]) + len(places[1])
        assert set(np.concatenate(places[:2]).tolist()) == set(range(size))
        assert places[2][0] == size and places[3][0] == size + 1
        if count > 16:
            assert places[2][1] == size + 17


def test_block_reads_back_what_was_built():
    leaves = [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(700)]
    block = M.Block(M.build_block(b"".join(leaves), True), 700, True)
    root, proofs = plain_tree([x.hex() for x in leaves])
    assert block.root == root
    for i in (0, 15, 16, 255, 256, 699):
        assert block.path(i) == proofs[i] and M.fold(leaves[i].hex(), block.path(i)) == root


# -- packing ----------------------------------------------------------------------
def packed_sequences(sizes, size, **kw):
    packer = B.Packer(size, **kw)
    out = []
    for i, n in enumerate(sizes):
        out += packer.add(np.arange(n, dtype="<u4"), i)
    return out + list(packer.close())


@given(st.lists(st.integers(1, 70), max_size=120), st.sampled_from([1 << 22, 200]), st.sampled_from([1024, 3]))
@settings(max_examples=60, deadline=None)
def test_pieces_are_whole_and_fit(sizes, pool, most_open):
    size, seen = 32, defaultdict(list)
    for sequence in packed_sequences(sizes, size, pool=pool, most_open=most_open):
        assert 0 < sum(len(p[0]) for p in sequence) <= size
        for ids, k, start, doc in sequence:
            seen[doc].append((k, start, ids.tolist()))
    assert len(seen) == len(sizes)
    for doc, pieces in seen.items():
        pieces.sort()
        assert [x for _, _, ids in pieces for x in ids] == list(range(sizes[doc]))
        assert [k for k, *_ in pieces] == list(range(-(-sizes[doc] // size)))
        assert all(len(ids) == size for _, _, ids in pieces[1:])
        assert [s for _, s, _ in pieces] == [0, *np.cumsum([len(ids) for *_, ids in pieces])[:-1].tolist()]


@given(st.lists(st.lists(st.integers(1, 20), min_size=1, max_size=4).filter(lambda b: sum(b) <= 40), min_size=2, max_size=12))
@settings(max_examples=100, deadline=None)
def test_every_exchange_raises_squared_fill_and_none_is_left(bins):
    search, state = B.Exchange(bins, 40), [list(b) for b in bins]
    square = lambda s: sum(sum(b) ** 2 for b in s)
    for a, b, there, back in search.run():
        before = square(state)
        assert (len(there), len(back)) in {(1, 0), (1, 1), (2, 1), (1, 2)}
        for s in there:
            state[a].remove(s)
            state[b].append(s)
        for s in back:
            state[b].remove(s)
            state[a].append(s)
        assert square(state) > before and sum(state[b]) <= 40
    assert sorted(x for b in state for x in b) == sorted(x for b in bins for x in b)
    live = sorted((b for b in state if 0 < sum(b) < 40), key=sum)
    if len(live) > 1 and sum(40 - sum(b) for b in live[1:]) >= sum(live[0]):      # else no bin can be saved
        for a, b in product(live, live):
            if a is b:
                continue
            for d in [x - y for x in a for y in [0, *b]] + [a[i] + a[j] - y for i in range(len(a)) for j in range(i) for y in b] + [
                    x - b[i] - b[j] for x in a for i in range(len(b)) for j in range(i)]:
                assert not (0 < d <= 40 - sum(b) and sum(b) + d > sum(a))


def test_exchange_saves_bins():
    rng = np.random.default_rng(0)
    sizes = rng.integers(200, 700, 1500)
    fills: list[int] = []
    B.best_fit(sizes, 1024, fills)
    sequences = packed_sequences(sizes.tolist(), 1024)
    assert len(sequences) < len(fills)
    assert len(sequences) <= 1.01 * math.ceil(sizes.sum() / 1024)
    # nothing to win: one item a bin
    assert len(packed_sequences([600] * 50, 1024)) == 50


def test_best_fit_rows(spark):
    texts = ["", None, "one", "word " * 3000, "short text here", "<|endoftext|>", "word " * 1023, "é" * 40] + [f"text {i} " * (i % 90) for i in range(200)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 1), (None, "x", "en", "s", 1)], DOCS)
    rows = B.best_fit_packed(docs.withColumn("piece", F.lit("clash"))).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, filled = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        pieces[r["doc_id"]].append(r)
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        if i != 3:
            got = sorted(pieces[i], key=lambda r: r["piece"])
            assert [x for r in got for x in r["ids"]] == tok.encode(t or "", add_special_tokens=False).ids + [2]
            assert all(r["length"] == 1024 for r in got[1:])
    assert len(pieces[3]) == 2 * 3 and len(pieces[None]) == 1       # a repeated row is packed twice
    for spans in filled.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 1024
    assert B.best_fit_packed(docs.limit(0)).collect() == []
