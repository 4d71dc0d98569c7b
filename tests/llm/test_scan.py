"""Decontamination, packing and HTML extraction against plain versions."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark import cloudpickle
from tokenizers import Tokenizer

from riskspark.llm import decontam as D, html as H, packing as P

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))


def plain(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k:k + n])].add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if got := windows.get(tuple(w[k:k + n])):
                    hit |= set(range(k, k + n))
                    found |= got
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


ITEMS = [(1, "Alpha beta, gamma! delta epsilon zeta eta theta iota kappa lambda mu"), (2, "short one"), (10, "été déjà-vu 42"),
         (3, ""), (4, None), (11, "short one"), (5, "beta gamma delta epsilon zeta eta theta iota kappa lambda")]
TEXTS = [(1, "xx ALPHA beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"), (2, "a short\none b short-one"), (3, None), (4, ""),
         (5, "ÉTÉ été DÉJÀ déjà vu 42 42"), (6, "alpha beta gamma delta epsilon zeta eta theta iota"), (7, "!!!"), (8, "short on e"),
         (9, "w " * 3000 + "short one" + " w" * 3000)]


@pytest.mark.parametrize("part_bytes", [D.PART_BYTES, 80])
def test_contamination_equals_plain_scan(spark, part_bytes):
    docs = spark.createDataFrame([(d, t, "en", None, 0) for d, t in TEXTS], DOCS)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = D.contamination(docs, items, part_bytes=part_bytes).drop("hit_starts", "hit_ends").collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == plain(TEXTS, ITEMS) and len(rows) == len(TEXTS)
    clean = D.without_contaminated(docs, items, part_bytes=part_bytes)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(d for d, v in plain(TEXTS, ITEMS).items() if not v[-1])
    assert clean.columns == docs.columns


def test_contamination_edges(spark):
    docs = spark.createDataFrame([(1, "a b", "en", None, 0), (1, "a b", "en", None, 0), (None, "c", None, None, None)], DOCS)
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["contaminated"] for r in D.contamination(docs, none).collect()] == [False] * 3
    assert D.contamination(docs.limit(0), none).collect() == []
    assert D.without_contaminated(docs, none).count() == 3


def test_packing_round_trip(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["hello world " * n for n in (0, 1, 3, 40, 700, 1500)] + [None, "<|endoftext|> it's éà 中文\n\n  x", "b" * 5000, "tail 12 34"] * 4
    docs = list(enumerate(texts))
    rows = P.packed(spark.createDataFrame([(d, t, None, None, None) for d, t in docs], DOCS).repartition(3), most_open=4).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
    for d, t in docs:
        want = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        parts = sorted(pieces[d], key=lambda r: r["start"])
        assert [i for r in parts for i in r["ids"]] == want
        assert [r["start"] for r in parts] == np.cumsum([0, *(r["length"] for r in parts)])[:-1].tolist()
        assert all(r["doc_tokens"] == len(want) and r["length"] == len(r["ids"]) for r in parts)
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in parts)
    for parts in windows.values():
        parts.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in parts] == np.cumsum([0, *(r["length"] for r in parts)])[:-1].tolist()
        filled = sum(r["length"] for r in parts)
        assert filled == P.WINDOW or filled & (filled - 1) == 0 and filled < P.WINDOW


def test_packing_fast_path_has_the_same_ids():
    tokenizer, fast = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), P.ByteBpe()
    for text in ("", "  a\t\tb\r\n", "I'LL don't 're", "naïve Ünïcode ½ ²³ ٣٤", "x<|endoftext|>y<|endoftext|>", "\u00a0\u2003 z \x00\x7f"):
        assert fast(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_sum_of_squares_placement():
    packing = P.SumOfSquares(10)
    for doc, n in enumerate((6, 6, 4)):
        done = list(packing.add(doc, np.zeros(n, np.uint32)))
    # two windows at level 6: filling one leaves 1 squared, a third level adds to 4
    assert [[len(p[2]) for p in w] for w in done] == [[6, 4]] and packing.levels[6] == 1
    assert [sum(len(p[2]) for p in w) for w in packing.close()] == [4, 2]


def test_packing_empty(spark):
    assert P.packed(spark.createDataFrame([], DOCS)).collect() == []


PAGES = {
    '<html><head><title>t</title></head><body><div id="cookie-notice"><p>We use cookies, you know, all the time here.</p></div><header><h1>Site</h1></header>'
    '<div class="wrap"><div class="sidebar"><p>side text, with, commas and more, of it</p></div><main><h1>Title &amp; more</h1>'
    '<div class="content"><p>First para, with commas, and text.<p>Second&nbsp; para <b>bold <i>x</b> y</p><form><input><p>Enter</p></form>'
    '<ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table></div><div class="comments"><p>Great post, really, wow</p></div></main></div>'
    '<footer>foot</footer>': "Title & more\nFirst para, with commas, and text.\nSecond para bold x y\none\ntwo\nc1\nc2",
    '<body><nav><a href=x>a</a></nav><article><h1>H</h1><p>Body text<br>here.</p><script>var p="<p>no</p>";</script><!-- <p>no</p> --><div class="ad"><p>Buy, now, this</p></div></article>': "H\nBody text here.",
    "plain text only": "plain text only", "": "", None: "", "<p>just <3 a &amp; b": "just <3 a & b", "<script>x": "", "<div></div>": "",
    "<form id=aspnetForm><div><p>Hello there, this is the page.</p><p>More text, of it.</p><p>And a third one.</p></div></form>":
        "Hello there, this is the page.\nMore text, of it.\nAnd a third one.",
}


def test_main_text():
    for page, want in PAGES.items():
        assert H.main_text(page) == want


def test_broken_and_deep_html_is_read():
    assert H.main_text("<div>" * 3000 + "deep text" + "</div>" * 10) == "deep text"
    assert H.main_text('<p title="a>b>unclosed') is not None
    long = "<article>" + "".join(f"<p>para {i}, of text</p>" for i in range(3000)) + "</article>"
    assert H.main_text(long).count("\n") == 2999


def test_page_texts(spark):
    rows = [(1, "u", "<article><p>a b</p></article>", "x"), (None, None, None, None), (1, "u", "<article><p>a b</p></article>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in H.page_texts(pages).collect()), key=str)
    assert got == sorted([(1, "u", "a b", 3), (1, "u", "a b", 3), (None, None, "", 0)], key=str)
    assert H.page_texts(pages.limit(0)).collect() == []


def test_code_sent_to_workers_is_small():
    windows = D.Windows([("a", "one two three four five six seven eight nine ten eleven")], 10)
    sent = cloudpickle.dumps(windows)
    assert len(sent) < 100_000
    assert cloudpickle.loads(sent).by == windows.by
