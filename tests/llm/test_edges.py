"""Clashing names, broken markup, repeated and null ids."""

import time

import pytest
from pyspark.sql import functions as F

from riskspark.llm import decontam as D, html as H, linededup as L

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ARTICLE = "<p>" + "A long paragraph, with commas, that is the article of the page. " * 5 + "</p>"
TEXT = "A long paragraph, with commas, that is the article of the page. " * 5


@pytest.mark.parametrize("attribute", ['title="The hidden valley"', 'data-hidden="false"', 'data-id="menu"', "data-x='a > b hidden'", "title=hidden"])
@pytest.mark.parametrize("tag", ["p", "article"])
def test_words_inside_other_attributes_mark_nothing(tag, attribute):
    page = f"<nav><a href='/'>Home</a></nav><article>{ARTICLE}</article>".replace(f"<{tag}>", f"<{tag} {attribute}>", 1)
    assert H.main_text(page) == TEXT.strip()


def test_exact_attributes_still_mark():
    for attribute in ("hidden", "aria-hidden='true'", "HIDDEN=''", "role=navigation", 'style="display: none"', "class='sidebar' class=''"):
        assert "aside" not in H.main_text(f"<article>{ARTICLE}<div {attribute}><p>aside text</p></div></article>")


@pytest.mark.parametrize("piece", ["<![CDATA[ x ", '<a href="x ', "<a href='x>y ", "<!-- x ", "<p ", "< ", "<a title=\"q\" 'z>", "<b>x", "</i>"])
def test_broken_markup_is_read_in_one_go(piece):
    began = time.time()
    H.main_text(ARTICLE + piece * (1_000_000 // len(piece)))
    assert time.time() - began < 8


def test_tokens_keep_all_text():
    """Every character is text, markup, or between the ends of a comment."""
    page = "a < b <i>c</i> 1 <2 <!-- d --> e <? f > <![CDATA[ g ]]> h <x y='>' z> i & <"
    got, tokens, at = [], H._tokens(page), None
    while True:
        try:
            before, _, name, _, at = tokens.send(None if at is None else (at, at))
        except StopIteration:
            break
        got.append((before, name))
    assert got == [("a < b ", "i"), ("c", "i"), (" 1 <2 ", ""), (" e ", ""), (" ", ""), (" h ", "x"), (" i & <", "")]


def test_lines_with_clashing_columns(spark):
    rows = [(1, "same line here\nfirst", "en", "s", 20), (2, "same line here\nsecond", "en", "s", 20)]
    docs = spark.createDataFrame(rows, DOCS)
    for c in ("n_removed", "n_lines", "_gone", "_doc", "key", "gone", "gone_doc"):
        docs = docs.withColumn(c, F.lit("kept"))
    out = L.dedup_lines(docs).collect()
    assert {r["doc_id"]: r["text"] for r in out} == {1: "same line here\nfirst", 2: "second"} and {r["_gone"] for r in out} == {"kept"}
    counted = L.dedup_lines(docs, counts=True).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in counted} == {1: (2, 0), 2: (2, 1)}

    import corpus_pipeline
    staged = corpus_pipeline.line_stage(spark, docs, "")
    assert staged.columns == docs.columns and {r["n_removed"] for r in staged.collect()} == {"kept"}


@pytest.mark.parametrize("part_bytes", [D.PART_BYTES, 60])
def test_same_rows_stay_on_either_side_of_the_bound(spark, part_bytes):
    hit, clean = "one two three four five six seven eight nine ten", "nothing of the kind"
    docs = spark.createDataFrame([(7, hit), (7, clean), (None, hit), (None, clean), (8, None)], "doc_id long, text string").withColumn("_k1", F.lit("clash"))
    items = spark.createDataFrame([(1, hit), (2, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 2)], "item_id long, text string")
    kept = D.without_contaminated(docs, items, part_bytes=part_bytes)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(7, clean), (None, clean), (8, None)], key=str)
