"""The pipeline's stages, each checked on its own input."""

import corpus_pipeline as C
from oracle import folder

from riskspark.llm import decontam, jaccard, quality
from riskspark.llm.common import staged
from riskspark.sources.files import read_table


def test_stages(spark):
    at = folder("0.001")
    docs = read_table(spark, at, "documents")
    columns = docs.columns
    for n, (name, stage) in enumerate(C.STAGES):
        out = staged(stage(spark, docs, at), name)
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        if n < len(C.STAGES) - 1:
            assert out.columns == columns
        after = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert after <= set(before)
        if name == "quality":
            scored = quality.quality_scores(docs, read_table(spark, at, "labels"))
            assert after == {r["doc_id"] for r in scored.where("predicted = 1").collect()}
        elif name == "lines":
            texts = {r["doc_id"]: r["text"] for r in out.collect()}
            for d, t in texts.items():
                rest = iter(before[d].split("\n"))
                assert all(x in rest for x in t.split("\n"))   # lines left in their order
        elif name == "near_copies":
            named = jaccard.jaccard_components(docs).collect()
            assert after == {r["doc_id"] for r in named if r["doc_id"] == r["component_id"]}
        elif name == "benchmark":
            judged = decontam.contamination(docs, read_table(spark, at, "benchmark")).collect()
            assert after == {r["doc_id"] for r in judged if not r["contaminated"]}
        else:
            assert after == set(before)
        docs = out
    assert C.run(spark, at).count() == docs.count()


def test_pipeline_of_nothing(spark, tmp_path):
    at = folder("0.001")
    for name in ("documents", "labels", "benchmark"):
        read_table(spark, at, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert C.run(spark, str(tmp_path)).collect() == []


def test_line_stage_drops_only_documents_that_lost_their_lines(spark):
    rows = [(1, "one line", "en", "s", 8), (2, "one line", "en", "s", 8), (3, "", "en", "s", 0), (4, " \n", "en", "s", 2), (5, None, "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = C.line_stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3, 4, 5]
