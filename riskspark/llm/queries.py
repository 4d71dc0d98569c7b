"""The registered corpus queries: each applies one operator to its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskspark.llm import (ann, bestfit, chat, decontam, html, jaccard, linededup, merkle, packing, quality, resample,
                           toxicity, urls)
from riskspark.sources.files import read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


@query
def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(read_table(spark, folder, "documents"), with_ids=False)


@query
def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Each document with its lines that stay."""
    out = linededup.dedup_lines(read_table(spark, folder, "documents"), counts=True)
    return out.select("doc_id", "text", "n_lines", "n_removed")


@query
def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.contamination(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark")).drop(
        "hit_starts", "hit_ends")


@query
def op10_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(read_table(spark, folder, "documents"))


@query
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_scores(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


@query
def op6_html(spark: SparkSession, folder: str) -> DataFrame:
    return html.page_texts(read_table(spark, folder, "pages"))


@query
def op1_nearest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read_table(spark, folder, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


@query
def op5_chat(spark: SparkSession, folder: str) -> DataFrame:
    return chat.rendered(chat.maximal_conversations(read_table(spark, folder, "conversations")))


@query
def op2_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judged_urls(read_table(spark, folder, "pages"), read_table(spark, folder, "labels"))


@query
def op11_resample(spark: SparkSession, folder: str) -> DataFrame:
    return resample.resampled(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


@query
def op12_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest_rows(read_table(spark, folder, "documents"))


@query
def op13_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    return bestfit.best_fit_packed(read_table(spark, folder, "documents"), with_ids=False)


SQL["op5_chat"] = chat.SQL
SQL["op11_resample"] = resample.SQL
SQL["op12_manifest"] = merkle.SQL

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op9_decontamination"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, n, w[i:i + n - 1] AS g FROM (
  SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0))),
seen AS (SELECT doc_id, n, i, w[i:i + n - 1] AS g FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM seen JOIN windows USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (
  SELECT DISTINCT doc_id, item_id::varchar AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SQL["op10_jaccard"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (
  SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y USING (g)
  WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reached GROUP BY a) USING (doc_id)
"""
