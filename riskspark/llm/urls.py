"""URL filter: fixed host rules first, then association rules mined from labels by FP-growth."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, functions as F

from riskspark.llm.common import staged

#: (verdict, rule): a host and its subdomains, and how the path begins.
HOST_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
              ("block", "com/de/"))
SUPPORT = 0.002      # least share of labelled pages that hold a combination,
LEAST = 20           # and least number
CONFIDENCE = 0.8     # least share of bad pages among them
BAD = "label:bad"


def _parts(url):
    """(host, path) of a url column; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)"))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: str = "url"):
    """Distinct tokens of a url: words of its host and path, names of query fields; numbers by length."""
    host, path = _parts(url)
    query = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "\\?([^#]*)", 1)
    number = lambda x: F.when(x.rlike("^[0-9]+$"), F.concat(F.lit("digits"), F.length(x).cast("string"))).otherwise(x)
    named = lambda what, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(what), number(x)))
    return F.array_distinct(F.concat(
        named("host:", F.split(host, "[^a-z0-9]+")),
        named("path:", F.split(F.lower(path), "[^a-z0-9]+")),
        named("field:", F.transform(F.split(F.lower(query), "&"), lambda x: F.substring_index(x, "=", 1)))))


def mined_rules(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``rule_id, items, key, confidence``: token combinations that labelled bad pages have nearly to themselves.

    A page is bad if ``labels`` (by doc_id = page_id) calls it toxic or of no quality. Combinations come from
    FP-growth, those below ``support`` or ``confidence`` go, and so does a rule of which a part is as sure.
    ``key`` is the rule's rarest token.
    """
    marks = labels.select(labels["doc_id"].cast("long").alias("page_id"), ((labels["quality"] == 0) | (labels["toxic"] == 1)).alias("bad"))
    marks = marks.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    seen = pages.select(pages["page_id"].cast("long").alias("page_id"), tokens().alias("t"))
    baskets = staged(seen.where(F.size("t") > 0).join(marks, "page_id").select(
        F.when(F.col("bad"), F.concat("t", F.array(F.lit(BAD)))).otherwise(F.col("t")).alias("items")), "baskets")
    empty = "rule_id long, items array<string>, key string, confidence double"
    spark = pages.sparkSession
    if not baskets.where(F.array_contains("items", BAD)).take(1):
        return spark.createDataFrame([], empty)
    support = min(1.0, max(support, LEAST / baskets.count()))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD)))
    rules = staged(rules.select(F.xxhash64(F.sort_array("antecedent")).alias("rule_id"),
                                F.sort_array("antecedent").alias("items"), "confidence"), "rules")
    # a rule is implied if a proper part of it is a rule that is as sure; both hold any token of the part
    part = rules.select(F.explode("items").alias("item"), F.col("items").alias("part"), F.col("confidence").alias("sure"))
    implied = rules.select("rule_id", F.explode("items").alias("item"), F.col("items").alias("full"), "confidence").join(
        part, "item").where((F.size("part") < F.size("full")) & (F.col("sure") >= F.col("confidence"))
                            & (F.size(F.array_except("part", "full")) == 0)).select("rule_id").distinct()
    own = rules.join(implied, "rule_id", "left_anti")
    often = baskets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    rarest = own.select("rule_id", F.explode("items").alias("item")).join(often, "item").groupBy("rule_id").agg(
        F.min(F.struct("n", "item")).alias("x")).select("rule_id", F.col("x.item").alias("key"))
    return own.join(rarest, "rule_id").select("rule_id", "items", "key", "confidence")


def judged_urls(pages: DataFrame, labels: DataFrame, host_rules=HOST_RULES, support: float = SUPPORT,
                confidence: float = CONFIDENCE) -> DataFrame:
    """``page_id, host, path, rule, verdict, n_rules`` of every row.

    The longest host rule that fits decides; else a url is blocked that holds all tokens of a mined
    rule (``n_rules`` of them), and allowed otherwise. A null url, or one without ``://``, has an empty host
    and path and no tokens from them. Null page_ids are passed on; repeated rows are each judged;
    an empty table gives no rows; without labels nothing is mined.

    Verdicts are found once per distinct url. A rule is looked up under its rarest token only, so common
    tokens such as ``com`` bring no url and rule together.
    """
    spark = pages.sparkSession
    host, path = _parts("url")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"))
    distinct = rows.select("url").distinct().withColumns({"host": host, "path": path})
    fixed = spark.createDataFrame([(r, r.partition("/")[0], "/" + r.partition("/")[2], v) for v, r in host_rules],
                                  "rule string, rule_host string, rule_path string, rule_verdict string")
    # a host's suffixes at label borders: the rules that may fit
    labels_of = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels_of)), lambda i: F.concat_ws(
        ".", F.slice(labels_of, i, F.size(labels_of))))
    fits = distinct.where("host <> ''").select("url", "path", F.explode(suffixes).alias("rule_host")).join(
        fixed, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    by_rule = fits.groupBy("url").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "rule_verdict")).alias("r")).select(
        F.col("url").alias("u1"), F.col("r.rule").alias("rule"), F.col("r.rule_verdict").alias("rule_verdict"))
    mined = mined_rules(pages, labels, support, confidence)
    held = distinct.where("url is not null").select("url", tokens().alias("t"))
    matched = held.select("url", "t", F.explode("t").alias("key")).join(mined, "key").where(
        F.size(F.array_except("items", "t")) == 0).groupBy(F.col("url").alias("u2")).agg(F.count("*").alias("n_rules"))
    verdicts = distinct.join(by_rule, distinct["url"] == by_rule["u1"], "left").join(
        matched, distinct["url"] == matched["u2"], "left").select(
        F.col("url").alias("u"), "host", "path", "rule", F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"),
        F.coalesce("rule_verdict", F.when(F.col("n_rules") > 0, "block").otherwise("allow")).alias("verdict"))
    return rows.join(verdicts, rows["url"].eqNullSafe(verdicts["u"])).select(
        "page_id", "host", "path", "rule", "verdict", "n_rules")
