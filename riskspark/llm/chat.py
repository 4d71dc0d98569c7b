"""Collapse of logged conversation snapshots, and chat formatting, in DataFrame operations only.

A conversation that is logged again after every turn is in the table many times, each a
prefix of the next. Every turn prefix gets a rolling hash; a conversation whose whole hash is
the hash of a proper prefix of another is dropped, and of equal ones the smallest id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from riskspark.llm.common import staged

#: Turns that one window task orders together; a longer conversation is taken in stretches.
STRETCH = 4096
START, END = "<|im_start|>", "<|im_end|>"


def _turns(conversations: DataFrame) -> DataFrame:
    c = conversations
    rows = c.select(c["conv_id"].cast("long").alias("conv_id"), c["turn"].cast("long").alias("turn"),
                    c["role"].cast("string").alias("role"), c["text"].cast("string").alias("text"))
    said = [F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    return rows.where("conv_id is not null").withColumns({
        "h1": F.xxhash64(*said), "h2": F.xxhash64(F.lit(1), *said),
        "stretch": F.floor(F.col("turn") / STRETCH)}).dropDuplicates(["conv_id", "turn", "h1", "h2"])


def _offsets(rows: DataFrame, *sums) -> DataFrame:
    """Per stretch: the aggregates over all earlier stretches of the conversation."""
    before = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    each = rows.groupBy("conv_id", "stretch").agg(*(f(c).alias(n) for n, f, c in sums))
    return each.select("conv_id", "stretch", *(F.coalesce((F.sum if f is F.count else f)(n).over(before), F.lit(0)).alias(n)
                                               for n, f, _ in sums))


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """``conv_id, position, role, text, e1, e2, p1, p2``: turns in order with the rolling hash of all up to each.

    The hash is the exclusive or of the turns' hashes with their positions, so it can be carried from
    stretch to stretch: no conversation has to fit into one task.
    """
    rows = _turns(conversations)
    here = Window.partitionBy("conv_id", "stretch").orderBy(*(F.asc_nulls_first(c) for c in ("turn", "role", "text")))
    ranked = rows.withColumn("local", F.row_number().over(here))
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in ("conv_id", "stretch")]
    at = _offsets(rows, ("earlier", F.count, "*"))
    placed = ranked.join(at, same(ranked, at)).select(
        ranked["conv_id"], ranked["stretch"], (ranked["local"] + at["earlier"]).alias("position"), "role", "text", "h1", "h2")
    placed = staged(placed.withColumns({"e1": F.xxhash64("position", "h1", "h2"), "e2": F.xxhash64(F.lit(1), "position", "h2", "h1")})
                    .drop("h1", "h2"), "turns")
    up_to = Window.partitionBy("conv_id", "stretch").orderBy("position")
    local = placed.withColumns({"x1": F.bit_xor("e1").over(up_to), "x2": F.bit_xor("e2").over(up_to)})
    past = _offsets(placed, ("y1", F.bit_xor, "e1"), ("y2", F.bit_xor, "e2"))
    return local.join(past, same(local, past)).select(
        local["conv_id"], "position", "role", "text", "e1", "e2",
        F.col("x1").bitwiseXOR(F.col("y1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("y2")).alias("p2"))


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """``conv_id, n_turns, position, role, text``: the turns of conversations that are no prefix of another.

    Turns go by number, those of one number by role and text, nulls first; repeated rows count once. Null
    roles and texts are values of their own. Rows without conv_id take no part. An empty table gives
    no rows.
    """
    turns = prefix_hashes(conversations)
    whole = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.bit_xor("e1").alias("p1"), F.bit_xor("e2").alias("p2"))
    different = whole.groupBy("n_turns", "p1", "p2").agg(F.min("conv_id").alias("conv_id"))
    last = whole.select("conv_id", "n_turns")
    # hashes of proper prefixes; a first turn that a third of all conversations share is one row after its aggregate
    proper = turns.join(last, "conv_id").where("position < n_turns").select(
        F.col("position").alias("n_turns"), "p1", "p2").distinct()
    kept = different.join(proper, ["n_turns", "p1", "p2"], "left_anti").select("conv_id", "n_turns")
    return turns.join(kept, "conv_id").select("conv_id", "n_turns", "position", "role", "text")


def rendered(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, position, rendered``: each turn in chat markup; null roles and texts are empty."""
    return turns.select("conv_id", "n_turns", "position", F.concat(
        F.lit(START), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(END + "\n")).alias("rendered"))


SQL = f"""
WITH turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS position
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL)),
whole AS (
  SELECT conv_id, count(*) AS n_turns, list(struct_pack(r := role, t := text) ORDER BY position) AS said
  FROM turns GROUP BY conv_id),
different AS (SELECT said, min(conv_id) AS conv_id, min(n_turns) AS n_turns FROM whole GROUP BY said),
proper AS (SELECT DISTINCT said[1:i] AS said FROM (SELECT said, unnest(range(1, n_turns)) AS i FROM whole)),
kept AS (SELECT conv_id, n_turns FROM different WHERE said NOT IN (SELECT said FROM proper))
SELECT conv_id, n_turns, position,
       '{START}' || coalesce(role, '') || chr(10) || coalesce(text, '') || '{END}' || chr(10) AS rendered
FROM turns JOIN kept USING (conv_id)
"""
