"""Merkle manifest of a table: 16-ary trees per source under one root, stored in van Emde Boas order.

Leaves are numbered within their source by range partitions. Aligned subtrees of ``16 ** HEIGHT`` leaves are
one stored row each, their nodes laid out by splitting the subtree at half its height again and again; the
roots of these blocks are the leaves of the next layer, until each source has one root, and the sources'
roots are built up the same way. Proofs come back down: every block receives the siblings above its root.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskspark.llm.common import staged
from riskspark.llm.resample import crc32_sql

FAN = 16
HEIGHT = 3          # levels a block climbs: up to 4,096 leaves, about 300 KB a stored row
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = 5


# -- layout -----------------------------------------------------------------------
def _up(count: int, levels: int) -> int:
    """Nodes ``levels`` above ``count`` left-packed nodes."""
    return -(-count // FAN ** levels)


@lru_cache(64)
def layout(count: int, levels: int) -> tuple[np.ndarray, ...]:
    """Address of each node of a left-packed tree with ``count`` leaves, one array per depth (root first).

    The tree is split at half its height: the upper part lies first, then the lower subtrees from
    left to right, each laid out in the same way. All but the last subtree are full, so a subtree's
    address is a product and a sum, and nodes that do not exist take no place.
    """
    if levels == 1:
        return (np.zeros(1, np.int64),)
    top = levels // 2
    low = levels - top
    roots = _up(count, low - 1)         # of the lower subtrees
    upper = layout(_up(roots, 1), top)
    size = sum(len(a) for a in upper)
    whole = FAN ** (low - 1)
    full = layout(whole, low)
    step = sum(len(a) for a in full)
    last = layout(count - (roots - 1) * whole, low)
    base = size + step * np.arange(roots, dtype=np.int64)
    return (*upper, *(np.concatenate(((base[:-1, None] + f[None, :]).ravel(), base[-1] + p)) for f, p in zip(full, last)))


def levels_of(count: int, alone: bool) -> int:
    """Levels of a block: a tree of its own ends where one node remains, a part of a larger one is climbed whole."""
    if not alone:
        return HEIGHT + 1
    n = 1
    while count > 1:
        count, n = _up(count, 1), n + 1
    return n


def _digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def build_block(leaves: bytes, alone: bool) -> bytes:
    """All nodes above and with ``leaves`` (32 bytes each) in layout order."""
    count = len(leaves) // 32
    levels = levels_of(count, alone)
    places = layout(count, levels)
    nodes = np.zeros((sum(len(a) for a in places), 32), np.uint8)
    level = leaves
    for depth in range(levels - 1, -1, -1):
        nodes[places[depth]] = np.frombuffer(level, np.uint8).reshape(-1, 32)
        text = level.hex()
        level = b"".join(sha256(text[i: i + 64 * FAN].encode()).digest() for i in range(0, len(text), 64 * FAN)) if depth else b""
    return nodes.tobytes()


class Block:
    """Reads runs of siblings out of a stored block."""

    def __init__(self, nodes: bytes, count: int, alone: bool):
        self.count, self.levels = count, levels_of(count, alone)
        stored = np.frombuffer(nodes, np.uint8).reshape(-1, 32)
        self.text = [stored[a].tobytes().hex() for a in layout(count, self.levels)]     # by depth

    @property
    def root(self) -> str:
        return self.text[0]

    def node(self, depth: int, i: int) -> str:
        return self.text[depth][64 * i: 64 * i + 64]

    def sides(self, depth: int, i: int) -> tuple[str, str]:
        """The siblings left and right of a node."""
        a = i // FAN * FAN
        return self.text[depth][64 * a: 64 * i], self.text[depth][64 * i + 64: 64 * (a + FAN)]

    def path(self, i: int) -> list[tuple[str, str]]:
        """Siblings of a leaf, level by level up to the block's root."""
        out = []
        for depth in range(self.levels - 1, 0, -1):
            out.append(self.sides(depth, i))
            i //= FAN
        return out


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        digest = _digest(left + digest + right)
    return digest


# -- leaves -----------------------------------------------------------------------
def leaf_digest(values: list[Column]) -> Column:
    """Hex sha256 of the values in a row: ``-`` for null, else byte count, colon, value."""
    parts = []
    for v in values:
        text = v.cast("string")
        parts.append(F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _digest_rows(docs: DataFrame) -> DataFrame:
    """``name`` (source; empty for null, else ``=`` and the source, so null is first), key, leaf, claimed digest if tampered."""
    key = docs["doc_id"].cast("long")
    whole = [docs[c] for c in FIELDS]
    lowered = [F.translate(docs[c].cast("string"), ascii_uppercase, ascii_lowercase) if c == "text" else docs[c] for c in FIELDS]
    touched = F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(TAMPERED)) == 0
    source = docs["source"].cast("string")
    return docs.select(
        F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source)).alias("name"), key.alias("key"),
        F.unhex(leaf_digest(whole)).alias("digest"), F.when(touched, F.unhex(leaf_digest(lowered))).alias("claimed"))


def numbered(rows: DataFrame, group: str | None, order: list[str], label: str) -> DataFrame:
    """``rows`` with ``at``: the 0-based place within the group by ``order``.

    The rows are range-partitioned by group and order, so a group that holds a third of them spans many
    tasks. A partition continues the group the one before it ended with, and only that one number per
    partition goes over the driver.
    """
    spark = rows.sparkSession
    cols = [F.col(c).asc_nulls_first() for c in ([group] if group else []) + order]
    placed = rows.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("part", F.spark_partition_id())
    columns = placed.columns

    def number(batches):
        last, run, at = None, -1, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            names = batch[group].to_pylist() if group else [""] * n
            runs, ats = np.empty(n, np.int64), np.empty(n, np.int64)
            for i, name in enumerate(names):
                if run < 0 or name != last:
                    last, run, at = name, run + 1, 0
                runs[i], ats[i] = run, at
                at += 1
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(runs), pa.array(ats)], names=[*columns, "run", "at"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields)
    placed = staged(placed.mapInArrow(number, f"{fields}, run long, at long"), label)
    name = F.col(group) if group else F.lit("")
    ends = placed.groupBy("part").agg(
        F.max("run").alias("runs"), F.count(F.when(F.col("run") == 0, 1)).alias("n"), F.max(F.struct("run", "at"))["at"].alias("to"),
        F.min_by(name, "run").alias("first"), F.max_by(name, "run").alias("last")).orderBy("part").collect()
    lifts, carried, before = [], 0, None
    for r in ends:
        lift = carried if r["first"] == before else 0
        lifts.append((r["part"], lift))
        carried, before = (lift + r["n"] if r["runs"] == 0 else r["to"] + 1), r["last"]
    lift = F.broadcast(spark.createDataFrame(lifts, "part int, lift long"))
    return placed.join(lift, "part").withColumn(
        "at", F.col("at") + F.when(F.col("run") == 0, F.col("lift")).otherwise(0)).drop("part", "run", "lift")


# -- building ---------------------------------------------------------------------
def _blocks(rows: DataFrame, carried: dict[str, pa.DataType], label: str) -> DataFrame:
    """One row per aligned subtree: ``name, block, n, nodes, root`` and the carried columns as lists, in leaf order."""
    wide = FAN ** HEIGHT
    rows = rows.select("name", F.floor(F.col("at") / wide).cast("long").alias("block"), "at", "digest", *carried)
    rows = rows.repartition("name", "block").sortWithinPartitions("name", "block", "at")

    def gather(batches):
        now, held = None, []

        def row():
            table = pa.Table.from_batches(held)
            leaves = b"".join(table["digest"].to_pylist())
            nodes = build_block(leaves, now[1] == 0)
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]]), pa.array([now[1]]), pa.array([table.num_rows], pa.int32()), pa.array([nodes]), pa.array([nodes[:32]]),
                 *(pa.array([table[c].to_pylist()], pa.list_(t)) for c, t in carried.items())],
                names=["name", "block", "n", "nodes", "root", *carried])

        for batch in batches:
            if not batch.num_rows:
                continue
            names, blocks = batch["name"].to_pylist(), batch["block"].to_pylist()
            begin = 0
            for i, here in enumerate([*zip(names, blocks), None]):
                if here != now or here is None:
                    if i > begin:
                        held.append(batch.slice(begin, i - begin))
                        begin = i
                    if here is not None:
                        if held:
                            yield row()
                        now, held = here, []
        if held:
            yield row()

    kinds = {pa.int64(): "bigint", pa.binary(): "binary", pa.string(): "string"}
    extra = "".join(f", {c} array<{kinds[t]}>" for c, t in carried.items())
    return staged(rows.mapInArrow(gather, f"name string, block long, n int, nodes binary, root binary{extra}"), label)


def _layers(leaves: DataFrame, carried: dict[str, pa.DataType], label: str) -> list[DataFrame]:
    """Blocks layer by layer, until every tree is one block."""
    out = [_blocks(leaves, carried, f"{label}-0")]
    while out[-1].where("block > 0").limit(1).count():
        up = out[-1].select("name", F.col("block").alias("at"), F.col("root").alias("digest"))
        out.append(_blocks(up, {}, f"{label}-{len(out)}"))
    return out


@dataclass
class Manifest:
    """Stored trees: ``trees`` of the sources and ``top`` over their roots, lowest layer first; the root as hex."""

    trees: list[DataFrame]
    top: list[DataFrame]
    root: str | None


def build(docs: DataFrame) -> Manifest:
    """Leaves of all rows, a tree for each source, and one over the sources' roots (null first, then by bytes).

    A source's rows ascend by doc_id, nulls first; rows that share one go by their leaf. Repeated rows are a leaf each.
    """
    leaves = numbered(staged(_digest_rows(docs), "merkle-leaves"), "name", ["key", "digest"], "merkle-places")
    trees = _layers(leaves, {"key": pa.int64(), "claimed": pa.binary()}, "merkle-tree")
    subroots = trees[-1].select(F.col("name").alias("tree"), F.col("root").alias("digest"))
    top = _layers(numbered(subroots, None, ["tree"], "merkle-sources").withColumn("name", F.lit("")), {"tree": pa.string()}, "merkle-top")
    last = top[-1].select("root").first()
    return Manifest(trees, top, last["root"].hex() if last else None)


# -- proofs -----------------------------------------------------------------------
_PATH = "lefts array<string>, rights array<string>"


def _members(blocks: DataFrame, child: str | None) -> DataFrame:
    """Each member's siblings up to the root, from its block's: rows for the blocks (or trees) below."""
    keep = [f.name for f in blocks.schema.fields if f.name == "subroot"]
    fields = "name string, at long, " + _PATH + (", subroot string" if keep or child else "")

    def descend(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                block = Block(r["nodes"], r["n"], r["block"] == 0)
                above = list(zip(r["lefts"], r["rights"]))
                out = [[] for _ in range(4 + bool(keep or child))]
                for i in range(r["n"]):
                    path = block.path(i) + above
                    row = [r[child][i] if child else r["name"], 0 if child else r["block"] * FAN ** HEIGHT + i,
                           [x for x, _ in path], [y for _, y in path]]
                    if len(out) == 5:
                        row.append(block.node(block.levels - 1, i) if child else r["subroot"])
                    for c, v in zip(out, row):
                        c.append(v)
                    if len(out[0]) == 256 or i == r["n"] - 1:       # paths are some KB each
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()))],
                            names=[x.split()[0] for x in fields.split(", ")])
                        out = [[] for _ in out]

    return blocks.mapInArrow(descend, fields)


def _meet(blocks: DataFrame, above: DataFrame) -> DataFrame:
    return blocks.join(above.withColumnRenamed("at", "block"), ["name", "block"])


def proofs(manifest: Manifest) -> DataFrame:
    """``key, leaf, subroot, root, proof_sha256, folded_root, verified`` of every leaf.

    The siblings are read from the stored blocks, from the top down. ``folded_root`` is recomputed from the
    claimed digest (the leaf's own where nothing else is claimed) and the siblings; equal runs are hashed once a block.
    """
    root = manifest.root
    top = manifest.top[-1].select("*", F.array().cast("array<string>").alias("lefts"), F.array().cast("array<string>").alias("rights"))
    for lower in reversed(manifest.top[:-1]):
        top = _meet(lower, _members(top, None))
    above = _members(top, "tree")
    for blocks in reversed(manifest.trees[1:]):
        above = _members(_meet(blocks, above), None)

    def prove(batches):
        for batch in batches:
            for i in range(batch.num_rows):     # a block at a time
                yield from _proved(batch.slice(i, 1).to_pylist()[0], root)

    return _meet(manifest.trees[0], above).mapInArrow(
        prove, "key long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _proved(r: dict, root: str):
    block = Block(r["nodes"], r["n"], r["block"] == 0)
    above = list(zip(r["lefts"], r["rights"]))
    # what a proof holds above each node of a depth, from the block's root down
    tail = ["".join(x + y for x, y in above)]
    for depth in range(1, block.levels - 1):
        n = len(block.text[depth]) // 64
        tail = ["".join(block.sides(depth, i)) + tail[i // FAN] for i in range(n)]
    known: dict[tuple[int, int], str] = {}
    folded_above: dict[str, str] = {}
    low = block.levels - 1
    cols = [[] for _ in range(7)]
    for i in range(r["n"]):
        leaf = block.node(low, i)
        if low:
            proof = "".join(block.sides(low, i)) + tail[i // FAN]
        else:
            proof = tail[0]
        claimed = r["claimed"][i]
        at, here = i, leaf if claimed is None else claimed.hex()
        for depth in range(low, 0, -1):
            if here == block.node(depth, at):       # the run as it is stored
                got = known.get((depth, at // FAN))
                if got is None:
                    left, right = block.sides(depth, at)
                    got = known[depth, at // FAN] = _digest(left + here + right)
                here = got
            else:
                left, right = block.sides(depth, at)
                here = _digest(left + here + right)
            at //= FAN
        if here == block.root:
            if here not in folded_above:
                folded_above[here] = fold(here, above)
            here = folded_above[here]
        else:
            here = fold(here, above)
        for c, v in zip(cols, (r["key"][i], leaf, r["subroot"], root, _digest(proof), here, here == root)):
            c.append(v)
    kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                     names=["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def manifest_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row of ``docs``.

    A leaf is the digest of doc_id, source, lang, n_chars and text. Every fifth id by crc32 claims the digest of its text
    with A-Z lower-cased; its ``folded_root`` differs and it is not verified, if the text had such letters.
    Nulls count as ``-`` and an empty text as ``0:``; a null source is a tree of its own, first under the root;
    rows without doc_id come first in their source and are not tampered with; repeated rows are a leaf each;
    other columns play no part; an empty table has no root and gives no row.
    """
    made = build(docs)
    if made.root is None:
        return docs.sparkSession.createDataFrame(
            [], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return proofs(made).withColumnRenamed("key", "doc_id")


def _sql(source_levels: int = 6, top_levels: int = 5) -> str:
    """The same rows in DuckDB, for sources of up to 16^6 rows and 16^5 sources."""
    def leaf(text: str) -> str:
        fields = [(f"{c}::varchar" if c != "text" else text) for c in FIELDS]
        return "sha256(" + " || ".join(f"CASE WHEN {f} IS NULL THEN '-' ELSE strlen({f}) || ':' || {f} END" for f in fields) + ")"

    lowered = f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')"
    parts = [f"""d AS (SELECT CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS g, doc_id, {leaf('text')} AS h,
 CASE WHEN {crc32_sql('doc_id::varchar')} % {TAMPERED} = 0 THEN {leaf(lowered)} END AS claimed FROM documents)""",
             "s0 AS (SELECT g, h, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS p, count(*) OVER (PARTITION BY g) AS n, doc_id, claimed FROM d)"]

    def climb(tag: str, levels: int) -> list[str]:
        out = []
        for k in range(levels):
            out.append(f"""{tag}{k + 1} AS (SELECT g, p // 16 AS p, (n + 15) // 16 AS n,
 CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h FROM {tag}{k} GROUP BY g, p // 16, n)""")
            out.append(f"""{tag}x{k} AS (SELECT a.g, a.p, a.n > 1 AS up, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p < a.p), '') AS l,
 coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p > a.p), '') AS r FROM {tag}{k} a JOIN {tag}{k} b ON a.g = b.g AND a.p // 16 = b.p // 16
 GROUP BY a.g, a.p, a.n)""")
        return out

    parts += climb("s", source_levels)
    parts.append(f"t0 AS (SELECT '' AS g, h, g AS tree, row_number() OVER (ORDER BY g) - 1 AS p, count(*) OVER () AS n FROM s{source_levels})")
    parts += climb("t", top_levels)
    parts.append("f0 AS (SELECT s0.*, t0.p AS q, t0.h AS subroot, '' AS proof, coalesce(claimed, s0.h) AS cur FROM s0 JOIN t0 ON t0.tree = s0.g)")
    n = 0
    for tag, levels, at, own in (("s", source_levels, "p", "f.g"), ("t", top_levels, "q", "''")):
        for k in range(levels):
            parts.append(f"""f{n + 1} AS (SELECT f.* EXCLUDE (proof, cur), proof || l || r AS proof, CASE WHEN up THEN sha256(l || cur || r) ELSE cur END AS cur
 FROM f{n} f JOIN {tag}x{k} x ON x.g = {own} AND x.p = f.{at} // {FAN ** k})""")
            n += 1
    body = ",\n".join(parts)
    return f"""WITH {body}
SELECT doc_id, f.h AS leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = t.h AS verified FROM f{n} f, t{top_levels} t"""


SQL = _sql()
