"""Merkle manifest of a dataset, rolled up in nested structs inside bounded blocks.

Every row is a leaf hash. The leaves of one tree are ranked; the rank's base-8 digits are
columns, and a block is ``8 ** DIGITS`` consecutive ranks. Inside a block the digit columns
are grouped away one after the other, each time nesting the child structs in their parent,
until a row is left per block. Block roots are the leaves of the next tier, and the roots of
the trees are the leaves of one last tree. Downwards, a block's nested structs are exploded
level by level, so that every leaf meets its siblings in the row it already is in. A block
meets the path above it by grouping (union and one aggregation), not by a join; the last tree
hands its root and paths to the trees below in the same way. Every leaf, tampered or not, is
then folded with its siblings, and the outcome is held against the root of the rollup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowguard.llm.common import UPPER, spread, written

BITS = 3
FANOUT = 1 << BITS
DIGITS = 3
BLOCK = FANOUT**DIGITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<left:string,right:string>>"


def digest(*texts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the concatenated texts."""
    return F.sha2(F.concat(*texts).cast("binary"), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_table(docs: DataFrame) -> DataFrame:
    """tree, doc_id, the leaf hash and that of the tampered row (null where none is tampered with).

    ``tree`` is empty for a null language and ``=`` before any other, so that its bytewise
    order is the order of languages with null first.
    """
    kinds = {"doc_id": "long", "n_chars": "long"}
    rows = docs.select(*[F.col(name).cast(kinds.get(name, "string")).alias(name) for name in FIELDS])
    changed = rows.select("*", F.translate("text", UPPER, UPPER.lower()).alias("lowered"))
    leaf = digest(*[encoded(F.col(name)) for name in FIELDS])
    tampered = digest(*[encoded(F.col(name)) for name in FIELDS[:-1]], encoded(F.col("lowered")))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    return changed.select(tree.alias("tree"), "doc_id", leaf.alias("hash"), F.when(hit, tampered).alias("tampered"), F.monotonically_increasing_id().alias("row"))


def ranked(rows: DataFrame, order: list[str], carry: list[str], partitions: int) -> DataFrame:
    """``rows`` with ``rank`` (from 0, within ``tree``, by ``order``) and ``size`` of the tree.

    Rows are range-partitioned and sorted; a row's place in its partition is counted there
    and the counts per (partition, tree) are added up, so one large tree is spread over
    partitions. ``order`` must end with a column that differs for every row.
    """
    placed = rows.repartitionByRange(partitions, "tree", *order).sortWithinPartitions("tree", *order)
    placed = written(placed.select("tree", *carry, F.monotonically_increasing_id().alias("slot")), "placed")
    part = F.shiftright("slot", 33)
    counts = placed.groupBy("tree", part.alias("part")).agg(F.count("*").alias("n"), F.min("slot").alias("first"))
    earlier = Window.partitionBy("tree").orderBy("part")
    offsets = counts.select(
        F.col("tree").alias("of_tree"), F.col("part").alias("of_part"), "first",
        (F.sum("n").over(earlier) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("tree")).alias("size"),
    )
    joined = placed.join(offsets, (F.col("tree") == F.col("of_tree")) & (part == F.col("of_part")))
    return joined.select("tree", *carry, (F.col("slot") - F.col("first") + F.col("before")).alias("rank"), "size")


def _combined(children: Column, done: Column) -> Column:
    """Hash of the parent; a tree that has one node left keeps it."""
    hashes = F.transform(children, lambda c: c["hash"])
    return F.when(done, hashes[0]).otherwise(digest(F.array_join(hashes, "")))


def rolled_up(nodes: DataFrame, leaf_fields: list[str]) -> DataFrame:
    """One row per block: tree, block, nodes (of the tree at this tier), hash and nested children.

    ``nodes`` has tree, rank, size (nodes of the tree at this tier) and the ``leaf_fields``,
    among them ``hash``. All groupings share the exchange on (tree, block).
    """
    digits = [F.shiftright("rank", BITS * i).bitwiseAND(FANOUT - 1) for i in range(DIGITS)]
    rows = nodes.select("tree", F.shiftright("rank", BITS * DIGITS).alias("block"), "size", *[d.alias(f"d{i}") for i, d in enumerate(digits)], *leaf_fields)
    rows = rows.repartition(spread(nodes.sparkSession), "tree", "block")
    inner = leaf_fields
    for level in range(DIGITS):
        keys = ["tree", "block", "size"] + [f"d{i}" for i in range(level + 1, DIGITS)]
        child = F.struct(F.col(f"d{level}").alias("digit"), *[F.col(f) for f in inner])
        grouped = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(child)).alias("children"))
        done = F.col("size") <= FANOUT**level
        rows = grouped.select(*keys, _combined(F.col("children"), done).alias("hash"), "children")
        inner = ["hash", "children"]
    return rows


def _step(level: int) -> Column:
    """What stands left and right of the child at ``at``; nothing in a tree that has ended."""
    left = F.array_join(F.slice("hashes", F.lit(1), F.col("at")), "")
    right = F.array_join(F.slice("hashes", F.col("at") + 2, F.lit(FANOUT)), "")
    step = F.array(F.struct(left.alias("left"), right.alias("right")))
    return F.when(F.col("size") <= FANOUT**level, F.array().cast(STEPS)).otherwise(step)


def exploded(blocks: DataFrame, leaf_fields: list[str], carry: list[str]) -> DataFrame:
    """tree, rank, the leaf fields, ``path`` (steps, the leaf's own level first) and ``carry`` of every leaf.

    ``blocks`` has the columns of ``rolled_up``, ``path``, the steps above its root, and ``carry``.
    """
    rows = blocks.select("tree", "size", "path", *carry, "children", F.col("block").alias("rank"))
    for level in reversed(range(DIGITS)):
        hashes = F.transform("children", lambda c: c["hash"])
        opened = rows.select("tree", "size", "rank", "path", *carry, hashes.alias("hashes"), F.posexplode("children").alias("at", "child"))
        fields = ["children"] if level else leaf_fields
        rows = opened.select(
            "tree", "size", (F.col("rank") * FANOUT + F.col("at")).alias("rank"), F.concat(_step(level), "path").alias("path"),
            *carry, *[F.col("child")[f].alias(f) for f in fields],
        )
    return rows


def _tiers(nodes: DataFrame, leaf_fields: list[str], name: str) -> tuple[list[tuple[DataFrame, list[str]]], DataFrame]:
    """(blocks and leaf fields of every tier, tree and root of every tree).

    A tier turns nodes into block roots until every tree has one; it reads the rows its
    predecessor wrote.
    """
    tiers, fields = [], leaf_fields
    while True:
        blocks = written(rolled_up(nodes, fields), name)
        tiers.append((blocks, fields))
        largest = blocks.agg(F.max("size")).first()[0] or 0
        if largest <= BLOCK:
            return tiers, blocks.select("tree", "hash")
        nodes = blocks.select("tree", F.col("block").alias("rank"), F.shiftright(F.col("size") + (BLOCK - 1), BITS * DIGITS).alias("size"), "hash")
        fields = ["hash"]


def _descended(tiers: list[tuple[DataFrame, list[str]]], above: DataFrame) -> DataFrame:
    """Leaf rows with their path to the very top; ``above`` has tree, the path of its root and columns to carry down."""
    carry = [c for c in above.columns if c not in ("tree", "path")]
    above = above.withColumn("block", F.lit(0).cast("long"))
    for blocks, fields in reversed(tiers):
        met = blocks.drop("hash").unionByName(above, allowMissingColumns=True).groupBy("tree", "block")
        met = met.agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("size", "children", "path", *carry)])
        rows = exploded(met, fields, carry)
        above = rows.select("tree", F.col("rank").alias("block"), "path", *carry)
    return rows


def _folded(node: Column, steps: Column) -> Column:
    return F.aggregate(steps, node, lambda below, s: digest(s["left"], below, s["right"]))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    Rows count by doc_id (null first), then by leaf; rows equal in all five columns are
    leaves of their own, whose order does not show. A null id is never tampered with. Null
    and empty values differ (``-`` and ``0:``). Other columns are ignored. No rows, no result.
    """
    partitions = spread(docs.sparkSession)
    leaves = written(leaf_table(docs), "leaves")
    nodes = ranked(leaves, ["doc_id", "hash", "row"], ["doc_id", "hash", "tampered"], partitions)
    tiers, subroots = _tiers(nodes, ["hash", "doc_id", "tampered"], "blocks")
    one = ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "hash"), ["key"], ["key", "hash"], partitions)
    last, top = _tiers(one, ["hash", "key"], "trees")
    trees = _descended(last, top.select("tree", F.array().cast(STEPS).alias("path"), F.col("hash").alias("root")))
    rows = _descended(tiers, trees.select(F.col("key").alias("tree"), "path", F.col("hash").alias("subroot"), "root"))
    proof = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    folded = _folded(F.coalesce("tampered", "hash"), F.col("path"))
    out = rows.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", digest(proof).alias("proof_sha256"), folded.alias("folded_root"))
    return out.select("*", (F.col("folded_root") == F.col("root")).alias("verified"))
