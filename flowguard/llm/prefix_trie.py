"""Prefix trie of conversations, built in adaptive radix trees over fixed-width turn ids.

A turn (role, text) has an id of ``WIDTH`` bytes: 16 of its SHA-256 and the code points of
its text as a big-endian integer. A conversation is the concatenation of its ids, and a
trie node is a prefix of whole ids, known by a digest that is chained from its parent's.

Tasks hold consecutive conversations in a bounded adaptive radix tree (compressed edges,
nodes of 4, 16, 48 or 256 children) and send on one row per trie node they saw, so a first
turn that a third of all conversations share costs one row per tree. Spark adds the rows
up by node. The smallest member of a node is its owner; an owner's nodes are one stretch of
its path. A second pass over the owners alone adds up what must count once per node.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowguard.llm.common import bounded_batches, spread, written

DIGEST = 16
WIDTH = DIGEST + 4
HEAD = 5
SALTS = 8
TREE_BYTES = 16 << 20
ROOT = bytes(DIGEST)
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

ROWS = "key binary, depth long, parent binary, conv_id long, n_convs long, chars long, spent long, n_leaves long, once long, ids string"
PATHS = "conv_id long, path binary, first long, leaf boolean"


class Node:
    """A tree node: the bytes of the edge to it, and children in the smallest layout that holds them."""

    __slots__ = ("edge", "keys", "kids", "index", "members", "first", "leaves")

    def __init__(self, edge: bytes):
        self.edge = edge
        self.keys: bytearray | None = bytearray()
        self.kids: list = []
        self.index: bytearray | None = None
        self.members: list[int] = []
        self.first = 1 << 62
        self.leaves = 0

    def child(self, byte: int) -> Node | None:
        if self.keys is not None:
            at = self.keys.find(byte)
            return self.kids[at] if at >= 0 else None
        if self.index is not None:
            return self.kids[self.index[byte] - 1] if self.index[byte] else None
        return self.kids[byte]

    def put(self, child: Node) -> None:
        """Add a child or replace the one that starts with the same byte, growing the layout when full."""
        byte = child.edge[0]
        if self.keys is not None:
            at = bisect_left(self.keys, byte)
            if at < len(self.keys) and self.keys[at] == byte:
                self.kids[at] = child
                return
            if len(self.keys) < 16:  # layouts of 4 and 16: sorted bytes beside the children
                self.keys.insert(at, byte)
                self.kids.insert(at, child)
                return
            self.index = bytearray(256)
            for i, key in enumerate(self.keys):
                self.index[key] = i + 1
            self.keys = None
        if self.index is not None:
            if self.index[byte]:
                self.kids[self.index[byte] - 1] = child
                return
            if len(self.kids) < 48:  # a layout of 48: one index byte per possible byte
                self.kids.append(child)
                self.index[byte] = len(self.kids)
                return
            slots: list = [None] * 256
            for key, place in enumerate(self.index):
                if place:
                    slots[key] = self.kids[place - 1]
            self.kids, self.index = slots, None
        self.kids[byte] = child

    def children(self) -> list[Node]:
        return [k for k in self.kids if k is not None]


def shared_bytes(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    apart = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (apart.bit_length() + 7) // 8


class Tree:
    """Conversations of one task, as paths of whole turn ids."""

    def __init__(self) -> None:
        self.root, self.size = Node(b""), 0

    def add(self, conv_id: int, path: bytes, first: int, leaf: bool) -> None:
        """Insert a path; its trie nodes from depth ``first`` on count as its own."""
        node, at = self.root, 0
        self.size += len(path) + 64
        while at < len(path):
            child = node.child(path[at])
            if child is None:
                child = Node(path[at:])
                node.put(child)
            else:
                n = shared_bytes(child.edge, path[at : at + len(child.edge)])
                if n < len(child.edge):
                    upper = Node(child.edge[:n])
                    upper.first = child.first
                    child.edge = child.edge[n:]
                    upper.put(child)
                    node.put(upper)
                    child = upper
            child.first = min(child.first, first)
            at += len(child.edge)
            node = child
        node.members.append(conv_id)
        node.leaves += leaf

    def rows(self) -> Iterator[tuple]:
        """One row per trie node, and one per node with members that end there (``ids``)."""
        seen: list[list] = []
        stack = [(self.root, -1, 0, ROOT, b"")]
        while stack:
            node, above, depth, key, rest = stack.pop()
            rest += node.edge
            steps = []
            for i in range(0, len(rest) - WIDTH + 1, WIDTH):
                turn = rest[i : i + WIDTH]
                below = hashlib.blake2b(key + turn, digest_size=DIGEST).digest()
                depth += 1
                steps.append((depth, key, below, int.from_bytes(turn[DIGEST:])))
                key = below
            rest = rest[len(steps) * WIDTH :]
            if node.members:
                members = sorted(node.members)
                yield (key, None, None, members[0], None, None, None, None, None, ",".join(map(str, members)))
            # count, smallest member, spent, leaves, once: below the node so far
            seen.append([node, above, steps, len(node.members), min(node.members, default=1 << 63), 0, node.leaves, 0])
            stack += [(child, len(seen) - 1, depth, key, rest) for child in node.children()]
        for node, above, steps, count, least, spent, leaves, once in reversed(seen):
            for depth, parent, key, chars in reversed(steps):
                spent += count * chars
                once += chars if depth >= node.first else 0
                yield (key, depth, parent, least, count, chars, spent, leaves, once, None)
            if above < 0:
                if count:
                    yield (ROOT, 0, None, least, count, 0, spent, leaves, once, None)
                return
            up = seen[above]
            up[3:] = [up[3] + count, min(up[4], least), up[5] + spent, up[6] + leaves, up[7] + once]


def _tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ints = ["conv_id", "n_convs", "chars", "spent", "n_leaves", "once"]
    schema = pa.schema([("key", pa.binary()), ("depth", pa.int64()), ("parent", pa.binary()), *[(c, pa.int64()) for c in ints], ("ids", pa.string())])

    def emit(tree: Tree) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in tree.rows():
            held.append(row)
            size += 100 + len(row[-1] or "")
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    tree = Tree()
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            tree.add(*row)
            if tree.size > TREE_BYTES:
                yield from emit(tree)
                tree = Tree()
    yield from emit(tree)


def _chained_sha256(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the comma-joined pieces of each key, which arrive in order."""
    key, state = None, None
    for batch in batches:
        keys, hashes = [], []
        for row_key, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if row_key != key:
                if state is not None:
                    keys.append(key)
                    hashes.append(state.hexdigest())
                key, state = row_key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes)], ["key", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])


def turn_id(role: Column, text: Column) -> Column:
    """Hexadecimal id of a turn."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.substring(F.sha2(whole.cast("binary"), 256), 1, 2 * DIGEST), F.lpad(F.lower(F.hex(F.char_length(text))), 8, "0"))


def rebuilt_paths(conversations: DataFrame) -> DataFrame:
    """conv_id and path of every rebuilt conversation (first turns of its hundred's head, then its own)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), turn_id(role, text).alias("id")).where("conv_id IS NOT NULL")
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "id"))).alias("turns"))
    ids = written(whole.select("conv_id", F.transform("turns", lambda t: t["id"]).alias("ids")), "turns")
    head = ids.where("conv_id % 100 = 0").select(F.col("conv_id").alias("head"), F.slice("ids", 1, HEAD).alias("head_ids"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)).cast("int")
    joined = ids.join(head, F.col("conv_id") - F.col("conv_id") % 100 == F.col("head"), "left")
    none = F.array().cast("array<string>")
    start = F.slice(F.coalesce("head_ids", none), F.lit(1), taken)
    own = F.slice("ids", taken + 1, F.greatest(F.size("ids"), F.lit(1)))
    return joined.select("conv_id", F.unhex(F.array_join(F.concat(start, own), "")).alias("path"))


def _in_order(paths: DataFrame) -> DataFrame:
    return paths.repartitionByRange(spread(paths.sparkSession), "conv_id").sortWithinPartitions("conv_id").select("conv_id", "path", "first", "leaf")


def trie_of_paths(paths: DataFrame) -> DataFrame:
    """One row per trie node of ``paths`` (conv_id, path; each conversation once)."""
    spark = paths.sparkSession
    bounded_batches(spark)
    n = spread(spark)
    paths = written(paths, "paths")
    seen = written(_in_order(paths.withColumns({"first": F.lit(1 << 62), "leaf": F.lit(False)})).mapInArrow(_tree_rows, ROWS), "prefixes")
    facts = seen.where("ids IS NULL").groupBy("key").agg(
        F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"), F.min("chars").alias("chars"), F.sum("spent").alias("spent"),
    )
    facts = written(facts, "nodes")
    ended = seen.where("ids IS NOT NULL").repartition(n, "key").sortWithinPartitions("key", "conv_id").select("key", "ids")
    ends = ended.mapInArrow(_chained_sha256, "key binary, ends_sha256 string")
    kids = facts.where("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = facts.join(kids, "key", "left").join(ends, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = written(nodes.withColumn("first", F.min("depth").over(Window.partitionBy("conv_id"))), "nodes")

    owners = nodes.groupBy("conv_id").agg(F.min("depth").alias("first"), F.max(F.col("n_children") == 0).alias("leaf"))
    own = _in_order(paths.join(owners, "conv_id")).mapInArrow(_tree_rows, ROWS).where("ids IS NULL")
    sums = own.groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("once").alias("once"))

    # An owner's top node hangs off another owner's node; both sides of that join are salted, most below the root.
    def salts(depth: Column) -> Column:
        return F.when(depth == 0, n).otherwise(SALTS)

    tops = nodes.where("depth = first AND depth > 0").select("key", "parent", F.pmod(F.xxhash64("key"), salts(F.col("depth") - 1)).cast("int").alias("salt"))
    branching = nodes.where("n_children > 1 OR ends_sha256 IS NOT NULL")
    above = branching.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.explode(F.sequence(F.lit(0), salts(F.col("depth")) - 1)).alias("salt"))
    parents = tops.join(above, ["parent", "salt"]).select("key", "parent_conv_id")
    whole = nodes.join(sums, "key").join(parents, "key", "left")
    parent = F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("parent_conv_id"))
    return whole.select(
        "key", "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        (F.col("spent") - F.col("once")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """Trie of the rebuilt conversations: key, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns of equal number (null counts as one, before all others) are ordered by role, then by
    id; rows that repeat are turns of their own. Null roles and texts are empty. Rows
    without conv_id belong to no conversation. Other columns are ignored. No rows, no
    nodes. A conversation is held as one row of 20 bytes a turn (about 100 while it is sorted).
    """
    return trie_of_paths(rebuilt_paths(conversations))
