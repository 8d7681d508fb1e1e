"""Near-duplicate components by b-bit MinHash.

Every text becomes a set of word shingles. Equal sets fold into one class by digest.
Class representatives get ``BANDS`` x ``ROWS`` minima; equal bands make candidate groups;
``BITS`` low bits of each minimum are packed into a signature, and the collision-corrected
agreement of two signatures drops candidates far below the wanted similarity. What remains
is confirmed on the full sets, and confirmed links are joined into components.

Candidate groups never become all their pairs. Each group sends on a spanning forest of
its near signatures, and the forests of all groups join into candidate clusters; every
wanted link lies inside one cluster. A cluster is first tied to one pivot by confirmed
links. Only members that this leaves apart are compared with the others on their full
sets, in pairs of blocks, and each pair of blocks sends on a spanning forest again.

A pair at similarity 0.8 misses all bands with probability (1 - 0.8**5)**40 = 1.3e-7, and
the signature filter with less than 1e-8 (six standard deviations).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.llm.common import WordHashes, bounded_batches, fresh_name, mix, shingles_of, spread, text_bytes, words_of, written

BANDS = 40
ROWS = 5
BITS = 4
PART = 64
GROUP_BLOCK = 2048
BLOCK = 256
#: Where the numbers of rows without an id of their own begin; ids are smaller.
AGAIN, NO_ID = 1 << 61, 1 << 62

_K = BANDS * ROWS
_SEEDS = mix(np.arange(1, 2 * _K + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_MUL = _SEEDS[:_K] | np.uint64(1)
_ADD = _SEEDS[_K:]
_NIBBLE = np.uint64(0x1111111111111111)

SETS = "doc_id long, n_shingles long, digest binary, bands array<long>, signature binary"


def minima(shingles: np.ndarray) -> np.ndarray:
    """Smallest value of every hash function over a set, as unsigned 32-bit integers."""
    low = np.full(_K, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 512):
            part = shingles[i : i + 512, None] * _MUL + _ADD
            np.minimum(low, part.min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def band_keys(low: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = np.arange(BANDS, dtype=np.uint64)
        for column in low.reshape(BANDS, ROWS).T:
            key = mix(key * np.uint64(0x100000001B3) + column)
    return key.view(np.int64)


def pack_bits(low: np.ndarray) -> bytes:
    """The ``BITS`` low bits of every minimum, two per byte, padded to whole words."""
    nibbles = np.zeros(-(-_K // 16) * 16, dtype=np.uint8)
    nibbles[:_K] = low & 0xF
    return (nibbles[0::2] | nibbles[1::2] << 4).tobytes()


def similarity(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity from packed signatures (rows of unsigned words).

    Two unequal minima agree on their low bits by chance once in 2**BITS; the estimate
    takes that share out.
    """
    differ = one ^ many
    differ |= differ >> np.uint64(1)
    differ |= differ >> np.uint64(2)
    unequal = np.bitwise_count(differ & _NIBBLE).sum(axis=-1)
    chance = 1 / 2**BITS
    return ((1 - unequal / _K) - chance) / (1 - chance)


def least_estimate(threshold: float) -> float:
    return threshold - 6 * (threshold * (1 - threshold) / _K) ** 0.5 * 1.05


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            counts, digests, bands, signatures = [], [], [], []
            for text in batch.column(1):
                shingles = shingles_of(hashes.of(words_of(text.as_py())), width)
                counts.append(len(shingles))
                if not len(shingles):
                    digests.append(None), bands.append(None), signatures.append(None)
                    continue
                low = minima(shingles)
                digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                bands.append(band_keys(low))
                signatures.append(pack_bits(low))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary())],
                ["doc_id", "n_shingles", "digest", "bands", "signature"],
            )

    return run


def shingle_sets(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Set size, set digest, band keys and packed signature of every text."""
    bounded_batches(docs.sparkSession)
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    return ids.mapInArrow(_sets(width), SETS)


def _near(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the wanted similarity."""
    small, large = sorted((one, two), key=len)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * common >= percent * (len(one) + len(two) - common)


def _confirm(width: int, percent: int):
    """Rows arrive sorted by (pivot, part), the pivot's own row first.

    A pivot whose id repeats with other texts has several rows; a link with any counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        pivot, own, heading = None, [], False
        for batch in batches:
            left, right = [], []
            pivots, members = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b, text in zip(pivots, members, batch.column(2)):
                shingles = shingles_of(hashes.of(words_of(text.as_py())), width)
                if a == b:
                    if not heading or pivot != a:
                        pivot, own, heading = a, [], True
                    if not any(np.array_equal(shingles, known) for known in own):
                        own.append(shingles)
                    continue
                heading = False
                assert pivot == a, "the pivot's row comes first"
                if any(_near(known, shingles, percent) for known in own):
                    left.append(a), right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def confirm_links(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach ``percent``; a pivot with many partners is split.

    ``docs`` has one row (doc_id, text bytes) per id. A part holds about ``PART`` partners
    and one copy of the pivot's text, so no task gathers a group.
    """
    spark = pairs.sparkSession
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    keyed = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), "b")
    heads = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("b"))
    texts = docs.select(F.col("doc_id").alias("b"), "text")
    rows = keyed.unionByName(heads).join(texts, "b")
    n = spread(spark)
    return (
        rows.select("a", "part", "b", "text")
        .repartition(n, "a", "part")
        .sortWithinPartitions("a", "part", F.col("b") != F.col("a"))
        .select("a", "b", "text")
        .mapInArrow(_confirm(width, percent), "a long, b long")
    )


def components(edges: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Smallest id reachable from every id of ``edges`` (a, b), as (id, component).

    Labels spread along edges and then jump to the label of their label, so long chains
    shorten by half each time; it stops when nothing changes. ``before`` holds labels of
    earlier edges; they count as edges too.
    """
    links = edges.select("a", "b")
    if before is not None:
        links = links.unionByName(before.where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b")))
    both = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels")
    while True:
        heard = both.join(labels, both.a == labels.id).groupBy(F.col("b").alias("id")).agg(F.min("component").alias("heard"))
        nearer = labels.join(heard, "id").select("id", F.col("component").alias("old"), F.least("component", "heard").alias("near"))
        far = labels.select(F.col("id").alias("near"), F.col("component").alias("far"))
        moved = written(nearer.join(far, "near").select("id", "old", F.least("near", "far").alias("component")), "labels")
        labels = moved.select("id", "component")
        if not moved.where("component <> old").limit(1).count():
            return labels


def forest(near, first: np.ndarray, second: np.ndarray) -> list[tuple[int, int]]:
    """Trees of a graph between two lists of positions (equal lists: within one), each as a star.

    The edges tie every position to the first one of its tree, so the groups that share
    members repeat the same few edges.

    ``near(i, others)`` picks the neighbours of a position among others. Each position is
    compared only with those not reached yet, so a dense group costs about one comparison
    per member.
    """
    within = first is second
    waiting = [first, first] if within else [first, second]
    waiting = [w.copy() for w in waiting]
    side_of = {int(i): 0 for i in first} if within else {int(i): 0 for i in first} | {int(i): 1 for i in second}
    edges, left = [], set(side_of)
    for start in list(side_of):
        if start not in left:
            continue
        left.discard(start)
        queue = [start]
        while queue:
            i = queue.pop()
            side = 0 if within else 1 - side_of[i]
            waiting[side] = waiting[side][[int(j) in left for j in waiting[side]]] if len(waiting[side]) else waiting[side]
            for j in near(i, waiting[side]) if len(waiting[side]) else ():
                edges.append((start, int(j)))
                left.discard(int(j))
                queue.append(int(j))
    return edges


def _edges(ids: np.ndarray, edges: list[tuple[int, int]]) -> pa.Table:
    at = np.array(edges, dtype=np.int64).reshape(-1, 2)
    return pa.table({"a": ids[at].min(axis=1, initial=np.iinfo(np.int64).max), "b": ids[at].max(axis=1, initial=np.iinfo(np.int64).min)})


def _signature_words(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("signature").to_pylist()), dtype=np.uint64).reshape(table.num_rows, -1)


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the rows of the two blocks, smaller ids first."""
    block, order = table.column("block").to_numpy(), np.argsort(table.column("id").to_numpy(), kind="stable")
    first, second = table.column("one")[0].as_py(), table.column("two")[0].as_py()
    one = order[block[order] == first]
    return one, one if first == second else order[block[order] == second]


def _near_signatures(least: float):
    """Rows (key, id, block, one, two, signature) of one pair of blocks of one candidate group."""

    def run(table: pa.Table) -> pa.Table:
        words = _signature_words(table)
        return _edges(table.column("id").to_numpy(), forest(lambda i, others: others[similarity(words[i], words[others]) >= least], *_sides(table)))

    return run


def _near_sets(width: int, percent: int, least: float):
    """The same on full sets, for rows that also hold the text and the component so far."""

    def run(table: pa.Table) -> pa.Table:
        hashes, words, group = WordHashes(), _signature_words(table), table.column("component").to_numpy()
        sets = [shingles_of(hashes.of(words_of(t)), width) for t in table.column("text").to_pylist()]

        def near(i: int, others: np.ndarray) -> list[int]:
            others = others[(group[others] != group[i]) & (similarity(words[i], words[others]) >= least)]
            return [j for j in others if _near(sets[i], sets[j], percent)]

        return _edges(table.column("id").to_numpy(), forest(near, *_sides(table)))

    return run


def _pairs_of_blocks(rows: DataFrame) -> DataFrame:
    """Rows dealt to the pairs of blocks of their key: every two blocks, and each with itself."""
    return rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other")).drop("blocks", "other")


def near_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Component of near copies of every row: doc_id, n_shingles, component_id, kept.

    Two texts are linked when ``100 * intersection >= percent * union`` of their shingle
    sets; ``component_id`` is the smallest id reachable. Texts without words are linked
    with nothing. Rows that repeat an id share its component. A row without an id gets the
    component of its equal set (null if none has an id), is no node itself, and is kept
    only where that component is null. Other columns of ``docs`` are ignored.
    """
    least = least_estimate(percent / 100)
    sets = written(shingle_sets(docs, width, id_col, text_col), "sets")
    classes = sets.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    members = written(sets.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left").select("doc_id", "n_shingles", "rep"), "members")
    nodes = sets.withColumnRenamed("doc_id", "rep").join(classes, ["digest", "rep"]).dropDuplicates(["rep", "digest"])
    nodes = written(nodes.select("rep", "bands", "signature"), "nodes")
    banded = nodes.select("rep", F.posexplode("bands").alias("band", "key")).select(F.xxhash64("band", "key").alias("key"), F.col("rep").alias("id"))
    shared = banded.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("key")
    groups = written(banded.join(shared, "key").distinct(), "groups")
    signatures = nodes.select(F.col("rep").alias("id"), "signature")
    involved = groups.select(F.col("id").alias("doc_id")).distinct()
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    texts = written(source.join(involved.hint("shuffle_hash"), "doc_id", "left_semi"), "texts")

    repeated = written(_repeated_links(sets, classes), "repeated")
    labels = components(repeated) if repeated.limit(1).count() else None
    sized = groups.groupBy("key").agg(F.ceil(F.count("*") / GROUP_BLOCK).cast("int").alias("blocks"))
    dealt = groups.join(sized, "key").join(signatures, "id").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    trees = written(_pairs_of_blocks(dealt).groupBy("key", "one", "two").applyInArrow(_near_signatures(least), "a long, b long").distinct(), "trees")
    if trees.limit(1).count():
        clusters = components(trees).withColumnRenamed("component", "cluster")
        pivots = clusters.where("id <> cluster").select(F.col("cluster").alias("a"), F.col("id").alias("b"))
        links = written(confirm_links(pivots, texts, width, percent), "confirmed")
        if links.limit(1).count():
            labels = components(links, labels)
        apart = _apart(clusters, labels)
        rows = apart.join(signatures, "id").join(texts.withColumnRenamed("doc_id", "id"), "id")
        more = written(rows.groupBy("cluster", "one", "two").applyInArrow(_near_sets(width, percent, least), "a long, b long").distinct(), "confirmed")
        if more.limit(1).count():
            labels = components(more, labels)
    if labels is not None:
        members = members.join(labels, members.rep == labels.id, "left").withColumn("rep", F.coalesce("component", "rep"))
    found = members.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("component_id"))
    return found.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def _repeated_links(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that repeat one id with different texts."""
    reps = sets.where("doc_id is not null").select("digest", "doc_id").distinct().join(classes, "digest")
    span = reps.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.collect_set("rep").alias("reps"))
    return span.where("a <> b").select("a", F.explode("reps").alias("b")).where("a <> b")


def _apart(clusters: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members of the clusters that are not one component yet, dealt to pairs of blocks.

    Blocks 0 to ``home - 1`` hold the pivot's component, whose members need no comparison
    among themselves; the others meet every block.
    """
    known = clusters.withColumn("component", F.col("id"))
    if labels is not None:
        known = clusters.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    known = known.join(known.where("id = cluster").select("cluster", F.col("component").alias("pivot")), "cluster")
    inside = F.col("component") == F.col("pivot")
    sizes = known.groupBy("cluster").agg(F.ceil(F.count_if(inside) / BLOCK).cast("int").alias("home"), F.ceil(F.count_if(~inside) / BLOCK).cast("int").alias("away")).where("away > 0")
    placed = known.join(sizes, "cluster").withColumn("block", F.when(inside, F.pmod(F.xxhash64("id"), "home")).otherwise(F.col("home") + F.pmod(F.xxhash64("id"), "away")).cast("int"))
    first = F.when(inside, F.col("home")).otherwise(F.lit(0))
    dealt = placed.withColumn("other", F.explode(F.sequence(first, F.col("home") + F.col("away") - 1)))
    return dealt.select("cluster", "id", "component", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of every group of near copies; columns unchanged.

    The row with the smallest id stays. Rows that repeat an id, with equal texts or not, are
    rows of their own: the first stays before the others. Rows without an id come after all
    others, so one of them stays only where the group has no id at all. Null, empty and
    blank texts are linked with nothing and stay. An empty table stays empty.
    """
    row, first, own = (fresh_name(docs, name) for name in ("row", "first", "own"))
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    repeated = numbered.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(row).alias(first), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = written(repeated.select(F.col("doc_id").alias(own), first), "repeated")
    met = numbered.join(repeated, numbered["doc_id"] == repeated[own], "left").drop(own)
    later = F.when(F.col("doc_id").isNull(), F.col(row) + NO_ID).when(F.col(first) != F.col(row), F.col(row) + AGAIN)
    met = met.withColumn(own, F.coalesce(later, F.col("doc_id").cast("long"))).drop(row, first)
    gone = near_components(met.select(F.col(own).alias("doc_id"), "text"), width, percent).where("not kept").select(F.col("doc_id").alias(first))
    return met.join(gone, met[own] == gone[first], "left_anti").drop(own)
