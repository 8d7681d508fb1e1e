"""Benchmark decontamination by pigeonhole pieces and bit-parallel edit distance.

An item of length m may differ from a passage by ``errors = floor(m * rate)`` edits. Cut
into ``errors + 1`` pieces, at least one piece stays unharmed in such a passage. Exact
piece hits come from one automaton over all pieces; each hit fixes a window of the text,
and Myers' bit-vector algorithm finds the smallest distance of the item within it.
Texts are compared in lower case with runs of white space as one space.

Items are handed to tasks in blocks of at most ``BLOCK_BYTES`` of text on average, however
large the benchmark is, and every block meets all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.llm.common import bounded_batches

RATE = 0.06
BLOCK_BYTES = 4 << 20

Item = tuple[int, str]
MATCHES = "doc_id long, item_id long, distance int, start int, end int"


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces_of(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of nearly equal length with their offsets."""
    n = errors + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def nearest(pattern: str, window: str) -> tuple[int, int]:
    """Smallest edit distance of the pattern to any substring of the window, and its first end.

    Myers' algorithm over one machine word of arbitrary width: the vertical differences
    of a column of the alignment matrix are two bit vectors.
    """
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, distance = full, 0, m
    best, end = m, 0
    for i, c in enumerate(window, 1):
        equal = masks.get(c, 0)
        across = equal | minus
        diagonal = (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | ~(diagonal | plus) & full, plus & diagonal
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(across | up) & full, up & across
        if distance < best:
            best, end = distance, i
    return best, end


class ItemMatcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[Item], rate: float):
        self.items = [(i, t, int(len(t) * rate)) for i, t in items if t]
        places: dict[str, list[tuple[int, int]]] = {}
        for number, (_, text, errors) in enumerate(self.items):
            for offset, piece in pieces_of(text, errors):
                places.setdefault(piece, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        if places:
            self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, set[int]]:
        """Item numbers with the places where their first character would stand."""
        found: dict[int, set[int]] = {}
        if self.items:
            for last, (length, places) in self.automaton.iter(text):
                for number, offset in places:
                    found.setdefault(number, set()).add(last + 1 - length - offset)
        return found

    def matches(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item_id, distance, start of the window, end) of the nearest passage of each item within its budget."""
        for number, begins in self.windows(text).items():
            item_id, item, errors = self.items[number]
            best = None
            for begin in sorted(begins):
                start = max(0, begin - errors)
                distance, end = nearest(item, text[start : begin + len(item) + errors])
                if distance <= errors and (best is None or distance < best[0]):
                    best = (distance, start, start + end)
                    if distance == 0:
                        break
            if best:
                yield item_id, *best


def item_blocks(benchmark: DataFrame) -> Iterator[list[Item]]:
    """Items in blocks of bounded text, dealt by a hash of their id; null ids and empty texts are skipped."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and trim(text) <> ''").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-total // BLOCK_BYTES)
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        yield sorted((r.item_id, plain(r.text)) for r in rows)


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """One row per document and item that a passage of it matches within the edit budget.

    ``distance`` is the smallest found; ``start`` and ``end`` bound the first such passage
    in the normalised text (the passage lies inside). Null and empty texts match nothing,
    an empty benchmark gives no rows, an item id that repeats with several texts counts as
    several items with one id, repeated document rows repeat their matches, and other
    columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def search(items: list[Item]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = ItemMatcher(items, rate)
            for batch in batches:
                rows = [(i, *m) for i, text in zip(batch.column(0).to_pylist(), batch.column(1)) for m in matcher.matches(plain(text.as_py()))]
                columns = zip(*rows) if rows else [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "distance", "start", "end"])

        return run

    found = None
    for items in item_blocks(benchmark):
        part = source.mapInArrow(search(items), MATCHES)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], MATCHES) if found is None else found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows in which no benchmark item is found, every column unchanged."""
    at = docs.columns.index("text")

    def clean(items: list[Item]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = ItemMatcher(items, rate)
            for batch in batches:
                keep = [next(matcher.matches(plain(text.as_py())), None) is None for text in batch.column(at)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return run

    bounded_batches(docs.sparkSession)
    for items in item_blocks(benchmark):
        docs = docs.mapInArrow(clean(items), docs.schema)
    return docs
