"""Removal of repeated passages: confirmed windows, sharded Aho-Corasick automata, cut texts.

A window is ``width`` consecutive words. A word goes if a window over it occurs anywhere else.

1. *Anchors.* Every window names the smallest hash among its phrases of ``width // 3`` words
   (the leftmost on a tie). Equal windows name equal phrases, so only windows whose anchor
   occurs twice can recur; anchors are some 8 % of the words, and only these are counted.
2. *Stretches.* The words under windows of a recurring anchor are cut out, once per ``owner``
   (smallest row that has the anchor). Equal windows have one owner and meet in its group; an
   anchor with more than ``HOT`` occurrences spreads its group over 2 ** level splits.
3. *Confirmed passages.* A group keeps the distinct windows that occur twice, joined into
   passages where they follow each other. Windows of a split group that are single in
   their split are counted over all splits by a 128-bit hash.
4. *Automata.* Passages are dealt into shards. A shard compiles blocks of ``(width + 1) // 2``
   words, which every window holds one of, and streams every stretch of its owners. Windows
   around a hit are looked up among the shard's and compared word by word.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowguard.llm.common import WordHashes, bounded_batches, mix, slices, spread, text_bytes, written
from flowguard.session import ensure_checkpoint_dir

WIDTH = 35
HOT = 4096
SALTS = 8
SHARD_WORDS = 200_000
BATCH_WORDS = 100_000
BASE = 64
CHUNK_BYTES = 2 << 20
OPEN_BYTES = 24 << 20

ANCHORS = "key long, anchors array<struct<anchor:long,runs:array<struct<first:int,last:int>>>>"
STRETCHES = "owner long, level int, key long, start int, words binary"
LOCAL = "owner long, level int, key long, start int, words binary, one long, two long"
SPANS = "key long, spans array<struct<start:int,end:int>>"
KEPT = "doc_id long, n_words long, spans array<struct<start:int,end:int>>, kept_text string"


def bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """``df`` stored once in buckets of ``column``, so that joins on it leave the texts in place."""
    spark = df.sparkSession
    n, table = spread(spark), f"{name}_{uuid.uuid4().hex}"
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{table}"
    df.repartition(n, column).write.bucketBy(n, column).option("path", folder).option("compression", "zstd").saveAsTable(table)
    return spark.table(table)


def sequence_hash(values: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """64-bit hash of every ``width`` consecutive values, from hashes of powers of two."""
    power, done, size = mix(values + np.uint64(salt)), None, 1
    with np.errstate(over="ignore"):
        while True:
            if width & size:
                done = power if done is None else mix(done[: len(power) - covered] * np.uint64(0x100000001B3) + power[covered:])
                covered = size if done is power else covered + size
            if 2 * size > width:
                return done[: len(values) - width + 1]
            power = mix(power[:-size] * np.uint64(0x9E3779B97F4A7C15) + power[size:])
            size *= 2


def _inside(lengths: np.ndarray, width: int) -> np.ndarray:
    """Starts of all windows that lie inside one of the concatenated sequences."""
    total = int(lengths.sum())
    ends = np.repeat(np.cumsum(lengths), lengths)
    starts = np.arange(total)
    return starts[starts + width <= ends]


def anchor_runs(hashes: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, last window) of every run of windows that share an anchor."""
    starts = _inside(lengths, width)
    if not len(starts):
        return np.zeros(0, np.int64), starts, starts
    phrase = max(1, width // 3)
    phrases = sequence_hash(hashes, phrase)
    least = np.lib.stride_tricks.sliding_window_view(phrases, width - phrase + 1)
    at = np.concatenate([part + least[part].argmin(axis=1) for part in np.array_split(starts, len(starts) // 100_000 + 1)])
    fresh = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([fresh[1:], [len(starts)]]) - 1
    return phrases[at[fresh]].view(np.int64), starts[fresh], starts[last]


def _anchors(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    run_kind = pa.struct([("first", pa.int32()), ("last", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = WordHashes()
        for batch in batches:
            for part in slices(batch, 1):
                texts = [t.split() for t in part.column(1).to_pylist()]
                lengths = np.array([len(t) for t in texts], np.int64)
                hashes = np.concatenate([numbers.of(t) for t in texts]) if texts else np.zeros(0, np.uint64)
                anchor, first, last = anchor_runs(hashes, lengths, width)
                offsets = np.concatenate([[0], np.cumsum(lengths)])
                doc = np.searchsorted(offsets, first, side="right") - 1
                order = np.lexsort((first, anchor, doc))
                anchor, doc, base = anchor[order], doc[order], offsets[doc[order]]
                runs = pa.StructArray.from_arrays([pa.array((x[order] - base).astype(np.int32)) for x in (first, last)], fields=list(run_kind))
                heads = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])) if len(anchor) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(anchor)).astype(np.int32)), runs)
                items = pa.StructArray.from_arrays([pa.array(anchor[heads]), lists], ["anchor", "runs"])
                bounds = np.searchsorted(doc[heads], np.arange(len(texts) + 1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), items)], ["key", "anchors"])

    return run


def _stretches(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("owner", pa.int64()), ("level", pa.int32()), ("key", pa.int64()), ("start", pa.int32()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for key, text, marks in zip(*(part.column(i).to_pylist() for i in range(3))):
                    words = text.split()
                    runs = sorted((m["owner"], m["level"], r["first"], r["last"] + width) for m in marks for r in m["runs"])
                    for (owner, level), group in groupby(runs, key=lambda r: r[:2]):
                        rows += [(owner, level, key, start, b" ".join(words[start:end])) for start, end in merged([r[2:] for r in group])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _passages_of(rows: list[tuple], split: set, numbers: WordHashes, width: int) -> list[tuple]:
    """Confirmed passages of some groups, and the single windows of those in ``split``.

    A row is (group, key, start, words). An occurrence is a (key, place), however many
    stretches of its group hold it. The first occurrence stands for a window; each group has
    its own, since its stretches meet no passage of another group.
    """
    words = [w for r in rows for w in r[3]]
    lengths = np.array([len(r[3]) for r in rows], np.int64)
    places = _inside(lengths, width)
    if not len(places):
        return []
    row = np.repeat(np.arange(len(rows)), lengths)[places]
    offset = (np.cumsum(lengths) - lengths)[row]
    group = np.cumsum([i > 0 and r[0] != rows[i - 1][0] for i, r in enumerate(rows)])[row]
    key, at = np.array([r[1] for r in rows])[row], np.array([r[2] for r in rows])[row] + places - offset
    hashes = numbers.of(words)
    one, two = sequence_hash(hashes, width)[places], sequence_hash(hashes, width, 1)[places]
    order = np.lexsort((at, key, two, one, group))
    same = (group[order[1:]] == group[order[:-1]]) & (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
    moved = (key[order[1:]] != key[order[:-1]]) | (at[order[1:]] != at[order[:-1]])
    head = np.concatenate([[True], ~same])
    window = np.cumsum(head) - 1
    times = np.bincount(window, weights=np.concatenate([[True], moved | ~same]))
    chosen, often = order[head], times > 1
    starts = np.sort(chosen[often])
    out = []
    if len(starts):
        cuts = np.flatnonzero((np.diff(places[starts]) != 1) | (np.diff(row[starts]) != 0)) + 1
        for run in np.split(starts, cuts):
            first, r = places[run[0]], rows[row[run[0]]]
            out.append((*r[0][:2], r[1], int(at[run[0]]), b" ".join(words[first : places[run[-1]] + width]), None, None))
    if split:
        loose = np.array([r[0] in split for r in rows])[row[chosen]] & ~often
        for i in chosen[loose].tolist():
            r = rows[row[i]]
            out.append((*r[0][:2], r[1], int(at[i]), None, int(one[i].view(np.int64)), int(two[i].view(np.int64))))
    return out


def _confirmed(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Groups arrive whole and in order; several small ones are taken together, large ones in parts."""
    ints = [("owner", pa.int64()), ("level", pa.int32()), ("key", pa.int64()), ("start", pa.int32())]
    schema = pa.schema([*ints, ("words", pa.binary()), ("one", pa.int64()), ("two", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held, size, split = WordHashes(), [], 0, set()

        def close() -> Iterator[pa.RecordBatch]:
            found = _passages_of(held, split, numbers, width)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

        for batch in batches:
            for owner, level, part, key, start, words in zip(*(c.to_pylist() for c in batch.columns)):
                group = (owner, level, part)
                fresh = not held or held[-1][0] != group
                if size >= (CHUNK_BYTES if fresh else OPEN_BYTES):
                    if not fresh:
                        split.add(group)
                    yield from close()
                    split &= {group}
                    held, size = [], 0
                if level > 0:
                    split.add(group)
                held.append((group, key, start, words.split(b" ")))
                size += len(words)
        yield from close()

    return run


def _recut(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Passages of confirmed single windows (``places``) from the stretches that hold them."""
    schema = pa.schema([("owner", pa.int64()), ("level", pa.int32()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for owner, level, start, text, places in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.split(b" ")
                inside = np.array(sorted({p - start for p in places if 0 <= p - start <= len(words) - width}), np.int64)
                for part in np.split(inside, np.flatnonzero(np.diff(inside) != 1) + 1):
                    if len(part):
                        rows.append((owner, level, b" ".join(words[part[0] : part[-1] + width])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


class Shard:
    """Automaton over the blocks of some passages.

    A word is spelled in a few letters of base ``BASE``, each place with letters of its own, so
    that blocks match at whole words only and no state has many successors.
    """

    def __init__(self, passages: list[bytes], width: int):
        self.width, self.step = width, (width + 1) // 2
        self.codes: dict[bytes, int] = {}
        coded = [np.array([self.codes.setdefault(w, len(self.codes) + 1) for w in text.split(b" ")], np.uint64) for text in passages]
        self.places = 1
        while BASE**self.places <= len(self.codes):
            self.places += 1
        lengths = np.array([len(c) for c in coded], np.int64)
        self.line = np.concatenate([*coded, np.zeros(width, np.uint64)])
        starts = _inside(lengths, width)
        hashes = sequence_hash(self.line, width)[starts]
        order = np.argsort(hashes, kind="stable")
        self.windows, self.starts = hashes[order], starts[order]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        for line in coded:
            letters = self.letters(line)
            for at in range(0, len(line) - self.step + 1, self.step):
                self.automaton.add_word(tuple(letters[at * self.places : (at + self.step) * self.places]))
        self.automaton.make_automaton()

    def letters(self, line: np.ndarray) -> list[int]:
        digits = [line // np.uint64(BASE**i) % np.uint64(BASE) + np.uint64(i * BASE) for i in range(self.places)]
        return np.stack(digits, axis=1).ravel().tolist()

    def covered(self, stretches: list[list[bytes]]) -> list[list[tuple[int, int]]]:
        """Per stretch, the merged (start, end) of all its windows that a passage holds."""
        if not len(self.windows):
            return [[] for _ in stretches]
        line = np.array([self.codes.get(w, 0) for words in stretches for w in words], np.uint64)
        lengths = np.array([len(words) for words in stretches], np.int64)
        ends = np.array([end for end, _ in self.automaton.iter(tuple(self.letters(line)))], np.int64) // self.places
        near = np.zeros(len(line) + 2 * self.width, np.int32)
        np.add.at(near, np.maximum(ends - self.width + 1, 0), 1)
        np.add.at(near, ends - self.step + 2, -1)
        starts = _inside(lengths, self.width)
        starts = starts[np.cumsum(near)[starts] > 0]
        if len(starts):
            hashes = sequence_hash(line, self.width)[starts]
            at = np.minimum(np.searchsorted(self.windows, hashes), len(self.windows) - 1)
            own, other = (np.lib.stride_tricks.sliding_window_view(x, self.width) for x in (line, self.line))
            found = self.windows[at] == hashes
            starts, at = starts[found], self.starts[at[found]]
            parts = [np.arange(i, min(i + 20_000, len(starts))) for i in range(0, len(starts), 20_000)]
            same = [(own[starts[p]] == other[at[p]]).all(axis=1) for p in parts]
            starts = starts[np.concatenate([*same, np.zeros(0, bool)])]
        edges = np.cumsum(lengths)
        row = np.searchsorted(edges, starts, side="right")
        out: list[list[tuple[int, int]]] = [[] for _ in stretches]
        for r, start in zip(row.tolist(), (starts - (edges - lengths)[row]).tolist()):
            spans = out[r]
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], start + self.width)
            else:
                spans.append((start, start + self.width))
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _located(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Passages of a shard come first, then its stretches."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, passages, shard, held, size = None, [], None, [], 0

        def close() -> Iterator[pa.RecordBatch]:
            rows = [(key, [{"start": int(a + start), "end": int(b + start)} for a, b in found]) for (key, start, _), found in zip(held, shard.covered([h[2] for h in held])) if found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], span)], ["key", "spans"])

        for batch in batches:
            for unit, key, start, words in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (unit != current or size > BATCH_WORDS):
                    yield from close()
                    held, size = [], 0
                if unit != current:
                    current, passages, shard = unit, [], None
                if key is None:
                    passages.append(words)
                    continue
                shard = shard or Shard(passages, width)
                held.append((key, start, words.split(b" ")))
                size += len(held[-1][2])
        if held:
            yield from close()

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        for part in slices(batch, 1):
            counts, spans, texts = [], [], []
            for text, lists in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                words = text.split()
                found = merged([(s["start"], s["end"]) for some in lists or [] for s in some])
                at, kept = 0, []
                for start, end in found:
                    kept += words[at:start]
                    at = end
                kept += words[at:]
                counts.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in found])
                texts.append(b" ".join(kept))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(spans, span), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "spans", "kept_text"])


def _splits() -> Column:
    return F.call_function("shiftleft", F.lit(1), F.col("level"))


def _group_of(splits: Column) -> Column:
    """Split of a stretch in its group, by its row alone."""
    return F.pmod(F.xxhash64("key"), splits).cast("int")


def find_passages(stretches: DataFrame, width: int) -> DataFrame:
    """(owner, level, words) of the confirmed passages; each recurring window is in one of them."""
    n = spread(stretches.sparkSession)
    groups = stretches.select("owner", "level", _group_of(_splits()).alias("split"), "key", "start", "words")
    dealt = groups.repartition(n, "owner", "level", "split").sortWithinPartitions("owner", "level", "split", "key", "start")
    local = written(dealt.mapInArrow(_confirmed(width), LOCAL), "passages")
    passages = local.where("words IS NOT NULL").select("owner", "level", "words")
    singles = local.where("words IS NULL")
    if singles.isEmpty():
        return passages
    place = F.struct("key", "start", "owner", "level")
    often = singles.groupBy("one", "two").agg(F.min(place).alias("a"), F.max(F.struct("key", "start")).alias("z")).where("a.key != z.key OR a.start != z.start")
    places = often.groupBy("a.owner", "a.level", "a.key").agg(F.collect_list("a.start").alias("places"))
    cut = stretches.join(places, ["owner", "level", "key"]).select("owner", "level", "start", "words", "places")
    return written(passages.unionByName(cut.mapInArrow(_recut(width), "owner long, level int, words binary")), "passages")


def _shards(passages: DataFrame, stretches: DataFrame) -> DataFrame:
    """Rows of all shards: unit, kind (passage or stretch), key, start, words.

    Owners are dealt into shards of about ``SHARD_WORDS`` words. A group with more is cut into
    parts, and its stretches go to each part.
    """
    words = F.octet_length("words") - F.octet_length(F.translate(F.col("words").cast("string"), " ", "")) + 1
    sized = passages.groupBy("owner", "level").agg(F.sum(words.cast("long")).alias("n"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // SHARD_WORDS))
    parts = F.ceil(F.col("n") / SHARD_WORDS).cast("int")
    large = written(sized.where(F.col("n") > SHARD_WORDS).select(F.col("owner").alias("of_owner"), F.col("level").alias("of_level"), parts.alias("parts")), "large")

    def with_parts(df: DataFrame) -> DataFrame:
        joined = df.join(large, (F.col("owner") == F.col("of_owner")) & (F.col("level") == F.col("of_level")), "left")
        return joined.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("splits", _splits())

    shard = F.pmod(F.xxhash64("owner", "level"), F.lit(shards))
    none = F.lit(None)
    part = F.pmod(F.xxhash64("words"), F.col("parts")).cast("int")
    first = with_parts(passages).select(shard.alias("shard"), "level", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split"), part.alias("part"), F.lit(0).alias("kind"), none.cast("long").alias("key"), none.cast("int").alias("start"), "words")
    second = with_parts(stretches).select(shard.alias("shard"), "level", _group_of(F.col("splits")).alias("split"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), "key", "start", "words")
    return first.unionByName(second)


def find_repeats(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(texts by key, spans by key): rows of ``docs`` as key, doc_id, text (bytes), and word spans to remove."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = bucketed(docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")), "texts", "key")
    runs = written(texts.select("key", "text").mapInArrow(_anchors(width), ANCHORS).where(F.size("anchors") > 0), "anchors")
    seen = runs.select("key", F.inline("anchors"))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / HOT))).cast("int")
    often = seen.groupBy("anchor").agg(F.sum(F.size("runs")).alias("n"), F.min("key").alias("owner")).where("n > 1")
    # one row per text and anchor, and an anchor's texts are dealt to several tasks
    salted = often.select("anchor", "owner", level.alias("level"), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    marked = seen.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, ["anchor", "salt"])
    marks = marked.groupBy("key").agg(F.collect_list(F.struct("owner", "level", "runs")).alias("marks"))
    stretches = written(texts.select("key", "text").join(marks, "key").mapInArrow(_stretches(width), STRETCHES), "stretches")
    keys = ["shard", "level", "split", "part"]
    rows = _shards(find_passages(stretches, width), stretches).repartition(spread(spark), *keys).sortWithinPartitions(*keys, "kind", "key", "start")
    unit = F.concat_ws(":", *keys).alias("unit")
    return texts, written(rows.select(unit, "key", "start", "words").mapInArrow(_located(width), SPANS), "repeats")


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, spans (removed words, merged) and kept_text (words joined by a space) of every row.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Windows are judged on the input, overlapping
    ones of one text included. Null and empty texts have no words; texts shorter than a
    window lose nothing. Rows that repeat count as rows of their own, with or without an
    id. Other columns are ignored.
    """
    texts, repeats = find_repeats(docs, width)
    spans = repeats.groupBy("key").agg(F.collect_list("spans").alias("spans"))
    return texts.join(spans, "key", "left").select("doc_id", "text", "spans").mapInArrow(_kept, KEPT)
