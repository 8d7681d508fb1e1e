"""Hierarchical Pitman-Yor language model over word pairs.

Every context word has a restaurant whose customers are the words that follow it; the
tables of all context restaurants are the customers of one shared parent restaurant, whose
base measure is uniform over the vocabulary. Seating is sampled by Gibbs: in a sweep all
customers of a word leave and are seated again, at a table in proportion to its size less
the discount or at a new one in proportion to the parent's probability; only the count of
tables matters, and it is drawn as a whole. Restaurants are swept side by side with the
totals of the last sweep. Predictive probabilities are averaged over the samples;
they are linear in the table counts, so the counts are averaged.

Documents are cut into blocks. A block sends each bucket of contexts its distinct word
pairs with the rows they occur in, so that a pair travels once per block however often
it occurs (once per ``MOST_TIMES``, to be exact, so that its training count is one byte). The
first row of a pair is marked by its complement; how often the pair occurs follows from the
marks. Buckets hold pair counts, answer block by block, and a block adds up the answers
of all buckets; its ids travel in one cell, so no task holds the ids of more than its share. Contexts that hold a large share of all words are dealt to all buckets by the
pair, and their totals are exchanged with those of the words.

The sampled state of a bucket depends on its data and fixed seeds alone, so a task that is
run again gives the same result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.llm.common import CACHE_WORDS, bounded_batches, mix, slices, text_bytes, words_of
from flowguard.operators.single import attach_row

BUCKET_BYTES = 16 << 20
BLOCK_BYTES = 12 << 20
LEAST_BUCKETS = 16
BLOCK_ROWS = 30_000
MOST_TIMES = 127
DISCOUNT, STRENGTH = 0.75, 2.0
PARENT_DISCOUNT, PARENT_STRENGTH = 0.5, 2.0
BURN_IN, SAMPLES = 2, 3
#: Rows of more customers draw their tables by rejection instead of from a table of all chances.
SMALL_ROW = 128
ROWS_AT_ONCE, NODES = 512, 65

_PRIME = np.uint64(0x100000001B3)
END, START = xxhash.xxh64_intdigest(b""), xxhash.xxh64_intdigest(b" ")
WORD, CONTEXT, TOTALS = 0, 1, 2

PAIRS = "bucket int, block long, doc_ids array<long>, lengths array<int>, contexts array<long>, spans array<int>, words array<long>, trained array<byte>, rows array<short>"
COUNTS = "bucket int, kind int, key long, customers long, tables double"
PARTS = "bucket int, block long, doc_ids array<long>, lengths array<int>, rows array<short>, n_known array<int>, base_score array<double>, score array<float>, train_tokens long"
SCORES = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def in_training(doc_ids: list[int | None]) -> np.ndarray:
    """Whether a document's words are learnt from; rows without an id are not."""
    return np.array([i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for i in doc_ids], dtype=bool)


@lru_cache
def stirling_logs(most: int, discount: float) -> np.ndarray:
    """Logs of the generalised Stirling numbers of up to ``most`` customers (rows) and tables (columns)."""
    logs = np.full((most + 1, most + 1), -np.inf)
    logs[1, 1] = 0.0
    tables = np.arange(1, most + 1)
    for c in range(1, most):
        t = tables[:c]
        logs[c + 1, 1 : c + 1] = np.logaddexp(logs[c, :c], np.log(c - discount * t) + logs[c, 1 : c + 1])
        logs[c + 1, c + 1] = 0.0
    return logs


class StirlingPath:
    """Logs of ``S(c, t) * weight**t`` of rows of many customers, up to a constant of the row.

    ``S(c, t)`` is a multiple of ``[x**c] (1 - (1 - x)**discount)**t / (t! discount**t)``, here
    Cauchy's integral by the trapezoidal rule along a path near the saddle point of the row: a
    parabola around the cut from 1 on, or an arc if the saddle point is far from 1.
    """

    def __init__(self, customers: np.ndarray, weight: np.ndarray, discount: float):
        c, self.customers, self.log_weight = customers.astype(float), customers, np.log(weight / discount)
        # weight * x * (1 - x) ** (discount - 1) = c, in the logit of 1 - x
        low, high = -np.log(4 * c), np.maximum(np.log(weight / c), 0) + 3
        for _ in range(40):
            middle = (low + high) / 2
            x, s = 1 / (1 + np.exp(middle)), 1 / (1 + np.exp(-middle))
            above = np.log(weight / c) + np.log(x) + (discount - 1) * np.log(s) > 0
            low, high = np.where(above, middle, low), np.where(above, high, middle)
        f, rate = 1 - s**discount, weight / discount
        slope, bend = x * discount * s ** (discount - 1), x * x * discount * (1 - discount) * s ** (discount - 2)
        self.mean = np.clip(rate * f, 1, c)
        self.deviation = np.sqrt(np.maximum(rate * (f - slope**2 / (slope + bend)), 0.1))
        spread = np.sqrt(np.maximum(self.mean * ((slope + bend) / f - (slope / f) ** 2), 1e-300))
        arc = s > 0.3
        near = np.maximum(s, 1 / c)
        reach = np.where(arc, np.minimum(np.pi, 10 / spread), 10 / np.sqrt(c * near))
        at = reach[:, None] * np.linspace(0, 1, NODES)
        z = 1 + 1j * at
        path = np.where(arc[:, None], x[:, None] * np.exp(1j * at), 1 - near[:, None] * z**2)
        self.log_x = np.where(arc[:, None], np.log(x)[:, None] + 1j * at, np.log1p(-near[:, None] * z**2))
        cut = np.where(arc[:, None], np.exp(discount * np.log1p(-np.where(arc[:, None], path, 0))), near[:, None] ** discount * np.exp(2 * discount * np.log(z)))
        self.log_f = np.log1p(-cut)
        self.step = np.where(arc[:, None], path, near[:, None] * z)
        self.step[:, [0, -1]] /= 2
        self.top_x, self.top_f = self.log_x[:, 0].real.copy(), self.log_f[:, 0].real.copy()
        self.log_x -= self.top_x[:, None]
        self.log_f -= self.top_f[:, None]

    def log_mass(self, rows: np.ndarray, tables: np.ndarray) -> np.ndarray:
        c = self.customers[rows] + 1.0
        area = (np.exp(tables[:, None] * self.log_f[rows] - c[:, None] * self.log_x[rows]) * self.step[rows]).real.sum(axis=1)
        logs = np.log(np.maximum(area, 1e-300)) + tables * self.top_f[rows] - c * self.top_x[rows]
        return logs + tables * self.log_weight[rows] - log_factorial(tables)


def log_factorial(n: np.ndarray) -> np.ndarray:
    """Stirling's series, shifted by ten."""
    x = n + 11.0
    logs = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return logs - np.log(np.prod(n[..., None] + np.arange(1.0, 11.0), axis=-1))


def draw_large(customers: np.ndarray, weight: np.ndarray, discount: float, random: np.random.Generator) -> np.ndarray:
    """Table counts of rows of many customers by rejection under two exponentials.

    ``S(c, t) * weight**t`` is log-concave in ``t`` (Kurtz), so a line through neighbouring
    logs is nowhere below the others.
    """
    path = StirlingPath(customers, weight, discount)
    rows, c = np.arange(len(customers)), customers
    middle, width = np.rint(path.mean).astype(np.int64), np.maximum(np.rint(path.deviation), 1).astype(np.int64)
    left, right = np.clip(middle - width, 1, c - 1), np.clip(middle + width, 2, c)
    ends = np.zeros((4, len(c)))
    todo = rows
    while len(todo):
        for k, t in enumerate((left, left + 1, right - 1, right)):
            ends[k, todo] = path.log_mass(todo, t[todo])
        falls = (ends[1] <= ends[0]) & (left > 1)
        rises = (ends[3] >= ends[2]) & (right < c)
        width *= 2
        left, right = np.where(falls, np.maximum(left - width, 1), left), np.where(rises, np.minimum(right + width, c), right)
        todo = np.flatnonzero(falls | rises)
    up, down = ends[1] - ends[0], ends[3] - ends[2]
    gap = up - down
    meet = np.where(gap > 1e-9, (ends[3] - down * right - ends[0] + up * left) / np.maximum(gap, 1e-9), middle)
    cut = np.clip(np.floor(meet), 0, c).astype(np.int64)
    sides = []
    for first, last, slope, value, at in ((1, cut, up, ends[0], left), (cut + 1, c, down, ends[3], right)):
        n, steep = last - first + 1, np.maximum(np.abs(slope), 1e-12)
        heavy = np.where(slope > 0, last, first)
        total = value + slope * (heavy - at) + np.log(np.maximum(-np.expm1(-steep * n), 1e-300)) - np.log(-np.expm1(-steep))
        sides.append((n, steep, slope, heavy, value, at, np.where(n > 0, total, -np.inf)))
    share = 1 / (1 + np.exp(np.clip(sides[1][-1] - sides[0][-1], -700, 700)))
    share = np.where(cut < 1, 0.0, np.where(cut >= c, 1.0, share))
    tables, todo = np.ones(len(c), np.int64), rows
    while len(todo):
        on_right = random.random(len(todo)) >= share[todo]
        n, steep, slope, heavy, value, at, _ = (np.where(on_right, two[todo], one[todo]) for one, two in zip(*sides))
        back = np.floor(np.log1p(random.random(len(todo)) * np.expm1(-steep * n)) / -steep).astype(np.int64)
        t = (heavy - np.where(slope > 0, 1, -1) * np.minimum(back, n - 1)).astype(np.int64)
        taken = np.log(1 - random.random(len(todo))) <= path.log_mass(todo, t) - (value + slope * (t - at))
        tables[todo[taken]] = t[taken]
        todo = todo[~taken]
    return tables


def draw_tables(customers: np.ndarray, weight: np.ndarray, discount: float, random: np.random.Generator) -> np.ndarray:
    """Tables of every row after all its customers are seated anew; ``weight`` is the mass of a new table.

    Drawn from the law in which a long run of single moves ends, ``S(c, t) * weight**t`` with
    generalised Stirling numbers, whatever the count.
    """
    tables = np.minimum(customers, 1)
    logs = stirling_logs(SMALL_ROW, discount)
    several = np.flatnonzero((customers > 1) & (customers <= SMALL_ROW))
    several = several[np.argsort(customers[several], kind="stable")]
    edges = np.searchsorted(customers[several], np.arange(2, SMALL_ROW + 2))
    for c, i, j in zip(range(2, SMALL_ROW + 1), edges[:-1], edges[1:]):
        for k in range(i, j, ROWS_AT_ONCE):
            at = several[k : min(j, k + ROWS_AT_ONCE)]
            mass = logs[c, 1 : c + 1] + np.log(weight[at])[:, None] * np.arange(1, c + 1)
            upto = np.cumsum(np.exp(mass - mass.max(axis=1, keepdims=True)), axis=1)
            tables[at] = 1 + np.minimum((upto <= (random.random(len(at)) * upto[:, -1])[:, None]).sum(axis=1), c - 1)
    large = np.flatnonzero(customers > SMALL_ROW)
    for k in range(0, len(large), ROWS_AT_ONCE):
        at = large[k : k + ROWS_AT_ONCE]
        tables[at] = draw_large(customers[at], weight[at], discount, random)
    return tables


def sweep_seats(customers: np.ndarray, room: np.ndarray, weight: np.ndarray, discount: float, random: np.random.Generator, seats: list | None) -> tuple[np.ndarray, list]:
    """One plain Gibbs sweep, customer by customer, which ``draw_tables`` is held against.

    Rows are grouped by the power of two that holds their customers (``room``), each group
    with a matrix of table sizes. A sweep moves as many random customers as the largest row
    of a group has. Returns the tables of every row and the state.
    """
    tables = np.minimum(customers, 1)
    if seats is None:
        seats = []
        for power in np.unique(room[customers > 1]):
            at = np.flatnonzero((room == power) & (customers > 1))
            extra = np.minimum(random.poisson(weight[at] / discount), customers[at] - 1)
            sizes = (np.arange(1 << int(power))[None, :] <= extra[:, None]).astype(np.int32)
            sizes[:, 0] = customers[at] - extra
            seats.append((at, sizes))
    for at, sizes in seats:
        count, mass, row = customers[at], weight[at], np.arange(len(at))
        open_tables = (sizes > 0).sum(axis=1)
        # tables beyond the last one in use, and one free one, hold nobody and are left out
        last = int(np.flatnonzero(sizes.any(axis=0))[-1])
        for _ in range(int(count.max())):
            used = sizes[:, : last + 2]
            leaves = np.minimum((np.cumsum(used, axis=1) <= (random.random(len(at)) * count)[:, None]).sum(axis=1), used.shape[1] - 1)
            used[row, leaves] -= 1
            open_tables -= used[row, leaves] == 0
            draw = random.random(len(at)) * (mass + count - 1 - discount * open_tables)
            new = draw < mass
            upto = np.cumsum(used - discount * (used > 0), axis=1)
            joins = np.minimum((upto <= (draw - mass)[:, None]).sum(axis=1), used.shape[1] - 1)
            empty = (used == 0).argmax(axis=1)
            old = used[row, joins] > 0
            joins = np.where(new, empty, np.where(old, joins, used.argmax(axis=1)))
            open_tables += used[row, joins] == 0
            used[row, joins] += 1
            last = max(last, int(joins.max()))
        tables[at] = open_tables
    return tables, seats


def word_cells(hashes: np.ndarray, cells: int) -> np.ndarray:
    return (mix(hashes) >> np.uint64(20)).astype(np.int64) & (cells - 1)


def is_hot(hashes: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Whether each word is dealt out by its pairs; ``hot`` is a mask of cells."""
    return hot[word_cells(hashes, len(hot))]


class WordCodes(dict):
    """Small numbers of the words met by a task, and their hashes; forgotten between blocks when many."""

    def __init__(self):
        super().__init__()
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.known: list[int] = [START, END]
        self.lengths = np.zeros(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self.known)
        self.known.append(xxhash.xxh64_intdigest(word))
        return code

    def block(self, texts: Iterable[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
        """Codes of the words of every text, and the hash of every code."""
        if len(self) > CACHE_WORDS:
            self.reset()
        codes = [np.fromiter(map(self.__getitem__, words_of(text)), np.int32) for text in texts]
        return codes, np.array(self.known, np.uint64)


def marked_rows(words: np.ndarray, spans: np.ndarray, times: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words, spans and times with pairs cut at ``MOST_TIMES`` occurrences, and the rows with the first of each marked."""
    cuts = -(-times // MOST_TIMES)
    spans = np.add.reduceat(cuts, np.cumsum(spans) - spans)
    last = np.cumsum(cuts) - 1
    left = times - (cuts - 1) * MOST_TIMES
    words, times = np.repeat(words, cuts), np.full(int(cuts.sum()), MOST_TIMES)
    times[last] = left
    rows, first = rows.astype(np.int16), np.cumsum(times) - times
    rows[first] = ~rows[first]
    return words, spans, times, rows


def times_and_rows(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of every pair of a block and their rows, from rows with the first of each pair marked."""
    times = np.diff(np.append(np.flatnonzero(marked < 0), len(marked)))
    return times, np.where(marked < 0, ~marked, marked)


class Bucket:
    """All word pairs of one bucket with their training counts, merged over the blocks that sent them."""

    def __init__(self, rows: pa.Table):
        flat = lambda name: rows.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        context = np.repeat(flat("contexts"), flat("spans")).view(np.uint64)
        word = flat("words").view(np.uint64)
        with np.errstate(over="ignore"):
            pair = mix(context * _PRIME + word)
        _, example, self.pair = np.unique(pair, return_index=True, return_inverse=True)
        self.customers = np.bincount(self.pair, weights=flat("trained"), minlength=len(example)).astype(np.int64)
        self.words, self.word = np.unique(word[example], return_inverse=True)
        self.contexts, self.context = np.unique(context[example], return_inverse=True)

    def parts(self, rows: pa.Table, known: np.ndarray, base: np.ndarray, score: np.ndarray) -> Iterator[tuple]:
        """Per block: its rows and their sums of the three values of every pair."""
        marked = rows.column("rows").combine_chunks()
        edges, marked = marked.offsets.to_numpy(), marked.values.to_numpy(zero_copy_only=False)
        pairs = 0
        for k in range(rows.num_rows):
            times, at = times_and_rows(marked[edges[k] : edges[k + 1]])
            token = np.repeat(self.pair[pairs : pairs + len(times)], times)
            pairs += len(times)
            held, row = np.unique(at, return_inverse=True)
            yield held, *[np.bincount(row, weights=x[token]) for x in (known, base, score)]

    def seat(self, parent: np.ndarray, sweeps: int, kept: int, others: np.ndarray | None = None, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Mean tables of every pair and of every context over the last ``kept`` sweeps.

        ``parent`` is the parent's probability of every word; ``others`` has the tables
        that each context has in other buckets.
        """
        random = np.random.default_rng(seed)
        away = np.zeros(len(self.contexts)) if others is None else others
        tables = np.minimum(self.customers, 1)
        mean = np.zeros(len(tables))
        for turn in range(sweeps):
            total = np.bincount(self.context, weights=tables, minlength=len(self.contexts)) + away
            weight = (STRENGTH + DISCOUNT * total[self.context]) * parent[self.word]
            tables = draw_tables(self.customers, weight, DISCOUNT, random)
            if turn >= sweeps - kept:
                mean += tables / kept
        return mean, np.bincount(self.context, weights=mean, minlength=len(self.contexts)) + away


def encode_block(batch: pa.RecordBatch, numbers: WordCodes, buckets: int, hot: np.ndarray) -> Iterator[tuple]:
    """Per bucket: contexts, pairs of each, words, occurrences of each pair and their rows."""
    texts, hashes = numbers.block(text.as_py() for text in batch.column(1))
    sizes = numbers.lengths = np.array([len(own) + 1 for own in texts], np.int64)
    start = np.zeros(1, np.int32)
    stream = np.concatenate([part for own in texts for part in (start, own)] + [start])
    del texts
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    before, after = stream[:-1], stream[1:].copy()
    after[np.cumsum(sizes) - 1] = 1
    bucket = (mix(hashes) % np.uint64(buckets)).astype(np.int64)[before]
    spread = np.flatnonzero(is_hot(hashes, hot)[before])
    with np.errstate(over="ignore"):
        bucket[spread] = mix(hashes[before[spread]] * _PRIME + hashes[after[spread]]) % np.uint64(buckets)
    key = bucket
    for part in (before, after):
        key *= len(hashes)
        key += part
    del stream, before, after, bucket, spread
    order = np.argsort(key)
    key, row = key[order], row[order]
    del order
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    times = np.diff(np.append(first, len(key)))
    rest, pair_word = np.divmod(key[first], len(hashes))
    pair_bucket, pair_context = np.divmod(rest, len(hashes))
    pair_word = hashes[pair_word]
    edges = np.searchsorted(pair_bucket, np.arange(buckets + 1))
    starts = np.append(first, len(key))
    for b in range(buckets):
        i, j = edges[b], edges[b + 1]
        if i == j:
            continue
        own = pair_context[i:j]
        heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        yield b, hashes[own[heads]], np.diff(np.append(heads, j - i)), pair_word[i:j], times[i:j], row[starts[i] : starts[j]]


def word_pairs(docs: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, block = WordCodes(), TaskContext.get().partitionId() << 40
        kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int8()), pa.list_(pa.int16()))
        names = ["bucket", "block", "doc_ids", "lengths", "contexts", "spans", "words", "trained", "rows"]
        for whole in batches:
            for batch in slices(whole, 1, BLOCK_BYTES):
                ids = batch.column(0).to_pylist()
                training = in_training(ids).astype(np.int32)
                cells = list(encode_block(batch, numbers, buckets, hot))
                # one cell of a block, another one from block to block, carries the ids and lengths
                carrier = int(mix(np.array([block], np.uint64))[0]) % max(len(cells), 1)
                for k, (b, contexts, spans, words, times, rows) in enumerate(cells):
                    learnt = training[rows]
                    words, spans, times, rows = marked_rows(words, spans, times, rows)
                    trained = np.add.reduceat(learnt, np.cumsum(times) - times)
                    values = [b], [block], [ids if k == carrier else None], [numbers.lengths if k == carrier else None], [contexts.view(np.int64)], [spans], [words.view(np.int64)], [trained], [rows]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], names)
                block += len(ids)

    bounded_batches(docs.sparkSession, BLOCK_ROWS, "16m")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return source.mapInArrow(run, PAIRS)


def frequent_words(docs: DataFrame, buckets: int) -> np.ndarray:
    """Which cells of word hashes hold more than a quarter of a bucket's mean share, as a mask.

    Words fall into ``64 * buckets`` cells or somewhat more, so a heavy cell is one of a
    frequent word, and there are fewer than ``4 * buckets``. They only steer how work is dealt.
    The counts are those of all rows and do not depend on how these are partitioned.
    """
    cells, share = 1 << int(np.ceil(np.log2(64 * buckets))), 1 / (8 * buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, total = WordCodes(), np.zeros(cells, np.int64)
        for batch in batches:
            texts, words = numbers.block(text.as_py() for text in batch.column(0))
            counts = np.bincount(np.concatenate(texts), minlength=len(words)) if texts else np.zeros(len(words), np.int64)
            counts[0] = len(texts)
            total += np.bincount(word_cells(words, cells), weights=counts, minlength=cells).astype(np.int64)
        held = np.flatnonzero(total)
        cell, n = np.append(held, -1).astype(np.int32), np.append(total[held], total.sum())
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], ["cell", "n"])

    bounded_batches(docs.sparkSession, BLOCK_ROWS, "16m")
    counts = docs.select(text_bytes().alias("text")).mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    rows = {r.cell: r.n for r in counts.orderBy(F.desc("n"), "cell").limit(4 * buckets + 1).collect()}
    whole = rows.pop(-1, 0)
    mask = np.zeros(cells, bool)
    mask[[cell for cell, n in rows.items() if n > 2 * share * whole]] = True
    return mask


def score_texts(docs: DataFrame) -> DataFrame:
    """Scores of every row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null or empty text is its end token alone. Words are learnt from rows whose id's
    crc32 leaves a remainder other than 2 by 7; rows without an id are scored, have a null
    held_out and are not learnt from. Repeated rows count and are scored each on its own.
    An empty table gives no rows; without training rows every score is 0. Other columns
    are ignored.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    hot = frequent_words(docs, buckets)
    pairs = word_pairs(docs, buckets, hot)

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        bucket = Bucket(rows)
        per_word = np.bincount(bucket.word, weights=bucket.customers, minlength=len(bucket.words))
        tables, per_context = bucket.seat((per_word + 1) / (per_word.sum() + len(per_word) + 1), BURN_IN + 1, 1, None, key[0].as_py())
        spread = np.flatnonzero(is_hot(bucket.contexts, hot))
        customers = np.bincount(bucket.context, weights=bucket.customers, minlength=len(bucket.contexts))
        word_tables = np.bincount(bucket.word, weights=tables, minlength=len(bucket.words))
        kind = np.concatenate([np.full(len(per_word), WORD), np.full(len(spread), CONTEXT), [TOTALS]])
        return pa.table({
            "bucket": pa.array(np.full(len(kind), key[0].as_py()), pa.int32()), "kind": pa.array(kind, pa.int32()),
            "key": np.concatenate([bucket.words, bucket.contexts[spread], np.zeros(1, np.uint64)]).view(np.int64),
            "customers": np.concatenate([per_word, customers[spread], [0]]).astype(np.int64), "tables": np.concatenate([word_tables, per_context[spread], [0.0]]),
        })

    counts = pairs.groupBy("bucket").applyInArrow(count, COUNTS)
    merged = counts.groupBy("kind", "key").agg(F.sum("customers").alias("customers"), F.sum("tables").alias("tables"), F.collect_list("bucket").alias("buckets"))
    is_word = (F.col("kind") == WORD) & (F.col("customers") > 0)
    # the totals read every column of the merge, so that both uses share one exchange
    totals = merged.agg(
        F.max(F.size("buckets")).alias("most"),
        F.coalesce(F.sum(F.when(is_word, F.col("customers"))), F.lit(0)).alias("n"), F.count_if(is_word).alias("v"), F.coalesce(F.sum(F.when(is_word, F.col("tables"))), F.lit(0.0)).alias("t")
    )

    def parent(key: tuple, rows: pa.Table) -> pa.Table:
        # the order and the seed of a group depend on its words alone
        rows = rows.sort_by([("kind", "ascending"), ("key", "ascending")])
        word, v = rows.column("kind").to_numpy() == WORD, rows.column("v").to_numpy()
        customers = np.rint(rows.column("tables").to_numpy()).astype(np.int64) * word
        weight = (PARENT_STRENGTH + PARENT_DISCOUNT * v) / (v + 1)
        tables = draw_tables(customers, weight, PARENT_DISCOUNT, np.random.default_rng(key[0].as_py()))
        buckets_of = rows.column("buckets").cast(pa.list_(pa.int32()))
        rows = rows.drop_columns("cell").set_column(rows.schema.get_field_index("buckets"), "buckets", buckets_of)
        return rows.append_column("parents", pa.array(np.where(word, tables, 0).astype(np.float64)))

    cell = F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("cell")
    known = attach_row(merged, totals).select("kind", "key", "customers", "tables", "buckets", "n", "v", "t", cell)
    seated = known.groupBy("cell").applyInArrow(parent, "kind int, key long, customers long, tables double, buckets array<int>, n long, v long, t double, parents double")
    seated = attach_row(seated, seated.agg(F.coalesce(F.sum("parents"), F.lit(0.0)).alias("p")))
    new = (F.lit(PARENT_STRENGTH) + PARENT_DISCOUNT * F.col("p")) / (F.col("v") + 1)
    chance = (F.greatest(F.col("tables") - PARENT_DISCOUNT * F.col("parents"), F.lit(0.0)) + new) / (PARENT_STRENGTH + F.col("t"))
    value = F.when(F.col("kind") == CONTEXT, F.col("tables")).otherwise(chance)
    reply = seated.select(F.explode("buckets").alias("bucket"), "kind", "key", F.when(F.col("kind") == TOTALS, F.col("n")).otherwise(F.col("customers")).alias("customers"), value.alias("value"), "v")

    def score(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        bucket = Bucket(rows)
        kind, name = told.column("kind").to_numpy(), told.column("key").to_numpy().view(np.uint64)
        customers, value = told.column("customers").to_numpy(), told.column("value").to_numpy()
        n, v = int(customers[kind == TOTALS][0]), int(told.column("v")[0].as_py())
        of = lambda wanted, names: np.argsort(name[kind == wanted])[np.searchsorted(np.sort(name[kind == wanted]), names)]
        at = of(WORD, bucket.words)
        word_count, chance = customers[kind == WORD][at], value[kind == WORD][at]
        own = np.bincount(bucket.context, weights=bucket.customers, minlength=len(bucket.contexts))
        away, total = np.zeros(len(own)), own.copy()
        spread = np.flatnonzero(is_hot(bucket.contexts, hot))
        if len(spread):
            at = of(CONTEXT, bucket.contexts[spread])
            total[spread] = customers[kind == CONTEXT][at]
            mine = np.bincount(bucket.context, weights=np.minimum(bucket.customers, 1), minlength=len(own))
            away[spread] = np.maximum(value[kind == CONTEXT][at] * (1 - own[spread] / np.maximum(total[spread], 1)), 0) * (mine[spread] < value[kind == CONTEXT][at])
        tables, per_context = bucket.seat(chance, BURN_IN + SAMPLES, SAMPLES, away, key[0].as_py())
        context = bucket.context
        seen = np.maximum(bucket.customers - DISCOUNT * tables, 0)
        probability = (seen + (STRENGTH + DISCOUNT * per_context[context]) * chance[bucket.word]) / (STRENGTH + total[context])
        base = np.log10((word_count + 1) / (n + v + 1))[bucket.word]
        held, *sums = zip(*bucket.parts(rows, (word_count > 0)[bucket.word].astype(float), base, np.log10(probability)))
        n_known, base_score, scores = sums
        whole = lambda parts: pa.array([np.rint(x).astype(np.int32) for x in parts], pa.list_(pa.int32()))
        return pa.table({
            "bucket": rows.column("bucket"), "block": rows.column("block"), "doc_ids": rows.column("doc_ids"), "lengths": rows.column("lengths"), "rows": pa.array(held, pa.list_(pa.int16())), "n_known": whole(n_known),
            "base_score": pa.array(base_score, pa.list_(pa.float64())), "score": pa.array([x.astype(np.float32) for x in scores], pa.list_(pa.float32())), "train_tokens": np.full(rows.num_rows, n),
        })

    def merge(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("bucket")
        ids = rows.column("doc_ids").drop_null().combine_chunks().flatten()
        at = rows.column("rows").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        total = lambda name: np.bincount(at, weights=rows.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False), minlength=len(ids))
        return pa.table({
            "doc_id": ids, "n_tokens": rows.column("lengths").drop_null().combine_chunks().flatten().cast(pa.int64()), "n_known": total("n_known").astype(np.int64),
            "train_tokens": pa.array(np.full(len(ids), rows.column("train_tokens")[0].as_py())), "base_score": total("base_score"), "score": total("score"),
        })

    scored = pairs.groupBy("bucket").cogroup(reply.groupBy("bucket")).applyInArrow(score, PARTS)
    summed = scored.groupBy("block").applyInArrow(merge, SCORES)
    held_out = (F.crc32(F.col("doc_id").cast("string")) % 7 == 2).alias("held_out")
    return summed.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")
