"""Token-id files by an adaptive context-mixing range coder.

Documents are encoded, in ascending id order, into segments of consecutive documents. The
id stream of a segment is cut into blocks of ``BLOCK_IDS`` ids. Every block starts from a
fresh model and carries a CRC-32 of its ids, so that it can be read, checked or lost alone.

Within a block, an order-2 and an order-1 table propose the id that last followed the same
context. Their confidences pick adaptive counts for three events: the order-2 proposal, the
order-1 proposal, or neither; agreeing proposals mix their counts. After "neither" the id
is coded by order-0 counts of its four groups of four bits, each under the groups before it
(the last two share rows among ids that agree in the second group).

The events and each of the four groups are a stream of their own, with a range coder of its
own, as the counts of one group never depend on another's except through bits decoded
before. A block is the number of ids spelled in groups, the lengths of the group streams,
these streams and that of the events, all in 16-bit units.

All streams of a segment are coded side by side, one array element per stream and one symbol
per step, so the arithmetic runs in numpy without a Python step per symbol. The groups of a
block are decoded one id apart (the first group of an id with the second of the id before
it, and so on), so that they too go side by side.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer, pre_tokenizers

from flowguard.llm.common import bounded_batches, slices, spread, text_bytes

BLOCK_IDS = 2048
SLOTS = 2048
STATES = 4
RATE_UP = 32
LIMIT = 1 << 14
HALVE_EVERY = 128
SEGMENT_BYTES = 10 << 20
KNOWN_PARTS = 1 << 20
END_ID = 2

GROUPS = 4
_HEADER = 1 + GROUPS
_WHOLE, _LEAST = 1 << 48, 1 << 32

SEGMENTS = "part int, number int, doc_ids array<long>, lengths array<long>, crcs array<long>, sizes array<int>, payload binary"


class _Guesses:
    """Order-2 and order-1 proposals and the counts of their events, for every lane (block)."""

    def __init__(self, lanes: int):
        self.lane = np.arange(lanes)
        self.first_slot = np.arange(2 * lanes).reshape(2, lanes) * SLOTS
        self.tables = np.zeros(2 * lanes * SLOTS, np.int32)  # proposed id << 8 | confidence
        self.first_row = self.lane * (STATES * STATES)
        self.events = np.ones((lanes * STATES * STATES, 4), np.uint16)
        self.events[:, 2:] = 2, 0
        self.slots, self.upto = np.empty((2, lanes), np.int64), np.zeros((4, lanes), np.int64)

    def contexts(self, older: np.ndarray, last: np.ndarray) -> None:
        """Proposals after two ids, and the running counts of the events in ``upto``."""
        np.add(older * 40503, last * 31, out=self.slots[0])
        self.slots[1] = last
        self.slots &= SLOTS - 1
        self.slots += self.first_slot
        found = self.tables.take(self.slots)
        self.offers, self.sure = found >> 8, found & 255
        state = np.minimum(self.sure, STATES - 1)
        self.row = self.first_row + state[0] * STATES + state[1]
        counts = self.events.view(np.uint64)[:, 0].take(self.row).view(np.uint16).reshape(-1, 4)
        both = counts[:, 0] + counts[:, 1]
        self.upto[1] = np.where(self.offers[0] == self.offers[1], both, counts[:, 0])
        self.upto[2] = both
        np.add(both, counts[:, 2], out=self.upto[3])

    def learn(self, ids: np.ndarray, event: np.ndarray, step: int) -> None:
        place = self.row * 4 + event
        flat = self.events.reshape(-1)
        flat[place] = flat.take(place) + np.uint16(RATE_UP)
        confidence = np.minimum(self.sure + 1, 200) * (self.offers == ids)
        self.tables[self.slots] = (ids << 8) + confidence
        if step % HALVE_EVERY == HALVE_EVERY - 1:
            full = np.flatnonzero(self.events.sum(axis=1) > LIMIT)
            self.events[full, :3] = self.events[full, :3] >> 1 | 1


class _Groups:
    """Order-0 counts of the four groups of bits, as running counts of 16 symbols a row."""

    ROWS = np.array([1, 16, 16, 256])
    FRESH = np.arange(1, 17, dtype=np.uint16)
    #: Added to a row after symbol s.
    MORE = (np.arange(16)[None, :] >= np.arange(16)[:, None]).astype(np.uint16) * np.uint16(RATE_UP)

    def __init__(self, lanes: int):
        self.counts = np.tile(self.FRESH, (lanes * int(self.ROWS.sum()), 1))
        self.packed = self.counts.view("V32")[:, 0]
        self.more = self.MORE.view("V32")[:, 0]
        edges = np.concatenate([[0], np.cumsum(self.ROWS * lanes)])
        self.areas = [slice(a, b) for a, b in zip(edges, edges[1:])]
        #: First row of every lane and group.
        self.base = (edges[:-1] + np.arange(lanes)[:, None] * self.ROWS).reshape(-1)
        self.own = np.arange(lanes * GROUPS) * 16

    @staticmethod
    def above(symbols: np.ndarray, second: np.ndarray) -> np.ndarray:
        """For four symbols in the bytes of a number, lowest first, the row each has in its group.

        ``second`` holds in the same way the second symbol of the id whose fourth is coded.
        """
        return (symbols << np.uint32(8)) + ((second & np.uint32(0xFF00)) << np.uint32(20))

    def rows(self, at: np.ndarray) -> np.ndarray:
        return self.packed.take(at).view(np.uint16)

    def bounds(self, rows: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts below and up to the symbol, of rows just taken."""
        place = self.own[: len(symbol)] + symbol
        upto = rows.take(place)
        place -= 1
        return rows.take(place) * (symbol > 0), upto

    def learn(self, at: np.ndarray, rows: np.ndarray, symbol: np.ndarray) -> None:
        more = self.more.take(symbol).view(np.uint16)
        more += rows
        self.packed.put(at, more.view("V32"))

    def age(self, area: slice) -> None:
        """Halve the full rows of a group."""
        counts = self.counts[area]
        full = np.flatnonzero(counts[:, 15] > LIMIT)
        single = np.diff(counts[full].astype(np.int64), axis=1, prepend=0) >> 1 | 1
        counts[full] = np.cumsum(single, axis=1)


class _Encoder:
    """Range coder of every stream, with 16-bit output units; carries are settled at the end."""

    def __init__(self, streams: int, steps: int):
        self.low = np.zeros(streams, np.int64)
        self.range = np.full(streams, _WHOLE)
        self.out = np.zeros((steps + 3) * streams, np.int32)
        self.next = np.arange(streams)
        self.streams = streams

    def put(self, below: np.ndarray, upto: np.ndarray, total: np.ndarray) -> None:
        """Code a symbol of each of the first streams, as many as the arrays are long."""
        n = len(total)
        low, width = self.low[:n], self.range[:n]
        step = width // total
        low += step * below
        np.multiply(step, upto - below, out=width)
        move = (width < _LEAST).nonzero()[0]
        if len(move):
            at, place = low.take(move), self.next.take(move)
            self.out[place] = at >> 32
            self.next[move] = place + self.streams
            low[move] = (at & (_LEAST - 1)) << 16
            width[move] = width.take(move) << 16

    def finish(self) -> list[np.ndarray]:
        """The units of every stream; whatever units follow them, they read the same."""
        low = self.low + 0xFFFF
        for unit in (low >> 32, low >> 16 & 0xFFFF):
            self.out[self.next] = unit
            self.next += self.streams
        used = self.next // self.streams
        units = self.out.reshape(-1, self.streams)[: int(used.max(initial=0))]
        while (carry := units >> 16).any():
            units &= 0xFFFF
            units[:-1] += carry[1:]
        units = units.T.astype("<u2")
        return [row[:n] for row, n in zip(units, used.tolist())]


class _Decoder:
    """Reads what ``_Encoder`` wrote, stream by stream."""

    def __init__(self, units: np.ndarray, first: np.ndarray):
        self.units, self.first = units, first
        self.next, self.code, self.range = (np.zeros(first.shape, np.int64) for _ in range(3))
        self.restart(slice(None))

    def restart(self, streams) -> None:
        at = self.first[streams]
        units = [self.units.take(at + i, mode="clip").astype(np.int64) for i in range(3)]
        self.code[streams] = units[0] << 32 | units[1] << 16 | units[2]
        self.next[streams], self.range[streams] = at + 3, _WHOLE

    def value(self, total: np.ndarray) -> np.ndarray:
        """Where each of the first streams stands among its counts."""
        n = len(total)
        self.step = self.range[:n] // total
        return self.code[:n] // self.step

    def take(self, below: np.ndarray, upto: np.ndarray) -> None:
        n = len(upto)
        code, width = self.code[:n], self.range[:n]
        code -= self.step * below
        np.multiply(self.step, upto - below, out=width)
        move = (width < _LEAST).nonzero()[0]
        if len(move):
            place = self.next.take(move)
            code[move] = (code.take(move) << 16) + self.units.take(place, mode="clip")
            self.next[move] = place + 1
            width[move] = width.take(move) << 16


def _lanes(total: int) -> tuple[int, np.ndarray]:
    lanes = -(-total // BLOCK_IDS)
    sizes = np.full(lanes, BLOCK_IDS, np.int64)
    if lanes:
        sizes[-1] = total - (lanes - 1) * BLOCK_IDS
    return lanes, sizes


def _live(sizes: np.ndarray, steps: int) -> list[int]:
    """For every step, how many of the lanes, longest first, are longer than it."""
    return (len(sizes) - np.searchsorted(sizes[::-1], np.arange(steps), "right")).tolist()


def _spell(spelled: np.ndarray, numbers: np.ndarray) -> list[list[np.ndarray]]:
    """Streams of the four groups of every lane; ``spelled`` holds the ids, lane after lane."""
    lanes, steps = len(numbers), int(numbers.max())
    order = np.argsort(-numbers, kind="stable")
    grid = np.zeros((lanes, steps), np.uint32)
    grid[np.arange(steps) < numbers[:, None]] = spelled
    grid = np.ascontiguousarray(grid[order].T)
    symbols = grid >> 12 | (grid >> 8 & 15) << 8 | (grid >> 4 & 15) << 16 | (grid & 15) << 24
    above = _Groups.above(symbols, symbols).view(np.uint8)
    symbols = symbols.view(np.uint8)
    model, coder = _Groups(lanes), _Encoder(lanes * GROUPS, steps)
    for t, live in enumerate(_live(numbers[order], steps)):
        n = live * GROUPS
        symbol = symbols[t, :n]
        at = model.base[:n] + above[t, :n]
        rows = model.rows(at)
        coder.put(*model.bounds(rows, symbol), rows[15::16])
        model.learn(at, rows, symbol)
        if t % HALVE_EVERY == HALVE_EVERY - 1:
            for area in model.areas:
                model.age(area)
    units = coder.finish()
    streams: list[list[np.ndarray]] = [[]] * lanes
    for i, lane in enumerate(order.tolist()):
        streams[lane] = units[i * GROUPS : (i + 1) * GROUPS]
    return streams


def _read_spelled(units: np.ndarray, first: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The ids whose group streams begin at ``first`` (lanes by groups), lane after lane."""
    lanes, steps = len(numbers), int(numbers.max())
    order = np.argsort(-numbers, kind="stable")
    model, coder = _Groups(lanes), _Decoder(units, first[order].reshape(-1))
    lag = GROUPS - 1
    found = np.zeros((steps + lag, lanes * GROUPS), np.uint8)
    last = before = np.zeros(lanes, np.uint32)
    live_at = _live(numbers[order], steps)
    for t, live in enumerate(live_at[:1] * lag + live_at):
        # group g is at id t - g: past the end of a lane it reads symbols that are left out
        n = live * GROUPS
        at = model.base[:n] + model.above(last[:live], before[:live]).view(np.uint8)
        rows = model.rows(at)
        value = coder.value(rows[15::16]).astype(np.uint16).astype(np.uint64)
        copies = np.repeat(value * np.uint64(0x0001000100010001), 4).view(np.uint16)
        passed = np.packbits(rows <= copies, bitorder="little").view("<u2")
        symbol = np.bitwise_count(passed & np.uint16(0x7FFF))
        coder.take(*model.bounds(rows, symbol))
        model.learn(at, rows, symbol)
        if (g := (t + 1) % HALVE_EVERY) < GROUPS and t >= HALVE_EVERY - 1:
            model.age(model.areas[g])
        before, last = last, symbol.view(np.uint32)
        found[t, :n] = symbol
        if t < lag:
            # the later groups have no id yet
            for g in range(t + 1, GROUPS):
                coder.restart(slice(g, None, GROUPS))
                model.counts[model.areas[g]] = model.FRESH
    found = found.reshape(-1, lanes, GROUPS)
    ids = found[:steps, :, 0].astype(np.int32)
    for g in range(1, GROUPS):
        ids <<= 4
        ids |= found[g : g + steps, :, g]
    grid = np.empty((lanes, steps), np.int32)
    grid[order] = ids.T
    return grid[np.arange(steps) < numbers[:, None]]


def encode_ids(ids: np.ndarray) -> tuple[list[int], np.ndarray, bytes]:
    """CRC-32 of the ids of every block, 16-bit units of every block, and the coded blocks."""
    lanes, sizes = _lanes(len(ids))
    if not lanes:
        return [], np.zeros(0, np.int64), b""
    plain = np.asarray(ids).astype("<u4")
    crcs = [zlib.crc32(plain[i * BLOCK_IDS : (i + 1) * BLOCK_IDS].tobytes()) for i in range(lanes)]
    grid = np.zeros(lanes * BLOCK_IDS, np.int32)
    grid[: len(ids)] = ids
    columns = np.ascontiguousarray(grid.reshape(lanes, BLOCK_IDS).T)
    events = np.zeros((BLOCK_IDS, lanes), np.uint8)
    steps = int(sizes.max())
    model, coder = _Guesses(lanes), _Encoder(lanes, steps)
    last = older = np.zeros(lanes, np.int64)
    for t, live in enumerate(_live(sizes, steps)):
        model.contexts(older, last)
        older, last = last, columns[t].astype(np.int64)
        event = np.where(last == model.offers[0], 0, np.where(last == model.offers[1], 1, 2))
        events[t] = event
        place = event * lanes + model.lane
        below, upto = model.upto.take(place), model.upto.take(place + lanes)
        coder.put(below[:live], upto[:live], model.upto[3, :live])
        model.learn(last, event, t)
    chosen = events.T.reshape(-1)
    chosen[len(ids) :] = 0
    chosen = chosen == 2
    numbers = chosen.reshape(lanes, BLOCK_IDS).sum(axis=1)
    if numbers.any():
        groups = _spell(grid[chosen], numbers)
    else:
        groups = [[np.zeros(0, "<u2")] * GROUPS] * lanes
    blocks = []
    for number, own, event_units in zip(numbers.tolist(), groups, coder.finish()):
        blocks.append(np.concatenate([np.array([number, *map(len, own)], "<u2"), *own, event_units]))
    return crcs, np.fromiter(map(len, blocks), np.int64, lanes), b"".join(b.tobytes() for b in blocks)


def decode_ids(total: int, crcs: list[int], units: np.ndarray, payload: bytes) -> np.ndarray:
    """The ids of a segment; raises ``ValueError`` when a block does not match its checksum."""
    lanes, sizes = _lanes(total)
    if not lanes:
        return np.zeros(0, np.int32)
    data, lengths = np.frombuffer(payload, "<u2").astype(np.int32), np.asarray(units, np.int64)
    begin = np.cumsum(lengths) - lengths
    header = data.take(begin[:, None] + np.arange(_HEADER), mode="clip").astype(np.int64)
    numbers = header[:, 0]
    first = begin[:, None] + _HEADER + np.cumsum(header[:, 1:], axis=1)
    for i in np.flatnonzero((numbers > sizes) | (first[:, -1] > begin + lengths)):
        raise ValueError(f"block {i} does not match its checksum")
    spelled = _read_spelled(data, first - header[:, 1:], numbers) if numbers.any() else np.zeros(0, np.int32)
    spelled = np.append(spelled, np.int32(0))
    columns = np.zeros((BLOCK_IDS, lanes), np.int32)
    model, coder = _Guesses(lanes), _Decoder(data, first[:, -1].copy())
    following = np.cumsum(numbers) - numbers
    last = older = np.zeros(lanes, np.int64)
    for t in range(int(sizes.max())):
        # past its end a lane reads ids that are left out
        model.contexts(older, last)
        value = coder.value(model.upto[3])
        spells = value >= model.upto[2]
        event = (value >= model.upto[1]) + spells.astype(np.int64)
        place = event * lanes + model.lane
        coder.take(model.upto.take(place), model.upto.take(place + lanes))
        now = np.where(spells, spelled.take(following, mode="clip"), model.offers.take(place - spells * lanes))
        following += spells
        model.learn(now, event, t)
        older, last = last, now
        columns[t] = now
    ids = np.ascontiguousarray(columns.T).reshape(-1)[:total]
    plain = ids.astype("<u4")
    for i in range(lanes):
        if zlib.crc32(plain[i * BLOCK_IDS : (i + 1) * BLOCK_IDS].tobytes()) != crcs[i]:
            raise ValueError(f"block {i} does not match its checksum")
    return ids


#: Letters that NFC leaves alone, and signs that join no letter before them.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = rf"^(?P<stem>[{_LETTERS}]+)(?P<sign>[!-&(-/:-@\[-`{{-~]*)$"
_TOGETHER = 500


def _letters_only(tokenizer: Tokenizer) -> Tokenizer | None:
    """The same vocabulary for lower-case words of letters alone, without its normaliser and
    splitter, which leave such words as they are; None if these do anything else."""
    spec = json.loads(tokenizer.to_str())
    normalisers = [(n["type"], n.get("content")) for n in (spec["normalizer"] or {}).get("normalizers", [])]
    splitters = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    if (
        normalisers != [("NFC", None), ("Replace", " "), ("Lowercase", None)]
        or [s["type"] for s in splitters] != ["Split", "ByteLevel"]
        or splitters[0]["pattern"] != {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
        or spec["model"].get("end_of_word_suffix") != "</w>"
        or spec["post_processor"] is not None
    ):
        return None
    letters = Tokenizer(tokenizer.model)
    byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)
    letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), byte_level])
    return letters


class WordEncoder:
    """Ids of whole texts, a few library calls for the words not met before.

    The vocabulary's normaliser and splitter never join characters across white space, so
    the ids of a text are those of its words in order. A word of letters and signs after
    them has the ids of both parts. The ids of such parts, in lower case, and those of other
    words are remembered.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids above 65,535 need wider symbols")
        self.letters = _letters_only(self.tokenizer)
        self.ends_word = np.zeros(1 << 16, bool)
        self.ends_word[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.reset()

    def reset(self) -> None:
        self.parts = pa.array([""], pa.large_string())
        self.flat, self.sizes = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _add(self, parts: pa.Array, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.parts = pa.concat_arrays([self.parts, parts])
        self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])

    def _encode(self, parts: pa.Array) -> None:
        texts = [p.decode("utf-8", "replace") for p in parts.cast(pa.large_binary()).to_pylist()]
        coded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(coded), np.int32)
        self._add(parts, flat, np.fromiter(map(len, coded), np.int64, len(coded)))

    def _encode_letters(self, parts: pa.Array) -> None:
        edges = np.append(np.arange(0, len(parts), _TOGETHER), len(parts))
        lines = pc.binary_join(pa.ListArray.from_arrays(edges.astype(np.int32), parts), pa.scalar(" ", pa.large_string()))
        coded = [e.ids for e in self.letters.encode_batch_fast(lines.to_pylist(), add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(coded), np.int32)
        ends = np.flatnonzero(self.ends_word[flat])
        if len(ends) == len(parts):
            self._add(parts, flat, np.diff(ends, prepend=-1))
        else:
            self._encode(parts)

    def _numbers(self, parts: pa.Array) -> np.ndarray:
        """The number of every part, met before or not."""
        coded = parts.dictionary_encode()
        numbers = pc.index_in(coded.dictionary, self.parts)
        fresh = np.flatnonzero(numbers.is_null().to_numpy(zero_copy_only=False))
        numbers = numbers.fill_null(0).to_numpy().copy()
        if len(fresh):
            words = coded.dictionary.take(pa.array(fresh))
            plain = np.zeros(len(fresh), bool)
            if self.letters:
                plain = pc.match_substring_regex(words, f"^[{_LETTERS}]+$").to_numpy(zero_copy_only=False)
            numbers[np.concatenate([fresh[plain], fresh[~plain]])] = len(self.parts) + np.arange(len(fresh))
            if plain.any():
                self._encode_letters(words.filter(pa.array(plain)))
            if not plain.all():
                self._encode(words.filter(pa.array(~plain)))
        return numbers[coded.indices.to_numpy()]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (binary) after one another, an end id after each, and their numbers."""
        if len(self.parts) > KNOWN_PARTS:
            self.reset()
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string(), safe=False))
        edges, words = split.offsets.to_numpy(), split.flatten().dictionary_encode()
        distinct = words.dictionary
        stems, signs = distinct, pa.repeat(pa.scalar("", pa.large_string()), len(distinct))
        if self.letters:
            found = pc.extract_regex(distinct, _PLAIN)
            signs = pc.fill_null(pc.struct_field(found, "sign"), "")
            stems = pc.coalesce(pc.utf8_lower(pc.struct_field(found, "stem")), distinct)
        # a word has two parts; white space at an end of a text gives empty words, which have no ids
        parts = self._numbers(pa.concat_arrays([stems, signs])).reshape(2, -1)
        parts = parts.T[words.indices.to_numpy()].reshape(-1)
        sizes = self.sizes.take(parts)
        stop = np.cumsum(sizes)
        source = np.repeat(((np.cumsum(self.sizes) - self.sizes).take(parts) - (stop - sizes)), sizes)
        source += np.arange(len(source))
        upto = np.concatenate([[0], stop])[2 * (edges - edges[0])]
        return np.insert(self.flat.take(source), upto[1:], END_ID), np.diff(upto) + 1


@lru_cache(1)
def word_encoder(path: str) -> WordEncoder:
    """The encoder of a vocabulary, kept for later tasks of the same process."""
    return WordEncoder(path)


def encode_segments(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Segments of coded ids, documents in ascending id order (null ids first).

    A segment holds consecutive documents of about ``SEGMENT_BYTES`` of text; ``part`` and
    ``number`` order the segments. Write it with any Spark writer that keeps binary columns.
    """

    def coded(batches: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        docs = pa.Table.from_batches(batches).combine_chunks()
        ids, lengths = word_encoder(tokenizer_path).ids(docs.column(1).combine_chunks())
        crcs, units, payload = encode_ids(ids)
        row = [[TaskContext.get().partitionId()], [number], [docs.column(0).to_pylist()], [lengths], [crcs], [units], [payload]]
        kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
        names = ["part", "number", "doc_ids", "lengths", "crcs", "sizes", "payload"]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sizes, number = [], [], 0
        for whole in batches:
            for batch in slices(whole, 1, SEGMENT_BYTES // 4):
                held.append(batch)
                sizes.append(batch.column(1).nbytes)
                # a segment goes once half another one follows, as a small one takes as many steps
                while len(held) > 1 and sum(sizes) >= SEGMENT_BYTES * 3 // 2:
                    whole_ones = max(1, int(np.searchsorted(np.cumsum(sizes), SEGMENT_BYTES, "right")))
                    yield coded(held[:whole_ones], number)
                    held, sizes, number = held[whole_ones:], sizes[whole_ones:], number + 1
        if held:
            yield coded(held, number)

    spark = docs.sparkSession
    bounded_batches(spark, 2000, "4m")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return source.repartitionByRange(spread(spark), "doc_id").sortWithinPartitions("doc_id").mapInArrow(run, SEGMENTS)


def read_documents(segments: DataFrame) -> DataFrame:
    """Decode segments: doc_id, start, n_tokens and ids_crc32 of every document.

    ``start`` counts the ids of all documents before it in file order. A block that fails
    its checksum stops the job with an error that names it.
    """
    totals = segments.select("part", "number", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))
    earlier = lambda window: F.coalesce(F.sum("total").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row per part, as many as the session has shuffle partitions
    parts = totals.groupBy("part").agg(F.sum("total").alias("total")).select("part", earlier(Window.orderBy("part")).alias("first"))
    within = totals.select("part", "number", earlier(Window.partitionBy("part").orderBy("number")).alias("local_first"))
    offsets = within.join(parts, "part").select("part", "number", (F.col("first") + F.col("local_first")).alias("offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, number, doc_ids, lengths, crcs, sizes, payload = (batch.column(c)[i].as_py() for c in range(7))
                lengths = np.array(lengths, np.int64)
                ids = decode_ids(int(lengths.sum()), crcs, np.array(sizes), payload).astype("<u4")
                stop = np.cumsum(lengths)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(stop - lengths, stop)]
                n = len(lengths)
                columns = (([part] * n, pa.int32()), ([number] * n, pa.int32()), (doc_ids, pa.int64()), (stop - lengths, pa.int64()), (lengths, pa.int64()), (crc, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in columns], ["part", "number", "doc_id", "local", "n_tokens", "ids_crc32"])

    found = segments.mapInArrow(run, "part int, number int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return found.join(offsets, ["part", "number"]).select("doc_id", (F.col("offset") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
