"""Token counts per section by offset-mapped attribution.

A document is encoded once as a whole. The byte spans of its tokens, known from the lengths
of the vocabulary entries, are joined to the spans of its sections. A token that crosses a
boundary counts for the section that holds most of its bytes, the earlier one on a tie;
bytes outside all sections compete as a section of their own that is not reported.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.llm.common import bounded_batches

COUNTS = "doc_id long, section int, start int, end int, n_tokens int, n_crossing int"


def load_encoding(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """Encoding of a rank file, and the bytes of every id."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def line_spans(text: str) -> list[tuple[int, int]]:
    """Lines of a text with their line ends, as code-point spans; an empty text has none."""
    spans, start = [], 0
    while start < len(text):
        stop = text.find("\n", start) + 1 or len(text)
        spans.append((start, stop))
        start = stop
    return spans


def byte_offsets(text: str, encoded: bytes, points: np.ndarray) -> np.ndarray:
    """Byte offsets of code-point offsets."""
    if len(encoded) == len(text):
        return points
    first = np.flatnonzero((np.frombuffer(encoded, np.uint8) & 0xC0) != 0x80)
    return np.append(first, len(encoded))[points]


def attribute(sizes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and boundary-crossing tokens of every section.

    ``sizes`` are the bytes of the tokens in order; ``starts`` and ``ends`` are sorted,
    disjoint byte spans of the sections. A crossing token is counted once, in its section.
    """
    n = len(starts)
    counts, crossing = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not len(sizes) or not n:
        return counts, crossing
    # strips alternate: gap before section 0, section 0, gap, section 1, ..., rest
    edges = np.stack([starts, ends], axis=1).ravel()
    stop = np.cumsum(sizes)
    begin = stop - sizes
    first, last = np.searchsorted(edges, begin, "right"), np.searchsorted(edges, stop - 1, "right")
    whole = first == last
    strips = np.bincount(first[whole], minlength=2 * n + 1)
    over = np.zeros(2 * n + 1, np.int64)
    limits = np.concatenate([[0], edges, [stop[-1]]])
    for i in np.flatnonzero(~whole):
        touched = np.arange(first[i], last[i] + 1)
        held = np.minimum(limits[touched + 1], stop[i]) - np.maximum(limits[touched], begin[i])
        strip = touched[np.argmax(held)]
        if (held > 0).sum() > 1:
            over[strip] += 1
        strips[strip] += 1
    return strips[1::2], over[1::2]


def section_counts(docs: DataFrame, vocabulary: str, pattern: str, sections: str | None = None) -> DataFrame:
    """Token counts of every section: doc_id, section, start, end, n_tokens, n_crossing.

    ``vocabulary`` is the path of a rank file and ``pattern`` its splitting pattern.
    ``sections`` names a column of structs (start, end) in code points, sorted and
    disjoint; without it sections are the lines, line ends included. Sections are numbered
    from 0. Texts that are null or empty, and rows without sections, give no rows; repeated
    and null ids are counted like any other; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = load_encoding(vocabulary, pattern)
        for batch in batches:
            columns = [[] for _ in range(6)]
            for doc_id, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                text = text.as_py() or ""
                chosen = line_spans(text) if sections is None else [(s["start"], s["end"]) for s in spans or []]
                if not text or not chosen:
                    continue
                encoded = text.encode()
                points = np.minimum(np.array(chosen, dtype=np.int64), len(text))
                at = byte_offsets(text, encoded, points)
                counts, crossing = attribute(lengths[encoding.encode_to_numpy(text, disallowed_special=())], at[:, 0], at[:, 1])
                for column, values in zip(columns, (np.full(len(points), -1 if doc_id is None else doc_id), np.arange(len(points)), points[:, 0], points[:, 1], counts, crossing)):
                    column.append(values)
                if doc_id is None:
                    columns[0][-1] = np.ma.masked_all(len(points), np.int64)
            arrays = []
            for k, column in enumerate(columns):
                kind = pa.int64() if k == 0 else pa.int32()
                values = np.ma.concatenate(column) if column else np.zeros(0, np.int64)
                arrays.append(pa.array(np.ma.getdata(values), pa.int64(), mask=np.ma.getmaskarray(values)).cast(kind))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    bounded_batches(docs.sparkSession)
    spans = F.lit(None).cast("array<struct<start:int,end:int>>") if sections is None else F.col(sections)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", spans.alias("sections")).mapInArrow(run, COUNTS)
