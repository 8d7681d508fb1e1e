"""Helpers shared by the operators: table access, words, written stages, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CACHE_WORDS = 400_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 2000, size: str = "16m") -> None:
    """Arrow batches that stay small however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back.

    Later steps start from the files, so a lost executor costs a reread and not a
    recomputation. Each call takes a folder of its own.
    """
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def spread(spark: SparkSession, least: int = 1) -> int:
    """Partitions for a keyed shuffle: the session's setting."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text, null as empty; tasks then skip decoding."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, UPPER.lower())


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lowered.

    ``bytes.split`` and ``bytes.lower`` use exactly these ASCII classes.
    """
    return text.lower().split()


class WordHashes(dict):
    """64-bit hash of each word, remembered up to a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(values: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of unsigned 64-bit values."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return values ^ (values >> np.uint64(32))


def shingles_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of a word sequence.

    A sequence of fewer words is one shingle as a whole; no words give none.
    """
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    with np.errstate(over="ignore"):
        value = np.full(n - width + 1, width, dtype=np.uint64)
        for i in range(width):
            value = mix(value * np.uint64(0x100000001B3) + hashes[i : n - width + 1 + i])
    return np.unique(value)


def slices(batch: pa.RecordBatch, column: int, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose binary column holds about ``size`` bytes."""
    lengths = np.array([len(v.as_buffer()) if v.is_valid else 0 for v in batch.column(column)]) if batch.num_rows else np.zeros(0)
    start = total = 0
    for i, length in enumerate(lengths):
        total += length
        if total >= size:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)
