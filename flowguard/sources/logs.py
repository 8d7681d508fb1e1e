"""Raw text sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str | list[str], line_numbers: bool = False) -> DataFrame:
    """One row per line with its file and, on request, its line number.

    Numbers count within a file, blank lines included. Each split counts its own
    lines; the lines of earlier splits of the file come from a table with one row
    per split, so nothing passes through the driver.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("source_path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    if not line_numbers:
        return lines.select("value", "source_path", F.struct("_block", "_row").alias("read_order"))
    splits = lines.groupBy("source_path", "_block").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("source_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "source_path", "_block", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    return lines.join(offsets, ["source_path", "_block"]).select(
        "value",
        "source_path",
        (F.col("_before") + F.col("_row") - F.col("_first") + 1).alias("line_number"),
    )


def stream_lines(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Lines of the files that land in a folder; rotated files stay as they are."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(folder)
