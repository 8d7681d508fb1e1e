"""Labelled flow datasets in CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowguard import vocabulary as V
from flowguard.functions.features import extract_label, normalize_labels, resolve_base_features, strip_column_names, with_features
from flowguard.functions.scalar import finite, number


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV, all columns as text, names stripped."""
    return strip_column_names(spark.read.csv(path, header=True))


def load_training(spark: SparkSession, path: str, extended: bool = True) -> DataFrame:
    """Features, integer label ``y`` and ``row_id``, a hash of the row that no file layout changes."""
    raw = read_features(spark, path)
    if not any(n in raw.columns for n in V.LABEL_COLUMNS):
        raise ValueError("training data needs a label column")
    numbered = raw.withColumn("row_id", F.xxhash64(*[F.col(f"`{c}`") for c in raw.columns]))
    labelled = extract_label(_typed_label(numbered))
    features = with_features(resolve_base_features(labelled), extended)
    names = V.FEATURES if extended else V.BASE_FEATURES
    return features.select("row_id", *names, "y")


def load_inference(spark: SparkSession, path: str, extended: bool = True) -> DataFrame:
    """Features only."""
    raw = read_features(spark, path)
    rest = extract_label(raw)
    features = with_features(resolve_base_features(rest), extended)
    return features.select(*(V.FEATURES if extended else V.BASE_FEATURES))


def _typed_label(df: DataFrame) -> DataFrame:
    """A label column of numbers only reads as numbers, as an inferring reader would have it."""
    name = next(n for n in V.LABEL_COLUMNS if n in df.columns)
    text = F.col(f"`{name}`")
    bad = df.where(text.isNotNull() & number(text, True).isNull()).limit(1)
    return df if bad.count() else df.withColumn(name, number(text, True))


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The separator of the header line."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0].value if first else ""
    return ";" if line.count(";") > line.count(",") else ","


def read_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Comma, else semicolon; blanks after separators skipped."""
    return spark.read.csv(
        path, header=header, sep=sniff_delimiter(spark, path), ignoreLeadingWhiteSpace=True
    )


def _number_or_zero(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(0.0)
    is_text = isinstance(df.schema[name].dataType, T.StringType)
    return F.coalesce(finite(number(F.col(f"`{name}`"), is_text)), F.lit(0.0))


def standardise_flows(df: DataFrame) -> DataFrame:
    """flow columns by name."""
    df = strip_column_names(df)
    label = F.col("Label").cast("string") if "Label" in df.columns else F.lit("BENIGN")
    return df.select(
        *[_number_or_zero(df, raw).alias(name) for raw, name in V.RAW_FLOW_COLUMNS.items()], label.alias("label")
    )


def standardise_positional(df: DataFrame) -> DataFrame:
    """flow columns by position."""
    # Position of each base feature; the label is last.
    places = {"connections": 1, "bytes": 7, "packets": 16, "packet_size": 7, "ports": 3}
    return df.select(
        *[_number_or_zero(df, df.columns[i]).alias(name) for name, i in places.items()],
        F.col(f"`{df.columns[-1]}`").cast("string").alias("label"),
    )


def dataset_kind(columns: list[str]) -> str | None:
    """which standard form a header leads to."""
    if "Flow Duration" in [c.strip() for c in columns]:
        return "flows"
    return "positional" if len(columns) > 40 else None


def list_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> list[str]:
    """File names only; nothing is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return sorted(r.path for r in files.select("path").collect())


def load_datasets(spark: SparkSession, folder: str) -> DataFrame:
    """All recognised CSV files of a folder in one table.

    Files are grouped by format, separator and header, and each group is one read.
    Headerless files keep their first row as data.
    """
    groups: dict[tuple, list[str]] = {}
    for path in list_files(spark, folder):
        first = read_csv(spark, path, header=False).limit(1).collect()
        head = tuple(str(x) for x in first[0]) if first else ()
        kind = dataset_kind(list(head))
        if kind is not None:
            shape = head if kind == "flows" else len(head)
            groups.setdefault((kind, sniff_delimiter(spark, path), shape), []).append(path)
    parts = []
    for (kind, sep, _), paths in groups.items():
        frame = spark.read.csv(paths, header=kind == "flows", sep=sep, ignoreLeadingWhiteSpace=True)
        parts.append(standardise_flows(frame) if kind == "flows" else standardise_positional(frame))
    if not parts:
        raise RuntimeError(f"no recognised dataset in {folder}")
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def prepare_dataset(df: DataFrame) -> DataFrame:
    """Binary target and derived features."""
    return with_features(normalize_labels(df))
