"""Labels and text search over columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowguard import vocabulary as V

LABELS = {
    "attack_type": V.ATTACK_LABELS,
    "risk_level": V.RISK_LABELS,
    "final_label": V.FINAL_LABELS,
    "decision_source": V.SOURCE_LABELS,
}


def title_words(value: Column) -> Column:
    """``snake_case`` as words with a capital first letter."""
    words = F.filter(F.split(F.coalesce(value, F.lit("unknown")), "_"), lambda w: w != "")
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " "
    )


def label(value: Column, kind: str) -> Column:
    """display label; technical names are matched as they are."""
    table = V.TECHNICAL_LABELS if kind == "technical" else LABELS[kind]
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    key = value if kind == "technical" else F.lower(F.trim(F.coalesce(value, F.lit("unknown"))))
    return F.coalesce(F.try_element_at(known, key), title_words(value))


def _folding() -> dict[str, str]:
    """Letters whose canonical decomposition starts with another letter, by rule, and that letter."""
    pairs = {}
    for code in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(unicodedata.combining(c) for c in parts[1:]):
            pairs[chr(code)] = parts[0]
    return pairs


ACCENTED = _folding()
MARKS = "".join(chr(c) for c in range(0x300, 0x370))


def fold(text: str) -> str:
    """Text without accents and case."""
    return text.translate(str.maketrans({**ACCENTED, **dict.fromkeys(MARKS, "")})).lower()


def folded(value: Column) -> Column:
    """The same for a column; texts of plain letters are only lowered."""
    plain = F.translate(value, "".join(ACCENTED) + MARKS, "".join(ACCENTED.values()))
    return F.lower(F.when(F.octet_length(value) == F.char_length(value), value).otherwise(plain))


def contains_text(value: Column, query: str) -> Column:
    """F16: accent- and case-insensitive contains; an empty query matches all."""
    if not query.strip():
        return F.lit(True)
    return F.contains(folded(F.coalesce(value.cast("string"), F.lit(""))), F.lit(fold(query)))


def plain_text(value: Column, kind: T.DataType) -> list[Column]:
    """Texts of a value and of everything nested in it, names left out."""
    if isinstance(kind, T.StructType):
        return [t for f in kind.fields for t in plain_text(value[f.name], f.dataType)]
    if isinstance(kind, T.MapType):
        return [F.array_join(F.transform(F.map_values(value), lambda x: x.cast("string")), " ")]
    if isinstance(kind, T.ArrayType):
        return [F.array_join(F.transform(value, lambda x: x.cast("string")), " ")]
    if isinstance(kind, T.DoubleType | T.FloatType):
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        return [F.when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))]
    return [value.cast("string")]


def search_text(df: DataFrame, columns: list[str]) -> Column:
    """one searchable text per row."""
    parts = [t for n in columns if n in df.columns for t in plain_text(F.col(n), df.schema[n].dataType)]
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])
