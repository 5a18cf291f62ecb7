"""Tab-separated copy lines: ``\\N`` for null, backslash escapes, ``\\.`` at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters with an escape of their own.
ESCAPES = (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"))


def to_lines(rows: DataFrame) -> DataFrame:
    """One ``value`` for each row."""

    def cell(c: str):
        text = F.col(c).cast("string")
        for a, b in ESCAPES:
            text = F.replace(text, F.lit(a), F.lit(b))
        return F.coalesce(text, F.lit("\\N"))

    return rows.select(F.concat_ws("\t", *[cell(c) for c in rows.columns]).alias("value"))


def unescape(piece):
    for a, b in ESCAPES:
        piece = F.when(piece == b, a).otherwise(piece)
    return piece


def from_lines(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of a schema; a cell that doesn't fit its type raises, the end mark is skipped."""
    cells = F.split("value", "\t")

    def cell(i: int, field: T.StructField):
        text = F.get(cells, F.lit(i))
        # one pass from left to right: each piece is one escape or one run without any
        pieces = F.regexp_extract_all(text, F.lit(r"(\\.|[^\\]+|\\)"), F.lit(1))
        plain = F.array_join(F.transform(pieces, unescape), "")
        return F.when(text != "\\N", plain).cast(field.dataType).alias(field.name)

    return lines.where("value <> '\\\\.'").select(*[cell(i, f) for i, f in enumerate(schema)])
