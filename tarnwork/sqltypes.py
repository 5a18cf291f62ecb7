"""SQL type names to Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from tarnwork.errors import EngineError

# Accepted names of each type.
NAMES = {
    "SMALLINT": T.ShortType(), "INT2": T.ShortType(), "INT": T.IntegerType(), "INTEGER": T.IntegerType(), "INT4": T.IntegerType(),
    "BIGINT": T.LongType(), "INT8": T.LongType(), "REAL": T.FloatType(), "FLOAT4": T.FloatType(), "DOUBLE PRECISION": T.DoubleType(),
    "DOUBLE": T.DoubleType(), "FLOAT8": T.DoubleType(), "FLOAT": T.DoubleType(), "BOOL": T.BooleanType(), "BOOLEAN": T.BooleanType(),
    "TEXT": T.StringType(), "VARCHAR": T.StringType(), "STRING": T.StringType(), "CHAR": T.StringType(), "BYTEA": T.BinaryType(), "TIMESTAMP": T.TimestampNTZType(),
    "TIMESTAMPTZ": T.TimestampType(), "DATE": T.DateType(), "JSON": T.StringType(), "JSONB": T.StringType(), "UUID": T.StringType(),
}


def spark_type(name: str) -> T.DataType:
    """The Spark type of a SQL type name, with arrays; unknown names raise 0A000."""
    text = " ".join(name.strip().upper().split())
    if text.endswith("[]"):
        return T.ArrayType(spark_type(text[:-2]))
    if text.endswith(" ARRAY"):
        return T.ArrayType(spark_type(text[:-6]))
    if m := re.fullmatch(r"(?:NUMERIC|DECIMAL|DEC)(?:\s*\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?", text):
        return T.DecimalType(int(m[1] or 38), int(m[2] or 0))
    if m := re.fullmatch(r"FLOAT\s*\(\s*(\d+)\s*\)", text):
        return T.FloatType() if int(m[1]) <= 24 else T.DoubleType()
    text = re.sub(r"\s*\(\s*\d+\s*\)$", "", text)
    if text in NAMES:
        return NAMES[text]
    raise EngineError("0A000", f"type {name} is not supported")


def parse_array(text: str) -> list[str | None]:
    """The members of a one-dimensional array literal such as ``{a,"b,c",NULL}``."""
    body = text.strip()[1:-1]
    found = re.findall(r'\s*(?:"((?:[^"\\]|\\.)*)"|([^,"]*))\s*(?:,|$)', body)[: -1 if body else None]
    return [re.sub(r"\\(.)", r"\1", a) if a or not b else None if b.strip().upper() == "NULL" else b.strip() for a, b in found] if body else []
