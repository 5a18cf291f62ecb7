"""Typed errors with SQLSTATE codes."""

from __future__ import annotations


class EngineError(Exception):
    def __init__(self, sqlstate: str, message: str):
        super().__init__(f"[{sqlstate}] {message}")
        self.sqlstate = sqlstate


# Error conditions of the query layer and the SQLSTATE each is reported under.
CONDITIONS = {
    "DIVIDE_BY_ZERO": "22012", "ARITHMETIC_OVERFLOW": "22003", "CAST_OVERFLOW": "22003", "CAST_INVALID_INPUT": "42804",
    "DATATYPE_MISMATCH": "42804", "TABLE_OR_VIEW_NOT_FOUND": "42P01", "UNRESOLVED_COLUMN": "42703", "PARSE_SYNTAX_ERROR": "42601",
}


def translate(error: Exception) -> EngineError:
    """A Spark error as an EngineError; XX000 where no code fits."""
    text = str(error)
    for name, state in CONDITIONS.items():
        if name in text:
            return EngineError(state, text.split("\n")[0])
    return EngineError("XX000", text.split("\n")[0])
