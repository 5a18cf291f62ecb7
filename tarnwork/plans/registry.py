"""All queries of the core, by name."""

from __future__ import annotations

from tarnwork.operators.logparse import parse_logs
from tarnwork.plans import managed, operators, relational
from tarnwork.runtime import load


def p2_found(spark, sf):
    return parse_logs(load(spark, sf, "live_server_log"))


def queries():
    return relational.queries() | operators.queries() | managed.queries() | {"p2_found": p2_found}


def oracle_sql():
    return relational.oracle_sql() | operators.oracle_sql() | managed.oracle_sql()
