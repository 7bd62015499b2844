"""Registration of published queries: a plan over the driver's tables and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def plan(sql: str | None = None, name: str | None = None) -> Callable[[Plan], Plan]:
    def add(f: Plan) -> Plan:
        key = name or f.__name__
        PLANS[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add
