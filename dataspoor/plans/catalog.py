"""The engine's published queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analytics, classify, documents, engine, facts, linking, programs, projects, reports, revisions, scalars, topology  # noqa: F401
from .registry import PLANS, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(PLANS)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PLANS["f1_exposure"](spark, sf_dir)
