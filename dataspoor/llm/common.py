"""What the training-data operators share: reading, shared folders, words.

Every operator takes the columns that it names and no others, so extra columns
of any name pass by unharmed, and returns only the columns of its docstring.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import cut, shared_dir

__all__ = ["SPACE", "WORD", "cut", "let", "new_path", "shared_dir", "table", "unused"]
#: A run of the six ASCII white-space characters, for Java's and Python's regexes.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def let(value, body):
    """body(value) with value computed once per row: a lambda's variable holds it."""
    return F.transform(F.array(value), body)[0]


def unused(docs: DataFrame, *names: str) -> list[str]:
    """These names, each with as many underscores before it as no column of docs has, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while (name := f"_{name}").lower() in taken:
            pass
        out.append(name)
    return out
