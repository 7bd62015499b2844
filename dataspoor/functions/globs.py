"""Globs of API paths and file paths as anchored regexes, made once a pattern on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\*\*(?P<sep>[./])?|\*|\?|\{|\}|,|[^*?{},]+")


def glob_regex(pattern: str, separator: str = ".") -> str:
    """Anchored regex of a glob.

    `*` stays in a segment, `**` doesn't, `**` and the separator match no or more
    whole segments, `{a,b}` is a choice, and `?` one character of a segment where
    the separator is `/`. An unclosed brace is an error.
    """
    sep, out, depth = re.escape(separator), [], 0
    for m in _TOKEN.finditer(pattern):
        t = m[0]
        if t[:2] == "**":
            whole = m["sep"] == separator
            out.append(f"(?:.*{sep})?" if whole else ".*" + re.escape(m["sep"] or ""))
        elif t == "*":
            out.append(f"[^{sep}]*")
        elif t == "?" and separator == "/":
            out.append("[^/]")
        elif t == "{":
            depth += 1
            out.append("(?:")
        elif t == "}" and depth:
            depth -= 1
            out.append(")")
        elif t == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(t))
    if depth:
        raise ValueError(f"unclosed brace in {pattern!r}")
    return f"^{''.join(out)}$"


def any_glob(value: Column, patterns: list[str], separator: str = ".") -> Column:
    """Whether a value matches any pattern: literal ones by equality, the rest by one regex."""
    literal = [p for p in patterns if not re.search(r"[*{?]", p)]
    rest = [glob_regex(p, separator) for p in patterns if re.search(r"[*{?]", p)]
    out = value.isin(*literal) if literal else F.lit(False)
    return out | value.rlike("|".join(rest)) if rest else out


def match_patterns(values: DataFrame, value_col: str, patterns: list[tuple[int, str]], on: str | None = None, separator: str = ".") -> DataFrame:
    """values with `ordinal` of every pattern that matches: literals by an equi-join, globs one regex each.

    patterns: (ordinal, glob). Distinct values are matched once and joined back,
    so a value that comes often costs no more.
    """
    spark = values.sparkSession
    literal = [(n, p) for n, p in patterns if not re.search(r"[*{?]", p)]
    globs = [(n, glob_regex(p, separator)) for n, p in patterns if re.search(r"[*{?]", p)]
    distinct = values.select(F.col(value_col).alias("__value")).distinct()
    tests = [F.when(F.col("__value").rlike(r), F.lit(n)) for n, r in globs]
    hits = [F.filter(F.array(*tests), lambda x: x.isNotNull())] if tests else []
    if literal:
        same = spark.createDataFrame(literal, "ordinal int, __pattern string").groupBy("__pattern").agg(F.collect_list("ordinal").alias("__same"))
        distinct = distinct.join(F.broadcast(same), F.col("__value") == F.col("__pattern"), "left")
        hits.append(F.coalesce(F.col("__same"), F.array().cast("array<int>")))
    found = distinct.select("__value", F.explode(F.concat(*hits)).alias("ordinal"))
    return values.join(found, values[value_col] == found["__value"]).drop("__value")
