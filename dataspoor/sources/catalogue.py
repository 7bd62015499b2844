"""The rule catalogue as tables: what decides a call, how handlers are known, and frameworks.

Values are in `values`; here they become rows. Patterns are globs of API paths;
`dataspoor.functions.globs` makes regexes of them once on the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.globs import glob_regex
from . import values as V
from .topology_values import TOPOLOGY

#: Languages by the first part of an entry's id.
LANGS = {"js": "javascript", "py": "python", "cs": "csharp"}


def lang_of(entry: str) -> str:
    return LANGS[entry.split(".")[0]]


def _methods(lang: str) -> dict[str, tuple[str, ...]]:
    """Methods of data by their flow; what a sanitiser's methods return is no data."""
    out: dict[str, tuple[str, ...]] = {}
    for entry, flow, _, methods, _ in V.PROPAGATORS:
        if lang_of(entry) == lang and methods:
            out[flow] = out.get(flow, ()) + tuple(methods.split())
    for entry, _, _, methods in V.SANITISERS:
        if lang_of(entry) == lang:
            out["none"] = out.get("none", ()) + tuple(methods.split())
    return out


PY_METHODS, JS_METHODS, CS_METHODS = _methods("python"), _methods("javascript"), _methods("csharp")
#: (receivers, methods) of loggers that are known by name, by language.
LOGGERS = {lang_of(entry): (tuple(receivers.split()), tuple(methods.split())) for entry, receivers, methods in V.SINK_RECEIVERS}


def _entries() -> list[tuple]:
    """(lang, kind, entry, patterns, class, processor, removes, flow) in the order of the catalogue."""
    rows: list[tuple] = [(lang_of(e), "sink", e, calls.split(), c, v, None, None) for e, c, v, calls in V.SINKS]
    rows += [(lang_of(e), "source", e, reads.split() + calls.split(), None, None, None, None) for e, _, _, _, reads, calls in V.SOURCES]
    rows += [(lang_of(e), "sanitiser", e, calls.split(), None, None, removes, None) for e, removes, calls, _ in V.SANITISERS]
    rows += [(lang_of(e), "propagator", e, calls.split(), None, None, None, flow) for e, flow, calls, _, _ in V.PROPAGATORS]
    return rows


def rules(spark: SparkSession, extensions: list[tuple] = ()) -> DataFrame:
    """(ordinal, lang, kind, entry, pattern, literal, regex, class, processor, removes, flow), extensions after the built-in ones.

    extensions: rows (lang, kind, entry, patterns, class, processor, removes, flow).
    """
    flat = [(n, lang, kind, e, p, not re.search(r"[*{]", p), glob_regex(p), c, v, r, f) for n, (lang, kind, e, ps, c, v, r, f) in enumerate([*_entries(), *extensions]) for p in ps]
    return spark.createDataFrame(flat, "ordinal int, lang string, kind string, entry string, pattern string, literal boolean, regex string, class string, processor string, removes string, flow string")


def receivers(lang: str) -> dict[str, str]:
    """Receivers that are known by name, with the flow of all their methods."""
    return {name: flow for entry, flow, _, _, names_ in V.PROPAGATORS if lang_of(entry) == lang for name in names_.split()}


def source_categories() -> dict[str, str]:
    """Category of what each request source reads, where the catalogue says one."""
    return {e: category for e, _, _, category, _, _ in V.SOURCES if category}


def handler_ways(lang: str) -> list[tuple[str, str, list[str]]]:
    """(entry, way, patterns) by which a language's handlers are known."""
    return [(e, way, values.split()) for e, way, values in V.HANDLERS if lang_of(e) == lang]


def parameters(lang: str) -> list[tuple[str, str, str, str, str | None]]:
    """(entry, which, how, name, category): what the parameters of a language's handlers carry."""
    return [row for row in V.PARAMETERS if lang_of(row[0]) == lang]


def dispatchers(lang: str) -> list[tuple]:
    """(entry, calls, argument, implemented type, method, parameter, type argument)."""
    return [row for row in V.DISPATCHERS if lang_of(row[0]) == lang]


def frameworks(lang: str) -> list[tuple[str, list[str], bool]]:
    """(name, modules, supported) of a language's web frameworks."""
    return [(name, modules.split(), supported) for name, of, modules, supported, _ in V.FRAMEWORKS if of == lang]


def names(table: tuple, lang: str) -> tuple[str, ...]:
    """Names that a (language, names) table of `values` holds for a language."""
    return tuple(n for of, text in table if of == lang for n in text.split())


def topology(spark: SparkSession) -> DataFrame:
    """(section, entry, lang, key, values array) of the topology catalogue, in order."""
    rows = [(n, section, entry, lang, key, text.split(" | ")) for n, (section, entry, lang, key, text) in enumerate(TOPOLOGY)]
    return spark.createDataFrame(rows, "ordinal int, section string, entry string, lang string, key string, values array<string>")


def purposes() -> tuple[dict[str, str], dict[str, str]]:
    """(data use by processor, data use by sink class) that declarations propose."""
    of = lambda section: {entry: text for s, entry, _, key, text in TOPOLOGY if s == section and key == "data_use"}
    return of("by_processor"), of("by_class")
