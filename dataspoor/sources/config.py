"""Project configuration: typed, validated with every error listed, turned into small tables.

Configuration is a driver-side document of a few kilobytes; nothing of it grows
with the data that is scanned.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.globs import glob_regex
from ..operators.exposure import RULES, SEVERITIES
from .files import DEFAULT_EXCLUDES

#: Keys and the JSON types they take.
SHAPE = {
    "system": str,
    "exclude": [str],
    "default_excludes": bool,
    "max_call_depth": int,
    "fields": [{"name": str, "category": str, "citation": str}],
    "not_personal": [{"name": str, "citation": str}],
    "processors": [{"name": str, "sinks": [str], "hosts": [str], "citation": str, "fides_key": str}],
    "systems": [{"name": str, "paths": [str], "hosts": [str]}],
    "policy": {"fail_on": str, "rules": dict},
    "sinks": [dict],
    "sources": [dict],
    "sanitisers": [dict],
    "propagators": [dict],
    "dispatchers": [dict],
}
REQUIRED = {"fields": ("name", "category", "citation"), "not_personal": ("name", "citation"), "processors": ("name", "citation"), "systems": ("name",)}


@dataclass
class Config:
    excludes: list[str] = field(default_factory=lambda: list(DEFAULT_EXCLUDES))
    max_call_depth: int = 32
    fail_on: str = "high"
    rules: dict[str, str] = field(default_factory=lambda: dict(RULES))
    fields: list[dict] = field(default_factory=list)
    not_personal: list[str] = field(default_factory=list)
    processors: list[dict] = field(default_factory=list)
    systems: list[dict] = field(default_factory=list)
    extensions: list[tuple] = field(default_factory=list)
    system: str | None = None


def validate(value, shape=SHAPE, at: str = "") -> list[str]:
    """What is wrong with a document, every place listed."""
    where = at or "document"
    if shape is dict:
        return [] if isinstance(value, dict) else [f"{where}: an object is expected"]
    if isinstance(shape, dict):
        if not isinstance(value, dict):
            return [f"{where}: an object is expected"]
        out = [f"{where}: unknown key {k!r}" for k in sorted(set(value) - set(shape))]
        for k in sorted(set(value) & set(shape)):
            out += validate(value[k], shape[k], f"{at}/{k}")
        return out
    if isinstance(shape, list):
        if not isinstance(value, list):
            return [f"{where}: a list is expected"]
        out = [e for n, x in enumerate(value) for e in validate(x, shape[0], f"{at}/{n}")]
        need = REQUIRED.get(at.strip("/"), ())
        return out + [f"{at}/{n}: {k!r} is required" for n, x in enumerate(value) if isinstance(x, dict) for k in need if k not in x]
    ok = isinstance(value, shape) and not (shape is int and isinstance(value, bool))
    return [] if ok else [f"{where}: {shape.__name__} is expected"]


def load(document: dict | str) -> Config:
    """A validated configuration; raises ValueError with every problem."""
    doc = json.loads(document) if isinstance(document, str) else document
    errors = validate(doc)
    policy = doc.get("policy", {}) if isinstance(doc, dict) else {}
    if isinstance(policy, dict):
        if policy.get("fail_on", "high") not in SEVERITIES:
            errors.append("/policy/fail_on: not a severity")
        for name, rule in (policy.get("rules") or {}).items() if isinstance(policy.get("rules", {}), dict) else ():
            if name not in RULES:
                errors.append(f"/policy/rules: unknown rule {name!r}")
            elif not isinstance(rule, dict) or rule.get("severity", "info") not in SEVERITIES:
                errors.append(f"/policy/rules/{name}: not a rule setting")
    depth = doc.get("max_call_depth", 32) if isinstance(doc, dict) else 32
    if isinstance(depth, int) and not 1 <= depth <= 64:
        errors.append("/max_call_depth: 1 to 64 is expected")
    if errors:
        raise ValueError("; ".join(errors))
    rules = {k: v for k, v in RULES.items() if policy.get("rules", {}).get(k, {}).get("enabled", True)}
    rules |= {k: v["severity"] for k, v in policy.get("rules", {}).items() if k in rules and "severity" in v}
    extensions = [
        (e.get("language", "python"), kind, e["id"], tuple(e.get("calls", ())), e.get("class"), e.get("processor"), e.get("removes"), e.get("flow"))
        for kind, key in (("sink", "sinks"), ("source", "sources"), ("sanitiser", "sanitisers"), ("propagator", "propagators"))
        for e in doc.get(key, [])
    ]
    return Config(
        excludes=[*(DEFAULT_EXCLUDES if doc.get("default_excludes", True) else ()), *doc.get("exclude", [])],
        max_call_depth=depth,
        fail_on=policy.get("fail_on", "high"),
        rules=rules,
        fields=doc.get("fields", []),
        not_personal=[x["name"] for x in doc.get("not_personal", [])],
        processors=doc.get("processors", []),
        systems=doc.get("systems", []),
        extensions=extensions,
        system=doc.get("system"),
    )


def processor_table(spark: SparkSession, config: Config) -> DataFrame:
    """(ordinal, name, sink_regex, host, citation, fides_key): a row for each host and pattern of a declaration."""
    rows = []
    for n, p in enumerate(config.processors):
        patterns = [glob_regex(g) for g in p.get("sinks", [])]
        hosts = p.get("hosts", [])
        for k in range(max(1, len(hosts))):
            rows.append((n, p["name"], "|".join(patterns) if patterns and not k else None, hosts[k] if k < len(hosts) else None, p["citation"], p.get("fides_key")))
    return spark.createDataFrame(rows, "ordinal int, name string, sink_regex string, host string, citation string, fides_key string")


def field_table(spark: SparkSession, config: Config) -> DataFrame:
    """(key, category, by): declared names by their keys."""
    from pyspark.sql import functions as F

    from ..functions.names import name_keys

    rows = spark.createDataFrame([(x["name"], x["category"]) for x in config.fields], "name string, category string")
    return rows.select(F.explode(name_keys(F.col("name"))).alias("key"), "category", F.lit("config").alias("by")).distinct()
