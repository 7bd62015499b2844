"""Data maps as leaf tables: ingest, generate, decide, merge with the lock, and write.

A map is a tree of a few thousand leaves for a system; here it is a table of
(path array, value), so that maps of any number of systems merge in one job.
Elements of lists stand in the path by their identity, not their place.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import revisions as R

_KEYS = ("fides_key", "name")


def identity(item, n: int) -> str:
    """What tells an element of a list from the others: key, type and key, name, scalar, else place."""
    if not isinstance(item, dict):
        return f"={json.dumps(item)}"
    for k in _KEYS:
        if k in item:
            return f"{item['type']}:{item[k]}" if "type" in item and k == "fides_key" else str(item[k])
    return f"#{n}"


def leaves(tree, path: tuple[str, ...] = ()) -> list[tuple[list[str], str]]:
    """(path, JSON value) of every leaf; empty lists and objects are leaves."""
    if isinstance(tree, dict) and tree:
        return [x for k, v in sorted(tree.items()) for x in leaves(v, (*path, f".{k}"))]
    if isinstance(tree, list) and tree:
        return [x for n, v in enumerate(tree) for x in leaves(v, (*path, f"[{identity(v, n)}]"))]
    return [(list(path), json.dumps(tree))]


def tree(rows: list[tuple[list[str], str]]):
    """The tree of leaves, lists in the order of their identities."""
    if len(rows) == 1 and not rows[0][0]:
        return json.loads(rows[0][1])
    groups: dict[str, list] = {}
    for path, value in rows:
        groups.setdefault(path[0], []).append((path[1:], value))
    if all(k.startswith(".") for k in groups):
        return {k[1:]: tree(v) for k, v in sorted(groups.items())}
    return [tree(v) for _, v in sorted(groups.items())]


def ingest(spark: SparkSession, maps: list[tuple[str, dict]]) -> DataFrame:
    """(map, path, value) of parsed documents."""
    rows = [(name, "\x1f".join(p), v) for name, doc in maps for p, v in leaves(doc)]
    return spark.createDataFrame(rows, "map string, path string, value string")


def fields(maps: DataFrame) -> DataFrame:
    """(map, collection, field, category): what a map says of each field, nested ones by their dotted path."""
    p = F.split("path", "\x1f")
    names = F.transform(F.filter(p, lambda s: s.startswith("[") & ~s.startswith("[=")), lambda s: F.substring(s, 2, 1_000_000).substr(F.lit(1), F.length(s) - 2))
    rows = maps.filter(F.col("path").contains(".data_categories")).select("map", names.alias("n"), F.regexp_replace("value", '^"|"$', "").alias("category"))
    return rows.filter(F.size("n") >= 3).select("map", F.get("n", 1).alias("collection"), F.array_join(F.slice("n", 3, 100), ".").alias("field"), "category")


def merge(lock: DataFrame, ours: DataFrame, generated: DataFrame) -> DataFrame:
    """(map, path, value, conflict): the edited map with what changed since the lock was written.

    Edits by people win over generated changes; a leaf that both changed apart is a
    conflict and keeps the edit.
    """
    side = lambda df: df.select(F.concat("map", F.lit("\x1e"), "path").alias("path"), "value")
    merged = R.merge_leaves(side(lock), side(ours), side(generated))
    parts = F.split("path", "\x1e")
    return merged.select(F.get(parts, 0).alias("map"), F.get(parts, 1).alias("path"), "value", "conflict")


def decide(generated: DataFrame, manifest: DataFrame, as_of: str) -> DataFrame:
    """generated with the manifest's decisions (path, value, until) put over it while they hold."""
    held = manifest.filter(F.col("until").isNull() | (F.col("until") >= as_of)).select("path", F.col("value").alias("decided"))
    return generated.join(held, "path", "full").select("path", F.coalesce("decided", "value").alias("value"), F.col("decided").isNotNull().alias("decided"))


def quarantine(nodes: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(complete, incomplete with the columns they lack)."""
    lacking = F.filter(F.array(*[F.when(F.col(c).isNull() | (F.col(c) == ""), c) for c in required]), lambda x: x.isNotNull())
    rows = nodes.withColumn("lacks", lacking)
    return rows.filter(F.size("lacks") == 0).drop("lacks"), rows.filter(F.size("lacks") > 0)


def to_yaml(node, notes: dict[tuple, str] | None = None, indent: int = 0, path: tuple = ()) -> str:
    """YAML of a tree, with `#:` notes before the keys they are about."""
    pad, out = "  " * indent, []
    if isinstance(node, dict):
        for k, v in node.items():
            here = (*path, k)
            if notes and here in notes:
                out += [f"{pad}#: {line}" for line in notes[here].split("\n")]
            out.append(f"{pad}{k}:" + (f" {json.dumps(v, ensure_ascii=False)}" if not isinstance(v, dict | list) or not v else "\n" + to_yaml(v, notes, indent + 1, here)))
    elif isinstance(node, list):
        for n, v in enumerate(node):
            inner = to_yaml(v, notes, indent + 1, (*path, n)) if isinstance(v, dict | list) and v else json.dumps(v, ensure_ascii=False)
            out.append(f"{pad}- " + inner.lstrip())
    return "\n".join(out)


def lock(generated) -> str:
    """The lock file: what was generated, so that the next run can tell edits from changes."""
    return json.dumps({"format": "0.1", "generated": generated}, sort_keys=True, ensure_ascii=False) + "\n"
