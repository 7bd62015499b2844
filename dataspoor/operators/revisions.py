"""Differences between two runs, decisions carried over, and three-way merges.

Findings are tables of (id, rule_id, sink, categories array, flows array); a
finding's lists come exploded where they are compared, so no list is searched
row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import spread


def diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """(change, id, rule_id, sink) of findings that a revision introduces, changes or removes.

    base, head: (id, rule_id, sink, flow), a row for each flow. A finding of both
    counts as changed when it has a flow that base lacks; one of head alone is
    changed when base has its exposure (rule and sink), else introduced; one of
    base alone is removed when head has no such exposure.
    """
    exposure, own = ["rule_id", "sink"], ["id", "rule_id", "sink"]
    side = lambda df, name: df.select(*own, "flow", F.lit(name).alias("side"))
    rows = side(base, "base").unionByName(side(head, "head"))
    has = lambda s: F.max(F.when(F.col("side") == s, 1).otherwise(0))
    flows = rows.groupBy(*own, "flow").agg(has("base").alias("b"), has("head").alias("h"))
    found = flows.groupBy(*own).agg(F.max("b").alias("in_base"), F.max("h").alias("in_head"), F.max(F.when((F.col("h") == 1) & (F.col("b") == 0), 1).otherwise(0)).alias("grew"))
    sides = found.groupBy(*exposure).agg(F.max("in_base").alias("exp_base"), F.max("in_head").alias("exp_head"))
    j = found.join(sides, exposure)
    both, new, old = (F.col("in_base") == 1) & (F.col("in_head") == 1), F.col("in_base") == 0, F.col("in_head") == 0
    change = F.when(both & (F.col("grew") == 1), "changed").when(new & (F.col("exp_base") == 1), "changed").when(new, "introduced").when(old & (F.col("exp_head") == 0), "removed")
    return j.select(change.alias("change"), *own).filter("change is not null")


def carry(findings: DataFrame, prior: DataFrame) -> DataFrame:
    """findings (id, rule_id, category, flow exploded) with `disposition` carried from prior ones, else null.

    prior: (id, rule_id, category, flow, disposition). By id first, and then that
    finding's own decision or none; failing that by the prior findings of the
    rule that share a flow, if all record one decision and together cover the
    categories.
    """
    decided = prior.select(F.col("id").alias("pid"), "disposition").distinct()
    by_id = findings.select("id").distinct().join(decided, F.col("id") == F.col("pid")).select("id", F.lit(True).alias("same"), F.col("disposition").alias("own"))
    fresh = findings.join(by_id.select("id"), "id", "left_anti")
    shared = fresh.select("id", "rule_id", "flow").distinct().join(prior.select(F.col("id").alias("pid"), "rule_id", "flow", "disposition").distinct(), ["rule_id", "flow"]).select("id", "pid", "disposition").distinct()
    agreed = shared.groupBy("id").agg(F.count_distinct("disposition").alias("n"), F.count_if(F.col("disposition").isNull()).alias("open"), F.min("disposition").alias("theirs")).filter("n = 1 and open = 0")
    covered = shared.select("id", "pid").join(prior.select(F.col("id").alias("pid"), "category").distinct(), "pid").select("id", "category").distinct()
    uncovered = fresh.select("id", "category").distinct().join(covered, ["id", "category"], "left_anti").select("id").distinct()
    by_flow = agreed.join(uncovered, "id", "left_anti").select("id", "theirs")
    ids = findings.select("id", "rule_id").distinct()
    return ids.join(by_id, "id", "left").join(by_flow, "id", "left").select("id", "rule_id", F.coalesce("own", "theirs").alias("disposition"))


def merged(base: Column, ours: Column, theirs: Column) -> Column:
    """Struct (value, conflict) of a three-way merge of one leaf; null is absence."""
    mine, new = ~ours.eqNullSafe(base), ~theirs.eqNullSafe(base)
    clash = mine & new & ~ours.eqNullSafe(theirs)
    return F.struct(F.when(mine, ours).otherwise(theirs).alias("value"), clash.alias("conflict"))


def merge_leaves(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(path, value, conflict) of three trees given as (path, value) leaves; ours wins a conflict."""
    side = lambda df, n: df.select("path", F.struct("value").alias("v"), F.lit(n).alias("side"))
    rows = side(base, "b").unionByName(side(ours, "o")).unionByName(side(theirs, "t"))
    pick = lambda s: F.max(F.when(F.col("side") == s, F.col("v.value")))
    g = rows.groupBy("path").agg(pick("b").alias("b"), pick("o").alias("o"), pick("t").alias("t"))
    m = merged(F.col("b"), F.col("o"), F.col("t"))
    return g.select("path", m.alias("m")).select("path", "m.value", "m.conflict").filter("value is not null or conflict")


def merge_sets(base: Column, ours: Column, theirs: Column) -> Column:
    """Sorted three-way merge of sets: ours less what theirs removed, with what theirs added."""
    removed, added = F.array_except(base, theirs), F.array_except(theirs, base)
    return F.array_sort(F.array_union(F.array_except(ours, removed), added))


def renamed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_id, new_id) of declarations gone and come with the same evidence, where there is one candidate each."""
    gone = old.join(new.select("id"), "id", "left_anti").select(F.col("id").alias("old_id"), "evidence")
    come = new.join(old.select("id"), "id", "left_anti").select(F.col("id").alias("new_id"), "evidence")
    one = lambda df, c: df.groupBy("evidence").agg(F.min(c).alias(c), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    return one(gone, "old_id").join(one(come, "new_id"), "evidence").select("old_id", "new_id")


def dropped(decisions: DataFrame, left: DataFrame) -> DataFrame:
    """(finding): decisions other than `open` that no finding is left for."""
    return decisions.filter("status <> 'open'").select("finding").distinct().join(left.select("finding"), "finding", "left_anti")


def evidence_grew(ours: Column, theirs: Column) -> Column:
    """Whether an accepted declaration goes back to review: its evidence holds what the accepted one didn't."""
    return F.size(F.array_except(ours, theirs)) > 0


def live_references(references: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """references whose target is left; the others dangle and go."""
    return references.join(targets.select(key).distinct(), key, "left_semi")


def same_node(fields: list[tuple[Column, Column]]) -> Column:
    """Whether two nodes are equal field by field; notes aren't among the fields."""
    out = F.lit(True)
    for a, b in fields:
        out = out & a.eqNullSafe(b)
    return out


def identity(kind: Column, key: Column, name: Column) -> Column:
    """What a list's element is known by: its typed key, its key, else its name."""
    return F.coalesce(F.concat(kind, F.lit(":"), key), key, name)


def quarantined(rows: DataFrame, lacks: list[tuple[Column, str]], key: str) -> DataFrame:
    """(key, reason): rows that lack something, with the first thing that they lack."""
    reason = None
    for test, name in lacks:
        reason = (F if reason is None else reason).when(test, F.lit(name))
    return rows.select(key, reason.alias("reason")).filter("reason is not null")


def integrity(keys: DataFrame, key: str, references: DataFrame, reference: str, targets: DataFrame, target: str) -> DataFrame:
    """(problem): keys that come twice, and references without a target."""
    twice = keys.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.concat(F.lit("duplicate "), key).alias("problem"))
    used = references.select(F.col(reference).alias("__target")).distinct()
    lost = used.join(targets.select(F.col(target).alias("__target")), "__target", "left_anti")
    return twice.unionByName(lost.select(F.concat(F.lit("dangling "), "__target").alias("problem")))


def not_rederived(stored: DataFrame, derived: DataFrame) -> DataFrame:
    """Stored rows that a second derivation doesn't give, repeated ones counted."""
    keys = stored.columns
    one = lambda df, n: df.toDF(*keys).select("*", F.lit(n).cast("long").alias("__n"))
    left = spread(one(stored, 1).union(one(derived, -1)), *keys).groupBy(*keys).agg(F.sum("__n").alias("__n")).filter(F.col("__n") > 0)
    return left.select(*keys, F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__k")).select(*keys)


def with_extensions(catalogue: DataFrame, extensions: DataFrame) -> DataFrame:
    """Entries of the catalogue, then of the project, each with its origin."""
    return catalogue.withColumn("origin", F.lit("catalogue")).unionByName(extensions.withColumn("origin", F.lit("config")))
