"""Diffs, carried decisions and merges over halves of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordering as O
from ..operators import revisions as R
from .registry import plan
from .relations import dispositions, flows, sinks, table, with_

# Findings of two revisions: one for each (source lang, source name) pair's class of documents.
_FIND = """SELECT 'pf-' || (doc_id % 97) AS id, 'PF00' || (doc_id % 97 % 6) AS rule_id, 'snk-' || (doc_id % 97 % 11) AS sink, 'flow-' || (n_chars % 400) AS flow, lang AS category,
    CASE WHEN doc_id % 97 % 4 = 0 THEN NULL ELSE 'decided-' || (doc_id % 97 % 3) END AS disposition, doc_id FROM documents"""


def _find(spark, sf):
    k = F.col("doc_id") % 97
    cat = lambda a, b: F.concat(F.lit(a), b)
    return table(spark, sf, "documents").select(
        cat("pf-", k).alias("id"), cat("PF00", k % 6).alias("rule_id"), cat("snk-", k % 11).alias("sink"), cat("flow-", F.col("n_chars") % 400).alias("flow"),
        F.col("lang").alias("category"), F.when(k % 4 != 0, cat("decided-", k % 3)).alias("disposition"), "doc_id",
    )


_BASE, _HEAD = "(doc_id % 2 = 0 AND doc_id % 97 % 5 <> 1)", "(doc_id % 3 > 0 AND doc_id % 97 % 7 <> 2)"


@plan(
    f"""WITH f AS ({_FIND}), b AS (SELECT * FROM f WHERE {_BASE}), h AS (SELECT * FROM f WHERE {_HEAD}),
    bi AS (SELECT DISTINCT id, rule_id, sink FROM b), hi AS (SELECT DISTINCT id, rule_id, sink FROM h)
    SELECT 'changed' AS change, * FROM hi WHERE id IN (SELECT id FROM bi) AND EXISTS (SELECT 1 FROM h WHERE h.id = hi.id AND NOT EXISTS (SELECT 1 FROM b WHERE b.id = h.id AND b.flow = h.flow))
    UNION ALL SELECT CASE WHEN EXISTS (SELECT 1 FROM bi WHERE bi.rule_id = hi.rule_id AND bi.sink = hi.sink) THEN 'changed' ELSE 'introduced' END, * FROM hi WHERE id NOT IN (SELECT id FROM bi)
    UNION ALL SELECT 'removed', * FROM bi WHERE id NOT IN (SELECT id FROM hi) AND NOT EXISTS (SELECT 1 FROM hi WHERE bi.rule_id = hi.rule_id AND bi.sink = hi.sink)"""
)
def i1_diff(spark, sf):
    """Exposures that a revision introduces, changes or removes."""
    f = _find(spark, sf)
    return R.diff(f.filter("doc_id % 2 = 0 and doc_id % 97 % 5 <> 1"), f.filter("doc_id % 3 > 0 and doc_id % 97 % 7 <> 2"))


_NEW = "'pf-' || CASE WHEN doc_id % 97 % 3 = 0 THEN doc_id % 97 ELSE doc_id % 97 + 200 END"


@plan(
    f"""WITH p AS (SELECT * FROM ({_FIND}) WHERE doc_id % 2 = 0), h AS (SELECT * REPLACE ({_NEW} AS id) FROM ({_FIND}) WHERE doc_id % 3 > 0), ids AS (SELECT DISTINCT id, rule_id FROM h),
    sh AS (SELECT DISTINCT h.id, p.id AS pid, p.disposition FROM h JOIN p ON p.rule_id = h.rule_id AND p.flow = h.flow WHERE h.id NOT IN (SELECT id FROM p)),
    ok AS (SELECT id, min(disposition) AS d FROM sh GROUP BY id HAVING count(DISTINCT disposition) = 1 AND count(*) = count(disposition)),
    un AS (SELECT DISTINCT h.id FROM h WHERE NOT EXISTS (SELECT 1 FROM sh JOIN p ON p.id = sh.pid WHERE sh.id = h.id AND p.category = h.category))
    SELECT i.id, i.rule_id, coalesce((SELECT min(disposition) FROM p WHERE p.id = i.id), (SELECT d FROM ok WHERE ok.id = i.id AND i.id NOT IN (SELECT id FROM un))) AS disposition FROM ids i"""
)
def i2_carry(spark, sf):
    f = _find(spark, sf)
    k = F.col("doc_id") % 97
    fresh = f.filter("doc_id % 3 > 0").withColumn("id", F.concat(F.lit("pf-"), F.when(k % 3 == 0, k).otherwise(k + 200)))
    return R.carry(fresh, f.filter("doc_id % 2 = 0"))


@plan(with_("SELECT DISTINCT finding FROM dispositions WHERE status <> 'open' AND finding NOT IN (SELECT 'pf-' || l_orderkey FROM lineitem WHERE l_returnflag = 'R')", "dispositions"))
def i3_dropped(spark, sf):
    """Decisions that no finding is left for."""
    left = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.concat(F.lit("pf-"), "l_orderkey").alias("finding"))
    return R.dropped(dispositions(spark, sf), left)


_LEAF = "SELECT p_partkey, 'system/' || p_partkey || '/name' AS path, p_name AS base, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_type WHEN 2 THEN NULL ELSE p_name END AS ours, CASE p_partkey % 7 WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN NULL WHEN 3 THEN p_type ELSE p_name END AS theirs FROM part"


def _leaves(spark, sf):
    k = F.col("p_partkey")
    p = table(spark, sf, "part").withColumn("path", F.concat(F.lit("system/"), k, F.lit("/name")))
    ours = F.when(k % 5 == 1, F.col("p_type")).when(k % 5 != 2, F.col("p_name"))
    theirs = F.when(k % 7 == 1, F.col("p_brand")).when(k % 7 == 3, F.col("p_type")).when(k % 7 != 2, F.col("p_name"))
    some = lambda v: p.select("path", v.alias("value")).filter("value is not null")
    return some(F.col("p_name")), some(ours), some(theirs)


@plan(f"SELECT path, CASE WHEN ours IS DISTINCT FROM base THEN ours ELSE theirs END AS value, ours IS DISTINCT FROM base AND theirs IS DISTINCT FROM base AND ours IS DISTINCT FROM theirs AS conflict FROM ({_LEAF}) WHERE CASE WHEN ours IS DISTINCT FROM base THEN ours ELSE theirs END IS NOT NULL OR (ours IS DISTINCT FROM base AND theirs IS DISTINCT FROM base AND ours IS DISTINCT FROM theirs)")
def i4_three_way_merge(spark, sf):
    return R.merge_leaves(*_leaves(spark, sf))


_SETS = "SELECT user_id, list_sort(coalesce(list(DISTINCT event_type) FILTER (WHERE event_id % 3 > 0), [])) AS b, list_sort(coalesce(list(DISTINCT event_type) FILTER (WHERE event_id % 3 > 1), [])) AS o, list_sort(coalesce(list(DISTINCT event_type) FILTER (WHERE event_id % 3 < 2), [])) AS t FROM events GROUP BY user_id"


@plan(f"SELECT user_id, array_to_string(list_sort(list_distinct(list_concat(list_filter(o, lambda x: NOT (list_contains(b, x) AND NOT list_contains(t, x))), list_filter(t, lambda x: NOT list_contains(b, x))))), ',') AS merged FROM ({_SETS})")
def i5_set_merge(spark, sf):
    k, pick = F.col("event_id") % 3, lambda c: F.collect_set(F.when(c, F.col("event_type")))
    g = table(spark, sf, "events").groupBy("user_id").agg(pick(k > 0).alias("b"), pick(k > 1).alias("o"), pick(k < 2).alias("t"))
    return g.select("user_id", F.array_join(R.merge_sets(F.col("b"), F.col("o"), F.col("t")), ",").alias("merged"))


_DECL = "SELECT p_partkey, 'decl-' || p_partkey AS old_id, CASE WHEN p_partkey % 4 = 0 THEN 'decl-new-' || p_partkey ELSE 'decl-' || p_partkey END AS new_id, sha256(p_name || p_type || p_brand || (p_partkey % 50)) AS evidence FROM part"


@plan(
    f"""WITH d AS ({_DECL}), g AS (SELECT old_id, evidence FROM d WHERE old_id NOT IN (SELECT new_id FROM d)), c AS (SELECT new_id, evidence FROM d WHERE new_id NOT IN (SELECT old_id FROM d))
    SELECT g.old_id, c.new_id FROM g JOIN c USING (evidence) WHERE (SELECT count(*) FROM g g2 WHERE g2.evidence = g.evidence) = 1 AND (SELECT count(*) FROM c c2 WHERE c2.evidence = c.evidence) = 1"""
)
def i6_renamed(spark, sf):
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").withColumn("evidence", F.sha2(F.concat("p_name", "p_type", "p_brand", k % 50), 256))
    old = rows.select(F.concat(F.lit("decl-"), k).alias("id"), "evidence")
    new = rows.select(F.when(k % 4 == 0, F.concat(F.lit("decl-new-"), k)).otherwise(F.concat(F.lit("decl-"), k)).alias("id"), "evidence")
    return R.renamed(old, new)


@plan(f"SELECT user_id, len(list_filter(o, lambda x: NOT list_contains(t, x))) > 0 AS review FROM ({_SETS})")
def i7_evidence_grew(spark, sf):
    """Accepted declarations go back to review when their evidence grows."""
    k, pick = F.col("event_id") % 3, lambda c: F.collect_set(F.when(c, F.col("event_type")))
    g = table(spark, sf, "events").groupBy("user_id").agg(pick(k > 1).alias("o"), pick(k < 2).alias("t"))
    return g.select("user_id", R.evidence_grew(F.col("o"), F.col("t")).alias("review"))


@plan("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def i8_dangling_references(spark, sf):
    """References whose target is left."""
    live = table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return R.live_references(table(spark, sf, "lineitem"), live, "l_suppkey").select("l_orderkey", "l_linenumber")


@plan("SELECT doc_id, lang = CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE lang END AND source IS NOT DISTINCT FROM CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END AS same FROM documents")
def i9_same_node(spark, sf):
    """Nodes compared field by field, notes left out."""
    other = F.when(F.col("doc_id") % 3 == 0, "en").otherwise(F.col("lang"))
    src = F.when(F.col("doc_id") % 5 != 0, F.col("source"))
    return table(spark, sf, "documents").select("doc_id", R.same_node([(F.col("lang"), other), (F.col("source"), src)]).alias("same"))


@plan("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_type || ':' || p_name WHEN 1 THEN p_name ELSE p_brand END AS identity FROM part")
def i10_identity(spark, sf):
    """Identity of list elements: typed key, key, else name."""
    k = F.col("p_partkey") % 3
    return table(spark, sf, "part").select("p_partkey", R.identity(F.when(k == 0, F.col("p_type")), F.when(k < 2, F.col("p_name")), F.col("p_brand")).alias("identity"))


@plan("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'balance' WHEN s_nationkey % 5 = 0 THEN 'nation' END AS reason FROM supplier WHERE s_acctbal < 0 OR s_nationkey % 5 = 0")
def i11_quarantine(spark, sf):
    """Incomplete declarations with what they lack."""
    return R.quarantined(table(spark, sf, "supplier"), [(F.col("s_acctbal") < 0, "balance"), (F.col("s_nationkey") % 5 == 0, "nation")], "s_suppkey")


@plan("SELECT 'duplicate ' || p_name AS problem FROM part GROUP BY p_name HAVING count(*) > 1 UNION ALL SELECT 'dangling ' || l_partkey FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5))")
def i12_integrity(spark, sf):
    """Keys that come twice and references without a target."""
    p = table(spark, sf, "part")
    return R.integrity(p, "p_name", table(spark, sf, "lineitem"), "l_partkey", p.filter("p_size > 5"), "p_partkey")


@plan(with_("(SELECT id, category FROM flows EXCEPT ALL SELECT id, category FROM flows WHERE depth <= 3)", "flows"))
def i13_rederived(spark, sf):
    """Stored rows that a second derivation doesn't give."""
    f = flows(spark, sf).select("id", "category", "depth")
    return R.not_rederived(f.select("id", "category"), f.filter("depth <= 3").select("id", "category"))


@plan("SELECT 'catalogue' AS origin, p_name AS entry FROM part WHERE p_size < 10 UNION ALL SELECT 'config', p_name FROM part WHERE p_size > 45")
def i14_extensions(spark, sf):
    p = table(spark, sf, "part").withColumn("entry", F.col("p_name"))
    return R.with_extensions(p.filter("p_size < 10").select("entry"), p.filter("p_size > 45").select("entry"))


@plan("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def i15_seed_dedup(spark, sf):
    """One seed for each variable and category, the first one."""
    return O.first_of(table(spark, sf, "events"), ["user_id", "event_type"], ["event_id"], ["event_id"])


@plan(with_("SELECT sink, count(*) AS n FROM flows WHERE sink IN (SELECT id FROM sinks WHERE class = 'http') GROUP BY sink", "flows", "sinks"))
def m_semi_join(spark, sf):
    http = sinks(spark, sf).filter("class = 'http'").select(F.col("id").alias("sink"))
    return flows(spark, sf).join(http, "sink", "left_semi").groupBy("sink").agg(F.count(F.lit(1)).alias("n"))
