"""Benchmark statistics over labels and documents, and order-based operators over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordering as O
from ..operators import statistics as S
from .registry import plan
from .relations import table

_LABELLED = "SELECT d.doc_id, d.source, d.lang, l.quality, l.toxic FROM labels l JOIN documents d USING (doc_id)"


def _labelled(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source", "lang"), "doc_id")


def _wilson_sql(k: str, n: str) -> dict[str, str]:
    z = S.Z
    p, d = f"({k} / {n}::DOUBLE)", f"(1 + {z} * {z} / {n}::DOUBLE)"
    mid = f"(({p} + {z} * {z} / (2 * {n})) / {d})"
    half = f"({z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4 * {n} * {n}::DOUBLE)) / {d})"
    return {"p": f"round({p}, 4)", "lo": f"round(greatest(0.0, {mid} - {half}), 4)", "hi": f"round(least(1.0, {mid} + {half}), 4)"}


_W = _wilson_sql("k", "n")


@plan(f"SELECT source, k, n, {_W['p']} AS p, {_W['lo']} AS lo, {_W['hi']} AS hi FROM (SELECT source, count(*) FILTER (WHERE quality = 1) AS k, count(*) AS n FROM ({_LABELLED}) GROUP BY source)")
def l1_wilson(spark, sf):
    g = _labelled(spark, sf).groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("k"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("w", S.wilson(F.col("k"), F.col("n"))).select("source", "k", "n", "w.*")


def _kappa_sql(by: str) -> str:
    cols, key = (f"{by}, ", f"AND t.{by} = x.{by}") if by else ("", "")
    return f"""WITH t AS ({_LABELLED}) SELECT {cols}n, round(po, 4) AS agreement, CASE WHEN pe < 1 THEN round((po - pe) / (1 - pe), 4) END AS kappa FROM (
    SELECT {cols}count(*) AS n, avg((quality = toxic)::INT::DOUBLE) AS po, (sum((quality = 1)::INT) * sum((toxic = 1)::INT) + sum((quality = 0)::INT) * sum((toxic = 0)::INT)) / (count(*) * count(*))::DOUBLE AS pe FROM t {'GROUP BY ' + by if by else ''})"""


@plan(_kappa_sql("source"))
def l2_kappa(spark, sf):
    return S.kappa(_labelled(spark, sf), ["source"], "quality", "toxic")


@plan(_kappa_sql("lang"))
def l3_agreement(spark, sf):
    return S.kappa(_labelled(spark, sf), ["lang"], "quality", "toxic")


_STRATA = f"""WITH t AS ({_LABELLED}), pop AS (SELECT lang, count(*) AS size FROM documents GROUP BY lang), c AS (SELECT {{by}}lang, count(*) AS n, avg((quality = 1)::INT::DOUBLE) AS p FROM t GROUP BY ALL),
    g AS (SELECT {{by}}sum(n)::BIGINT AS n, sum(size) AS total, sum(size * p) AS hits, sum(CASE WHEN n > 1 THEN size * size * greatest(1 - n / size::DOUBLE, 0.0) * p * (1 - p) / (n - 1) ELSE 0 END) AS var FROM c JOIN pop USING (lang) {{group}})
    SELECT {{by}}n, round(hits / total, 4) AS estimate, round(greatest(hits / total - {S.Z} * sqrt(var) / total, 0.0), 4) AS lo, round(least(hits / total + {S.Z} * sqrt(var) / total, 1.0), 4) AS hi FROM g"""


def _observed(spark, sf):
    return _labelled(spark, sf).withColumn("ok", F.col("quality") == 1), table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("size"))


@plan(_STRATA.format(by="", group=""))
def l4_stratified(spark, sf):
    obs, pop = _observed(spark, sf)
    return S.stratified(obs.withColumn("all", F.lit(1)), pop, ["lang"], ["all"]).drop("all")


@plan(f"SELECT lang, found, n, round(found / n::DOUBLE, 4) AS recall FROM (SELECT lang, count(*) FILTER (WHERE source IN (SELECT DISTINCT source FROM documents WHERE doc_id % 3 = 0)) AS found, count(*) AS n FROM ({_LABELLED}) GROUP BY lang)")
def l5_run_recall(spark, sf):
    """Share of labelled sites that a run reports, by language."""
    hit = table(spark, sf, "documents").filter("doc_id % 3 = 0").select("source", F.lit(True).alias("hit")).distinct()
    g = _labelled(spark, sf).join(hit, "source", "left").groupBy("lang").agg(F.count_if("hit").alias("found"), F.count(F.lit(1)).alias("n"))
    return g.select("lang", "found", "n", F.round(F.col("found") / F.col("n"), 4).alias("recall"))


def _sample_sql(rows: str, strata: list[str], key: str, k: str, salt: str) -> str:
    parts = " || chr(31) || ".join([f"'{salt}'", *strata, f"{key}::VARCHAR"])
    return f"SELECT * EXCLUDE (mark) FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(strata)} ORDER BY mark, {key})::INT AS place FROM (SELECT *, sha256({parts}) AS mark FROM ({rows}))) WHERE place <= {k}"


@plan(_sample_sql("SELECT doc_id, lang, source FROM documents", ["lang"], "doc_id", "5", "sheet"))
def h6_hash_sample(spark, sf):
    return S.hash_sample(table(spark, sf, "documents").select("doc_id", "lang", "source"), ["lang"], "doc_id", 5, "sheet")


@plan(_sample_sql("SELECT doc_id, lang, source FROM documents", ["lang", "source"], "doc_id", "2", "blind"))
def l6_stratified_sheet(spark, sf):
    return S.hash_sample(table(spark, sf, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 2, "blind")


@plan(_sample_sql("SELECT event_id, event_type, user_id FROM events", ["event_type"], "event_id", "7", "other"))
def l7_competitor_sheet(spark, sf):
    return S.hash_sample(table(spark, sf, "events").select("event_id", "event_type", "user_id"), ["event_type"], "event_id", 7, "other")


@plan(f"SELECT doc_id, lang, toxic, place FROM ({_sample_sql(_LABELLED, ['lang', 'toxic'], 'doc_id', '4', 'site')}) WHERE place <= CASE WHEN toxic = 1 THEN 1 ELSE 4 END")
def l8_site_quota(spark, sf):
    """Sites by language; of those of one kind, a smaller quota."""
    rows = S.hash_sample(_labelled(spark, sf), ["lang", "toxic"], "doc_id", 4, "site")
    return rows.filter(F.col("place") <= F.when(F.col("toxic") == 1, 1).otherwise(4)).select("doc_id", "lang", "toxic", "place")


@plan("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type")
def g4_hop_collapse(spark, sf):
    """Steps of each path without consecutive repeats."""
    return O.collapse_runs(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


@plan("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id) AS n, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    WHERE k = 1 OR k = n OR before <> event_type""")
def l9_line_collapse(spark, sf):
    """As g4, but the first and the last hop always stay."""
    return O.collapse_runs(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type", ends=True).select("user_id", "event_id")


@plan(r"SELECT doc_id, n AS line, m AS call FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1)::INT AS n FROM documents), LATERAL (SELECT unnest(regexp_extract_all(t, '[A-Za-z0-9._]+@[A-Za-z0-9.]+')) AS m)")
def l10_candidate_sites(spark, sf):
    """Places of the text that look like a sink, with their line."""
    return O.candidate_sites(table(spark, sf, "documents"), "doc_id", "text", r"[A-Za-z0-9._]+@[A-Za-z0-9.]+")


@plan("SELECT count(*) FILTER (WHERE a.source IS NOT NULL AND b.source IS NOT NULL) AS shared, count(*) FILTER (WHERE b.source IS NULL) AS only_a, count(*) FILTER (WHERE a.source IS NULL) AS only_b FROM (SELECT DISTINCT source, lang FROM documents WHERE doc_id % 2 = 0) a FULL JOIN (SELECT DISTINCT source, lang FROM documents WHERE doc_id % 3 = 0) b ON a.source = b.source AND a.lang = b.lang")
def l11_tool_overlap(spark, sf):
    """Sites that two tools report: shared ones and each one's own, in one aggregation."""
    d = table(spark, sf, "documents").select("source", "lang", (F.col("doc_id") % 2 == 0).alias("a"), (F.col("doc_id") % 3 == 0).alias("b"))
    return O.overlap(d, ["source", "lang"], "a", "b")


@plan("SELECT doc_id, CASE WHEN quality = toxic THEN quality::VARCHAR ELSE 'unsure' END AS verdict FROM labels")
def l12_final_labels(spark, sf):
    return table(spark, sf, "labels").select("doc_id", O.final_label(F.col("quality"), F.col("toxic")).alias("verdict"))


@plan("SELECT event_type, round(median(value), 4) AS median, count(*) AS n FROM events GROUP BY event_type")
def l13_medians(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.median("value"), 4).alias("median"), F.count(F.lit(1)).alias("n"))


@plan("SELECT lang, count(*) AS files, sum(len(string_split(text, chr(10))))::BIGINT AS lines FROM documents GROUP BY lang")
def f9_language_counts(spark, sf):
    return O.line_counts(table(spark, sf, "documents"), "lang", "text")


@plan("SELECT o_custkey AS seed, l_suppkey AS target, min(l_linenumber * 100 + trunc(l_quantity))::BIGINT AS best FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2")
def g2_best_witness(spark, sf):
    """The shortest witness of each (seed, target), then the shallowest: an aggregate, no sort."""
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    reached = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("seed"), F.col("l_suppkey").alias("target"), F.col("l_linenumber").alias("dist"), F.col("l_quantity").cast("int").alias("depth"))
    return O.first_of(reached, ["seed", "target"], ["dist", "depth"], ["dist", "depth"]).select("seed", "target", (F.col("dist") * 100 + F.col("depth")).cast("long").alias("best"))


@plan("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY props, event_id) AS k FROM (SELECT user_id, props, min(event_id) AS event_id FROM events GROUP BY user_id, props)) WHERE k <= 16")
def h5_smallest_sixteen(spark, sf):
    """The 16 smallest paths of each variable stay."""
    return O.smallest(table(spark, sf, "events"), ["user_id"], "props", "event_id", 16).select("user_id", "event_id")


@plan("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY props, event_id) AS k FROM (SELECT user_id, props, min(event_id) AS event_id FROM events GROUP BY user_id, props)) WHERE k <= 16", name="e19_bounded_set")
def e19_bounded_set(spark, sf):
    return h5_smallest_sixteen(spark, sf)


@plan("SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type))[:3], ',') || CASE WHEN count(DISTINCT event_type) > 3 THEN ' and ' || (count(DISTINCT event_type) - 3) || ' more' ELSE '' END AS sites FROM events GROUP BY user_id")
def h4_top_sites(spark, sf):
    """The first sites and how many more there are."""
    g = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("s"))
    return g.select("user_id", O.shown(F.col("s"), 3).alias("sites"))


@plan("SELECT event_id FROM (SELECT event_id, sum(v) OVER (PARTITION BY user_id ORDER BY event_id) AS total FROM (SELECT event_id, user_id, trunc(value)::BIGINT AS v FROM events)) WHERE total <= 200")
def g10_running_budget(spark, sf):
    """What fits a budget in order."""
    rows = table(spark, sf, "events").withColumn("v", F.col("value").cast("long"))
    return O.within_budget(rows, ["user_id"], ["event_id"], "v", 200).select("event_id")


@plan("SELECT p_type, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_size, p_partkey) AS k FROM part) WHERE k = 1")
def g9_first_match(spark, sf):
    """The first entry in catalogue order wins."""
    return O.first_of(table(spark, sf, "part"), ["p_type"], ["p_size", "p_partkey"], ["p_partkey"])


@plan("SELECT user_id, event_id, n FROM (SELECT user_id, event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) ORDER BY n, user_id, event_id")
def h7_longest_first(spark, sf):
    rows = O.ranked(table(spark, sf, "events"), ["user_id"], [F.desc("value"), F.asc("event_id")], "n")
    return rows.select("user_id", "event_id", "n").orderBy("n", "user_id", "event_id")


@plan("SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", name="m_scope_rollup")
def m_scope_rollup(spark, sf):
    """Scopes of a score: each pair, each first key, and all."""
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("suppliers"))
