"""Exposures, egress, gaps, decisions and their order over the embedded relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import exposure as X
from ..operators import ordering as O
from .registry import plan
from .relations import dispositions, flows, gaps, names, processors, sinks, sources, table, with_
from .scalars import below_sql

FIRST_PARTY = "coalesce(class = 'http' AND host_kind = 'relative', false)"
INTERNAL = "coalesce(dest_kind = 'internal', false)"
LEAVES = f"(class NOT IN ('log', 'browser_storage', 'device_storage') AND NOT {FIRST_PARTY} AND NOT {INTERNAL})"
PROCESSOR = "coalesce(processor, CASE WHEN dest_kind = 'processor' THEN dest_target END, CASE WHEN host_kind = 'literal' THEN host_value END)"
DECLARED = """SELECT k.*, d.ordinal AS decl_ordinal, d.name AS decl_name, d.citation AS decl_citation FROM sinks k LEFT JOIN LATERAL (
    SELECT ordinal, name, citation FROM processors p WHERE lower(p.name) = lower(k.processor) OR regexp_matches(k.catalogue_id, p.sink_regex)
    OR (CASE WHEN k.host_kind = 'literal' AND k.host_value IS NOT NULL THEN k.host_value WHEN k.dest_kind = 'processor' THEN k.dest_target END) = p.host
    OR ends_with(CASE WHEN k.host_kind = 'literal' AND k.host_value IS NOT NULL THEN k.host_value WHEN k.dest_kind = 'processor' THEN k.dest_target END, '.' || p.host)
    ORDER BY ordinal LIMIT 1) d ON true"""
_SPECIAL, _CREDENTIAL = below_sql("f.category", N.SPECIAL), below_sql("f.category", N.CREDENTIAL)
_HEADER = "coalesce(class = 'http' AND lower(field) IN ('headers', 'authorization', 'auth', 'x-api-key', 'api-key', 'proxy-authorization'), false)"
_LOWERED = "(s.needs_review OR f.echoed OR f.category = 'unknown')"
_TESTS = {
    "PF001": f"class = 'log' AND NOT {_CREDENTIAL} AND NOT {below_sql('f.category', ['user.unique_id.pseudonymous'])}",
    "PF002": f"{LEAVES} AND decl_ordinal IS NULL AND {PROCESSOR} IS NOT NULL",
    "PF003": "class = 'llm'",
    "PF004": f"{_SPECIAL} AND {LEAVES}",
    "PF005": f"{_CREDENTIAL} AND (class = 'log' OR {LEAVES}) AND NOT {_HEADER}",
    "PF006": f"class = 'http' AND host_kind = 'dynamic' AND dest_kind IS NULL AND NOT ({_CREDENTIAL} AND {_HEADER})",
}
_RANK = {"info": 0, "warning": 1, "medium": 2, "high": 3}
FIRED = " UNION ALL ".join(
    f"""SELECT f.id AS flow, '{r}' AS rule, f.source, f.sink, f.category, (s.needs_review OR k.heuristic OR f.category = 'unknown' OR f.echoed) AS needs_review,
    CASE WHEN {_LOWERED} THEN 0 ELSE {_RANK[X.RULES[r]]} END AS severity, {'NULL' if r in ('PF001', 'PF006') else PROCESSOR} AS processor, k.heuristic,
    s.path AS src_path, s.line AS src_line, s.text, k.path AS sink_path, k.line AS sink_line, k.catalogue_id, k.class
    FROM flows f JOIN sources s ON s.id = f.source JOIN declared k ON k.id = f.sink WHERE {t}"""
    for r, t in _TESTS.items()
)
_WHAT = "CASE WHEN cats = ['unknown'] THEN 'uncertain: data of undetermined category' ELSE array_to_string(cats, ', ') END || ' from `' || f.text || '` (' || f.src_path || ':' || f.src_line || ')' || CASE n_sources WHEN 1 THEN '' WHEN 2 THEN ' and 1 other source' ELSE ' and ' || (n_sources - 1) || ' other sources' END"
_AT = "path || ':' || line"
_WHOM = "coalesce(processor, 'an LLM provider chosen at run time')"
_MESSAGE = f"""CASE rule WHEN 'PF001' THEN {_WHAT} || ' reaches a log sink (' || catalogue_id || ') at ' || {_AT}
    WHEN 'PF002' THEN {_WHAT} || ' reaches ' || {_WHOM} || ', a processor that is not declared, at ' || {_AT}
    WHEN 'PF003' THEN {_WHAT} || ' reaches ' || {_WHOM} || ' through a model call at ' || {_AT}
    WHEN 'PF004' THEN 'special-category data: ' || {_WHAT} || ' reaches an external ' || class || ' sink at ' || {_AT}
    WHEN 'PF005' THEN 'credentials: ' || {_WHAT} || ' reach a ' || class || ' sink at ' || {_AT}
    ELSE {_WHAT} || ' is sent over HTTP to a host computed at run time, at ' || {_AT} END"""
_GROUPED = """SELECT rule, sink, needs_review, max(severity) AS rank, list_sort(list(DISTINCT category)) AS cats, count(DISTINCT flow) AS n_flows, count(DISTINCT source) AS n_sources,
    max(processor) AS processor, min(heuristic) AS heuristic, min(sink_path) AS path, min(sink_line) AS line, min(catalogue_id) AS catalogue_id, min(class) AS class,
    min({'src_path': src_path, 'src_line': src_line, 'source': source, 'text': text}) AS f FROM fired GROUP BY rule, sink, needs_review"""
_ID = """'pf-' || substr(sha256('["' || rule || '","' || sink || '",' || needs_review || ',["' || array_to_string(cats, '","') || '"]]'), 1, 16)"""
_SEV = "['info', 'warning', 'medium', 'high']"
EXPOSED = f"SELECT {_ID} AS id, rule AS rule_id, sink, needs_review, {_SEV}[rank + 1] AS severity, array_to_string(cats, ',') AS categories, n_flows, n_sources, processor, heuristic, path, line, {_MESSAGE} AS message FROM grouped"
_ALL = ("sources", "sinks", "flows", "processors")
_CTES = {"declared": DECLARED, "fired": FIRED, "grouped": _GROUPED, "exposed": EXPOSED}


def _hits(spark, sf):
    return X.fired(flows(spark, sf), sources(spark, sf), sinks(spark, sf), processors(spark, sf))


def _findings(spark, sf):
    return X.exposures(_hits(spark, sf)).withColumn("categories", F.array_join("categories", ","))


@plan(with_("SELECT * FROM exposed", *_ALL, **_CTES))
def f1_exposure(spark, sf):
    """Which exposures each rule raises, with categories, severity and sources."""
    return _findings(spark, sf)


@plan(with_("SELECT flow, rule, source, sink, needs_review, severity::BIGINT AS severity, processor FROM fired", *_ALL, declared=DECLARED, fired=FIRED))
def f2_rule_predicates(spark, sf):
    return _hits(spark, sf).select("flow", "rule", "source", "sink", "needs_review", F.col("severity").cast("long").alias("severity"), "processor")


_DETAIL = r"""SELECT kind, m || array_to_string(list_filter(string_split(d, '.'), lambda s, i: i = 1 OR s <> string_split(d, '.')[i - 1]), '.') AS detail, path, line, category, needs_review
    FROM (SELECT *, regexp_extract(detail, '^[^:]*:') AS m, regexp_replace(detail, '^[^:]*:', '') AS d FROM gaps)"""
_PERSONAL = "list_sort(coalesce(list(DISTINCT category) FILTER (WHERE NOT needs_review AND category <> 'unknown'), []))"
_SHOWS = "bool_or(kind IN ('unresolved_callee', 'unresolved_method', 'dynamic_call') AND contains(detail, '1'))"
_REACHED = f"""SELECT kind, detail, n_locations, n_reached, CASE WHEN shows THEN 'low' WHEN len(personal) = 0 THEN 'medium' ELSE 'high' END AS impact,
    CASE WHEN shows THEN 'the call only presents the value' WHEN len(personal) = 0 THEN 'only values whose category needs review reach it'
    ELSE 'personal data reaches its arguments: ' || array_to_string(personal[:3], ', ') || CASE WHEN len(personal) > 3 THEN ', …' ELSE '' END END AS impact_reason, f.path AS first_path, f.line AS first_line
    FROM (SELECT kind, detail, count(DISTINCT (path, line)) AS n_locations, count(*) AS n_reached, {_SHOWS} AS shows, {_PERSONAL} AS personal, min({{'path': path, 'line': line}}) AS f FROM normal GROUP BY kind, detail)"""


def _reached(spark, sf):
    return X.reached_gaps(gaps(spark, sf), F.col("detail").contains("1"))


@plan(with_("SELECT kind, detail, n_locations, n_reached, first_path, first_line FROM reached", "gaps", normal=_DETAIL, reached=_REACHED))
def f7_reached_gaps(spark, sf):
    return _reached(spark, sf).select("kind", "detail", "n_locations", "n_reached", "first_path", "first_line")


@plan(with_("SELECT kind, detail, impact, impact_reason FROM reached", "gaps", normal=_DETAIL, reached=_REACHED))
def f8_gap_impact(spark, sf):
    return _reached(spark, sf).select("kind", "detail", "impact", "impact_reason")


_GAP_ID = """'gap-' || substr(sha256('["' || kind || '",' || to_json(detail) || ']'), 1, 16)"""
_GAP_FINDINGS = f"""SELECT 'pf-' || substr(sha256('["PFC01","' || gap || '"]'), 1, 16) AS id, gap, CASE WHEN impact = 'low' THEN 'info' ELSE 'warning' END AS severity,
    'coverage gap (' || kind || ', ' || impact || ' impact): ' || detail AS message, first_path AS path, first_line AS line FROM (SELECT *, {_GAP_ID} AS gap FROM reached)"""


@plan(with_("SELECT * FROM pfc", "gaps", normal=_DETAIL, reached=_REACHED, pfc=_GAP_FINDINGS))
def f3_gap_findings(spark, sf):
    return X.gap_findings(_reached(spark, sf))


_EGRESS = f"""SELECT whom AS processor, CASE WHEN whom IS NOT NULL THEN coalesce(nullif(lower(regexp_replace(regexp_replace(whom, '^[^A-Za-z0-9._]+|[^A-Za-z0-9._]+$', '', 'g'), '[^A-Za-z0-9._]+', '_', 'g')), ''), 'unknown_processor') END AS fides_key,
    class, hk AS host_kind, hv AS host_value, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories, arg_min(decl_citation, decl_ordinal) IS NOT NULL AS declared, arg_min(decl_citation, decl_ordinal) AS citation, count(DISTINCT flow) AS n_flows
    FROM (SELECT f.id AS flow, f.category, k.*, coalesce(decl_name, {PROCESSOR}) AS whom, CASE WHEN coalesce(decl_name, {PROCESSOR}) IS NULL THEN host_kind END AS hk, CASE WHEN coalesce(decl_name, {PROCESSOR}) IS NULL THEN host_value END AS hv
      FROM flows f JOIN declared k ON k.id = f.sink WHERE {LEAVES}) GROUP BY whom, class, hk, hv"""


def _egress(spark, sf):
    return X.egress(flows(spark, sf), sinks(spark, sf), processors(spark, sf)).withColumn("categories", F.array_join("categories", ","))


@plan(with_(_EGRESS, *_ALL, declared=DECLARED))
def f4_egress(spark, sf):
    return _egress(spark, sf)


@plan(with_("SELECT 'rule' AS what, rule_id AS value, count(*) AS n FROM exposed GROUP BY rule_id UNION ALL SELECT 'severity', severity, count(*) FROM exposed GROUP BY severity UNION ALL SELECT 'processors', NULL, count(DISTINCT processor) FROM egress", *_ALL, **_CTES, egress=_EGRESS))
def f5_summary(spark, sf):
    """Counts by rule and by severity from one pass over the findings, and of processors."""
    found = _findings(spark, sf).select(F.explode(F.array(F.struct(F.lit("rule").alias("what"), F.col("rule_id").alias("value")), F.struct(F.lit("severity").alias("what"), F.col("severity").alias("value")))).alias("x"))
    counts = found.groupBy("x.what", "x.value").agg(F.count(F.lit(1)).alias("n"))
    whom = _egress(spark, sf).agg(F.count_distinct("processor").alias("n")).select(F.lit("processors").alias("what"), F.lit(None).cast("string").alias("value"), "n")
    return counts.unionByName(whom)


@plan(with_("SELECT rule_id, severity, count(*) AS n FROM exposed WHERE sink IN (SELECT id FROM sinks WHERE line % 2 = 0) GROUP BY ALL", *_ALL, **_CTES))
def f6_recount(spark, sf):
    """Counts over the findings that a diff leaves."""
    left = sinks(spark, sf).filter("line % 2 = 0").select(F.col("id").alias("sink"))
    return _findings(spark, sf).join(left, "sink", "left_semi").groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


@plan(with_("SELECT count(*) || ' findings: ' || string_agg(severity || ' ' || n, ', ' ORDER BY severity) AS line FROM (SELECT severity, n FROM (SELECT severity, count(*) AS n FROM exposed GROUP BY severity)), (SELECT 1)".replace("count(*) || ' findings: '", "sum(n) || ' findings: '", 1), *_ALL, **_CTES))
def f15_summary_line(spark, sf):
    counts = _findings(spark, sf).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("severity", "n"))), lambda x: F.concat(x["severity"], F.lit(" "), x["n"])), ", ")
    return counts.agg(F.concat(F.sum("n"), F.lit(" findings: "), parts).alias("line"))


@plan(with_(f"SELECT id, {FIRST_PARTY} AS first_party FROM sinks", "sinks"))
def c9_first_party(spark, sf):
    return sinks(spark, sf).select("id", X.is_first_party().alias("first_party"))


@plan(with_(f"SELECT id, {INTERNAL} AS internal FROM sinks", "sinks"))
def c10_internal(spark, sf):
    return sinks(spark, sf).select("id", X.is_internal().alias("internal"))


@plan(with_(f"SELECT id, {PROCESSOR} AS processor FROM sinks", "sinks"))
def c11_processor(spark, sf):
    return sinks(spark, sf).select("id", X.processor_of().alias("processor"))


@plan(with_("SELECT id, decl_ordinal, decl_name, decl_citation FROM declared", "sinks", "processors", declared=DECLARED))
def c12_declared_processor(spark, sf):
    return X.declared(sinks(spark, sf), processors(spark, sf)).select("id", "decl_ordinal", "decl_name", "decl_citation")


AS_OF = "2024-06-30"
SUPPRESSED = f"CASE WHEN status IN ('accepted', 'false_positive') THEN coalesce(decided_at <= '{AS_OF}', false) AND coalesce(expires_at >= '{AS_OF}', true) WHEN status = 'remediated' THEN coalesce(remediated_at <= '{AS_OF}', false) ELSE false END"
_DATE = lambda x: rf"coalesce(regexp_full_match({x}, '\d\d\d\d-\d\d-\d\d') AND try_cast({x} AS DATE) IS NOT NULL, false)"


@plan(with_(f"SELECT finding, {SUPPRESSED} AS suppressed FROM dispositions", "dispositions"))
def c13_suppressed(spark, sf):
    return dispositions(spark, sf).select("finding", X.suppressed(F.col("status"), F.col("decided_at"), F.col("expires_at"), F.col("remediated_at"), AS_OF).alias("suppressed"))


_PROBLEMS = f"""CASE WHEN status = 'open' THEN '' ELSE concat_ws('; ', CASE WHEN coalesce(owner, '') = '' THEN 'owner is required' END, CASE WHEN coalesce(rationale, '') = '' THEN 'rationale is required' END,
    CASE WHEN NOT {_DATE('decided_at')} THEN 'decided_at must be a calendar date (YYYY-MM-DD)' END, CASE WHEN expires_at IS NOT NULL AND NOT {_DATE('expires_at')} THEN 'expires_at must be a calendar date' END,
    CASE WHEN remediated_at IS NOT NULL AND NOT {_DATE('remediated_at')} THEN 'remediated_at must be a calendar date' END, CASE WHEN expires_at < decided_at THEN 'expires_at precedes decided_at' END,
    CASE WHEN status = 'remediated' THEN CASE WHEN remediated_at IS NULL THEN 'remediated requires remediated_at' WHEN decided_at IS NULL OR remediated_at < decided_at THEN 'remediated_at precedes decided_at' END END) END"""


@plan(with_(f"SELECT finding, {_PROBLEMS} AS problems FROM dispositions", "dispositions"))
def c14_disposition_shape(spark, sf):
    found = X.check_disposition(*[F.col(c) for c in ("status", "owner", "rationale", "decided_at", "expires_at", "remediated_at")])
    return dispositions(spark, sf).select("finding", F.array_join(found, "; ").alias("problems"))


@plan(with_(f"SELECT finding, decided_at, {_DATE('decided_at')} AS valid, {_DATE('expires_at')} AS expiry_valid FROM dispositions", "dispositions"))
def c15_date(spark, sf):
    return dispositions(spark, sf).select("finding", "decided_at", N.is_date(F.col("decided_at")).alias("valid"), N.is_date(F.col("expires_at")).alias("expiry_valid"))


@plan("SELECT event_id, rule FROM (SELECT event_id, 'PF00' || (event_id % 9) AS rule FROM events) WHERE rule IN ('PF001', 'PF002', 'PF003', 'PF004', 'PF005', 'PF006', 'PFC01')")
def c16_known_rule(spark, sf):
    known = spark.createDataFrame([(r,) for r in X.RULES], "rule string")
    return table(spark, sf, "events").select("event_id", F.concat(F.lit("PF00"), F.col("event_id") % 9).alias("rule")).join(F.broadcast(known), "rule", "left_semi").select("event_id", "rule")


@plan(with_("SELECT rule_id, ['info', 'warning', 'medium', 'high'][max(list_position(['info', 'warning', 'medium', 'high'], severity))] AS worst, ['info', 'warning', 'medium', 'high'][min(list_position(['info', 'warning', 'medium', 'high'], severity))] AS least FROM exposed GROUP BY rule_id", *_ALL, **_CTES))
def c17_severity_order(spark, sf):
    rank = X.rank_of(F.col("severity"), X.SEVERITIES)
    return _findings(spark, sf).groupBy("rule_id").agg(X.severity_of(F.max(rank)).alias("worst"), X.severity_of(F.min(rank)).alias("least"))


@plan(with_(f"SELECT CASE WHEN blocking > 0 THEN 4 WHEN failing > 0 THEN 1 ELSE 0 END::BIGINT AS verdict, blocking, failing FROM (SELECT count(*) FILTER (WHERE rule = 'PFC01') AS blocking, count(*) FILTER (WHERE rule <> 'PFC01' AND sev >= 2) AS failing FROM (SELECT CASE WHEN hash_k % 50 = 0 THEN 'PFC01' ELSE 'PF001' END AS rule, hash_k % 4 AS sev FROM (SELECT *, substr(finding, 4)::BIGINT AS hash_k FROM dispositions) WHERE NOT {SUPPRESSED}))", "dispositions"))
def f17_check(spark, sf):
    """Exit code of a check: 4 for active gaps, 1 for active findings at or over the severity, else 0."""
    k = F.expr("cast(substring(finding, 4) as long)")
    active = dispositions(spark, sf).filter(~X.suppressed(F.col("status"), F.col("decided_at"), F.col("expires_at"), F.col("remediated_at"), AS_OF))
    rows = active.select(F.when(k % 50 == 0, "PFC01").otherwise("PF001").alias("rule"), (k % 4).alias("sev"))
    counts = rows.agg(F.count_if(F.col("rule") == "PFC01").alias("blocking"), F.count_if((F.col("rule") != "PFC01") & (F.col("sev") >= 2)).alias("failing"))
    return counts.select(F.when(F.col("blocking") > 0, 4).when(F.col("failing") > 0, 1).otherwise(0).cast("long").alias("verdict"), "blocking", "failing")


@plan(with_("SELECT f.id, k.path AS sink_path, k.line AS sink_line, s.path AS src_path, s.line AS src_line FROM flows f JOIN sinks k ON k.id = f.sink JOIN sources s ON s.id = f.source ORDER BY 2, 3, 4, 5, f.category, f.id", *_ALL))
def h1_document_order(spark, sf):
    return O.document_order(O.located(flows(spark, sf), sources(spark, sf), sinks(spark, sf))).select("id", "sink_path", "sink_line", "src_path", "src_line")


@plan(with_("SELECT DISTINCT rule_id, path, line, id FROM exposed ORDER BY rule_id, path NULLS FIRST, line, id", *_ALL, **_CTES))
def h2_findings_order(spark, sf):
    return _findings(spark, sf).dropDuplicates(["id"]).select("rule_id", "path", "line", "id").orderBy("rule_id", F.asc_nulls_first("path"), "line", "id")


@plan(with_(f"SELECT kind, detail, impact, {_GAP_ID} AS id FROM reached ORDER BY list_position(['high', 'medium', 'low'], impact), kind, detail", "gaps", normal=_DETAIL, reached=_REACHED))
def h3_gaps_order(spark, sf):
    gap = F.concat(F.lit("gap-"), N.short_hash(N.json_array(N.json_string(F.col("kind")), N.json_string(F.col("detail")))))
    return _reached(spark, sf).orderBy(X.rank_of(F.col("impact"), X.IMPACTS), "kind", "detail").select("kind", "detail", "impact", gap.alias("id"))


@plan(with_("SELECT rule, sink, f.text AS first_text, n_sources, CASE WHEN n_sources > 1 THEN 'and ' || (n_sources - 1) || ' other' END AS more FROM grouped", *_ALL, **_CTES))
def g3_first_source(spark, sf):
    g = _hits(spark, sf).groupBy("rule", "sink", "needs_review").agg(F.min_by("text", F.struct("src_path", "src_line", "source", "text")).alias("first_text"), F.count_distinct("source").alias("n_sources"))
    return g.select("rule", "sink", "first_text", "n_sources", F.when(F.col("n_sources") > 1, F.concat(F.lit("and "), F.col("n_sources") - 1, F.lit(" other"))).alias("more"))


@plan(with_("SELECT severity, CASE severity WHEN 'high' THEN 'error' WHEN 'info' THEN 'note' ELSE 'warning' END AS level, count(*) AS n FROM exposed GROUP BY ALL", *_ALL, **_CTES))
def b9_sarif_level(spark, sf):
    level = F.when(F.col("severity") == "high", "error").when(F.col("severity") == "info", "note").otherwise("warning")
    return _findings(spark, sf).groupBy("severity", level.alias("level")).agg(F.count(F.lit(1)).alias("n"))


@plan(with_("""SELECT DISTINCT '{"category":"' || f.category || '","sink":{"line":' || k.line || ',"path":"' || k.path || '"},"source":{"line":' || s.line || ',"path":"' || s.path || '"}}' AS line
    FROM flows f JOIN sinks k ON k.id = f.sink JOIN sources s ON s.id = f.source ORDER BY 1""", *_ALL))
def b7_facts_lines(spark, sf):
    """One canonical JSON line a flow, distinct and in order."""
    place = lambda df, name: df.select(F.col("id").alias(name), F.struct("line", "path").alias(f"{name}_at"))
    rows = flows(spark, sf).join(place(sinks(spark, sf), "sink"), "sink").join(place(sources(spark, sf), "source"), "source")
    return rows.select(F.to_json(F.struct("category", F.col("sink_at").alias("sink"), F.col("source_at").alias("source"))).alias("line")).distinct().orderBy("line")


@plan(with_("SELECT text AS name, count(DISTINCT sink || rule) AS n_findings, array_to_string(list_sort(list(DISTINCT rule)), ',') AS rules FROM fired WHERE needs_review GROUP BY text", *_ALL, declared=DECLARED, fired=FIRED))
def b13_review_queue(spark, sf):
    """Names whose findings wait for review, with their rules."""
    return _hits(spark, sf).filter("needs_review").groupBy(F.col("text").alias("name")).agg(F.count_distinct(F.concat("sink", "rule")).alias("n_findings"), F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"))


@plan(with_("SELECT path, anchor, 'src-' || substr(sha256(anchor || chr(31) || n), 1, 16) AS id FROM (SELECT path, line, anchor, dense_rank() OVER (PARTITION BY anchor ORDER BY path, line) - 1 AS n FROM (SELECT path, line, path || chr(31) || category AS anchor FROM sources))", "sources"))
def g1_anchor_ids(spark, sf):
    """Ids that outlive unrelated edits: equal anchors are numbered in source order."""
    return anchor_ids(sources(spark, sf).withColumn("anchor", N.anchor_key(F.col("path"), F.col("category"))), "src", ["path", "line"]).select("path", "anchor", "id")


def anchor_ids(rows, prefix: str, place: list[str]):
    from pyspark.sql import Window

    n = F.dense_rank().over(Window.partitionBy("anchor").orderBy(*place)) - 1
    return rows.withColumn("id", F.concat(F.lit(f"{prefix}-"), N.short_hash(F.concat("anchor", F.lit("\x1f"), n.cast("string")))))
