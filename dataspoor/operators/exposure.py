"""Policy rules over flows: exposures, egress, gaps and their order.

Inputs are the tables of `dataspoor.plans.relations` or of a scan: sources (id,
category, needs_review, path, line, text), sinks (id, catalogue_id, class,
processor, heuristic, host_kind, host_value, dest_kind, dest_target, path, line),
flows (id, source, sink, category, echoed, field) and declared processors
(ordinal, name, sink_regex, host, citation). Dimension tables grow with the
code, so no join here is forced to broadcast: the optimizer takes the small side
by its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N

#: Severities in ascending order and the default severity of each rule.
SEVERITIES = ("info", "warning", "medium", "high")
RULES = {"PF001": "medium", "PF002": "high", "PF003": "medium", "PF004": "high", "PF005": "high", "PF006": "warning", "PFC01": "warning"}
IMPACTS = ("high", "medium", "low")


def rank_of(value: Column, order: tuple[str, ...]) -> Column:
    """Place in the order from 0; values outside it come last."""
    at = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(at > 0, at - 1).otherwise(F.lit(len(order))).cast("int")


def severity_of(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, SEVERITIES)), rank)


def is_first_party() -> Column:
    return F.coalesce((F.col("class") == "http") & (F.col("host_kind") == "relative"), F.lit(False))


def is_internal() -> Column:
    return F.coalesce(F.col("dest_kind") == "internal", F.lit(False))


def leaves() -> Column:
    """Data goes to someone else: an external class, no first-party request, no system of the repository."""
    return N.is_external(F.col("class")) & ~is_first_party() & ~is_internal()


def processor_of() -> Column:
    """The vendor, else the destination's processor, else a literal host."""
    return F.coalesce("processor", F.when(F.col("dest_kind") == "processor", F.col("dest_target")), F.when(F.col("host_kind") == "literal", F.col("host_value")))


def declared(sinks: DataFrame, processors: DataFrame) -> DataFrame:
    """sinks with decl_ordinal, decl_name and decl_citation of the first declaration that matches, else null.

    A declaration matches by name (any case), by a pattern of sink ids, or by the
    host or a domain above it. Names and hosts are equi-joins (a host brings all
    its parent domains); patterns are few and matched once per distinct sink id.
    """
    host = F.when((F.col("host_kind") == "literal") & F.col("host_value").isNotNull(), F.col("host_value")).when(F.col("dest_kind") == "processor", F.col("dest_target"))
    parts = F.split(host, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    by_name = sinks.select("id", F.lower("processor").alias("k")).join(processors.select(F.lower("name").alias("k"), "ordinal"), "k").select("id", "ordinal")
    by_host = sinks.filter(host.isNotNull()).select("id", F.explode(above).alias("k")).join(processors.select(F.col("host").alias("k"), "ordinal"), "k").select("id", "ordinal")
    ids = sinks.select("catalogue_id").distinct()
    by_id = ids.join(processors.filter("sink_regex is not null"), F.expr("catalogue_id rlike sink_regex")).select("catalogue_id", "ordinal")
    by_id = sinks.select("id", "catalogue_id").join(by_id, "catalogue_id").select("id", "ordinal")
    first = by_name.union(by_host).union(by_id).groupBy("id").agg(F.min("ordinal").alias("decl_ordinal"))
    facts = processors.select(F.col("ordinal").alias("decl_ordinal"), F.col("name").alias("decl_name"), F.col("citation").alias("decl_citation"))
    return sinks.join(first.join(facts, "decl_ordinal"), "id", "left")


def fired(flows: DataFrame, sources: DataFrame, sinks: DataFrame, processors: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """A row for each flow and rule that fires on it.

    flow, rule, source, sink, category, needs_review, severity (rank), processor,
    heuristic and the places of source and sink. rules: the enabled rules'
    severities.
    """
    src = sources.select(F.col("id").alias("source"), F.col("needs_review").alias("src_review"), F.col("path").alias("src_path"), F.col("line").alias("src_line"), "text")
    # What a sink alone decides is computed once for it and not for each of its flows.
    snk = declared(sinks, processors).withColumns({"__out": leaves(), "__whom": processor_of()}).withColumnsRenamed({"id": "sink", "path": "sink_path", "line": "sink_line"})
    f = flows.withColumnRenamed("id", "flow").join(src, "source").join(snk, "sink")
    category = F.col("category")
    unsure = category == N.UNKNOWN
    credential, out, whom = N.is_credential(category), F.col("__out"), F.col("__whom")
    in_header = F.coalesce((F.col("class") == "http") & F.lower("field").isin(*N.AUTH_FIELDS), F.lit(False))
    log = F.col("class") == "log"
    tests = {
        "PF001": log & ~credential & ~N.starts_below(category, "user.unique_id.pseudonymous"),
        "PF002": out & F.col("decl_ordinal").isNull() & whom.isNotNull(),
        "PF003": F.col("class") == "llm",
        "PF004": N.is_special(category) & out,
        "PF005": credential & (log | out) & ~in_header,
        "PF006": F.coalesce((F.col("class") == "http") & (F.col("host_kind") == "dynamic"), F.lit(False)) & F.col("dest_kind").isNull() & ~(credential & in_header),
    }
    lowered = F.col("src_review") | F.col("echoed") | unsure
    level = lambda rule: F.when(lowered, F.least(rank_of(F.lit(rules[rule]), SEVERITIES), F.lit(0))).otherwise(rank_of(F.lit(rules[rule]), SEVERITIES))
    quiet = ("PF001", "PF006")
    hits = [F.when(t, F.struct(F.lit(r).alias("rule"), level(r).alias("severity"), (F.lit(None).cast("string") if r in quiet else whom).alias("processor"))) for r, t in tests.items() if r in rules]
    rows = f.withColumn("hit", F.explode(F.array(*hits))).filter("hit is not null")
    review = F.col("src_review") | F.col("heuristic") | unsure | F.col("echoed")
    return rows.select("flow", "hit.rule", "source", "sink", "category", review.alias("needs_review"), "hit.severity", "hit.processor", "heuristic", "src_path", "src_line", "text", "sink_path", "sink_line", "catalogue_id", "class")


def exposures(hits: DataFrame) -> DataFrame:
    """One finding for each (rule, sink, needs_review).

    id, rule_id, sink, needs_review, severity, categories (sorted), n_flows,
    n_sources, processor, heuristic, path, line and message. The first source in
    the order of place and id describes the data. What a group may hold without
    bound is counted, not gathered: flows are `findings_flows`'s rows. A flow has
    one source, so flows are counted by source and their numbers added up.
    """
    same = ("heuristic", "sink_path", "sink_line", "catalogue_id", "class")
    by_source = hits.groupBy("rule", "sink", "needs_review", "source").agg(
        F.max("severity").alias("rank"),
        F.collect_set("category").alias("categories"),
        F.count_distinct("flow").alias("n_flows"),
        F.max("processor").alias("processor"),
        *[F.first(c).alias(c) for c in same],
        F.min(F.struct("src_path", "src_line", "source", "text")).alias("first"),
    )
    g = by_source.groupBy("rule", "sink", "needs_review").agg(
        F.max("rank").alias("rank"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("categories")))).alias("categories"),
        F.sum("n_flows").alias("n_flows"),
        F.count("source").alias("n_sources"),
        F.max("processor").alias("processor"),
        F.first("heuristic").alias("heuristic"),
        F.first("sink_path").alias("path"),
        F.first("sink_line").alias("line"),
        F.first("catalogue_id").alias("catalogue_id"),
        F.first("class").alias("class"),
        F.min("first").alias("first"),
    )
    key = N.json_array(N.json_string(F.col("rule")), N.json_string(F.col("sink")), F.col("needs_review").cast("string"), N.json_array(*[F.array_join(F.transform("categories", N.json_string), ",")]))
    return g.select(F.concat(F.lit("pf-"), N.short_hash(key)).alias("id"), F.col("rule").alias("rule_id"), "sink", "needs_review", severity_of(F.col("rank")).alias("severity"), "categories", "n_flows", "n_sources", "processor", "heuristic", "path", "line", message().alias("message"))


def message() -> Column:
    """What a finding says: its data, its first source, how many more, and where it goes."""
    data = F.when((F.size("categories") == 1) & (F.get("categories", 0) == N.UNKNOWN), F.lit("uncertain: data of undetermined category")).otherwise(F.array_join("categories", ", "))
    more = F.when(F.col("n_sources") == 1, "").when(F.col("n_sources") == 2, " and 1 other source").otherwise(F.concat(F.lit(" and "), F.col("n_sources") - 1, F.lit(" other sources")))
    what = F.concat(data, F.lit(" from `"), F.col("first.text"), F.lit("` ("), F.col("first.src_path"), F.lit(":"), F.col("first.src_line"), F.lit(")"), more)
    at = F.concat(F.col("path"), F.lit(":"), F.col("line"))
    whom = F.coalesce("processor", F.lit("an LLM provider chosen at run time"))
    tails = {
        "PF001": ("", F.concat(F.lit(" reaches a log sink ("), "catalogue_id", F.lit(") at "), at)),
        "PF002": ("", F.concat(F.lit(" reaches "), whom, F.lit(", a processor that is not declared, at "), at)),
        "PF003": ("", F.concat(F.lit(" reaches "), whom, F.lit(" through a model call at "), at)),
        "PF004": ("special-category data: ", F.concat(F.lit(" reaches an external "), "class", F.lit(" sink at "), at)),
        "PF005": ("credentials: ", F.concat(F.lit(" reach a "), "class", F.lit(" sink at "), at)),
        "PF006": ("", F.concat(F.lit(" is sent over HTTP to a host computed at run time, at "), at)),
    }
    out = None
    for rule, (before, after) in tails.items():
        out = (F if out is None else out).when(F.col("rule") == rule, F.concat(F.lit(before), what, after))
    return out


def egress(flows: DataFrame, sinks: DataFrame, processors: DataFrame) -> DataFrame:
    """A row for each (processor, class, host) that data leaves to.

    processor, fides_key, class, host_kind, host_value, categories (sorted),
    declared, citation, n_flows.
    """
    snk = declared(sinks, processors).withColumnRenamed("id", "sink").filter(leaves())
    whom = F.coalesce("decl_name", processor_of())
    f = flows.withColumnRenamed("id", "flow").join(snk, "sink").withColumn("whom", whom)
    unnamed = lambda c: F.when(F.col("whom").isNull(), F.col(c))
    g = f.groupBy("whom", "class", unnamed("host_kind").alias("host_kind"), unnamed("host_value").alias("host_value")).agg(
        F.array_sort(F.collect_set("category")).alias("categories"),
        F.count_distinct("flow").alias("n_flows"),
        F.min_by("decl_citation", F.col("decl_ordinal")).alias("citation"),
    )
    return g.select(F.col("whom").alias("processor"), F.when(F.col("whom").isNotNull(), N.fides_slug(F.col("whom"))).alias("fides_key"), "class", "host_kind", "host_value", "categories", F.col("citation").isNotNull().alias("declared"), "citation", "n_flows")


def reached_gaps(gaps: DataFrame, presentation: Column | None = None) -> DataFrame:
    """Gaps grouped by (kind, normal detail) with impact and reason.

    kind, detail, n_locations, n_reached, impact, impact_reason, first_path,
    first_line. presentation: whether a call only presents its value (null: none).
    """
    calls = F.col("kind").isin("unresolved_callee", "unresolved_method", "dynamic_call")
    shows = F.lit(False) if presentation is None else presentation & calls
    g = (
        gaps.withColumns({"__shows": shows, "__detail": N.gap_detail(F.col("detail"))})
        .groupBy("kind", "__detail")
        .agg(
            F.count_distinct("path", "line").alias("n_locations"),
            F.count(F.lit(1)).alias("n_reached"),
            F.max("__shows").alias("shows"),
            F.array_sort(F.collect_set(F.when(~F.col("needs_review") & (F.col("category") != N.UNKNOWN), F.col("category")))).alias("personal"),
            F.min(F.struct("path", "line")).alias("first"),
        )
    )
    named = F.concat(F.lit("personal data reaches its arguments: "), F.array_join(F.slice("personal", 1, 3), ", "), F.when(F.size("personal") > 3, ", …").otherwise(""))
    impact = F.when(F.col("shows"), "low").when(F.size("personal") == 0, "medium").otherwise("high")
    reason = F.when(F.col("shows"), "the call only presents the value").when(F.size("personal") == 0, "only values whose category needs review reach it").otherwise(named)
    return g.select("kind", F.col("__detail").alias("detail"), "n_locations", "n_reached", impact.alias("impact"), reason.alias("impact_reason"), F.col("first.path").alias("first_path"), F.col("first.line").alias("first_line"))


def gap_findings(gaps: DataFrame, severity: str = RULES["PFC01"]) -> DataFrame:
    """One PFC01 finding a gap; a gap of low impact is information only."""
    gap = F.concat(F.lit("gap-"), N.short_hash(N.json_array(N.json_string(F.col("kind")), N.json_string(F.col("detail")))))
    own = rank_of(F.lit(severity), SEVERITIES)
    level = F.when(F.col("impact") == "low", F.least(own, F.lit(0))).otherwise(own)
    said = F.concat(F.lit("coverage gap ("), "kind", F.lit(", "), "impact", F.lit(" impact): "), "detail")
    rows = gaps.withColumn("gap", gap)
    return rows.select(F.concat(F.lit("pf-"), N.short_hash(N.json_array(F.lit('"PFC01"'), N.json_string(F.col("gap"))))).alias("id"), "gap", severity_of(level).alias("severity"), said.alias("message"), F.col("first_path").alias("path"), F.col("first_line").alias("line"))


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def check_disposition(status: Column, owner: Column, rationale: Column, decided: Column, expires: Column, remediated: Column) -> Column:
    """What is wrong with a decision, in order; nothing for an open one."""
    blank = lambda c: F.coalesce(c == "", F.lit(True))
    fixed = status == "remediated"
    problems = [
        F.when(blank(owner), "owner is required"),
        F.when(blank(rationale), "rationale is required"),
        F.when(~N.is_date(decided), "decided_at must be a calendar date (YYYY-MM-DD)"),
        F.when(expires.isNotNull() & ~N.is_date(expires), "expires_at must be a calendar date"),
        F.when(remediated.isNotNull() & ~N.is_date(remediated), "remediated_at must be a calendar date"),
        F.when(expires < decided, "expires_at precedes decided_at"),
        F.when(fixed & remediated.isNull(), "remediated requires remediated_at").when(fixed & (decided.isNull() | (remediated < decided)), "remediated_at precedes decided_at"),
    ]
    found = F.filter(F.array(*problems), lambda p: p.isNotNull())
    return F.when(status == "open", F.array().cast("array<string>")).otherwise(found)


def suppressed(status: Column, decided: Column, expires: Column, remediated: Column, as_of: str) -> Column:
    """Whether a decision takes its finding away on a day; dates compare as text."""
    held = F.coalesce(decided <= as_of, F.lit(False)) & F.coalesce(expires >= as_of, F.lit(True))
    return F.when(status.isin("accepted", "false_positive"), held).when(status == "remediated", F.coalesce(remediated <= as_of, F.lit(False))).otherwise(F.lit(False))
