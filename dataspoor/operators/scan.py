"""The main query: from source files to flows, findings, egress and gaps.

files -> statements (parsed on executors, file by file) -> edges, seeds and hits
(joins with the rule tables) -> reachability (rounds over the edge table) ->
report tables. Every step is a table keyed by repository, so one job scans any
number of repositories, and nothing is gathered by repository or on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..sources import catalogue
from . import classification as K
from . import exposure as X
from . import graph as G
from . import handlers as H
from . import lookup as L
from . import program as R
from . import propagation as P

_PROCESSORS = "ordinal int, name string, sink_regex string, host string, citation string"


@dataclass
class Report:
    sources: DataFrame
    sinks: DataFrame
    flows: DataFrame
    gaps: DataFrame
    findings: DataFrame
    egress: DataFrame


def _anchored(rows: DataFrame, prefix: str, *parts: str) -> DataFrame:
    """rows with ids from what identifies them without their line; equal anchors are numbered in source order."""
    n = F.dense_rank().over(Window.partitionBy("__a").orderBy("path", "line", "col")) - 1
    keyed = rows.withColumn("__a", N.anchor_key(*[F.col(p) for p in parts]))
    return keyed.withColumn("id", F.concat(F.lit(f"{prefix}-"), N.short_hash(F.concat("__a", F.lit("\x1f"), n.cast("string"))))).drop("__a")


def resolve_local(ir: DataFrame) -> DataFrame:
    """(sid, target): functions of the repository that calls reach, by the file's own names or by a path's suffix."""
    funcs = ir.filter("kind = 'func'").select("repo", "path", "fn")
    own = ir.filter("kind = 'call' and how = 'local'").select("sid", "repo", "path", F.col("callee").alias("fn"))
    init = own.withColumn("fn", F.concat("fn", F.lit(".__init__")))
    same = own.unionByName(init).join(funcs, ["repo", "path", "fn"]).select("sid", "path", "fn", "repo")
    module = F.regexp_replace(F.regexp_replace("path", r"(?:/__init__)?\.[^./]+$", ""), "/", ".")
    dotted = F.split(F.concat(module, F.lit("."), "fn"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(dotted) - 1), lambda k: F.array_join(F.slice(dotted, k, F.size(dotted)), "."))
    by_suffix = funcs.select("repo", F.explode(suffixes).alias("name"), "path", "fn")
    best = by_suffix.groupBy("repo", "name").agg(F.min_by(F.struct("path", "fn"), F.struct(F.length("path"), "path")).alias("t"))
    far = ir.filter("kind = 'call' and how = 'api'").select("sid", "repo", F.regexp_replace("callee", r"^\.+", "").alias("name"))
    other = far.join(best, ["repo", "name"]).select("sid", "t.path", "t.fn", "repo")
    return same.unionByName(other).select("sid", F.concat_ws("|", "repo", "path", "fn").alias("target"))


def scan(ir: DataFrame, lang: str, rules: DataFrame, methods: dict[str, tuple[str, ...]], processors: DataFrame | None = None, extra: DataFrame | None = None, levels: dict[str, str] = X.RULES, most: int | None = None) -> Report:
    """Report tables of statements (see sources.python.IR).

    rules: see sources.catalogue.rules; methods: data methods by their flow;
    extra: declared names for the classifier; processors: declared ones; levels:
    severities of the policy rules that are enabled; most: edges that a flow may
    take, all by default; what that cuts is a `depth_bound` gap.
    """
    spark = ir.sparkSession
    processors = spark.createDataFrame([], _PROCESSORS) if processors is None else processors
    ir = G.store(ir.withColumn("sid", F.concat_ws("|", "repo", "path", "n")))
    calls = ir.filter("kind = 'call'")
    entries = rules.select("entry", "class", "processor", "removes", "flow").distinct()

    # What each call is: of the repository, decided by the catalogue, a data method, or a gap.
    targets = G.cut(resolve_local(ir))
    rest = calls.join(targets.select("sid").distinct(), "sid", "left_anti")
    decided = L.decide(rest.filter("how = 'api'").select(F.col("sid").alias("stmt"), F.col("callee").alias("path"), F.lit(lang).alias("lang")), rules).select(F.col("stmt").alias("sid"), "kind", "entry")
    by_rule = G.cut(rest.join(decided.filter("kind is not null").withColumnRenamed("kind", "decision"), "sid").join(F.broadcast(entries), "entry"))
    unruled = rest.join(by_rule.select("sid"), "sid", "left_anti")
    loggers, log_methods = catalogue.LOGGERS[lang]
    ladder = G.cut(R.method_ladder(unruled, loggers, log_methods, methods, catalogue.receivers(lang)))
    logs, left = ladder.filter("step = 'sink'"), ladder.filter("step <> 'sink'")

    # Edges.
    needs = F.transform(F.filter("args", lambda a: a["var"].isNotNull()), lambda a: a["var"])
    none = F.lit(None).cast("string")
    shape = lambda df, flow: df.select(F.col("sid").alias("stmt"), flow.alias("flow"), "dst", "recv", needs.alias("args"), none.alias("callback_formal"), none.alias("callback_return"))
    applied = P.apply_flows(shape(by_rule.filter("decision in ('propagator', 'source')"), F.coalesce("flow", F.lit("args_to_result"))).unionByName(shape(left, F.coalesce("flow", F.lit("args_to_result")))))
    edge = lambda df, kind, key, a, b: df.select(F.lit(kind).alias("kind"), key.alias("key"), a.alias("a"), b.alias("b"))
    cleaned = by_rule.filter("decision = 'sanitiser' and removes <> '*'").select("dst", "removes", F.explode(needs).alias("src"))
    formals = ir.filter("kind = 'func'").select(F.concat_ws("|", "repo", "path", "fn").alias("fn"), F.explode("args").alias("p")).select("fn", F.col("p.var").alias("formal"), "p.kind", "p.pos", "p.name")
    local = calls.join(targets, "sid")
    passed = local.select(F.col("sid").alias("site"), F.col("target").alias("fn"), F.explode("args").alias("x")).select("site", "fn", "x.*")
    bound = L.bind(passed, formals)
    results = local.join(ir.filter("kind = 'func'").select(F.concat_ws("|", "repo", "path", "fn").alias("target"), F.col("dst").alias("slot")), "target")
    edges = (
        P.statement_edges(ir).select("kind", "key", F.col("src").alias("a"), F.col("dst").alias("b"))
        .unionByName(applied.select("kind", none.alias("key"), F.col("src").alias("a"), F.col("dst").alias("b")))
        .unionByName(edge(cleaned, "sanitize", F.col("removes"), F.col("src"), F.col("dst")))
        .unionByName(edge(bound, "copy", none, F.col("actual"), F.col("formal")))
        .unionByName(edge(results, "copy", none, F.col("slot"), F.col("dst")))
    )
    edges = G.cut(edges.filter("a is not null and b is not null").distinct())

    # Sources: fields by name, request input, parameters by name.
    reads = ir.filter("kind in ('load', 'api')")
    requests = L.decide(reads.filter("callee is not null").select(F.col("sid").alias("stmt"), F.col("callee").alias("path"), F.lit(lang).alias("lang")), rules.filter("kind = 'source'")).filter("entry is not null").select(F.col("stmt").alias("sid"), F.lit(True).alias("request"))
    no_siblings = F.array().cast("array<string>")
    named = reads.select("sid", F.col("field").alias("name"), N.receiver_ident(F.col("text")).alias("object"), no_siblings.alias("siblings")).filter("name is not null")
    classified = K.classify(named, extra).select("sid", "category", "needs_review", "by")
    read_seeds = reads.join(requests, "sid", "left").join(classified, "sid", "left").filter("category is not null or request")
    read_seeds = read_seeds.select("repo", "path", "fn", F.col("dst").alias("var"), F.coalesce("category", F.lit(N.UNKNOWN)).alias("category"), F.coalesce("needs_review", F.lit(False)).alias("needs_review"), F.when(F.col("request"), "request").otherwise("field").alias("kind"), F.col("field").alias("name"), "text", "line", "col")
    of_source = F.create_map(*[F.lit(x) for kv in catalogue.source_categories().items() for x in kv])
    called = by_rule.filter("decision = 'source'").select("repo", "path", "fn", F.col("dst").alias("var"), F.coalesce(F.try_element_at(of_source, F.col("entry")), F.lit(N.UNKNOWN)).alias("category"), F.lit(False).alias("needs_review"), F.lit("request").alias("kind"), F.coalesce(F.col("field"), F.col("callee")).alias("name"), "text", "line", "col")
    carries = spark.createDataFrame(catalogue.parameters(lang), "entry string, which string, how string, name string, category string")
    handlers = H.find_handlers(ir, catalogue.handler_ways(lang)).select("repo", "path", "fn", "entry")
    carried = H.select_parameters(G.cut(handlers), H.parameters_of(ir), carries, ir.filter("kind = 'class'").select("repo", F.col("field").alias("type")).distinct())
    carried, read_seeds = G.cut(carried), G.cut(read_seeds)
    brought = H.handler_seeds(ir, carried).select("repo", "path", "fn", "var", "category", F.lit(False).alias("needs_review"), F.lit("request").alias("kind"), "name", "text", "line", "col").distinct()
    # A value that its own name classifies is that, not unknown request input.
    known_by_name = read_seeds.filter(F.col("category") != N.UNKNOWN).select("var").distinct()
    read_seeds = read_seeds.unionByName(called).unionByName(brought.join(known_by_name, "var", "left_anti"))
    params = ir.filter("kind = 'func'").select("repo", "path", "fn", "text", "line", "col", F.explode("args").alias("p"), F.transform("args", lambda a: N.table_key(a["name"])).alias("siblings"))
    params = params.select("repo", "path", "fn", F.col("p.var").alias("var"), F.col("p.name").alias("name"), F.lit(None).cast("string").alias("object"), "siblings", "text", "line", "col").filter("name is not null")
    param_seeds = K.classify(params, extra).select("repo", "path", "fn", "var", "category", "needs_review", F.lit("parameter").alias("kind"), "name", "text", "line", "col")
    named_params = param_seeds.select("var").distinct()
    read_seeds = read_seeds.join(named_params, "var", "left_anti")
    sources = G.cut(_anchored(read_seeds.unionByName(param_seeds).filter("var is not null"), "src", "repo", "path", "fn", "kind", "name", "category", "text"))

    # Sinks.
    url = F.col("host")
    complete = F.coalesce(url.startswith("="), F.lit(False))
    prefix = F.regexp_replace(url, "^=", "")
    http = F.col("class") == "http"
    sunk = by_rule.filter("decision = 'sink'").select("sid", "repo", "path", "fn", "args", "host", "text", "line", "col", F.col("entry").alias("catalogue_id"), "class", "processor", F.lit(False).alias("heuristic"))
    sunk = sunk.unionByName(logs.select("sid", "repo", "path", "fn", "args", "host", "text", "line", "col", F.lit("logger-by-name").alias("catalogue_id"), F.lit("log").alias("class"), none.alias("processor"), F.lit(True).alias("heuristic")))
    sunk = sunk.withColumns({"host_kind": F.when(http & url.isNotNull(), N.host_kind(prefix, complete)), "host_value": F.when(http & url.isNotNull(), N.host_value(prefix, complete)), "dest_kind": none, "dest_target": none})
    sinks = G.cut(_anchored(sunk, "snk", "repo", "path", "fn", "catalogue_id", "text"))

    # Flows and the gaps that data reaches.
    seeds = sources.select(F.col("id").alias("seed"), "var", "category").distinct()
    reached = G.reach(edges, seeds, most=most)
    best = G.cut(reached.groupBy("seed", "var").agg(F.min("dist").alias("dist")))
    hit_vars = sinks.select(F.col("id").alias("sink"), F.explode(needs).alias("var")).distinct()
    pairs = best.join(hit_vars, "var").groupBy(F.col("seed").alias("source"), "sink").agg(F.min("dist").alias("hops"))
    flows = pairs.join(sources.select(F.col("id").alias("source"), "category").distinct(), "source")
    key = N.json_array(N.json_string(F.col("source")), N.json_string(F.col("sink")), N.json_string(F.col("category")))
    flows = G.cut(flows.select(F.concat(F.lit("flow-"), N.short_hash(key)).alias("id"), "source", "sink", "category", F.col("hops").cast("long").alias("hops"), F.lit(False).alias("echoed"), none.alias("field")))
    open_calls = left.filter("flow is null").select(F.when(F.col("how") == "method", "unresolved_method").otherwise("unresolved_callee").alias("kind"), F.col("callee").alias("detail"), "path", "line", F.explode(needs).alias("var"))
    touched = open_calls.join(best.join(sources.select(F.col("id").alias("seed"), "category", "needs_review").distinct(), "seed"), "var").select("kind", "detail", "path", "line", "category", "needs_review")
    broken = ir.filter("kind = 'parse_error'").select("kind", F.col("text").alias("detail"), "path", "line", F.lit(N.UNKNOWN).alias("category"), F.lit(True).alias("needs_review"))
    foreign = H.framework_imports(ir, catalogue.frameworks(lang)).filter("not supported").groupBy("framework", "path").agg(F.min("line").alias("line"))
    foreign = foreign.select(F.lit("unsupported_framework").alias("kind"), F.col("framework").alias("detail"), "path", "line", F.lit(N.UNKNOWN).alias("category"), F.lit(True).alias("needs_review"))
    seen = touched.unionByName(broken).unionByName(foreign)
    if most is not None:
        over = G.reach_gaps(reached, edges, seeds, most).select(F.col("seed").alias("id")).distinct()
        cut_short = over.join(sources.select("id", "path", "line", "category", "needs_review").distinct(), "id")
        seen = seen.unionByName(cut_short.select(F.lit("depth_bound").alias("kind"), F.lit(f"flows of more than {most} edges").alias("detail"), "path", "line", "category", "needs_review"))
    gaps = X.reached_gaps(seen)
    slim = sources.select("id", "category", "needs_review", "path", "line", "text").distinct()
    flat = sinks.select("id", "repo", "catalogue_id", "class", "processor", "heuristic", "host_kind", "host_value", "dest_kind", "dest_target", "path", "line").dropDuplicates(["id"])
    findings = X.exposures(X.fired(flows, slim, flat, processors, levels)).join(flat.select(F.col("id").alias("sink"), "repo"), "sink")
    return Report(sources, flat, flows, gaps, findings, X.egress(flows, flat, processors))


def _union(a: Report, b: Report) -> Report:
    return Report(*[getattr(a, f).unionByName(getattr(b, f)) for f in ("sources", "sinks", "flows", "gaps", "findings", "egress")])


def scan_files(files: DataFrame, config=None) -> Report:
    """Report of source files (repo, path, text): exclusions, size limit and languages as configured.

    config: a `sources.config.Config`; the built-in rules and its extensions
    apply. Files of known languages that aren't read, and those over the size
    limit, are gaps.
    """
    from ..functions.globs import any_glob
    from ..sources import config as C
    from ..sources import files as S
    from ..sources import python, scripts

    spark = files.sparkSession
    config = C.Config() if config is None else config
    kept = files.filter(~any_glob(F.col("path"), config.excludes, "/")).withColumn("lang", S.language_of(F.col("path")))
    readable, large = S.size_guard(kept.filter("lang is not null"), text_col="text")
    rules = catalogue.rules(spark, config.extensions)
    processors = C.processor_table(spark, config).select("ordinal", "name", "sink_regex", "host", "citation")
    extra = C.field_table(spark, config)
    halves, read = [], []
    for lang, wanted, lower, methods in (("python", ("python",), python.lower_files, catalogue.PY_METHODS), ("javascript", ("javascript", "typescript"), scripts.lower_files, catalogue.JS_METHODS)):
        read += wanted
        halves.append(scan(lower(readable.filter(F.col("lang").isin(*wanted))), lang, rules.filter(F.col("lang") == lang), methods, processors, extra, config.rules))
    report = _union(*halves)
    # Whatever no reader above took and carries logic is a gap.
    unread = kept.filter(F.col("lang").isNull() | ~F.col("lang").isin(*read)).withColumn("other", F.coalesce(S.unsupported_of(F.col("path")), "lang")).filter("other is not null")
    static = unread.select(F.lit("unsupported_language").alias("kind"), F.col("other").alias("detail"), "path").unionByName(large.select("kind", F.lit("over the size limit").alias("detail"), "path"))
    counted = static.groupBy("kind", "detail").agg(F.count(F.lit(1)).alias("n_locations"), F.count(F.lit(1)).alias("n_reached"), F.min("path").alias("first_path"))
    said = "it exists whatever the data, so what it hides is not known"
    report.gaps = report.gaps.unionByName(counted.select("kind", "detail", "n_locations", "n_reached", F.lit("medium").alias("impact"), F.lit(said).alias("impact_reason"), "first_path", F.lit(None).cast(report.gaps.schema["first_line"].dataType).alias("first_line")))
    return report


def scan_python(files: DataFrame) -> DataFrame:
    """(repo, id, rule_id, severity, path, line, categories, message) of Python files (repo, path, text)."""
    from ..sources import python

    r = scan(python.lower_files(files), "python", catalogue.rules(files.sparkSession).filter("lang = 'python'"), catalogue.PY_METHODS)
    return r.findings.select("repo", "id", "rule_id", "severity", "path", "line", F.array_join("categories", ",").alias("categories"), "message")
