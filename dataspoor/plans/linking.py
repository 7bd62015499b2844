"""Rule lookup, name resolution and ownership over embedded calls and files."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.globs import glob_regex
from ..operators import handlers as H
from ..operators import lookup as L
from .registry import plan
from .relations import table

# A catalogue of (lang, kind, entry, pattern) in its order.
CATALOGUE = (
    ("python", "propagator", "any", "**"),
    ("python", "sink", "log", "logging.{info,debug}"),
    ("python", "sink", "click", "app.click*"),
    ("python", "source", "input", "request.**"),
    ("python", "sanitiser", "hash", "app.purchase"),
    ("javascript", "sink", "console", "console.*"),
    ("javascript", "sink", "error", "app.error"),
    ("javascript", "propagator", "view", "app.{view,signup}*"),
)
_LANG = "CASE WHEN user_id % 2 = 0 THEN 'python' ELSE 'javascript' END"
_PATH = "CASE event_id % 3 WHEN 0 THEN 'app.' || event_type WHEN 1 THEN 'logging.info' ELSE 'request.' || event_type || '.get' END"
_CALLS = f"SELECT event_id AS stmt, {_PATH} AS path, {_LANG} AS lang FROM events"


def _calls(spark, sf):
    k = F.col("event_id") % 3
    path = F.when(k == 0, F.concat(F.lit("app."), "event_type")).when(k == 1, "logging.info").otherwise(F.concat(F.lit("request."), "event_type", F.lit(".get")))
    return table(spark, sf, "events").select(F.col("event_id").alias("stmt"), path.alias("path"), F.when(F.col("user_id") % 2 == 0, "python").otherwise("javascript").alias("lang"))


def _catalogue(spark):
    rows = [(n, lang, kind, entry, p, not re.search(r"[*{]", p), glob_regex(p)) for n, (lang, kind, entry, p) in enumerate(CATALOGUE)]
    return spark.createDataFrame(rows, "ordinal int, lang string, kind string, entry string, pattern string, literal boolean, regex string")


_CAT_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({n}, '{a}', '{k}', '{e}', '{glob_regex(p).replace(chr(92), chr(92))}')" for n, (a, k, e, p) in enumerate(CATALOGUE)) + ") t(ordinal, lang, kind, entry, regex)"
_DECIDE = f"""WITH calls AS ({_CALLS}), cat AS ({_CAT_SQL}), d AS (SELECT DISTINCT ON (p.lang, p.path) p.lang, p.path, cat.kind, cat.entry FROM (SELECT DISTINCT lang, path FROM calls) p JOIN cat ON cat.lang = p.lang AND regexp_matches(p.path, cat.regex)
    ORDER BY p.lang, p.path, list_position(['sink', 'source', 'sanitiser', 'propagator'], cat.kind), ordinal)"""


@plan(f"{_DECIDE} SELECT stmt, c.path, c.lang, d.kind, d.entry FROM calls c LEFT JOIN d ON d.lang = c.lang AND d.path = c.path")
def d1_catalogue_decision(spark, sf):
    return L.decide(_calls(spark, sf), _catalogue(spark))


@plan(f"{_DECIDE} SELECT count(*) AS gaps, path FROM calls c WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.lang = c.lang AND d.path = c.path) GROUP BY path")
def k3_call_gaps(spark, sf):
    """Calls that no entry decides become coverage gaps."""
    return L.decide(_calls(spark, sf), _catalogue(spark)).filter("kind is null").groupBy("path").agg(F.count(F.lit(1)).alias("gaps"))


@plan("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{k}', '{p}')" for a, k, _, p in CATALOGUE) + ") t(lang, kind, pattern) WHERE lang = 'python'")
def a14_api_patterns(spark, sf):
    return _catalogue(spark).filter("lang = 'python'").select("lang", "kind", "pattern")


@plan("SELECT * FROM (VALUES " + ", ".join(f"({n}, '{k}', '{e}')" for n, (_, k, e, _) in enumerate(CATALOGUE)) + ") t(ordinal, kind, entry)")
def b22_rules_listing(spark, sf):
    return _catalogue(spark).select("ordinal", "kind", "entry")


_NAMED = "SELECT * FROM (VALUES ('view', 'log'), ('error', 'tracker')) t(event_type, sink)"


def _small(spark, rows, schema):
    return F.broadcast(spark.createDataFrame(rows, schema))


@plan("SELECT event_id, 'document.' || event_type AS property FROM events WHERE regexp_matches('document.' || event_type, '^document[.][^.]*i[^.]*$')")
def d5_assign_sink(spark, sf):
    """Writes of properties that are sinks."""
    at = F.concat(F.lit("document."), "event_type")
    return table(spark, sf, "events").select("event_id", at.alias("property")).filter(F.col("property").rlike(glob_regex("document.*i*")))


@plan("SELECT p_partkey AS fn, 'task.' || p_type AS decorator FROM part WHERE regexp_matches('task.' || p_type, '^task[.](?:SMALL|MEDIUM)$')")
def d6_decorated_sink(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("fn"), F.concat(F.lit("task."), "p_type").alias("decorator")).filter(F.col("decorator").rlike(glob_regex("task.{SMALL,MEDIUM}")))


@plan("SELECT doc_id FROM documents WHERE regexp_matches('src/' || lang || '/' || source, '^src/(?:.*/)?[^/]*1[^/]*$') AND regexp_matches('mask_' || (doc_id % 10), '^mask_[^.]*[0-4]$')")
def d7_local_sanitiser(spark, sf):
    """Functions of the project that are declared sanitisers, by file and name."""
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("src/"), "lang", F.lit("/"), "source").alias("file"), F.concat(F.lit("mask_"), F.col("doc_id") % 10).alias("fn"))
    return d.filter(F.col("file").rlike(glob_regex("src/**/*1*", "/")) & F.col("fn").rlike("^mask_[^.]*[0-4]$")).select("doc_id")


_ARGS = "SELECT l_orderkey AS site, l_suppkey % 5 AS fn, l_partkey AS var, ['positional', 'keyword', 'spread', 'kwspread'][l_suppkey % 4 + 1] AS kind, l_linenumber - 1 AS pos, 'p' || (l_partkey % 5) AS name FROM lineitem"
_FORMALS = "SELECT fn, fn || ':' || pos AS formal, CASE WHEN pos = 3 THEN 'rest' WHEN pos = 4 THEN 'kwrest' ELSE 'plain' END AS kind, pos, CASE WHEN pos < 3 THEN 'p' || pos END AS name FROM range(5) a(fn), range(5) b(pos)"


@plan(
    f"""WITH a AS ({_ARGS}), f AS ({_FORMALS}) SELECT DISTINCT site, var AS actual, formal FROM a JOIN f USING (fn) WHERE CASE a.kind
    WHEN 'positional' THEN (f.kind = 'plain' AND f.pos = a.pos) OR (f.kind = 'rest' AND f.pos <= a.pos) WHEN 'keyword' THEN (f.kind = 'plain' AND f.name = a.name) OR (f.kind = 'kwrest' AND a.name NOT IN ('p0', 'p1', 'p2'))
    WHEN 'spread' THEN f.kind IN ('plain', 'rest') AND f.pos >= a.pos ELSE f.kind IN ('plain', 'kwrest') END"""
)
def d8_bind_arguments(spark, sf):
    li = table(spark, sf, "lineitem")
    kind = F.get(F.array(*map(F.lit, ("positional", "keyword", "spread", "kwspread"))), (F.col("l_suppkey") % 4).cast("int"))
    args = li.select(F.col("l_orderkey").alias("site"), (F.col("l_suppkey") % 5).alias("fn"), F.col("l_partkey").alias("var"), kind.alias("kind"), (F.col("l_linenumber") - 1).alias("pos"), F.concat(F.lit("p"), F.col("l_partkey") % 5).alias("name"))
    # A range's size is known to Spark, so the five functions go to the arguments and not these to five tasks.
    fn, pos = F.floor(F.col("id") / 5), (F.col("id") % 5).cast("int")
    formals = spark.range(25).select(fn.alias("fn"), F.concat(fn, F.lit(":"), pos).alias("formal"), F.when(pos == 3, "rest").when(pos == 4, "kwrest").otherwise("plain").alias("kind"), pos.alias("pos"), F.when(pos < 3, F.concat(F.lit("p"), pos)).alias("name"))
    return L.bind(args, formals)


@plan("SELECT DISTINCT l_orderkey AS call, s_suppkey AS handler FROM lineitem JOIN supplier ON s_nationkey = l_partkey % 25 WHERE l_returnflag = 'R'")
def d9_dispatch(spark, sf):
    """Calls to the handlers of their argument's type."""
    calls = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("site"), F.lit("").alias("repo"), (F.col("l_partkey") % 25).cast("string").alias("type"))
    s = table(spark, sf, "supplier")
    classes = s.select(F.lit("").alias("repo"), F.col("s_suppkey").cast("string").alias("path"), F.lit("Handler").alias("cls"), F.lit("Bus.IHandler").alias("implements"), F.col("s_nationkey").cast("string").alias("type_arg"))
    hits = H.dispatched(calls.distinct(), classes, [("Bus.{IHandler,IBehavior}", "Handle", "bus")])
    return hits.select(F.col("site").alias("call"), F.col("path").cast(s.schema["s_suppkey"].dataType).alias("handler"))


@plan("SELECT l_orderkey, l_linenumber, p_size IS NULL OR p_size > 20 AS fits, p_size IS NULL AS open FROM lineitem LEFT JOIN (SELECT p_partkey, p_size FROM part WHERE p_type <> 'PROMO') ON p_partkey = l_partkey")
def d11_type_fit(spark, sf):
    """Whether a type argument fits; an unknown one does and stays open."""
    known = table(spark, sf, "part").filter("p_type <> 'PROMO'").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size") > 20, "large").otherwise("small").alias("type"))
    fit = H.type_fit(table(spark, sf, "lineitem").join(known, "l_partkey", "left").withColumn("formal", F.lit("large")), "type", "formal")
    return fit.select("l_orderkey", "l_linenumber", "fits", "open")


_FIELDS = "(VALUES ('ECONOMY', 'email', 'user.contact.email'), ('ECONOMY', 'name', 'unknown'), ('SMALL', 'phone', 'user.contact.phone_number')) t(type, field, category)"
_TYPED = [("ECONOMY", "email", "user.contact.email"), ("ECONOMY", "name", "unknown"), ("SMALL", "phone", "user.contact.phone_number")]


@plan("SELECT DISTINCT l_partkey AS var, l_linenumber AS field FROM lineitem WHERE l_shipdate > TIMESTAMP '1995-01-01' AND l_linenumber <= 3")
def d14_property_seeds(spark, sf):
    """Attributes that are set from requests."""
    return table(spark, sf, "lineitem").filter("l_shipdate > timestamp_ntz'1995-01-01 00:00:00' and l_linenumber <= 3").select(F.col("l_partkey").alias("var"), F.col("l_linenumber").alias("field")).distinct()


@plan("SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber = 1 THEN 'kw' || l_suppkey END, CASE WHEN l_returnflag = 'R' THEN 'pos' || l_partkey END, w.host) AS host FROM lineitem LEFT JOIN (SELECT s_suppkey, 'wrap' || s_nationkey AS host FROM supplier WHERE s_acctbal > 0) w ON s_suppkey = l_suppkey")
def d16_call_host(spark, sf):
    """Host of a request: keyword, then position, then what its wrapper was built with."""
    wraps = table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit("wrap"), "s_nationkey").alias("wrapped"))
    kw, pos = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("kw"), "l_suppkey")), F.when(F.col("l_returnflag") == "R", F.concat(F.lit("pos"), "l_partkey"))
    return table(spark, sf, "lineitem").join(wraps, "l_suppkey", "left").select("l_orderkey", "l_linenumber", F.coalesce(kw, pos, "wrapped").alias("host"))


# Files named by customers in three levels of directories.
_TREE = "SELECT c_custkey, 'd' || (c_nationkey % 5) || '/e' || (c_custkey % 4) || '/f' || c_custkey || '.ts' AS path FROM customer"


def _tree(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("d"), F.col("c_nationkey") % 5, F.lit("/e"), F.col("c_custkey") % 4, F.lit("/f"), "c_custkey", F.lit(".ts")).alias("path"))


_ROOTS = ("", "d1", "d1/e2", "d3", "d4/e0")
_ROOT_SQL = "(VALUES " + ", ".join(f"('{r}')" for r in _ROOTS) + ") t(root)"


def _roots(spark, roots=_ROOTS):
    return spark.createDataFrame([(r,) for r in roots], "root string")


_NEAREST = "SELECT path, arg_max(root, length(root)) AS root FROM ({0}) LEFT JOIN {1} ON root = '' OR starts_with(path, root || '/') GROUP BY path"


@plan(_NEAREST.format(_TREE, _ROOT_SQL))
def d24_nearest_ancestor(spark, sf):
    """The nearest project file above each file."""
    return L.nearest_ancestor(_tree(spark, sf).select("path"), _roots(spark)).select("path", "root")


@plan(_NEAREST.format(_TREE, _ROOT_SQL.replace("(''), ", "")))
def d25_nearest_config(spark, sf):
    return L.nearest_ancestor(_tree(spark, sf).select("path"), _roots(spark, _ROOTS[1:])).select("path", "root")


@plan(f"SELECT path, arg_max(root, length(root)) AS root FROM ({_TREE}) LEFT JOIN {_ROOT_SQL} ON (root = '' OR starts_with(path, root || '/')) AND (root <> 'd1' OR c_custkey % 2 = 0) GROUP BY path")
def d27_owning_unit(spark, sf):
    """The nearest unit above a file that takes its language."""
    files = _tree(spark, sf)
    even = L.nearest_ancestor(files.filter("c_custkey % 2 = 0").select("path"), _roots(spark))
    odd = L.nearest_ancestor(files.filter("c_custkey % 2 <> 0").select("path"), _roots(spark, [r for r in _ROOTS if r != "d1"]))
    return even.unionByName(odd).select("path", "root")


_SPECS = "SELECT c_custkey AS site, 'd' || (c_nationkey % 5) || '/e' || (c_custkey % 4) || '/f' || (c_custkey + 4 * (c_custkey % 2)) AS spec FROM customer"
_CANDS = f"SELECT site, spec || s AS candidate, r FROM ({_SPECS}), (VALUES ('.tsx', 0), ('.ts', 1), ('/index.ts', 2)) x(s, r)"


def _resolved(spark, sf):
    k = F.col("c_custkey")
    base = F.concat(F.lit("d"), F.col("c_nationkey") % 5, F.lit("/e"), k % 4, F.lit("/f"), k + 4 * (k % 2))
    tails = F.posexplode(F.array(F.lit(".tsx"), F.lit(".ts"), F.lit("/index.ts"))).alias("r", "s")
    c = table(spark, sf, "customer").select(k.alias("site"), base.alias("spec"), tails).select("site", "r", F.concat("spec", "s").alias("candidate"))
    return L.first_resolved(c, _tree(spark, sf), ["site"], "candidate", "r")


@plan(f"SELECT site, (SELECT arg_min(candidate, r) FROM ({_CANDS}) c WHERE c.site = s.site AND candidate IN (SELECT path FROM ({_TREE}))) AS target FROM ({_SPECS}) s")
def d20_import_resolution(spark, sf):
    """The first candidate file of an import that exists."""
    return _resolved(spark, sf)


@plan(f"SELECT count(*) AS sites, count(target) AS resolved FROM (SELECT site, (SELECT arg_min(candidate, r) FROM ({_CANDS}) c WHERE c.site = s.site AND candidate IN (SELECT path FROM ({_TREE}))) AS target FROM ({_SPECS}) s)")
def d22_candidate_files(spark, sf):
    return _resolved(spark, sf).agg(F.count(F.lit(1)).alias("sites"), F.count("target").alias("resolved"))


@plan(f"WITH f AS (SELECT path, unnest([path, split_part(path, '/', 2) || '/' || split_part(path, '/', 3), split_part(path, '/', 3)]) AS suffix FROM ({_TREE})) SELECT suffix, arg_min(path, {{'n': length(path), 'p': path}}) AS target, count(*) AS n FROM f GROUP BY suffix")
def d21_suffix_import(spark, sf):
    """The shortest file that an absolute import's path is a suffix of."""
    parts = F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    f = _tree(spark, sf).select("path", F.explode(suffixes).alias("suffix"))
    return f.groupBy("suffix").agg(F.min_by("path", F.struct(F.length("path"), "path")).alias("target"), F.count(F.lit(1)).alias("n"))


@plan("WITH RECURSIVE x AS (SELECT p_partkey AS a, p_partkey - 7 AS b FROM part WHERE p_partkey % 4 > 0), r AS (SELECT p_partkey AS file, p_partkey AS loc FROM part UNION SELECT file, b FROM r JOIN x ON loc = a WHERE b >= 0) SELECT file, max(loc) AS exporter FROM r WHERE loc % 4 = 0 GROUP BY file")
def d23_export_lookup(spark, sf):
    """The file that exports a name, through re-exports."""
    from ..operators import graph as G

    k = F.col("p_partkey")
    edges = G.cut(table(spark, sf, "part").filter("p_partkey % 4 > 0 and p_partkey >= 7").select(k.alias("a"), (k - 7).alias("b")))
    reached = G.closure(edges, table(spark, sf, "part").select(k.alias("start"), k.alias("node")))
    return reached.filter("node % 4 = 0").groupBy(F.col("start").alias("file")).agg(F.max("node").alias("exporter"))


@plan("SELECT p_partkey, b.p_name AS package FROM part a JOIN (SELECT DISTINCT p_name FROM part WHERE p_size > 40) b ON b.p_name = a.p_name")
def d26_workspace_package(spark, sf):
    p = table(spark, sf, "part")
    packages = p.filter("p_size > 40").select("p_name").distinct()
    return p.join(packages, "p_name", "left_semi").select("p_partkey", F.col("p_name").alias("package"))


@plan("SELECT l_orderkey, l_linenumber, s_suppkey AS client, 'result' AS how FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber < 3 UNION ALL SELECT l_orderkey, l_linenumber, s_suppkey, 'type' FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber = 3")
def d28_client_binding(spark, sf):
    """Requests bound to the registration of their client; one join serves both ways."""
    li = table(spark, sf, "lineitem").filter("l_linenumber <= 3")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"))
    return li.join(s, "l_suppkey").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("client"), F.when(F.col("l_linenumber") < 3, "result").otherwise("type").alias("how"))


@plan("SELECT s_suppkey, coalesce(n_name, CASE WHEN s_acctbal > 5000 THEN 'key:' || s_name END, 'processor:' || s_suppkey) AS endpoint FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) ON n_nationkey = s_nationkey")
def d29_base_address(spark, sf):
    """Where a base address leads: a system, a configured key, else a processor."""
    hosts = table(spark, sf, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return table(spark, sf, "supplier").join(hosts, "s_nationkey", "left").select("s_suppkey", F.coalesce("n_name", F.when(F.col("s_acctbal") > 5000, F.concat(F.lit("key:"), "s_name")), F.concat(F.lit("processor:"), "s_suppkey")).alias("endpoint"))


@plan("SELECT l_orderkey, l_linenumber, p_partkey AS target FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type = 'SMALL'")
def d34_extension_targets(spark, sf):
    ext = table(spark, sf, "part").filter("p_type = 'SMALL'").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf, "lineitem").join(ext, "l_partkey").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("target"))


_ATTR = "SELECT DISTINCT o_custkey AS flow, l_linenumber AS file FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber > 3"
_SYS = "SELECT DISTINCT l_suppkey AS system, l_linenumber AS file FROM lineitem"


@plan(f"WITH f AS ({_ATTR}), s AS ({_SYS}) SELECT flow, system FROM f JOIN s USING (file) GROUP BY flow, system HAVING count(*) = (SELECT count(*) FROM f x WHERE x.flow = f.flow)")
def d35_attribution(spark, sf):
    """Systems whose files hold every hop of a flow: relational division."""
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    hops = li.filter("l_linenumber > 3").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("flow"), F.col("l_linenumber").alias("file"))
    return L.divide(hops, li.select(F.col("l_suppkey").alias("system"), F.col("l_linenumber").alias("file")), "flow", "file", "system")


@plan("SELECT c_custkey, path, lib FROM (SELECT c_custkey, 'flask' || CASE WHEN c_custkey % 3 = 0 THEN '.app' ELSE 'x' END AS path, c_custkey % 2 = 0 AS lib FROM customer) WHERE path = 'flask' OR starts_with(path, 'flask.')")
def c22_unsupported_framework(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(k, F.concat(F.lit("flask"), F.when(k % 3 == 0, ".app").otherwise("x")).alias("path"), (k % 2 == 0).alias("lib"))
    return rows.filter(L.any_below(F.col("path"), ["flask", "django"]))
