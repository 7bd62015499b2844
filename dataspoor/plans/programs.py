"""Whole-program operators over parsed programs: a Python file for each part, whose text its row decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import datasets
from ..operators import graph as G
from ..operators import handlers as H
from ..operators import program as R
from ..operators import scan as S
from ..sources import catalogue, csharp, python
from ..sources import values as V
from .registry import plan
from .relations import dealt, table

_PATH = "CASE WHEN p_size % 7 = 0 THEN 'v' || p_partkey || '/views.py' ELSE 'm' || p_partkey || '.py' END"
_P = f"p AS (SELECT *, {_PATH} AS path, p_size % 7 <> 0 AS module, 'run' || (p_size % 4) AS method FROM part)"
#: Rows that the statements of `run` below are lowered to.
_STMTS = 14


def _files(spark, sf) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    has_base = k % 3 > 0
    line = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x], F.lit("\n"))
    maybe = lambda cond, text: F.when(cond, text).otherwise("")
    text = F.concat(
        line("import logging"),
        maybe(s % 10 == 0, line("import tornado.web")),
        line("from fastapi import FastAPI, Request"),
        maybe(has_base, line("from m", k - 1, " import C", k - 1)),
        line("app = FastAPI()"),
        line("class C", k, maybe(has_base, F.concat(F.lit("(C"), k - 1, F.lit(")"))), ":"),
        line("    def run", s % 4, "(self, user, n):"),
        *[line(f"        {x}") for x in ("a = user.email", "b = a", "c = b", "d = make(c)", "e = d", "logger.info(c)", "db.execute(c)", "e.lower()", "p = n", "q = p", "q.weird(e)", "return e")],
        maybe(F.col("p_type") == "SMALL", line('@app.post("/p")')),
        line("def handle(user: ", F.col("p_type"), ", request: Request, db: Session, body):"),
        line("    return helper(request.headers)"),
        line("def helper(x):"),
        line("    return x"),
    )
    path = F.when(s % 7 == 0, F.concat(F.lit("v"), k, F.lit("/views.py"))).otherwise(F.concat(F.lit("m"), k, F.lit(".py")))
    return dealt(spark, sf, "part", "p_partkey", "p_size", "p_type").select(F.lit("").alias("repo"), path.alias("path"), text.alias("text"))


def _ir(spark, sf, *kinds: str) -> DataFrame:
    """Statements of the kinds that a query reads, or all."""
    return python.lower_files(_files(spark, sf), kinds or None)


def _held(spark, sf, *kinds: str) -> DataFrame:
    """Statements that a query reads more than once: files are parsed once."""
    return G.store(_ir(spark, sf, *kinds))


#: Kinds of statements that tell handlers and their parameters.
_HANDLERS = ("func", "class", "annotation", "call")


def _name(var: str):
    """A variable's own name; temporaries have none."""
    last = F.substring_index(var, "|", -1)
    return F.when(last.startswith("%"), "%").otherwise(last)


def _of(var: str):
    return F.split(F.col(var), r"\|")[1]


@plan(f"WITH {_P} SELECT path, 'handle' AS fn, 'py.fastapi.handler' AS entry, 'decorator' AS how FROM p WHERE p_type = 'SMALL' UNION ALL SELECT path, fn, 'py.django.view', 'file' FROM (SELECT path, unnest(['C' || p_partkey || '.' || method, 'handle', 'helper']) AS fn FROM p WHERE NOT module)")
def d12_find_handlers(spark, sf):
    """Request handlers by decorators and by files."""
    return H.find_handlers(_held(spark, sf, *_HANDLERS), catalogue.handler_ways("python")).select("path", "fn", "entry", "how")


def _carried(ir):
    rules = ir.sparkSession.createDataFrame(catalogue.parameters("python"), "entry string, which string, how string, name string, category string")
    return H.select_parameters(H.find_handlers(ir, catalogue.handler_ways("python")).drop("how"), H.parameters_of(ir), rules)


@plan(f"WITH {_P} SELECT path, param FROM (SELECT path, unnest(['user', 'body']) AS param FROM p WHERE p_type = 'SMALL')")
def c35_skipped_parameters(spark, sf):
    """Parameters that carry request input as a whole: those that no rule skips by type or name, or says more of."""
    return _carried(_held(spark, sf, *_HANDLERS)).filter("how = 'whole'").select("path", "param").distinct()


@plan(f"WITH {_P} SELECT path, name, 'unknown' AS category FROM (SELECT path, unnest(['user', 'body']) AS name FROM p WHERE p_type = 'SMALL' UNION ALL SELECT path, 'headers' FROM p WHERE p_type = 'SMALL' OR NOT module)")
def d15_handler_seeds(spark, sf):
    """What handlers' parameters bring in: reads of the request, and parameters as a whole."""
    ir = _held(spark, sf, *_HANDLERS, "load")
    return H.handler_seeds(ir, G.cut(_carried(ir))).select("path", "name", "category").distinct()


@plan(f"WITH {_P} SELECT path, 'user' AS var, field, category FROM p JOIN (VALUES ('ECONOMY', 'email', 'user.contact.email'), ('ECONOMY', 'name', 'unknown'), ('SMALL', 'phone', 'user.contact.phone_number')) t(type, field, category) ON type = p_type")
def d13_typed_seeds(spark, sf):
    """Seeds of annotated parameters by the classified fields of their type."""
    fields = spark.createDataFrame([("ECONOMY", "email", "user.contact.email"), ("ECONOMY", "name", "unknown"), ("SMALL", "phone", "user.contact.phone_number")], "type string, field string, category string")
    return H.typed_seeds(H.parameters_of(_held(spark, sf, "func", "annotation")).select("var", "type"), fields).select(_of("var").alias("path"), _name("var").alias("var"), "field", "category")


@plan(f"WITH {_P} SELECT path, unnest(['a', 'b', 'c']) AS var, 'user.email' AS origin FROM p")
def d18_copy_origin(spark, sf):
    """The read that a variable's value comes from, through plain copies."""
    ir = _held(spark, sf)
    reads = ir.filter("kind = 'load'").select(F.col("dst").alias("origin"), "text")
    return R.copy_origins(ir).join(reads, "origin").select(_of("var").alias("path"), _name("var").alias("var"), F.col("text").alias("origin")).filter("var <> '%'")


@plan(f"WITH {_P} SELECT path, unnest(['d', 'e']) AS var, 'make' AS callee FROM p UNION ALL SELECT path, 'app', 'fastapi.FastAPI' FROM p")
def d19_defining_call(spark, sf):
    """The call that gave a variable its value, seen through copies."""
    return R.defining_calls(_held(spark, sf)).select(_of("var").alias("path"), _name("var").alias("var"), "callee").filter("var <> '%'")


@plan(f"WITH {_P} SELECT path, t.* FROM p, (VALUES ('info', 'logger'), ('execute', 'db'), ('lower', '%'), ('weird', 'n')) t(callee, origin)")
def d30_receiver_origins(spark, sf):
    """Where the receivers of method calls come from."""
    return R.receiver_origins(_held(spark, sf)).select("path", "callee", _name("origin").alias("origin"))


def _steps(spark, sf):
    calls = _ir(spark, sf, "call").filter("kind = 'call' and how in ('method', 'unknown')")
    loggers, log_methods = catalogue.LOGGERS["python"]
    return R.method_ladder(calls, loggers, log_methods, catalogue.PY_METHODS, catalogue.receivers("python"))


@plan(f"WITH {_P} SELECT path, 'info' AS callee FROM p")
def d2_name_heuristic(spark, sf):
    """Sinks known by their receiver's name and method alone."""
    return _steps(spark, sf).filter("step = 'sink'").select("path", "callee")


@plan(f"WITH {_P} SELECT path, t.* FROM p, (VALUES ('info', 'sink'), ('execute', 'receiver'), ('lower', 'data'), ('weird', 'gap'), ('make', 'gap')) t(callee, step)")
def d3_plain_method(spark, sf):
    """A method of an unknown receiver: named sink, data method, receiver's propagator, else a gap."""
    return _steps(spark, sf).select("path", "callee", "step")


@plan(f"WITH {_P} SELECT path, 'lower' AS callee, 'args_to_result' AS flow FROM p")
def d4_data_method(spark, sf):
    """Methods of data with their flow."""
    return _steps(spark, sf).filter("step = 'data'").select("path", "callee", "flow")


@plan(f"WITH {_P} SELECT path, unnest(['user', 'logger', 'db', 'q', 'request']) AS var FROM p")
def c27_records(spark, sf):
    """Variables used as records: named fields are read, or methods called that plain values don't have."""
    return R.records(_held(spark, sf, "load", "call"), catalogue.names(V.VALUE_METHODS, "python")).select(_of("var").alias("path"), _name("var").alias("var")).filter("var <> '%'")


@plan(f"WITH {_P} SELECT path, unnest(['user', 'logger', 'db', 'q', 'p', 'n', 'request']) AS var FROM p")
def c26_record_use(spark, sf):
    """Variables whose value is used as a record within three copies."""
    ir = _held(spark, sf, "load", "call", "assign")
    used = R.record_use(ir, R.records(ir, catalogue.names(V.VALUE_METHODS, "python")))
    return used.select(_of("var").alias("path"), _name("var").alias("var")).filter("var <> '%'")


_LINKS = f"{_P}, l AS (SELECT a.p_partkey AS k, b.p_partkey AS b, a.path, b.path AS base_path FROM p a JOIN p b ON b.p_partkey = a.p_partkey - 1 WHERE a.p_partkey % 3 > 0 AND b.module)"


@plan(f"WITH {_LINKS} SELECT path, 'C' || k AS cls, base_path, 'C' || b AS base FROM l")
def e22_hierarchy(spark, sf):
    """Classes with the classes of the repository that they extend, across files."""
    return R.hierarchy(_held(spark, sf, "class")).select("path", "cls", "base_path", "base")


_COPIES = f"""WITH {_LINKS}, up AS (SELECT k, b, 1 AS d FROM l UNION ALL SELECT x.k, y.b, 2 FROM l x JOIN l y ON y.k = x.b),
    c AS (SELECT up.k, arg_min(up.b, d) AS b, anc.method FROM up JOIN p anc ON anc.p_partkey = up.b JOIN p own ON own.p_partkey = up.k WHERE anc.method <> own.method GROUP BY up.k, anc.method)"""


@plan(f"{_COPIES} SELECT path, 'C' || b AS base, c.method, (sum({_STMTS}) OVER (ORDER BY path, c.method))::BIGINT AS total, sum({_STMTS}) OVER (ORDER BY path, c.method) <= 5000 AS within FROM c JOIN p ON p_partkey = k")
def e23_specialise(spark, sf):
    """Base methods that subclasses run on their own members, within a budget of copied statements."""
    ir = _held(spark, sf)
    return R.specialise(R.members(ir), R.hierarchy(ir), 5000).select("path", "base", "method", "total", "within")


@plan(f"WITH {_P} SELECT path, 'helper' AS target FROM p")
def e28_call_targets(spark, sf):
    """Functions of the repository that calls reach."""
    ir = _held(spark, sf, "func", "call").withColumn("sid", F.concat_ws("|", "repo", "path", "n"))
    return S.resolve_local(ir).select(_of("target").alias("path"), F.substring_index("target", "|", -1).alias("target"))


@plan(f"WITH {_P} SELECT 'FastAPI' AS framework, true AS supported, count(*) AS files FROM p UNION ALL SELECT 'Tornado', false, count(*) FROM p WHERE p_size % 10 = 0")
def b21_doctor(spark, sf):
    """The web frameworks that a scan would find, and whether their handlers are modelled."""
    found = H.framework_imports(_ir(spark, sf, "import"), catalogue.frameworks("python"))
    return found.groupBy("framework", "supported").agg(F.count_distinct("path").alias("files"))


@plan("SELECT lang, kind, entries, patterns FROM (VALUES ('csharp', 'propagator', 7, 49), ('csharp', 'sanitiser', 2, 11), ('csharp', 'sink', 35, 45), ('csharp', 'source', 6, 14), ('javascript', 'propagator', 6, 31), ('javascript', 'sanitiser', 2, 9), ('javascript', 'sink', 60, 78), ('javascript', 'source', 1, 1), ('python', 'propagator', 5, 18), ('python', 'sanitiser', 2, 7), ('python', 'sink', 48, 71), ('python', 'source', 1, 2)) t(lang, kind, entries, patterns)")
def a13_rule_catalogue(spark, sf):
    """How many entries and patterns the catalogue holds, by language and kind."""
    return catalogue.rules(spark).groupBy("lang", "kind").agg(F.count_distinct("entry").alias("entries"), F.count(F.lit(1)).alias("patterns"))


def _csharp(spark, sf) -> DataFrame:
    """A context and its entity in two parts for each part; an odd part's entity stands in a file of its own."""
    k = F.col("p_partkey")
    line = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x], F.lit("\n"))
    head = line("namespace Shop.N", k % 3, ";")
    context = F.concat(line("// Store of ", F.col("p_name")), line("public class Ctx", k, "(Options o) : DbContext(o) {"), line("  public DbSet<E", k, "> ", F.col("p_type"), "s { get; set; }"), line("  private readonly string text = @\"a}\"\"b\";"), line("}"))
    one = F.concat(line("[Table(\"e\")]"), line("public partial class E", k, " : Entity<int>, IHas {"), line("  public string Email { get; set; } = \"{\";"), line("  public static int Count { get; set; }"), line("  public async Task<List<int>> Load<T>(int n, [FromBody] string q = \"x\") where T : class { if (n > 0) { return null; } }"), line("}"))
    two = F.concat(line("public partial class E", k, " { public int? Size", F.col("p_size"), " => null; [NotMapped] public int Skip { get; } }"))
    p = dealt(spark, sf, "part", "p_partkey", "p_name", "p_type", "p_size")
    own = p.select(F.concat(F.lit("c"), k, F.lit(".cs")).alias("path"), F.concat(line("using System;"), head, context, F.when(k % 2 == 0, F.concat(one, two)).otherwise("")).alias("text"))
    apart = p.filter(k % 2 == 1).select(F.concat(F.lit("e"), k, F.lit(".cs")).alias("path"), F.concat(head, one, two).alias("text"))
    return own.unionByName(apart).select(F.lit("").alias("repo"), "path", "text")


_NS = "'Shop.N' || (p_partkey % 3) || '.'"


@plan(
    f"""WITH p AS (SELECT *, {_NS} AS ns, 'c' || p_partkey || '.cs' AS own, CASE WHEN p_partkey % 2 = 0 THEN 'c' ELSE 'e' END || p_partkey || '.cs' AS apart FROM part)
    SELECT own AS path, 'class' AS kind, ns || 'Ctx' || p_partkey AS fqn, NULL AS type FROM p UNION ALL SELECT own, 'property', ns || 'Ctx' || p_partkey || '.' || p_type || 's', 'DbSet<E' || p_partkey || '>' FROM p UNION ALL SELECT own, 'field', ns || 'Ctx' || p_partkey || '.text', 'string' FROM p
    UNION ALL SELECT apart, t.kind, ns || 'E' || p_partkey || t.name, t.type FROM p, (VALUES ('class', '', NULL), ('property', '.Email', 'string'), ('property', '.Count', 'int'), ('method', '.Load', 'Task<List<int>>'), ('class', '', NULL), ('property', '.Skip', 'int')) t(kind, name, type)
    UNION ALL SELECT apart, 'property', ns || 'E' || p_partkey || '.Size' || p_size, 'int?' FROM p"""
)
def a30_declaration_scan(spark, sf):
    """What C# files declare: types and members with their types."""
    return csharp.declarations(_csharp(spark, sf)).filter("kind <> 'using'").select("path", "kind", "fqn", "type")


@plan(f"SELECT {_NS} || 'E' || p_partkey AS fqn, 2 AS parts, t.m AS member FROM part, (VALUES ('Count'), ('Email'), ('Load'), ('Skip')) t(m) UNION ALL SELECT {_NS} || 'E' || p_partkey, 2, 'Size' || p_size FROM part")
def a31_declaration_index(spark, sf):
    """Parts of a class become one declaration with the members of all."""
    rows = csharp.declarations(_csharp(spark, sf)).filter(F.col("owner").startswith("E"))
    at = rows.select(F.concat_ws(".", "namespace", "owner").alias("fqn"), F.col("name").alias("member"), F.concat_ws(":", "path", F.when(F.col("name").isin("Email", "Count", "Load"), 1).otherwise(2)).alias("part"))
    merged = R.merge_parts(at, ["fqn"], "part", "member")
    return merged.select("fqn", F.col("parts").cast("int").alias("parts"), F.explode("members").alias("member"))


@plan(f"SELECT {_NS} || 'Ctx' || p_partkey AS context, p_type || 's' AS \"table\", {_NS} || 'E' || p_partkey AS entity, unnest(['Email', 'Size' || p_size]) AS field FROM part")
def d31_context_datasets(spark, sf):
    """Tables and fields of database contexts, from parts of their entities' classes."""
    declared = G.store(csharp.declarations(_csharp(spark, sf)).filter("kind in ('class', 'record', 'property', 'field')"))
    return datasets.context_datasets(declared).select("context", "table", "entity", "field")


@plan("SELECT * FROM (VALUES ('by_class', 8, 8), ('by_processor', 24, 24), ('clients', 6, 28), ('configuration', 1, 4), ('default_data_subjects', 1, 1), ('deployables', 10, 21), ('environment', 1, 4), ('evidence', 4, 4), ('never', 6, 6), ('orchestrators', 2, 7), ('stores', 4, 58)) t(section, entries, n)")
def a15_topology_catalogue(spark, sf):
    """How many entries and values the topology catalogue holds, by section."""
    return catalogue.topology(spark).groupBy("section").agg(F.count_distinct("entry").alias("entries"), F.count(F.lit(1)).alias("n"))
