"""Fixpoints: reachability, closures, hierarchy and propagation over embedded graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import graph as G
from ..operators import program as R
from .registry import plan
from .relations import flows, sources, table, with_

# Customers' data goes to orders, is stored there under the line number, and suppliers read one line.
_EDGES = """SELECT 'c' || o_custkey AS a, 'copy' AS kind, NULL AS key, 'o' || o_orderkey AS b FROM orders
    UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'store', l_linenumber::VARCHAR, 'p' || l_partkey FROM lineitem
    UNION ALL SELECT DISTINCT 'p' || l_partkey, 'load', (l_suppkey % 7 + 1)::VARCHAR, 's' || l_suppkey FROM lineitem
    UNION ALL SELECT 's' || s_suppkey, 'collapse', NULL, 'n' || s_nationkey FROM supplier"""
_NEXT = "CASE kind WHEN 'copy' THEN token WHEN 'collapse' THEN 'TOP' WHEN 'load' THEN CASE WHEN token IN ('TOP', key) THEN 'TOP' END WHEN 'store' THEN key END"


def _edges(spark, sf):
    cat = lambda a, b: F.concat(F.lit(a), b)
    li, none = table(spark, sf, "lineitem"), F.lit(None).cast("string")
    row = lambda df, a, kind, key, b: df.select(a.alias("a"), F.lit(kind).alias("kind"), key.alias("key"), b.alias("b"))
    part, sup = cat("p", F.col("l_partkey")), cat("s", F.col("l_suppkey"))
    return (
        row(table(spark, sf, "orders"), cat("c", F.col("o_custkey")), "copy", none, cat("o", F.col("o_orderkey")))
        .union(row(li, cat("o", F.col("l_orderkey")), "store", F.col("l_linenumber").cast("string"), part).distinct())
        .union(row(li, part, "load", (F.col("l_suppkey") % 7 + 1).cast("string"), sup).distinct())
        .union(row(table(spark, sf, "supplier"), cat("s", F.col("s_suppkey")), "collapse", none, cat("n", F.col("s_nationkey"))))
    )


_REACH = f"""WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT 'c' || c_custkey AS seed, 'c' || c_custkey AS var, 'TOP' AS token FROM customer
    UNION SELECT * FROM (SELECT seed, b AS var, {_NEXT} AS token FROM r JOIN e ON r.var = e.a) WHERE token IS NOT NULL)"""


@plan(f"{_REACH} SELECT seed, var, token FROM r WHERE var LIKE 's%' OR var LIKE 'n%'")
def e1_reach(spark, sf):
    """Field-sensitive reachability of every customer's data."""
    seeds = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("seed")).withColumn("var", F.col("seed"))
    return G.reach(G.store(_edges(spark, sf)), seeds).filter("var like 's%' or var like 'n%'").select("seed", "var", "token")


_RING = "SELECT DISTINCT user_id AS a, (user_id * 7 + 13) % (SELECT max(user_id) + 1 FROM events) AS b FROM events"


def _ring(spark, sf):
    e = table(spark, sf, "events")
    n = e.agg(F.max("user_id")).first()[0] + 1
    return e.select(F.col("user_id").alias("a")).distinct().select("a", ((F.col("a") * 7 + 13) % n).alias("b"))


_RING_DEPTH = f"""WITH RECURSIVE e AS ({_RING}), r AS (SELECT a AS start, a AS node, 0 AS depth FROM e UNION SELECT start, b, depth + 1 FROM r JOIN e ON r.node = e.a WHERE depth < {{0}}),
    m AS (SELECT start, node, min(depth) AS depth FROM r GROUP BY start, node)"""


@plan(_RING_DEPTH.format(5) + " SELECT start, node, depth FROM m")
def e2_least_depth(spark, sf):
    """Least number of steps over a cyclic relation, within a bound."""
    edges = G.cut(_ring(spark, sf))
    return G.closure(edges, edges.select(F.col("a").alias("start"), F.col("a").alias("node")), 5)


@plan(_RING_DEPTH.format(4) + " SELECT DISTINCT start, e.b AS node FROM m JOIN e ON m.node = e.a WHERE m.depth = 4 AND NOT EXISTS (SELECT 1 FROM m x WHERE x.start = m.start AND x.node = e.b)")
def e11_depth_gaps(spark, sf):
    """Places that only a step over the bound reaches."""
    edges = G.cut(_ring(spark, sf))
    reached = G.closure(edges, edges.select(F.col("a").alias("start"), F.col("a").alias("node")), 4)
    return G.depth_gaps(reached, edges, 4)


@plan("SELECT l_orderkey, l_linenumber, CASE kind WHEN 'copy' THEN token WHEN 'collapse' THEN 'TOP' WHEN 'load' THEN CASE WHEN token IN ('TOP', key) THEN 'TOP' END WHEN 'store' THEN key WHEN 'sanitize' THEN CASE WHEN NOT removed THEN 'TOP' END END AS next FROM (SELECT l_orderkey, l_linenumber, ['copy', 'collapse', 'load', 'store', 'sanitize'][l_suppkey % 5 + 1] AS kind, CASE WHEN l_partkey % 3 = 0 THEN 'TOP' ELSE 'f' || (l_partkey % 4) END AS token, 'f' || (l_orderkey % 4) AS key, l_returnflag = 'R' AS removed FROM lineitem)")
def e3_transfer(spark, sf):
    kind = F.get(F.array(*map(F.lit, ("copy", "collapse", "load", "store", "sanitize"))), (F.col("l_suppkey") % 5).cast("int"))
    token = F.when(F.col("l_partkey") % 3 == 0, G.TOP).otherwise(F.concat(F.lit("f"), F.col("l_partkey") % 4))
    key = F.concat(F.lit("f"), F.col("l_orderkey") % 4)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", G.transfer(kind, key, token, F.col("l_returnflag") == "R").alias("next"))


_ENTRY = "SELECT l_suppkey AS fn, CASE l_linenumber WHEN 1 THEN 'TOP' WHEN 2 THEN 'PHI' ELSE 'f' || l_linenumber END AS token, l_returnflag AS slot FROM lineitem"


@plan(
    f"""WITH s AS (SELECT DISTINCT fn, token, slot FROM ({_ENTRY})), a AS (SELECT DISTINCT l_suppkey AS fn, CASE WHEN l_linenumber = 7 THEN 'TOP' ELSE 'f' || (l_linenumber + 1) END AS token FROM lineitem)
    SELECT a.fn, a.token, s.slot, CASE WHEN s.token = 'PHI' THEN a.token ELSE s.token END AS out FROM a JOIN s USING (fn) WHERE (a.token = 'TOP' AND s.token = 'TOP') OR (a.token <> 'TOP' AND (s.token = a.token OR (s.token = 'PHI' AND NOT EXISTS (SELECT 1 FROM s n WHERE n.fn = a.fn AND n.token = a.token))))"""
)
def e4_summary_lookup(spark, sf):
    """Entries of a summary by the token that arrives; PHI stands for a field without an entry of its own."""
    n = F.col("l_linenumber")
    li = table(spark, sf, "lineitem")
    s = li.select(F.col("l_suppkey").alias("fn"), F.when(n == 1, G.TOP).when(n == 2, G.PHI).otherwise(F.concat(F.lit("f"), n)).alias("st"), F.col("l_returnflag").alias("slot")).distinct()
    a = li.select(F.col("l_suppkey").alias("fn"), F.when(n == 7, G.TOP).otherwise(F.concat(F.lit("f"), n + 1)).alias("token")).distinct()
    exact = a.join(s.withColumnRenamed("st", "token"), ["fn", "token"]).select("fn", "token", "slot", F.col("token").alias("out"))
    rest = a.filter(F.col("token") != G.TOP).join(s.select("fn", F.col("st").alias("token")).distinct(), ["fn", "token"], "left_anti")
    return exact.union(rest.join(s.filter(F.col("st") == G.PHI).select("fn", "slot"), "fn").select("fn", "token", "slot", F.col("token").alias("out")))


@plan("WITH b AS (SELECT l_suppkey AS fn, l_linenumber AS depth, min(trunc(l_quantity))::BIGINT AS dist FROM lineitem GROUP BY 1, 2) SELECT fn, depth, dist FROM b WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.fn = b.fn AND o.depth < b.depth AND o.dist <= b.dist)")
def e7_pareto(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("fn"), F.col("l_linenumber").alias("depth"), F.col("l_quantity").cast("long").alias("dist"))
    return G.pareto(rows, ["fn"], "depth", "dist")


# A class tree: each part's base is the part of half its key.
_BASES = "SELECT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey // 2 IN (SELECT p_partkey FROM part) AND p_partkey // 2 <> p_partkey"


def _bases(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("a"), F.floor(F.col("p_partkey") / 2).alias("b"))
    return p.join(p.select(F.col("a").alias("b")), "b", "left_semi").filter("a <> b").select("a", "b")


def _tree(direction: str) -> str:
    a, b = ("a", "b") if direction == "up" else ("b", "a")
    return f"WITH RECURSIVE e AS ({_BASES}), r AS (SELECT p_partkey AS start, p_partkey AS node, 0 AS depth FROM part UNION SELECT start, e.{b}, depth + 1 FROM r JOIN e ON r.node = e.{a} WHERE depth < 32)"


def _closed(spark, sf, up=True, most=32):
    e = G.cut(_bases(spark, sf))
    e = e if up else e.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return G.closure(e, table(spark, sf, "part").select(F.col("p_partkey").alias("start"), F.col("p_partkey").alias("node")), most)


@plan(_tree("up") + " SELECT start, node, depth FROM r")
def e20_lineage(spark, sf):
    """A class and its bases, nearest first."""
    return _closed(spark, sf)


@plan(_tree("down") + " SELECT start, count(*) - 1 AS descendants FROM r GROUP BY start")
def e21_descendants(spark, sf):
    return _closed(spark, sf, up=False).groupBy("start").agg((F.count(F.lit(1)) - 1).alias("descendants"))


@plan(_tree("up") + " SELECT start, arg_min(node, depth) AS definer FROM r JOIN part ON p_partkey = node WHERE p_type = 'ECONOMY' GROUP BY start")
def e16_class_member(spark, sf):
    """The nearest class of the lineage that defines a member."""
    defines = table(spark, sf, "part").filter("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("node"))
    return _closed(spark, sf).join(defines, "node").groupBy("start").agg(F.min_by("node", "depth").alias("definer"))


@plan(_tree("up") + " SELECT start, arg_min(node, depth) AS handler FROM r JOIN part ON p_partkey = node WHERE p_brand = 'Brand#2' AND start IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY start")
def d10_dispatch_candidates(spark, sf):
    """For each class that a call may mean, the nearest one of its lineage that handles it."""
    p = table(spark, sf, "part")
    handles, asked = p.filter("p_brand = 'Brand#2'").select(F.col("p_partkey").alias("node")), p.filter("p_size > 10").select(F.col("p_partkey").alias("start"))
    return _closed(spark, sf).join(asked, "start", "left_semi").join(handles, "node").groupBy("start").agg(F.min_by("node", "depth").alias("handler"))


@plan(_tree("down") + " SELECT start AS outer_fn, node AS inner_fn FROM r WHERE depth BETWEEN 1 AND 3")
def e34_subtree(spark, sf):
    """Functions nested in a function, to three levels."""
    return _closed(spark, sf, up=False, most=3).filter("depth > 0").select(F.col("start").alias("outer_fn"), F.col("node").alias("inner_fn"))


@plan(_tree("down") + " SELECT start AS fn, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS fields FROM r JOIN part ON p_partkey = node GROUP BY start")
def e35_load_fields(spark, sf):
    """Fields read by a function and those nested in it."""
    reads = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), "p_type")
    return _closed(spark, sf, up=False).join(reads, "node").groupBy(F.col("start").alias("fn")).agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("fields"))


@plan(_tree("up") + " SELECT start, max(depth) AS height FROM r GROUP BY start", name="e8_post_order")
def e8_post_order(spark, sf):
    """Height over the roots: an order in which every callee comes before its callers."""
    return _closed(spark, sf).groupBy("start").agg(F.max("depth").alias("height"))


_DEFS = "SELECT p_partkey AS a, CASE WHEN p_partkey % 3 > 0 THEN p_partkey - 1 END AS b FROM part"


def _copy_origin(spark, sf):
    """Where a variable comes from through single plain copies, to eight steps: pointer doubling, three rounds."""
    p = F.col("p_partkey")
    hop = table(spark, sf, "part").select(p.alias("var"), F.when(p % 3 > 0, p - 1).otherwise(p).alias("origin"))
    for _ in range(3):
        hop = hop.join(hop.select(F.col("var").alias("origin"), F.col("origin").alias("further")), "origin", "left").select("var", F.coalesce("further", "origin").alias("origin"))
    return hop


@plan("SELECT p_partkey AS var, p_name AS literal FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p.p_partkey, q.p_name FROM part p JOIN part q ON q.p_partkey = p.p_partkey - p.p_partkey % 3 WHERE p.p_partkey % 3 > 0")
def d17_literal_prefix(spark, sf):
    """The literal at the origin of a variable."""
    text = table(spark, sf, "part").select(F.col("p_partkey").alias("origin"), F.col("p_name").alias("literal"))
    return _copy_origin(spark, sf).join(text, "origin").select("var", "literal")


_REMOVES = (("user.contact",), ("user",), ("user.authorization", "unknown"))


@plan(with_("SELECT category, dense_rank() OVER (ORDER BY s) AS class FROM (SELECT DISTINCT category, " + " || ".join("CASE WHEN " + " OR ".join(f"category = '{p}' OR starts_with(category, '{p}.')" for p in r) + " THEN '1' ELSE '0' END" for r in _REMOVES) + " AS s FROM sources)", "sources"))
def e12_category_classes(spark, sf):
    """Categories that every sanitiser treats alike share a class; there are as many as categories at most."""
    from pyspark.sql import Window

    bits = []
    for prefixes in _REMOVES:
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | N.starts_below(F.col("category"), p)
        bits.append(F.when(hit, "1").otherwise("0"))
    cats = sources(spark, sf).select("category").distinct().withColumn("s", F.concat(*bits))
    order = cats.select("s").distinct().withColumn("class", F.dense_rank().over(Window.orderBy("s")).cast("long"))
    return cats.join(F.broadcast(order), "s").select("category", "class")


@plan(with_("SELECT f.id FROM flows f WHERE f.sink NOT IN (SELECT id FROM sinks WHERE class = 'log')", "flows", "sinks"))
def e10_stop_at_shared(spark, sf):
    from .relations import sinks

    shared = sinks(spark, sf).filter("class = 'log'").select(F.col("id").alias("sink"))
    return flows(spark, sf).join(shared, "sink", "left_anti").select("id")


# Inclusion constraints: allocation sites flow over copies.
_PTS = f"""WITH RECURSIVE e AS ({_BASES}), pts AS (SELECT p_partkey AS var, p_partkey AS site FROM part WHERE p_partkey % 5 = 0
    UNION SELECT e.b, site FROM pts JOIN e ON pts.var = e.a)"""


def _points(spark, sf):
    sites = table(spark, sf, "part").filter("p_partkey % 5 = 0").select(F.col("p_partkey").alias("start"), F.col("p_partkey").alias("node"))
    return G.closure(G.cut(_bases(spark, sf)), sites).select(F.col("node").alias("var"), F.col("start").alias("site"))


@plan(f"{_PTS} SELECT var, site FROM pts")
def e29_points_to(spark, sf):
    return _points(spark, sf)


@plan(f"{_PTS} SELECT DISTINCT pts.var, p_type AS field, p_brand AS value FROM pts JOIN part ON p_partkey = site WHERE p_size < 25")
def e30_field_load(spark, sf):
    """Values that a field read may give: those stored in the sites that its object points to."""
    stored = table(spark, sf, "part").filter("p_size < 25").select(F.col("p_partkey").alias("site"), F.col("p_type").alias("field"), F.col("p_brand").alias("value"))
    return _points(spark, sf).join(stored, "site").select("var", "field", "value").distinct()


@plan(f"{_PTS} SELECT var, CASE WHEN bool_or(site % 35 = 0) OR count(*) > 32 THEN 'load' ELSE 'copy' END AS edge FROM pts GROUP BY var")
def e31_pending_loads(spark, sf):
    """A load becomes copies where all its sites are known and few."""
    g = _points(spark, sf).groupBy("var").agg(F.max(F.col("site") % 35 == 0).alias("open"), F.count(F.lit(1)).alias("n"))
    return g.select("var", F.when(F.col("open") | (F.col("n") > 32), "load").otherwise("copy").alias("edge"))


@plan(_tree("up").replace("SELECT p_partkey AS start", "SELECT p_partkey AS start") + " SELECT start AS system, count(*) AS files FROM r WHERE node NOT IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO') OR node = start GROUP BY start")
def e33_system_closure(spark, sf):
    """Files of a system and the libraries that it refers to, never another system's own."""
    other = table(spark, sf, "part").filter("p_type = 'PROMO'").select(F.col("p_partkey").alias("node"), F.lit(True).alias("owned"))
    reached = _closed(spark, sf).join(other, "node", "left").filter("owned is null or node = start")
    return reached.groupBy(F.col("start").alias("system")).agg(F.count(F.lit(1)).alias("files"))


@plan("SELECT p_partkey, p_type || '.' || p_brand AS prov FROM part WHERE p_size > 25 UNION SELECT p_partkey, 'fn:' || p_name FROM part WHERE p_size <= 25")
def e15_member_access(spark, sf):
    p = table(spark, sf, "part")
    api = p.filter("p_size > 25").select("p_partkey", F.concat("p_type", F.lit("."), "p_brand").alias("prov"))
    return api.union(p.filter("p_size <= 25").select("p_partkey", F.concat(F.lit("fn:"), "p_name").alias("prov"))).distinct()


@plan("SELECT o_custkey AS box, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS elements FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey")
def e24_container(spark, sf):
    """What may come out of a container: all that was put in."""
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("box")).agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("elements"))


@plan("SELECT DISTINCT l_suppkey AS fn, l_linenumber AS formal, l_returnflag AS prov FROM lineitem")
def e25_formal_provenance(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("fn"), F.col("l_linenumber").alias("formal"), F.col("l_returnflag").alias("prov")).distinct()


@plan("SELECT DISTINCT p_type || '.<cb' || (p_size % 3) || '>' AS path FROM part")
def e26_callback_params(spark, sf):
    return table(spark, sf, "part").select(F.concat("p_type", F.lit(".<cb"), F.col("p_size") % 3, F.lit(">")).alias("path")).distinct()


@plan(f"SELECT a AS subclass, b AS base, p_type AS field FROM ({_BASES}) JOIN part ON p_partkey = b")
def e27_field_links(spark, sf):
    fields = table(spark, sf, "part").select(F.col("p_partkey").alias("b"), F.col("p_type").alias("field"))
    return _bases(spark, sf).join(fields, "b").select(F.col("a").alias("subclass"), F.col("b").alias("base"), "field")


@plan("SELECT p_name AS key, min(p_partkey) AS id, count(*) AS parts FROM part GROUP BY p_name")
def e32_partial_merge(spark, sf):
    """Parts of one class become one, under the first part's id."""
    return R.merge_parts(table(spark, sf, "part").withColumn("key", F.col("p_name")), ["key"], "p_partkey", "p_type").select("key", "id", "parts")
