"""Systems, data maps and renderings over the embedded relations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import lookup as L
from ..operators import topology as T
from ..operators.graph import spread
from .registry import plan
from .relations import flows, processors, sinks, sources, table, with_
from .reports import DECLARED, PROCESSOR

_ALL = ("sources", "sinks", "flows", "processors")
_ATTR = f"""SELECT 'system_' || (s.line % 6) AS system, coalesce(k.decl_name, {PROCESSOR}, 'none') AS endpoint, k.class, f.category, f.id AS flow, f.sink, k.decl_ordinal IS NOT NULL AS declared, k.decl_citation AS citation
    FROM flows f JOIN sources s ON s.id = f.source JOIN declared k ON k.id = f.sink"""
_EDGES = "SELECT system, endpoint, class, list_sort(list(DISTINCT category)) AS cats, count(DISTINCT flow) AS n_flows, count(DISTINCT sink) AS n_sinks, bool_or(declared) AS declared, min(citation) AS citation FROM attributed GROUP BY system, endpoint, class"


def _attributed(spark, sf):
    from ..operators import exposure as X

    src = sources(spark, sf).select(F.col("id").alias("source"), F.concat(F.lit("system_"), F.col("line") % 6).alias("system"))
    snk = X.declared(sinks(spark, sf), processors(spark, sf)).select(F.col("id").alias("sink"), F.coalesce("decl_name", X.processor_of(), F.lit("none")).alias("endpoint"), "class", F.col("decl_ordinal").isNotNull().alias("declared"), F.col("decl_citation").alias("citation"))
    return flows(spark, sf).withColumnRenamed("id", "flow").join(src, "source").join(snk, "sink")


@plan(with_("SELECT system, endpoint, class, array_to_string(cats, ',') AS categories, n_flows, n_sinks, declared, citation FROM e", *_ALL, declared=DECLARED, attributed=_ATTR, e=_EDGES))
def f11_topology_edges(spark, sf):
    return T.edges(_attributed(spark, sf)).withColumn("categories", F.array_join("categories", ","))


_USE = "coalesce(u.data_use, CASE class " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.PURPOSES.items()) + " END)"


@plan(
    with_(
        f"SELECT system, use AS data_use, count(DISTINCT (endpoint, class)) AS evidence, array_to_string(list_sort(list(DISTINCT c)), ',') AS categories FROM (SELECT system, e.endpoint, class, {_USE} AS use, unnest(cats) AS c FROM e LEFT JOIN (VALUES ('none', 'unknown_use')) u(endpoint, data_use) ON u.endpoint = e.endpoint) WHERE use IS NOT NULL GROUP BY system, use",
        *_ALL, declared=DECLARED, attributed=_ATTR, e=_EDGES,
    )
)
def f12_declarations(spark, sf):
    uses = spark.createDataFrame([("none", "unknown_use")], "endpoint string, data_use string")
    return T.declarations(T.edges(_attributed(spark, sf)), F.broadcast(uses)).withColumn("categories", F.array_join("categories", ","))


@plan(with_("SELECT c.system, c.categories, s.sites, c.n FROM (SELECT path AS system, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories, count(DISTINCT line) AS n FROM sources GROUP BY path) c JOIN (SELECT path AS system, string_agg(path || ':' || line, ',' ORDER BY line) AS sites FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line) AS k FROM sources) WHERE k <= 5 GROUP BY path) s USING (system)", "sources"))
def f13_user_input(spark, sf):
    return T.user_input(sources(spark, sf).withColumn("system", F.col("path"))).withColumn("categories", F.array_join("categories", ","))


@plan("SELECT p_partkey, array_to_string(list_sort(list_distinct([p_type, p_brand, p_name])), ',') AS categories FROM part")
def f14_field_categories(spark, sf):
    """Categories of nested fields, three levels deep."""
    leaf = F.array(F.struct(F.array("p_name").alias("categories")))
    mid = F.array(F.struct(F.array("p_brand").alias("categories"), leaf.alias("fields")))
    top = F.array(F.struct(F.array("p_type").alias("categories"), mid.alias("fields")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(T.field_categories(top), ",").alias("categories"))


@plan("SELECT p_name AS identity, arg_min(p_brand, p_partkey) AS value, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS items FROM part GROUP BY p_name")
def f16_consolidate(spark, sf):
    nodes = table(spark, sf, "part").select(F.col("p_name").alias("identity"), F.col("p_brand").alias("value"), F.array("p_type").alias("items"), F.col("p_partkey").alias("n"))
    return T.consolidate(nodes, "identity", "n").withColumn("items", F.array_join("items", ","))


@plan("SELECT n_nationkey, CASE WHEN count(*) OVER (PARTITION BY base) = 1 THEN base ELSE base || '_' || n_nationkey END AS key FROM (SELECT n_nationkey, 'app' || (n_nationkey % 20) AS base FROM nation)")
def g8_unique_keys(spark, sf):
    """Keys of systems, told apart by their directories where they clash."""
    n = F.col("n_nationkey")
    rows = table(spark, sf, "nation").select("n_nationkey", F.concat(F.lit("app"), n % 20).alias("base"), F.concat(F.lit("services/"), n).alias("root"))
    return L.unique_keys(rows, "base", "root").select("n_nationkey", "key")


_PATHS = "SELECT f.id, f.source, f.sink, f.category, f.hops, s.line FROM flows f JOIN sources s ON s.id = f.source"


@plan(with_(f"SELECT a.id FROM ({_PATHS}) a WHERE NOT EXISTS (SELECT 1 FROM ({_PATHS}) b WHERE b.sink = a.sink AND b.category = a.category AND b.source <> a.source AND b.hops > a.hops AND b.line % 50 = a.line % 50)", "flows"))
def g6_subsumption(spark, sf):
    """Flows that aren't part of a longer one to the same sink: those passing the same source anchor.

    Membership is transitive here, so only the two longest of each anchor matter
    and one window over flows that are dealt once does for the self-join.
    """
    f = flows(spark, sf).join(sources(spark, sf).select(F.col("id").alias("source"), (F.col("line") % 50).alias("anchor")), "source")
    f = spread(f.select("id", "sink", "category", "anchor", "hops"), "sink", "category", "anchor")
    most = F.max("hops").over(Window.partitionBy("sink", "category", "anchor"))
    return f.withColumn("most", most).filter("hops = most").select("id")


@plan(with_(f"SELECT a.id FROM ({_PATHS}) a WHERE NOT (a.category = 'unknown' AND EXISTS (SELECT 1 FROM ({_PATHS}) b WHERE b.sink = a.sink AND b.category <> 'unknown' AND b.line % 50 = a.line % 50))", "flows"))
def g7_narrowing(spark, sf):
    """Request input of unknown category goes where a classified read refines it."""
    f = flows(spark, sf).join(sources(spark, sf).select(F.col("id").alias("source"), (F.col("line") % 50).alias("anchor")), "source")
    known = f.filter(F.col("category") != N.UNKNOWN).select("sink", "anchor").distinct()
    wide = f.filter(F.col("category") == N.UNKNOWN).join(known, ["sink", "anchor"], "left_anti")
    return wide.select("id").union(f.filter(F.col("category") != N.UNKNOWN).select("id"))
