"""Statements, arguments and seeds as relations: the propagation algebra."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import handlers as H
from ..operators import propagation as P
from .registry import plan
from .relations import table

_FLOW = "['" + "', '".join(P.FLOWS) + "'][l_suppkey % 7 + 1]"
_CALL = f"SELECT l_orderkey * 10 + l_linenumber AS stmt, {_FLOW} AS flow, 'd' || l_orderkey AS dst, CASE WHEN l_linenumber % 3 > 0 THEN 'r' || l_linenumber END AS recv, ['a' || l_partkey, 'b' || l_suppkey] AS args, CASE WHEN l_returnflag = 'R' THEN 'cf' || l_partkey END AS cf, CASE WHEN l_returnflag = 'R' THEN 'cr' || l_partkey END AS cr FROM lineitem"
_BOTH = "SELECT stmt, flow, dst, recv, unnest(CASE WHEN recv IS NULL THEN args ELSE list_append(args, recv) END) AS src FROM c"


def _flow_calls(spark, sf):
    cat = lambda a, b: F.concat(F.lit(a), b)
    back = F.col("l_returnflag") == "R"
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("stmt"), F.get(F.array(*map(F.lit, P.FLOWS)), (F.col("l_suppkey") % 7).cast("int")).alias("flow"), cat("d", F.col("l_orderkey")).alias("dst"),
        F.when(F.col("l_linenumber") % 3 > 0, cat("r", F.col("l_linenumber"))).alias("recv"), F.array(cat("a", F.col("l_partkey")), cat("b", F.col("l_suppkey"))).alias("args"),
        F.when(back, cat("cf", F.col("l_partkey"))).alias("callback_formal"), F.when(back, cat("cr", F.col("l_partkey"))).alias("callback_return"),
    )


@plan(
    f"""WITH c AS ({_CALL}), both_ AS ({_BOTH}), a AS (SELECT stmt, flow, dst, recv, cr, unnest(args) AS src FROM c)
    SELECT DISTINCT * FROM (SELECT stmt, 'collapse' AS kind, src, dst FROM both_ WHERE flow IN ('args_to_result', 'args_to_receiver', 'fluent')
    UNION ALL SELECT stmt, 'collapse', src, dst FROM a WHERE flow = 'args_only' OR (flow = 'callback_result' AND cr IS NULL)
    UNION ALL SELECT stmt, 'copy', src, recv FROM a WHERE flow IN ('args_to_receiver', 'fluent') AND recv IS NOT NULL
    UNION ALL SELECT stmt, 'copy', dst, recv FROM c WHERE flow = 'fluent' AND recv IS NOT NULL
    UNION ALL SELECT stmt, 'copy', recv, dst FROM c WHERE flow = 'receiver_to_callback' AND recv IS NOT NULL
    UNION ALL SELECT stmt, 'copy', recv, cf FROM c WHERE flow = 'receiver_to_callback' AND recv IS NOT NULL AND cf IS NOT NULL
    UNION ALL SELECT stmt, 'copy', cr, dst FROM c WHERE flow IN ('receiver_to_callback', 'callback_result') AND cr IS NOT NULL)"""
)
def k1_apply_flow(spark, sf):
    """Edges of the seven kinds of propagation."""
    return P.apply_flows(_flow_calls(spark, sf))


_STMT_KINDS = ("assign", "concat", "load", "store", "return", "noop")
_STMT = "SELECT ['" + "', '".join(_STMT_KINDS) + "'][l_suppkey % 6 + 1] AS kind, 'd' || l_orderkey AS dst, 's' || l_partkey AS src, 'o' || l_suppkey AS obj, 'f' || l_linenumber AS field, ['p' || l_partkey, 'q' || l_linenumber] AS parts FROM lineitem"


def _stmts(spark, sf):
    cat = lambda a, b: F.concat(F.lit(a), F.col(b))
    kind = F.get(F.array(*map(F.lit, _STMT_KINDS)), (F.col("l_suppkey") % 6).cast("int"))
    return table(spark, sf, "lineitem").select(kind.alias("kind"), cat("d", "l_orderkey").alias("dst"), cat("s", "l_partkey").alias("src"), cat("o", "l_suppkey").alias("obj"), cat("f", "l_linenumber").alias("field"), F.array(cat("p", "l_partkey"), cat("q", "l_linenumber")).alias("parts"))


@plan(
    f"""WITH s AS ({_STMT}) SELECT DISTINCT * FROM (SELECT 'copy' AS kind, NULL AS key, src, dst FROM s WHERE kind IN ('assign', 'return') UNION ALL SELECT 'collapse', NULL, unnest(parts), dst FROM s WHERE kind = 'concat'
    UNION ALL SELECT 'load', field, obj, dst FROM s WHERE kind = 'load' UNION ALL SELECT 'store', field, src, obj FROM s WHERE kind = 'store')"""
)
def k2_statement_edges(spark, sf):
    return P.statement_edges(_stmts(spark, sf))


@plan("SELECT l_orderkey, array_to_string(list_sort(list('v' || l_partkey) FILTER (WHERE l_suppkey % 3 = 2 OR (l_suppkey % 3 = 0 AND l_linenumber IN (1, 2)) OR (l_suppkey % 3 = 1 AND l_partkey % 4 IN (0, 1)))), ',') AS taken FROM lineitem GROUP BY l_orderkey")
def c19_argument_selection(spark, sf):
    """Arguments by position, by keyword, and spreads."""
    kind = F.get(F.array(*map(F.lit, ("positional", "keyword", "spread"))), (F.col("l_suppkey") % 3).cast("int"))
    arg = F.struct(F.concat(F.lit("v"), "l_partkey").alias("var"), kind.alias("kind"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("k"), F.col("l_partkey") % 4).alias("name"))
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(arg).alias("args"))
    taken = F.array_sort(P.select_args(F.col("args"), [1, 2], ["k0", "k1"]))
    return g.select("l_orderkey", F.when(F.size(taken) > 0, F.array_join(taken, ",")).alias("taken"))


@plan("SELECT p_partkey, p_type NOT IN ('PROMO', 'SMALL') AS propagates FROM part")
def c23_non_propagating(spark, sf):
    return table(spark, sf, "part").select("p_partkey", (~F.col("p_type").isin("PROMO", "SMALL")).alias("propagates"))


@plan("SELECT p_partkey FROM part WHERE (p_type, p_brand) IN (('PROMO', 'Brand#1'), ('SMALL', 'Brand#2'))")
def c24_value_methods(spark, sf):
    listed = spark.createDataFrame([("PROMO", "Brand#1"), ("SMALL", "Brand#2")], "p_type string, p_brand string")
    return table(spark, sf, "part").join(F.broadcast(listed), ["p_type", "p_brand"], "left_semi").select("p_partkey")


@plan("SELECT p_partkey FROM part WHERE (p_type, p_brand) NOT IN (('PROMO', 'Brand#1'), ('SMALL', 'Brand#2'))")
def c25_accessor_fields(spark, sf):
    listed = spark.createDataFrame([("PROMO", "Brand#1"), ("SMALL", "Brand#2")], "p_type string, p_brand string")
    return table(spark, sf, "part").join(F.broadcast(listed), ["p_type", "p_brand"], "left_anti").select("p_partkey")


@plan("SELECT l_orderkey AS call, bool_or(l_returnflag = 'N') AS echoes FROM lineitem GROUP BY l_orderkey")
def c28_echoes(spark, sf):
    """Whether any target of a call may echo its arguments."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("call")).agg(F.max(F.col("l_returnflag") == "N").alias("echoes"))


@plan("SELECT p_partkey, p_type = 'PROMO' OR (p_type = 'SMALL' AND p_size > 25) AS shared FROM part")
def c29_shared_variable(spark, sf):
    kind = F.col("p_type")
    return table(spark, sf, "part").select("p_partkey", ((kind == "PROMO") | ((kind == "SMALL") & (F.col("p_size") > 25))).alias("shared"))


_TRAITS = "SELECT user_id, list_sort(list(DISTINCT event_type)) AS m FROM events GROUP BY user_id"


@plan(f"SELECT user_id, list_has_all(m, ['view', 'click']) AND NOT list_has_any(m, ['purchase']) AS selected FROM ({_TRAITS})")
def c34_member_filter(spark, sf):
    """Members with all required modifiers and none of the excluded ones."""
    g = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("m"))
    return g.select("user_id", H.is_member(F.col("m"), {"require": ["view", "click"], "exclude": ["purchase"]}).alias("selected"))


@plan("SELECT s_suppkey, starts_with(s_name, 'Supplier#00000000') AND s_nationkey IN (1, 2, 3) AS matches FROM supplier")
def c36_project_match(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", (F.col("s_name").startswith("Supplier#00000000") & F.col("s_nationkey").isin(1, 2, 3)).alias("matches"))


@plan(f"SELECT user_id, list_has_any(m, ['signup', 'error']) AS matches FROM ({_TRAITS})")
def c37_package_match(spark, sf):
    g = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("m"))
    return g.select("user_id", F.arrays_overlap("m", F.array(F.lit("signup"), F.lit("error"))).alias("matches"))


@plan("SELECT o_orderkey, o_orderstatus <> 'O' AND strftime(o_orderdate + INTERVAL 365 DAY, '%Y-%m-%d') >= '1996-06-30' AS decided FROM orders")
def c38_decided(spark, sf):
    """Decisions of a manifest that hold on a day."""
    until = F.date_format(F.date_add("o_orderdate", 365), "yyyy-MM-dd")
    return table(spark, sf, "orders").select("o_orderkey", ((F.col("o_orderstatus") != "O") & (until >= "1996-06-30")).alias("decided"))


@plan("SELECT event_id, event_type AS source FROM events WHERE regexp_matches('req.' || event_type, '^req[.](?:view|signup)$')")
def k5_api_reads(spark, sf):
    """Reads of API paths that are sources."""
    from ..functions.globs import glob_regex

    path = F.concat(F.lit("req."), "event_type")
    return table(spark, sf, "events").filter(path.rlike(glob_regex("req.{view,signup}"))).select("event_id", F.col("event_type").alias("source"))


@plan("SELECT p_partkey AS var, t.category FROM part JOIN (VALUES ('ECONOMY', 'user.contact'), ('PROMO', 'user.name')) t(p_type, category) USING (p_type)")
def k7_annotated(spark, sf):
    kinds = spark.createDataFrame([("ECONOMY", "user.contact"), ("PROMO", "user.name")], "p_type string, category string")
    return table(spark, sf, "part").join(F.broadcast(kinds), "p_type").select(F.col("p_partkey").alias("var"), "category")


@plan("SELECT DISTINCT l_orderkey AS site, p_type AS result FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 45")
def k8_annotated_results(spark, sf):
    """Call sites whose function's result type is a source."""
    fns = table(spark, sf, "part").filter("p_size > 45").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("result"))
    return table(spark, sf, "lineitem").join(fns, "l_partkey").select(F.col("l_orderkey").alias("site"), "result").distinct()


@plan("SELECT 'slot' AS kind, count(DISTINCT l_suppkey) AS n FROM lineitem UNION ALL SELECT 'exit', count(DISTINCT (l_suppkey, l_orderkey)) FROM lineitem UNION ALL SELECT 'hit', count(*) FROM lineitem WHERE l_returnflag = 'R'")
def k9_fact_counts(spark, sf):
    """Slots, exits and hits in one pass."""
    li = table(spark, sf, "lineitem")
    g = li.agg(F.count_distinct("l_suppkey").alias("slot"), F.count_distinct("l_suppkey", "l_orderkey").alias("exit"), F.count_if(F.col("l_returnflag") == "R").alias("hit"))
    return g.select(F.explode(F.create_map(*[x for k in ("slot", "exit", "hit") for x in (F.lit(k), F.col(k))])).alias("kind", "n"))


@plan("SELECT l_orderkey, l_linenumber, coalesce('catch:' || s_suppkey, 'throw:' || l_orderkey) AS slot FROM lineitem LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12) ON s_suppkey = l_suppkey")
def k10_throw_exits(spark, sf):
    """Where an exception goes: the handler around the call, else the caller's own exit."""
    handlers = table(spark, sf, "supplier").filter("s_nationkey < 12").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("caught"))
    j = table(spark, sf, "lineitem").join(handlers, "l_suppkey", "left")
    return j.select("l_orderkey", "l_linenumber", F.when(F.col("caught"), F.concat(F.lit("catch:"), "l_suppkey")).otherwise(F.concat(F.lit("throw:"), "l_orderkey")).alias("slot"))


@plan("SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 THEN 'source' WHEN event_type = 'purchase' THEN 'write' WHEN event_type = 'error' THEN 'error' ELSE 'assign' END AS hop FROM events")
def k11_hops(spark, sf):
    """Steps of a path by the kind of their statement."""
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    kind = F.when(F.col("pos") == 1, "source").when(F.col("event_type") == "purchase", "write").when(F.col("event_type") == "error", "error").otherwise("assign")
    return table(spark, sf, "events").withColumn("pos", pos.cast("long")).select("user_id", "pos", kind.alias("hop"))
