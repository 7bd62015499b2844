"""Flow relations embedded in the star schema, so that report operators have data of any size.

Each relation is given twice, as a DataFrame and as a SQL common table
expression of the same name; `with_` puts the latter before a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import short_hash
from ..operators.graph import spread

#: Sink classes in the order in which keys are dealt to them.
CLASSES = ("log", "http", "messaging", "llm", "analytics", "error_tracking", "third_party", "browser_storage", "device_storage")
#: A category for each market segment.
CATEGORIES = {
    "AUTOMOBILE": "user.contact.email",
    "BUILDING": "user.authorization.password",
    "FURNITURE": "user.health_and_medical.record_id",
    "HOUSEHOLD": "user.unique_id.pseudonymous",
    "MACHINERY": "unknown",
}
GAP_KINDS = ("unresolved_callee", "unresolved_method", "dynamic_call", "parse_error", "unsupported_language", "unsupported_framework", "depth_bound", "budget", "missing_source")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table whose rows become files to parse, dealt over all cores.

    A row is a few bytes and its file some milliseconds of work, so splits by
    bytes, as the reader makes them, would be a task or two for a million files.
    """
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return table(spark, sf_dir, name).select(*columns).repartition(n)


def _case(column, values: dict, otherwise=None):
    out = None
    for k, v in values.items():
        out = (F if out is None else out).when(column == k, F.lit(v))
    return out.otherwise(F.lit(otherwise))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, category, needs_review, path, line, text."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.concat(F.lit("src-"), F.col("c_custkey")).alias("id"),
        _case(F.col("c_mktsegment"), CATEGORIES, "unknown").alias("category"),
        (F.col("c_acctbal") < 0).alias("needs_review"),
        F.concat(F.lit("nation/"), F.col("c_nationkey")).alias("path"),
        F.col("c_custkey").alias("line"),
        F.col("c_name").alias("text"),
    )


def sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, catalogue_id, class, processor, heuristic, host_kind, host_value, dest_kind, dest_target, path, line."""
    k = F.col("s_suppkey")
    kind = _case(k % 3, {0: "literal", 1: "relative", 2: "dynamic"})
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("snk-"), k).alias("id"),
        F.concat(F.lit("cat."), k % 13).alias("catalogue_id"),
        F.get(F.array(*map(F.lit, CLASSES)), (k % 9).cast("int")).alias("class"),
        F.when(k % 4 != 0, F.col("s_name")).alias("processor"),
        (k % 7 == 0).alias("heuristic"),
        kind.alias("host_kind"),
        F.when(k % 3 == 0, F.concat(F.lit("api"), k % 5, F.lit(".example.com"))).alias("host_value"),
        F.when(k % 11 == 0, "internal").when(k % 11 == 1, "processor").alias("dest_kind"),
        F.when(k % 11 == 1, F.concat(F.lit("dest"), k % 3, F.lit(".example.net"))).when(k % 11 == 0, F.concat(F.lit("system_"), k % 4)).alias("dest_target"),
        F.concat(F.lit("nation/"), F.col("s_nationkey")).alias("path"),
        k.alias("line"),
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source, sink, category, depth, hops, echoed, field: one a (customer, supplier) of the orders."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    lines = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")
    pairs = spread(lines, "o_custkey", "l_suppkey").groupBy("o_custkey", "l_suppkey")
    kept = pairs.agg(F.min("l_linenumber").alias("depth"), F.min(F.col("l_quantity").cast("int")).alias("hops"), F.max(F.col("l_returnflag") == "R").alias("returned"))
    src = sources(spark, sf_dir).select(F.col("id").alias("source"), "category")
    named = kept.withColumns({"source": F.concat(F.lit("src-"), "o_custkey"), "sink": F.concat(F.lit("snk-"), "l_suppkey")}).join(src, "source")
    key = F.concat(F.lit('["'), "source", F.lit('","'), "sink", F.lit('","'), "category", F.lit('"]'))
    both = F.col("o_custkey") + F.col("l_suppkey")
    return named.select(
        F.concat(F.lit("flow-"), short_hash(key)).alias("id"),
        "source",
        "sink",
        "category",
        F.col("depth").cast("long").alias("depth"),
        F.col("hops").cast("long").alias("hops"),
        (both % 17 == 0).alias("echoed"),
        F.when(both % 6 == 0, "Authorization").when(both % 6 == 1, "body").alias("field"),
    )


def processors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ordinal, name, sink_regex, host, citation: declared processors."""
    k = F.col("s_suppkey")
    return (
        table(spark, sf_dir, "supplier")
        .filter(k % 5 == 0)
        .select(
            k.alias("ordinal"),
            F.upper("s_name").alias("name"),
            F.when(k % 10 == 5, F.concat(F.lit(r"^cat\."), k % 13, F.lit("$"))).alias("sink_regex"),
            F.when(k % 3 == 0, F.concat(F.lit("api"), k % 5, F.lit(".example.com"))).alias("host"),
            F.concat(F.lit("contract "), k).alias("citation"),
        )
    )


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, detail, path, line, category, needs_review: what reached a place that isn't resolved."""
    e = table(spark, sf_dir, "events").filter("event_type = 'error'")
    u = F.col("user_id")
    return e.select(
        F.get(F.array(*map(F.lit, GAP_KINDS)), (u % 9).cast("int")).alias("kind"),
        F.concat(F.lit("pkg:a.a."), F.col("props")).alias("detail"),
        F.concat(F.lit("mod/"), u % 10).alias("path"),
        F.col("event_id").alias("line"),
        F.get(F.array(*map(F.lit, CATEGORIES.values())), (F.col("event_id") % 5).cast("int")).alias("category"),
        (F.col("value") < 5).alias("needs_review"),
    )


def dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """finding, status, owner, rationale, decided_at, expires_at, remediated_at (dates as strings)."""
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("pf-"), k).alias("finding"),
        F.when(k % 4 == 3, "false_positive").otherwise(_case(F.col("o_orderstatus"), {"O": "open", "F": "accepted", "P": "remediated"})).alias("status"),
        F.when(k % 9 != 0, F.col("o_orderpriority")).alias("owner"),
        F.when(k % 8 != 0, F.lit("seen")).otherwise(F.lit("")).alias("rationale"),
        F.when(k % 10 == 0, F.lit("2024-02-30")).otherwise(day).alias("decided_at"),
        F.when(k % 5 == 0, F.date_format(F.date_add("o_orderdate", 90), "yyyy-MM-dd")).when(k % 5 == 1, F.lit("soon")).alias("expires_at"),
        F.when(k % 6 == 0, F.date_format(F.date_sub("o_orderdate", 3), "yyyy-MM-dd")).when(k % 6 == 1, F.date_format(F.date_add("o_orderdate", 30), "yyyy-MM-dd")).alias("remediated_at"),
    )


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, object, siblings: names to classify, made of the tables' values."""
    p = table(spark, sf_dir, "part")
    bases = F.array(*map(F.lit, NAME_BASES))
    n = F.col("p_partkey")
    return p.select(
        n.alias("n"),
        F.concat(F.get(bases, (n % len(NAME_BASES)).cast("int")), F.when(n % 4 == 0, F.lit("")).when(n % 4 == 1, F.lit("Id")).when(n % 4 == 2, F.concat(F.lit("_"), F.col("p_type"))).otherwise(F.concat(F.lit(" "), F.col("p_brand")))).alias("name"),
        F.when(n % 3 == 0, "address").when(n % 3 == 1, "billing_address").otherwise("order").alias("object"),
        F.when(n % 2 == 0, F.array(F.lit("first_name"), F.lit("email"))).otherwise(F.array(F.lit("quantity"))).alias("siblings"),
    )


#: Names whose keys the classification operators try.
NAME_BASES = ("email", "emailAddress", "phone_number", "phoneNumber", "PasswordHash", "state", "userName", "IPAddress", "product", "catalogItem", "religion", "name", "contact", "health_record_id", "cardNumber", "apiKey", "user.email", "HTTPServerID", "größeÄnderung", "x")

_CATEGORY_SQL = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORIES.items()) + " ELSE 'unknown' END"
_CLASS_SQL = "CASE s_suppkey % 9 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(CLASSES)) + " END"
_KIND_SQL = "CASE user_id % 9 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(GAP_KINDS)) + " END"
_EVENT_CATEGORY_SQL = "CASE event_id % 5 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(CATEGORIES.values())) + " END"
_NAME_SQL = "CASE p_partkey % " + str(len(NAME_BASES)) + " " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(NAME_BASES)) + " END"

_CTE = {
    "sources": f"SELECT 'src-' || c_custkey AS id, {_CATEGORY_SQL} AS category, c_acctbal < 0 AS needs_review, 'nation/' || c_nationkey AS path, c_custkey AS line, c_name AS text FROM customer",
    "sinks": f"""SELECT 'snk-' || s_suppkey AS id, 'cat.' || (s_suppkey % 13) AS catalogue_id, {_CLASS_SQL} AS class,
        CASE WHEN s_suppkey % 4 <> 0 THEN s_name END AS processor, s_suppkey % 7 = 0 AS heuristic,
        CASE s_suppkey % 3 WHEN 0 THEN 'literal' WHEN 1 THEN 'relative' ELSE 'dynamic' END AS host_kind,
        CASE WHEN s_suppkey % 3 = 0 THEN 'api' || (s_suppkey % 5) || '.example.com' END AS host_value,
        CASE s_suppkey % 11 WHEN 0 THEN 'internal' WHEN 1 THEN 'processor' END AS dest_kind,
        CASE s_suppkey % 11 WHEN 1 THEN 'dest' || (s_suppkey % 3) || '.example.net' WHEN 0 THEN 'system_' || (s_suppkey % 4) END AS dest_target,
        'nation/' || s_nationkey AS path, s_suppkey AS line FROM supplier""",
    "flows": """SELECT 'flow-' || substr(sha256('["' || s.id || '","snk-' || l_suppkey || '","' || s.category || '"]'), 1, 16) AS id,
        s.id AS source, 'snk-' || l_suppkey AS sink, s.category AS category, min(l_linenumber)::BIGINT AS depth,
        min(trunc(l_quantity))::BIGINT AS hops, (o_custkey + l_suppkey) % 17 = 0 AS echoed,
        CASE (o_custkey + l_suppkey) % 6 WHEN 0 THEN 'Authorization' WHEN 1 THEN 'body' END AS field
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN sources s ON s.id = 'src-' || o_custkey
        GROUP BY o_custkey, l_suppkey, s.id, s.category""",
    "processors": r"""SELECT s_suppkey AS ordinal, upper(s_name) AS name,
        CASE WHEN s_suppkey % 10 = 5 THEN '^cat\.' || (s_suppkey % 13) || '$' END AS sink_regex,
        CASE WHEN s_suppkey % 3 = 0 THEN 'api' || (s_suppkey % 5) || '.example.com' END AS host,
        'contract ' || s_suppkey AS citation FROM supplier WHERE s_suppkey % 5 = 0""",
    "gaps": f"""SELECT {_KIND_SQL} AS kind, 'pkg:a.a.' || props AS detail, 'mod/' || (user_id % 10) AS path, event_id AS line,
        {_EVENT_CATEGORY_SQL} AS category, value < 5 AS needs_review FROM events WHERE event_type = 'error'""",
    "dispositions": """SELECT 'pf-' || o_orderkey AS finding,
        CASE WHEN o_orderkey % 4 = 3 THEN 'false_positive' ELSE CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'accepted' WHEN 'P' THEN 'remediated' END END AS status,
        CASE WHEN o_orderkey % 9 <> 0 THEN o_orderpriority END AS owner, CASE WHEN o_orderkey % 8 <> 0 THEN 'seen' ELSE '' END AS rationale,
        CASE WHEN o_orderkey % 10 = 0 THEN '2024-02-30' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS decided_at,
        CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate + INTERVAL 90 DAY, '%Y-%m-%d') WHEN 1 THEN 'soon' END AS expires_at,
        CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate - INTERVAL 3 DAY, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') END AS remediated_at FROM orders""",
    "names": f"""SELECT p_partkey AS n, {_NAME_SQL} || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Id' WHEN 2 THEN '_' || p_type ELSE ' ' || p_brand END AS name,
        CASE p_partkey % 3 WHEN 0 THEN 'address' WHEN 1 THEN 'billing_address' ELSE 'order' END AS object,
        CASE WHEN p_partkey % 2 = 0 THEN ['first_name', 'email'] ELSE ['quantity'] END AS siblings FROM part""",
}
_NEEDS = {"flows": ("sources",)}


def with_(query: str, *relations: str, **more: str) -> str:
    """query after the named relations and further expressions, in order."""
    wanted: list[str] = []
    for r in relations:
        wanted += [x for x in (*_NEEDS.get(r, ()), r) if x not in wanted]
    parts = [f"{r} AS ({_CTE[r]})" for r in wanted] + [f"{k} AS ({v})" for k, v in more.items()]
    return f"WITH {', '.join(parts)} {query}" if parts else query
