"""Whole-program relations of statements: origins of values, records, classes and what calls reach.

Tables are of statements (see sources.python.IR) of any number of repositories;
a row's `repo` is part of every key, and nothing is gathered by repository.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph as G

#: Plain copies are followed for so many doublings: eight steps.
DOUBLINGS = 3


def copy_origins(ir: DataFrame, doublings: int = DOUBLINGS) -> DataFrame:
    """(var, origin): where each defined variable's value comes from through copies of variables defined once.

    Pointers are doubled, so 2**doublings copies are followed by that many joins.
    """
    defined = ir.filter("dst is not null and kind not in ('func', 'annotation', 'return')").groupBy(F.col("dst").alias("var"))
    one = defined.agg(F.count(F.lit(1)).alias("n"), F.first(F.when(F.col("kind") == "assign", F.col("src"))).alias("src"))
    hop = G.cut(one.select("var", F.when(F.col("n") == 1, F.coalesce("src", "var")).otherwise(F.col("var")).alias("origin")))
    for _ in range(doublings):
        further = hop.select(F.col("var").alias("origin"), F.col("origin").alias("further"))
        hop = hop.join(further, "origin", "left").select("var", F.coalesce("further", "origin").alias("origin"))
    return hop


def defining_calls(ir: DataFrame) -> DataFrame:
    """(var, origin, callee, how) of variables whose value a call gave, seen through copies."""
    calls = ir.filter("kind = 'call'").select(F.col("dst").alias("origin"), "callee", "how")
    return copy_origins(ir).join(calls, "origin").select("var", "origin", "callee", "how")


def receiver_origins(ir: DataFrame) -> DataFrame:
    """(repo, path, fn, callee, recv, origin): method calls with where their receiver's value comes from."""
    calls = ir.filter("kind = 'call' and how = 'method' and recv is not null").select("repo", "path", "fn", "callee", "recv")
    origins = copy_origins(ir).withColumnRenamed("var", "recv")
    return calls.join(origins, "recv", "left").withColumn("origin", F.coalesce("origin", "recv"))


def records(ir: DataFrame, value_methods: tuple[str, ...]) -> DataFrame:
    """(var): variables used as records: a named field is read, or a method that plain values don't have is called."""
    reads = ir.filter("kind = 'load' and obj is not null").select(F.col("obj").alias("var"))
    calls = ir.filter("kind = 'call' and how = 'method' and recv is not null").filter(~F.col("callee").isin(*value_methods)).select(F.col("recv").alias("var"))
    return reads.union(calls).distinct()


def record_use(ir: DataFrame, of: DataFrame, most: int = 3) -> DataFrame:
    """(var): variables whose value is one of the records `of`, through at most `most` copies."""
    back = G.cut(ir.filter("kind = 'assign' and src is not null").select(F.col("dst").alias("a"), F.col("src").alias("b")).distinct())
    return G.closure(back, of.select(F.col("var").alias("start"), F.col("var").alias("node")), most).select(F.col("node").alias("var")).distinct()


def hierarchy(ir: DataFrame) -> DataFrame:
    """(repo, path, cls, base_path, base): classes with those classes of the repository that they extend.

    A base is a class of the same file, else the one of the shortest path whose
    dotted module and name end like it.
    """
    classes = ir.filter("kind = 'class'").select("repo", "path", F.col("field").alias("cls"), "parts")
    named = classes.select("repo", "path", "cls", F.explode("parts").alias("name")).filter("name <> ''")
    own = named.join(classes.select("repo", "path", F.col("cls").alias("name")), ["repo", "path", "name"]).select("repo", "path", "cls", F.col("path").alias("base_path"), F.col("name").alias("base"))
    module = F.regexp_replace(F.regexp_replace("path", r"(?:/__init__)?\.[^./]+$", ""), "/", ".")
    dotted = F.split(F.concat(module, F.lit("."), "cls"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(dotted) - 1), lambda k: F.array_join(F.slice(dotted, k, F.size(dotted)), "."))
    ends = classes.select("repo", F.explode(suffixes).alias("name"), "path", "cls").groupBy("repo", "name").agg(F.min_by(F.struct("path", "cls"), F.struct(F.length("path"), "path")).alias("t"))
    far = named.filter("name like '%.%'").withColumn("name", F.regexp_replace("name", r"^\.+", "")).join(ends, ["repo", "name"])
    return own.unionByName(far.select("repo", "path", "cls", F.col("t.path").alias("base_path"), F.col("t.cls").alias("base"))).distinct()


def members(ir: DataFrame) -> DataFrame:
    """(repo, path, cls, method, stmts): methods with the number of their statements."""
    inside = ir.filter(F.col("fn").contains(".") & (F.col("kind") != "func")).groupBy("repo", "path", "fn").agg(F.count(F.lit(1)).alias("stmts"))
    funcs = ir.filter(F.col("fn").contains(".") & (F.col("kind") == "func")).select("repo", "path", "fn")
    both = funcs.join(inside, ["repo", "path", "fn"], "left")
    return both.select("repo", "path", F.substring_index("fn", ".", 1).alias("cls"), F.substring_index("fn", ".", -1).alias("method"), F.coalesce("stmts", F.lit(0)).alias("stmts"))


def running_budget(rows: DataFrame, order: list[str], weight: str, budget: int) -> DataFrame:
    """rows with `total`, the running total of weight in the order of columns, and `within` the budget.

    Rows are dealt by ranges of the order; each range adds up by itself, and what
    comes before it is one number for each range.
    """
    spark = rows.sparkSession
    dealt = G.cut(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sums, before, offsets = sorted((r["__range"], r["n"]) for r in dealt.groupBy("__range").agg(F.sum(weight).alias("n")).collect()), 0, []
    for k, n in sums:
        offsets.append((k, before))
        before += n or 0
    base = spark.createDataFrame(offsets, "__range int, __before long")
    own = F.sum(weight).over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = dealt.join(base, "__range").withColumn("total", (F.col("__before") + own).cast("long"))
    return out.withColumn("within", F.col("total") <= budget).drop("__range", "__before")


def specialise(own: DataFrame, links: DataFrame, budget: int) -> DataFrame:
    """(repo, path, cls, base_path, base, method, stmts, total, within): base methods that each subclass runs on its own members.

    own: see members; links: see hierarchy, direct ones. A method goes to every
    descendant that doesn't override it, nearest definition first. Copies are
    taken in order until their statements exceed the budget; the rest are not
    `within`, which is a gap and not silence.
    """
    key = lambda path, cls: F.concat_ws("|", "repo", path, cls)
    edges = G.cut(links.select(key("path", "cls").alias("a"), key("base_path", "base").alias("b")).distinct())
    known = links.select(key("path", "cls").alias("start")).distinct()
    up = G.closure(edges, known.select("start", F.col("start").alias("node")))
    has = own.select(key("path", "cls").alias("node"), "method", "stmts")
    nearest = up.join(has, "node").groupBy("start", "method").agg(F.min_by(F.struct("node", "stmts", "depth"), F.struct("depth", "node")).alias("d"))
    copies = nearest.filter("d.depth > 0").select("start", F.col("d.node").alias("node"), "method", F.col("d.stmts").alias("stmts"))
    part = lambda c, k: F.split(F.col(c), r"\|")[k]
    named = copies.select(part("start", 0).alias("repo"), part("start", 1).alias("path"), part("start", 2).alias("cls"), part("node", 1).alias("base_path"), part("node", 2).alias("base"), "method", "stmts")
    return running_budget(named, ["repo", "path", "cls", "method"], "stmts", budget)


def merge_parts(parts: DataFrame, key: list[str], part_id: str, member: str) -> DataFrame:
    """(key, id, parts, members): declarations of one class become one, under the first part's id."""
    return parts.groupBy(*key).agg(F.min(part_id).alias("id"), F.count_distinct(part_id).alias("parts"), F.array_sort(F.collect_set(member)).alias("members"))


def method_ladder(calls: DataFrame, loggers: tuple[str, ...], log_methods: tuple[str, ...], methods: dict[str, tuple[str, ...]], receivers: dict[str, str]) -> DataFrame:
    """calls that no entry decides, with `step` and `flow`.

    step: `sink` for a logger known by its receiver's name; else `data` for a
    method of data, `receiver` for any method of a receiver known by name, each
    with its flow; else `gap`.
    """
    last = F.regexp_extract("callee", r"([^.]*)$", 1)
    flow_of = F.create_map(*[x for flow, names in methods.items() for m in names for x in (F.lit(m), F.lit(flow))]) if methods else F.create_map().cast("map<string,string>")
    receiver_of = F.create_map(*[F.lit(x) for kv in receivers.items() for x in kv]) if receivers else F.create_map().cast("map<string,string>")
    sink = F.col("field").isin(*loggers) & last.isin(*log_methods)
    method = F.col("how") == "method"
    data, known = F.when(method, F.try_element_at(flow_of, F.col("callee"))), F.when(method, F.try_element_at(receiver_of, F.col("field")))
    step = F.when(sink, "sink").when(data.isNotNull(), "data").when(known.isNotNull(), "receiver").otherwise("gap")
    return calls.withColumns({"step": step, "flow": F.when(step.isin("data", "receiver"), F.coalesce(data, known))})
