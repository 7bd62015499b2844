"""Statements and rules to edges: one union branch for each kind."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLOWS = ("args_to_result", "args_only", "args_to_receiver", "fluent", "receiver_to_callback", "callback_result", "none")


def apply_flows(calls: DataFrame) -> DataFrame:
    """Edges (stmt, kind, src, dst) of calls that a propagator decides.

    calls: (stmt, flow, dst, recv, args array of variables, callback_formal,
    callback_return), the last two of the function passed in, else null. What a
    call needs stands in its own row, so there is no join.
    """
    some = lambda c: F.filter(F.array(c), lambda x: x.isNotNull())
    edge = lambda kind, src, dst: F.transform(src, lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("src"), dst.alias("dst")))
    dst, recv, args, flow = F.col("dst"), some(F.col("recv")), F.col("args"), F.col("flow")
    both = F.concat(args, recv)
    to_receiver = F.filter(edge("copy", args, F.col("recv")), lambda e: e["dst"].isNotNull())
    callback = F.concat(edge("copy", recv, dst), F.filter(edge("copy", recv, F.col("callback_formal")), lambda e: e["dst"].isNotNull()), edge("copy", some(F.col("callback_return")), dst))
    empty = F.filter(edge("copy", args, dst), lambda e: F.lit(False))
    edges = (
        F.when(flow == "args_to_result", edge("collapse", both, dst))
        .when(flow == "args_only", edge("collapse", args, dst))
        .when(flow == "args_to_receiver", F.concat(to_receiver, edge("collapse", both, dst)))
        .when(flow == "fluent", F.concat(to_receiver, edge("collapse", both, dst), F.filter(edge("copy", F.array(dst), F.col("recv")), lambda e: e["dst"].isNotNull())))
        .when(flow == "receiver_to_callback", callback)
        .when(flow == "callback_result", F.when(F.col("callback_return").isNotNull(), edge("copy", some(F.col("callback_return")), dst)).otherwise(edge("collapse", args, dst)))
        .otherwise(empty)
    )
    return calls.select("stmt", F.explode(edges).alias("e")).select("stmt", "e.*").distinct()


def statement_edges(stmts: DataFrame) -> DataFrame:
    """Edges (kind, key, src, dst) of statements (kind, dst, src, obj, field, parts array).

    assign, await, index and iterate copy; binary, concat and template collapse
    their parts; load and store go by their field; return and throw copy to the
    function's slot (dst).
    """
    row = lambda df, kind, key, src, dst: df.select(F.lit(kind).alias("kind"), key.alias("key"), src.alias("src"), dst.alias("dst"))
    none, of = F.lit(None).cast("string"), lambda *k: stmts.filter(F.col("kind").isin(*k))
    parts = of("binary", "concat", "template").select(F.explode("parts").alias("src"), "dst")
    branches = [
        row(of("assign", "await", "index", "iterate", "return", "throw"), "copy", none, F.col("src"), F.col("dst")),
        row(parts, "collapse", none, F.col("src"), F.col("dst")),
        row(of("load"), "load", F.col("field"), F.col("obj"), F.col("dst")),
        row(of("store"), "store", F.col("field"), F.col("src"), F.col("obj")),
    ]
    return reduce(DataFrame.unionByName, branches).filter("src is not null and dst is not null").distinct()


def select_args(args, positions: list[int] | None = None, keywords: list[str] | None = None):
    """Variables of the arguments that a rule takes: all, or those of positions or keywords; spreads always."""
    if positions is None and keywords is None:
        return F.transform(args, lambda a: a["var"])
    at = lambda a: (a["kind"] == "positional") & a["pos"].isin(*(positions or [-1]))
    by = lambda a: (a["kind"] == "keyword") & a["name"].isin(*(keywords or [""]))
    return F.transform(F.filter(args, lambda a: at(a) | by(a) | a["kind"].isin("spread", "kwspread")), lambda a: a["var"])
