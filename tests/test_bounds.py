"""What passes through the driver, and what one task holds, don't grow with the tables."""

import random
from collections import defaultdict

from dataspoor.operators import graph as G
from dataspoor.operators import handlers as H
from dataspoor.operators import lookup as L
from dataspoor.operators import revisions as V
from dataspoor.operators import topology as T
from dataspoor.plans import catalog


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_rounds_never_broadcast(spark, monkeypatch):
    plans, held = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: plans.append(final_plan(df)) or held(df))
    written = G.store
    monkeypatch.setattr(G, "store", lambda df, *at: plans.append(final_plan(df)) or written(df, *at))
    edges = spark.range(4).selectExpr("id a", "id + 1 b")
    assert G.closure(edges, spark.createDataFrame([(0, 0)], "start long, node long")).count() == 5
    flow = edges.selectExpr("cast(a as string) a", "'copy' kind", "cast(null as string) key", "cast(b as string) b")
    assert G.reach(flow, spark.createDataFrame([("s", "0")], "seed string, var string")).count() == 5
    assert len(plans) > 9 and not any("Broadcast" in p for p in plans)


def test_long_flows_are_merged_and_whole(spark):
    edges = spark.range(15).selectExpr("cast(id as string) a", "'copy' kind", "cast(null as string) key", "cast((id + 1) % 15 as string) b")
    got = G.reach(edges, spark.createDataFrame([("s", "0"), ("t", "7")], "seed string, var string"))
    assert {(r.seed, int(r.var)): r.dist for r in got.collect()} == {(s, (k + at) % 15): k for s, at in (("s", 0), ("t", 7)) for k in range(15)}


def test_dispatch_makes_each_pair_once_without_moving_it(spark):
    r = random.Random(5)
    for _ in range(3):
        calls = [(r.randrange(6), r.choice(["p", "q"]), r.choice([None, "a", "b", "c"])) for _ in range(25)]
        classes = [(r.choice(["p", "q"]), f"f{r.randrange(4)}", f"C{r.randrange(2)}", r.choice(["Bus.IHandler", "Bus.IOther"]), r.choice([None, "a", "b", "c"])) for _ in range(25)]
        got = H.dispatched(spark.createDataFrame(calls, "site int, repo string, type string"), spark.createDataFrame(classes, "repo string, path string, cls string, implements string, type_arg string"), [("Bus.IHandler", "Handle", "bus")])
        want = {(s, repo, path, f"{cls}.Handle", t is None or arg is None) for s, repo, t in calls for own, path, cls, of, arg in classes if own == repo and of == "Bus.IHandler" and (t is None or arg is None or t == arg)}
        rows = [tuple(x) for x in got.collect()]
        assert len(rows) == len(want) and set(rows) == want
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Union") < plan.index("Aggregate")


def test_bind_by_hand(spark):
    r = random.Random(3)
    formals = [("f", "f0", "plain", 0, "a"), ("f", "f1", "plain", 1, "b"), ("f", "f2", "rest", 2, None), ("f", "f3", "kwrest", None, None), ("g", "g0", "plain", 0, "a"), ("h", "h0", "rest", 0, None)]
    args = [(r.randrange(4), r.choice("fgh"), f"v{r.randrange(5)}", k, r.randrange(4) if k in ("positional", "spread") else None, r.choice("abz") if k == "keyword" else None) for k in ["positional", "keyword", "spread", "kwspread"] * 12]
    names, want = defaultdict(set), set()
    for fn, _, kind, _, name in formals:
        names[fn] |= {name} if kind == "plain" else set()
    for site, fn, var, kind, pos, name in args:
        for of, formal, fk, fp, fname in formals:
            hit = {"positional": fk == "plain" and fp == pos or fk == "rest" and fp <= (pos or 0), "keyword": fk == "plain" and fname == name or fk == "kwrest" and name not in names[fn], "spread": fk in ("plain", "rest") and fp is not None and fp >= (pos or 0), "kwspread": fk in ("plain", "kwrest")}[kind]
            if of == fn and hit:
                want.add((site, var, formal))
    got = L.bind(spark.createDataFrame(args, "site int, fn string, var string, kind string, pos int, name string"), spark.createDataFrame(formals, "fn string, formal string, kind string, pos int, name string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "RepartitionByExpression [site" in got._jdf.queryExecution().optimizedPlan().toString()


def test_rows_not_derived_again(spark):
    schema = "id string, n int"
    stored, derived = [("a", 1), ("a", 1), ("a", None), ("b", None), ("c", 2)], [("a", 1), ("b", None), ("d", 4), ("c", 2), ("c", 2)]
    got = V.not_rederived(spark.createDataFrame(stored, schema), spark.createDataFrame(derived, schema))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 1), ("a", None)], key=str)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("RepartitionByExpression") < plan.index("Union")


def test_counts_of_groups_make_one_row_of_each(spark):
    rows = [("s", "e", "http", c, f"{s}{k}", s, d, None) for s, k, c, d in (("x", 1, "u", True), ("x", 2, "v", False), ("x", 2, "v", False), ("y", 1, None, False))]
    edges = T.edges(spark.createDataFrame(rows, "system string, endpoint string, class string, category string, flow string, sink string, declared boolean, citation string"))
    assert [tuple(r) for r in edges.collect()] == [("s", "e", "http", ["u", "v"], 3, 2, True, None)]
    assert "Expand" not in edges._jdf.queryExecution().optimizedPlan().toString()


def test_subsumption_reads_flows_once(spark):
    plan = catalog.queries()["g6_subsumption"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 3 and "Window" in plan
