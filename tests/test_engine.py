"""Rounds of reachability against a search in memory, on random graphs."""

import random
from collections import deque

from dataspoor.operators import graph as G


def search(edges, seeds):
    out: dict = {}
    for seed, category in seeds:
        seen, todo = {(seed, "TOP"): 0}, deque([(seed, "TOP")])
        while todo:
            v, t = todo.popleft()
            for a, kind, key, b in edges:
                if a != v:
                    continue
                n = {"copy": t, "collapse": "TOP", "store": key, "load": "TOP" if t in ("TOP", key) else None, "sanitize": None if key == "*" or category == key or category.startswith(f"{key}.") else "TOP"}[kind]
                if n and (b, n) not in seen:
                    seen[b, n] = seen[v, t] + 1
                    todo.append((b, n))
        out |= {(seed, v, t): d for (v, t), d in seen.items()}
    return out


def test_random_graphs(spark):
    for s in range(3):
        r = random.Random(s)
        edges = [(f"v{r.randrange(14)}", r.choice(["copy", "collapse", "load", "store", "sanitize"]), None, f"v{r.randrange(14)}") for _ in range(40)]
        edges = [(a, k, {"load": r.choice("fg"), "store": r.choice("fg"), "sanitize": r.choice(["user", "*"])}.get(k), b) for a, k, _, b in edges]
        seeds = [("v0", "user.name"), ("v1", "unknown")]
        got = G.reach(spark.createDataFrame(edges, "a string, kind string, key string, b string"), spark.createDataFrame([(v, v, c) for v, c in seeds], "seed string, var string, category string")).collect()
        assert {(x.seed, x.var, x.token): x.dist for x in got} == search(edges, seeds)


def test_long_chain_and_cycle(spark):
    edges = spark.createDataFrame([(k, (k + 1) % 40) for k in range(40)], "a long, b long")
    got = G.closure(edges, spark.createDataFrame([(0, 0)], "start long, node long"))
    assert sorted((r.node, r.depth) for r in got.collect()) == [(k, k) for k in range(40)]
    near = G.closure(edges, spark.createDataFrame([(0, 0)], "start long, node long"), 3)
    assert near.count() == 4
    assert [(r.start, r.node) for r in G.depth_gaps(near, edges, 3).collect()] == [(0, 4)]


def test_pareto(spark):
    rows = [("f", 1, 9), ("f", 2, 9), ("f", 2, 3), ("f", 3, 4), ("f", 5, 1), ("g", 1, 1)]
    got = G.pareto(spark.createDataFrame(rows, "fn string, depth int, dist int"), ["fn"], "depth", "dist").collect()
    assert sorted((r.fn, r.depth, r.dist) for r in got) == [("f", 1, 9), ("f", 2, 3), ("f", 5, 1), ("g", 1, 1)]
