"""Near duplicates against all pairs of whole sets; SuperMinHash against exact similarities."""

import random
import re

import numpy as np
import pytest

from dataspoor.llm import components as cc
from dataspoor.llm import near_dedup as nd
from dataspoor.llm.common import cut


def sets_of(docs):
    out = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def brute(docs):
    sets = sets_of(docs)
    ids = sorted(sets)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def corpus(seed=1, n=160):
    r = random.Random(seed)
    words = [f"W{k}" if k % 7 == 0 else f"w{k}é" for k in range(400)]
    docs, base = [], []
    for d in range(n):
        if d % 4 and base:
            w = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5, 8])):
                w[r.randrange(len(w))] = r.choice(words)
        else:
            w = [r.choice(words) for _ in range(r.choice([1, 3, 4, 5, 6, 40, 120, 300]))]
        base.append(w)
        docs.append((1000 - d, r.choice([" ", "\n", "\t "]).join(w)))
    return [*docs, (5000, ""), (5001, None), (5002, " \n"), (5003, "one"), (5004, "ONE"), (5005, "one two")]


def test_components_equal_all_pairs(spark):
    docs = corpus()
    got = nd.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(docs)


def test_small_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 3)
    docs = corpus(2, 90)
    got = nd.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(docs)


def test_a_large_family_meets_by_bands(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 4)
    r, words = random.Random(8), [f"w{k}" for k in range(60)]
    shared = [r.choice(words) for _ in range(90)]
    docs = [(k, " ".join(shared + [r.choice(words) for _ in range(r.choice([4, 10, 25, 40]))])) for k in range(80)]
    got = nd.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(docs)


def test_units_hold_every_pair_of_a_band_once(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 3)
    bands = {1: [1, 2], 2: [2, 3], 3: [3, 4], 4: [3, 4], 5: [4, 5], 6: [8, 9], 7: [9, 10]}
    rows = [(b, n, n) for b, ns in bands.items() for n in ns]
    units: dict = {}
    for r in nd._units(spark.createDataFrame(rows, "band long, node long, root long")).collect():
        units.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, units.values())) == [[1, 2], [2, 3], [3, 4], [4, 5], [8, 9, 10]]


def test_signatures_estimate_similarity():
    r = np.random.default_rng(0)
    pool = r.integers(0, 2**63, 1200, dtype=np.uint64)
    a, b = np.sort(pool[:1000]), np.sort(pool[200:])
    x, y = nd.signatures([a, b], 120)
    assert abs((x == y).mean() - 800 / 1200) < 0.15
    assert (nd.signatures([a], 120)[0] == x).all()
    assert len({int(v >> np.uint64(56)) for v in nd.signatures([a[:2]], 120)[0]}) > 5


def edges_and_roots(seed=3):
    r = random.Random(seed)
    order = r.sample(range(-500, 500), 700)
    pairs = list(zip(order[:300], order[1:301])) + [(order[400], x) for x in order[401:500]]
    pairs += [(r.choice(order[500:]), r.choice(order[500:])) for _ in range(150)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return pairs, {x: find(x) for x in list(root)}


@pytest.mark.parametrize("small", [cc.SMALL, 0])
def test_components_of_chains_stars_and_chance(spark, monkeypatch, small):
    monkeypatch.setattr(cc, "SMALL", small)
    pairs, want = edges_and_roots()
    got = cc.components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long")).collect()
    assert len(got) == len(want)
    assert {x.node: x.root for x in got} == want


def test_components_of_no_edges(spark):
    assert cc.components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []


def test_long_chains_leave_the_driver_few_plans(spark):
    edges = cut(spark.range(2000).selectExpr("id as a", "id + 1 as b"))
    plans = spark._jsparkSession.sharedState().statusStore().executionsCount
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = plans()
    found = cc.components(edges)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert plans() - before <= 3
    assert found.filter("root <> 0").isEmpty() and found.count() == 2001
