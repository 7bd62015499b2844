"""Long flows are followed to their end; what an asked bound cuts is a gap."""

import inspect

from dataspoor.operators import graph as G
from dataspoor.operators import scan as S
from dataspoor.sources import catalogue, python


def test_long_chains_end(spark):
    edges = G.cut(spark.range(66).selectExpr("cast(id as string) as a", "cast(id + 1 as string) as b"))
    assert G.closure(edges, spark.createDataFrame([("0", "0")], "start string, node string")).agg({"depth": "max"}).first()[0] == 66
    for f in (G.reach, G.closure, S.scan):  # one loop serves all; 257 rounds of reach take minutes
        assert inspect.signature(f).parameters["most"].default is None


def test_bound_gives_gaps(spark):
    text = "import logging\n\ndef f(user):\n    a = user.email\n" + "".join(f"    {y} = {x}\n" for x, y in zip("abcdefg", "bcdefgh")) + "    logging.info(h)\n"
    rows = spark.createDataFrame([("", "a.py", text)], "repo string, path string, text string")
    run = lambda most: S.scan(python.lower_files(rows), "python", catalogue.rules(spark).filter("lang = 'python'"), catalogue.PY_METHODS, most=most)
    short, whole = run(2), run(None)
    assert short.findings.count() == 0 and whole.findings.count() == 1
    assert [(g.first_path, g.first_line) for g in short.gaps.filter("kind = 'depth_bound'").collect()] == [("a.py", 4)]
    assert whole.gaps.filter("kind = 'depth_bound'").count() == 0
