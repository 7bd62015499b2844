"""Configuration, data maps, renderings, revisions of a tree and streams."""

import json
import subprocess

import pytest

from dataspoor.operators import datamap as D
from dataspoor.operators import outputs as O
from dataspoor.sources import config, files


def test_configuration_lists_every_problem():
    good = config.load({"fields": [{"name": "nick", "category": "user.name", "citation": "x"}], "policy": {"rules": {"PF001": {"enabled": False}, "PF002": {"severity": "medium"}}}})
    assert "PF001" not in good.rules and good.rules["PF002"] == "medium"
    with pytest.raises(ValueError) as e:
        config.load({"nope": 1, "exclude": "x", "fields": [{"name": "a"}], "max_call_depth": 90, "policy": {"rules": {"PF9": {}}}})
    for part in ("nope", "/exclude", "'category' is required", "1 to 64", "PF9"):
        assert part in str(e.value)


def test_tables_of_a_configuration(spark):
    c = config.load({"processors": [{"name": "A", "hosts": ["a.com", "b.com"], "sinks": ["py.*"], "citation": "c"}], "fields": [{"name": "nickName", "category": "user.name", "citation": "x"}]})
    assert [(r.ordinal, r.host, r.sink_regex is None) for r in config.processor_table(spark, c).collect()] == [(0, "a.com", False), (0, "b.com", True)]
    assert {r.key for r in config.field_table(spark, c).collect()} == {"nickname", "nick_name"}


def test_three_way_merge_of_maps(spark):
    lock = {"system": [{"fides_key": "a", "name": "A", "uses": ["x", "y"]}, {"fides_key": "b", "name": "B"}]}
    ours = {"system": [{"fides_key": "a", "name": "Mine", "uses": ["x", "y"]}, {"fides_key": "b", "name": "B"}]}
    new = {"system": [{"fides_key": "a", "name": "A2", "uses": ["x", "z"]}]}
    one = lambda t: D.ingest(spark, [("m", t)])
    rows = D.merge(one(lock), one(ours), one(new)).collect()
    tree = D.tree([(r.path.split("\x1f"), r.value) for r in rows if r.value is not None])
    assert tree == {"system": [{"fides_key": "a", "name": "Mine", "uses": ["x", "z"]}]}
    assert [r.path.split("\x1f")[-1] for r in rows if r.conflict] == [".name"]
    assert D.tree(D.leaves(lock)) == lock
    assert json.loads(D.lock(lock))["generated"] == lock
    assert D.to_yaml({"a": [{"b": 1}], "c": []}, {("a",): "note"}) == "#: note\na:\n  - b: 1\nc: []"


def test_formats_and_lines(spark):
    assert [O.infer(x) for x in ("a.sarif", "b.intoto.json", "c.json", "d.fides.yml", "e")] == ["sarif", "intoto", "json", "fides", None]
    f = spark.createDataFrame([("r", "pf-1", "PF001", "high", "a.py", 3, "said \"x\"", True), ("r", "pf-2", "PF002", "info", "b.py", 1, "m", False)], "repo string, id string, rule_id string, severity string, path string, line int, message string, needs_review boolean")
    doc = json.loads("".join(r.line for r in O.sarif_parts(f, "t", "1").collect()))
    assert [x["level"] for x in doc["runs"][0]["results"]] == ["error", "note"]
    assert O.review(f).count() == 1
    assert O.table(f).first()[0].startswith("high    PF001")
    doc = spark.createDataFrame([("{\"a\":1}", "abc", "repo")], "d string, c string, r string")
    stmt = doc.select(O.statement(doc.d, doc.c, doc.r, "https://example.com/p").alias("s"))
    made = json.loads(stmt.first().s)
    assert made["predicate"] == {"a": 1} and made["subject"][0]["digest"] == {"gitCommit": "abc"}
    from pyspark.sql import functions as F

    assert stmt.select(O.unwrap(F.col("s"), F.lit("abc")), O.unwrap(F.col("s"), F.lit("x"))).first()[:] == ('{"a":1}', None)


def test_tree_and_revision(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_text("one")
    git("add", "."), git("commit", "-qm", "first")
    (tmp_path / "a" / "x.py").write_text("two")
    (tmp_path / "new.py").write_text("not tracked")
    old = files.with_text(files.revision(spark, str(tmp_path), "HEAD")).collect()
    now = files.with_text(files.tracked(spark, str(tmp_path))).collect()
    assert [(r.path, r.text) for r in old] == [("a/x.py", "one")]
    assert [(r.path, r.text, r.dirty) for r in now] == [("a/x.py", "two", True)]
    with pytest.raises(ValueError):
        files.resolve_revision(str(tmp_path), "--all")


def test_stream_of_files(spark, tmp_path):
    from dataspoor.streaming import incremental as I

    rows = [("r", "a.py", "x", "1"), ("r", "b.py", "y", "1")]
    spark.createDataFrame(rows, I.FILES).write.parquet(str(tmp_path / "in"))
    q = I.scan_to(I.arriving(spark, str(tmp_path / "in")), lambda df: df.select("repo", "path"), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
