"""Names, globs and paths on hand-made cases."""

import re

import pytest
from pyspark.sql import functions as F

from dataspoor.functions import globs
from dataspoor.functions import names as N
from dataspoor.sources import files


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_glob_segments():
    cases = [("a.*", "a.b", True), ("a.*", "a.b.c", False), ("a.**", "a.b.c", True), ("**.get", "get", True), ("**.get", "x.y.get", True), ("**.get", "target", False), ("x{,()}.y", "x().y", True), ("x{a,b*}.y", "xbc.y", True), ("a?", "a?", True)]
    for pattern, text, hit in cases:
        assert bool(re.match(globs.glob_regex(pattern), text)) is hit, pattern
    assert re.match(globs.glob_regex("**/app/?.py", "/"), "src/app/a.py")
    with pytest.raises(ValueError):
        globs.glob_regex("{a")


def test_match_patterns(spark):
    df = spark.createDataFrame([("a.b",), ("a.b",), ("q",)], "p string")
    got = globs.match_patterns(df, "p", [(1, "a.b"), (2, "a.*"), (3, "z")]).orderBy("ordinal").collect()
    assert [(r.p, r.ordinal) for r in got] == [("a.b", 1), ("a.b", 1), ("a.b", 2), ("a.b", 2)]


def test_names(spark):
    rows = [("firstName",), ("IPAddress",), ("HTTPServer2Go",), ("__Größe__X",), (None,)]
    assert values(spark, N.snake(F.col("x")), rows) == ["first_name", "ip_address", "http_server2_go", "__größe__x", None]
    assert values(spark, N.table_key(F.col("x")), rows) == ["firstname", "ipaddress", "httpserver2go", "größe_x", None]
    things = values(spark, N.entity_identifier(F.col("x")), [("item_id",), ("catalog_item_ids",), ("productid",), ("user_item_id",), ("id",)])
    assert things == [True, True, True, False, False]


def test_hosts_and_paths(spark):
    urls = [("https+http://Orders-Api:8080/x",), ("//[::1]:80/",), ("http://u:p@Host.:1?q",), ("mailto:a",), ("http://",)]
    assert values(spark, N.authority(F.col("x")), urls) == ["orders-api", "[::1]", "host", None, None]
    assert values(spark, N.normalize_path(F.col("x")), [("a/./b/../c",), ("../a",), ("",)]) == ["a/c", "a", ""]
    assert values(spark, N.ancestors(F.col("x")), [("a/b/c.ts",), ("c.ts",)]) == [["a/b", "a", ""], [""]]
    assert values(spark, N.is_date(F.col("x")), [("2024-02-29",), ("2023-02-29",), ("2024-2-9",), (None,)]) == [True, False, False, False]
    assert values(spark, N.gap_detail(F.col("x")), [("m:a.b.b.c",), ("a.b.c.d.e.f.g.h.i",)]) == ["m:a.b.c", "a.b.c.….g.h.i"]


def test_jsonc(spark):
    text = '{ // "no"\n "a": "http://x//y", /* "b": 1, */ "c": [1, 2,], }'
    import json

    assert json.loads(values(spark, files.strip_jsonc(F.col("x")), [(text,)])[0]) == {"a": "http://x//y", "c": [1, 2]}


def test_ids_match_the_published_formula(spark):
    import hashlib

    got = values(spark, N.short_hash(N.json_array(N.json_string(F.col("x")), N.json_string(F.lit("q\"é\n")))), [("src-1",)])
    assert got == [hashlib.sha256('["src-1","q\\"é\\n"]'.encode()).hexdigest()[:16]]
