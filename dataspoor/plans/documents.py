"""Scans and renderings over text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordering as O
from ..sources import files as S
from .registry import plan
from .relations import dealt, table

_FILES = "SELECT doc_id, 'src/' || lang || '/f' || doc_id || ['.py', '.ts', '.cs', '.go', '.rb', '.md', ''][doc_id % 7 + 1] AS path, text FROM documents"


def _files(spark, sf):
    ext = F.get(F.array(*map(F.lit, (".py", ".ts", ".cs", ".go", ".rb", ".md", ""))), (F.col("doc_id") % 7).cast("int"))
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("src/"), "lang", F.lit("/f"), F.col("doc_id"), ext).alias("path"), "text")


_LANG_SQL = "CASE regexp_extract(path, '[.]([^./]*)$', 1) " + " ".join(f"WHEN '{e}' THEN '{lang}'" for e, lang in S.LANGUAGES.items()) + " END"
_UNSUPPORTED_SQL = "CASE regexp_extract(path, '[.]([^./]*)$', 1) " + " ".join(f"WHEN '{e}' THEN '{lang}'" for e, lang in S.UNSUPPORTED.items()) + " END"


@plan(f"SELECT doc_id, {_LANG_SQL} AS language FROM ({_FILES})")
def a6_language(spark, sf):
    return _files(spark, sf).select("doc_id", S.language_of(F.col("path")).alias("language"))


@plan(f"SELECT doc_id, {_UNSUPPORTED_SQL} AS language FROM ({_FILES}) WHERE {_UNSUPPORTED_SQL} IS NOT NULL")
def a7_unsupported_language(spark, sf):
    return _files(spark, sf).select("doc_id", S.unsupported_of(F.col("path")).alias("language")).filter("language is not null")


@plan(f"SELECT doc_id, 'parse_error' AS kind FROM ({_FILES}) WHERE strlen(text) > 8192")
def a8_size_guard(spark, sf):
    """Files over the size limit are gaps, not errors."""
    return S.size_guard(_files(spark, sf), 8192, "text")[1].select("doc_id", "kind")


@plan(f"SELECT {_UNSUPPORTED_SQL} AS detail, count(*) AS files, min(path) AS first FROM ({_FILES}) WHERE {_UNSUPPORTED_SQL} IS NOT NULL GROUP BY 1")
def f10_static_gaps(spark, sf):
    """Files in languages that aren't read, by language."""
    rows = _files(spark, sf).select("path", S.unsupported_of(F.col("path")).alias("detail")).filter("detail is not null")
    return rows.groupBy("detail").agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("first"))


@plan("SELECT doc_id, pos, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INT AS pos FROM documents) WHERE pos % 3 = 1")
def b20_explain(spark, sf):
    """Source lines of the hops of a flow."""
    return O.lines_at(table(spark, sf, "documents"), "doc_id", "text", F.col("pos") % 3 == 1)


@plan("WITH RECURSIVE c AS (SELECT p_partkey AS cfg, p_partkey AS x, 0 AS d FROM part UNION ALL SELECT cfg, x // 3, d + 1 FROM c WHERE x % 3 = 0 AND x > 0 AND d < 8) SELECT cfg, arg_min(p_size, d) AS target FROM c JOIN part ON p_partkey = x WHERE p_size > 10 GROUP BY cfg")
def a25_extends_chain(spark, sf):
    """Setting of a configuration through those that it extends, the nearest first."""
    from ..operators import graph as G

    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    edges = G.cut(p.filter("p_partkey % 3 = 0 and p_partkey > 0").select(k.alias("a"), F.floor(k / 3).alias("b")))
    reached = G.closure(edges, p.select(k.alias("start"), k.alias("node")), 8)
    sets = p.filter("p_size > 10").select(k.alias("node"), "p_size")
    return reached.join(sets, "node").groupBy(F.col("start").alias("cfg")).agg(F.min_by("p_size", "depth").alias("target"))


@plan()
def a9_jsonc(spark, sf):
    """Comments and trailing commas stripped from configuration texts."""
    text = F.concat(F.lit('{ // "'), "event_type", F.lit('"\n "props": '), "props", F.lit(', /* x */ "url": "http://a//b", }'))
    return table(spark, sf, "events").select("event_id", S.strip_jsonc(text).alias("json"))


@plan()
def a28_script_ir(spark, sf):
    """Statements of JavaScript programs made of the tables' rows."""
    from ..sources import scripts

    src = F.concat(F.lit("import log from 'log';\nfunction f"), "event_id", F.lit("(req) {\n  const v = req.body."), "event_type", F.lit(";\n  log.info(`x ${v}`);\n}\n"))
    return scripts.lower_files(dealt(spark, sf, "events", "event_id", "event_type").select(F.concat(F.lit("f"), "event_id", F.lit(".js")).alias("path"), src.alias("text")))


@plan()
def a29_python_ir(spark, sf):
    """Statements of Python programs made of the tables' rows."""
    from ..sources import python

    src = F.concat(F.lit("import logging\ndef f"), "event_id", F.lit("(request):\n    v = request.form['"), "event_type", F.lit("']\n    logging.info(v)\n"))
    return python.lower_files(dealt(spark, sf, "events", "event_id", "event_type").select(F.concat(F.lit("f"), "event_id", F.lit(".py")).alias("path"), src.alias("text")))


@plan()
def scan_python(spark, sf):
    """The main query: findings of Python programs, one repository for each user."""
    from ..operators.scan import scan_python as scan

    src = F.concat(F.lit("import logging\nimport requests\n\ndef view"), "event_id", F.lit("(request):\n    who = request.form['email']\n    note = 'x ' + who\n    "), F.when(F.col("event_id") % 2 == 0, "logging.info(note)").otherwise("requests.post('https://api.example.com/v1', json={'who': note})"), F.lit("\n"))
    files = dealt(spark, sf, "events", "event_id", "user_id").select(F.concat(F.lit("repo"), "user_id").alias("repo"), F.concat(F.lit("app/f"), "event_id", F.lit(".py")).alias("path"), src.alias("text"))
    return scan(files)
