"""Renderings of a report: facts, SARIF, attestations, review queues and tables.

Each is a DataFrame of lines or of one document a repository; what is sorted for
people is sorted by a range partitioning, and written by the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from . import exposure as X

#: File endings and the format they mean.
FORMATS = {".sarif": "sarif", ".sarif.json": "sarif", ".intoto.json": "intoto", ".fides.yml": "fides", ".fides.yaml": "fides", ".jsonl": "facts", ".md": "review", ".txt": "table", ".json": "json"}


def infer(path: str) -> str | None:
    """Format of an output by its file name, the longest ending first."""
    for ending in sorted(FORMATS, key=len, reverse=True):
        if path.endswith(ending):
            return FORMATS[ending]
    return None


def facts(flows: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """One canonical JSON line a flow, distinct and sorted."""
    place = lambda df, name: df.select(F.col("id").alias(name), F.struct("line", "path").alias(f"{name}_at")).distinct()
    rows = flows.join(place(sinks, "sink"), "sink").join(place(sources, "source"), "source")
    return rows.select(F.to_json(F.struct("category", F.col("sink_at").alias("sink"), F.col("source_at").alias("source"))).alias("value")).distinct().orderBy("value")


def level(severity: Column) -> Column:
    return F.when(severity == "high", "error").when(severity == "info", "note").otherwise("warning")


def sarif_results(findings: DataFrame) -> DataFrame:
    """(repo, result): a SARIF result a finding, as JSON."""
    region = F.struct(F.coalesce("line", F.lit(1)).alias("startLine"))
    place = F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    result = F.struct(level(F.col("severity")).alias("level"), place.alias("locations"), F.struct(F.col("message").alias("text")).alias("message"), F.create_map(F.lit("finding/v1"), F.col("id")).alias("partialFingerprints"), F.col("rule_id").alias("ruleId"))
    return findings.select("repo", "rule_id", "path", "line", "id", F.to_json(result).alias("result")).orderBy("repo", "rule_id", "path", "line", "id")


def sarif_parts(findings: DataFrame, tool: str, version: str) -> DataFrame:
    """(repo, part, line) lines that, in order, are one SARIF document a repository; no repository is gathered in a row."""
    head = '{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":{"name":%s,"version":%s}},"results":[' % (f'"{tool}"', f'"{version}"')
    rows = sarif_results(findings)
    first = rows.groupBy("repo").agg(F.min(F.struct("rule_id", "path", "line", "id")).alias("first"))
    body = rows.join(first, "repo").select("repo", F.lit(1).alias("part"), F.concat(F.when(F.struct("rule_id", "path", "line", "id") == F.col("first"), "").otherwise(","), "result").alias("line"), F.struct("rule_id", "path", "line", "id").alias("o"))
    ends = findings.select("repo").distinct().select("repo", F.explode(F.array(F.struct(F.lit(0).alias("part"), F.lit(head).alias("line")), F.struct(F.lit(2).alias("part"), F.lit("]}]}").alias("line")))).alias("x")).select("repo", "x.part", "x.line", F.lit(None).cast(body.schema["o"].dataType).alias("o"))
    return body.unionByName(ends).orderBy("repo", "part", "o").drop("o")


def fides_lines(egress: DataFrame) -> DataFrame:
    """(fides_key, line): an egress entry of a data map for each processor, in YAML."""
    g = egress.filter("fides_key is not null").groupBy("fides_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("categories")))).alias("categories"))
    cats = F.array_join(F.transform("categories", lambda c: F.concat(F.lit("      - "), c)), "\n")
    return g.select("fides_key", F.concat(F.lit("  - fides_key: "), N.yaml_quoted(F.col("fides_key")), F.lit("\n    type: system\n    data_categories:\n"), cats).alias("line")).orderBy("fides_key")


def statement(document: Column, commit: Column, repository: Column, predicate_type: str) -> Column:
    """An in-toto Statement around a JSON document; null without a commit."""
    subject = F.array(F.struct(repository.alias("name"), F.create_map(F.lit("gitCommit"), commit).alias("digest")))
    head = F.to_json(F.struct(F.lit("https://in-toto.io/Statement/v1").alias("_type"), F.lit(predicate_type).alias("predicateType"), subject.alias("subject")))
    return F.when(commit.isNotNull(), F.concat(head.substr(F.lit(1), F.length(head) - 1), F.lit(',"predicate":'), document, F.lit("}")))


def unwrap(statement_json: Column, commit: Column) -> Column:
    """The predicate of a Statement if its subject is the commit, else null."""
    same = F.get_json_object(statement_json, "$.subject[0].digest.gitCommit") == commit
    return F.when(same, F.get_json_object(statement_json, "$.predicate"))


def seal(canonical: Column) -> Column:
    """Digest of a document whose own digest is the empty text and whose dispositions are null."""
    return N.digest(canonical)


def review(findings: DataFrame) -> DataFrame:
    """(path, line): Markdown of the findings that wait for review, by place."""
    said = F.concat(F.lit("- ["), F.lit(" ] `"), "path", F.lit(":"), "line", F.lit("` **"), "rule_id", F.lit("** "), "message")
    return findings.filter("needs_review").select("path", "line", said.alias("text")).orderBy("path", "line", "text")


def table(findings: DataFrame) -> DataFrame:
    """Lines of a terminal table, worst first."""
    place = F.concat(F.coalesce("path", F.lit("-")), F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit("-")))
    said = F.concat(F.rpad("severity", 8, " "), F.rpad("rule_id", 7, " "), F.rpad(place, 40, " "), F.lit(" "), N.excerpt(F.col("message"), 100))
    return findings.orderBy(F.desc(X.rank_of(F.col("severity"), X.SEVERITIES)), "rule_id", "path", "line").select(said.alias("value"))


def explain(flow_steps: DataFrame, lines: DataFrame, flow: str) -> DataFrame:
    """(pos, path, line, text) of a flow's steps with their source lines."""
    return flow_steps.filter(F.col("flow") == flow).join(lines, ["path", "line"], "left").select("pos", "path", "line", "text").orderBy("pos")
