"""Command line: scan a folder, list the rules, or say what a scan would read.

Exit codes: 0 nothing to act on, 1 findings at or over the configured severity,
2 wrong use, 3 wrong configuration, 4 coverage gaps that can hide personal data.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import exposure as X
from .operators import outputs as O
from .operators.scan import scan_files
from .sources import catalogue, config, files


def _files(spark: SparkSession, root: str):
    found = files.with_text(files.walk(spark, root).filter(files.language_of(F.col("path")).isNotNull() | files.unsupported_of(F.col("path")).isNotNull()))
    return found.select(F.lit("").alias("repo"), "path", "text")


def scan(spark: SparkSession, root: str, output: str | None, settings: config.Config) -> int:
    report = scan_files(_files(spark, root), settings)
    kind = O.infer(output) if output else "table"
    lines = {
        "facts": lambda: O.facts(report.flows, report.sources, report.sinks),
        "review": lambda: O.review(report.findings).select(F.col("text").alias("value")),
        "fides": lambda: O.fides_lines(report.egress).select(F.col("line").alias("value")),
        "sarif": lambda: O.sarif_parts(report.findings, "dataspoor", "0.1").select(F.col("line").alias("value")),
        "json": lambda: report.findings.select(F.to_json(F.struct("*")).alias("value")),
        "table": lambda: O.table(report.findings),
    }
    if kind not in lines:
        print(f"no format is known for {output}", file=sys.stderr)
        return 2
    rows = lines[kind]()
    if output:
        rows.coalesce(1).write.mode("overwrite").text(output)
    else:
        for r in rows.toLocalIterator():
            print(r.value)
    hiding = report.gaps.filter("impact = 'high'").limit(1).count()
    failing = report.findings.filter(X.rank_of(F.col("severity"), X.SEVERITIES) >= X.SEVERITIES.index(settings.fail_on)).limit(1).count()
    return 4 if hiding else 1 if failing else 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="dataspoor", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("scan", "doctor"):
        c = sub.add_parser(name)
        c.add_argument("path")
        c.add_argument("--config")
        c.add_argument("--output")
    sub.add_parser("rules")
    a = p.parse_args(argv)
    try:
        settings = config.load(Path(a.config).read_text()) if getattr(a, "config", None) else config.Config()
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 3
    spark = SparkSession.builder.appName("dataspoor").getOrCreate()
    if a.command == "scan":
        return scan(spark, a.path, a.output, settings)
    if a.command == "rules":
        catalogue.rules(spark, settings.extensions).select("entry", "lang", "kind", "pattern").show(1000, False)
        return 0
    found = _files(spark, a.path).withColumn("language", F.coalesce(files.language_of(F.col("path")), F.concat(F.lit("not read: "), files.unsupported_of(F.col("path")))))
    found.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum(F.size(F.split("text", "\n"))).alias("lines")).orderBy("language").show(100, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
