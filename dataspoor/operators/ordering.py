"""First, last and nearest rows of groups, runs in order, and sets held small: what reports choose and in which order.

Choices are aggregates where one row of a group stays, so they combine before
rows are dealt; windows stand only where every row needs its neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(rows: DataFrame, key: list[str], order: list[str], take: list[str]) -> DataFrame:
    """(key, take): what the first row of each key in the order of columns holds."""
    best = rows.groupBy(*key).agg(F.min(F.struct(*order, *[c for c in take if c not in order])).alias("__first"))
    return best.select(*key, *[F.col(f"__first.{c}").alias(c) for c in take])


def smallest(rows: DataFrame, key: list[str], value: str, also: str, k: int) -> DataFrame:
    """(key, value, also): the k smallest different values of each key, each with its least `also`."""
    once = rows.groupBy(*key, value).agg(F.min(also).alias(also))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(value))
    return once.withColumn("__k", place).filter(F.col("__k") <= k).drop("__k")


def shown(values: Column, k: int, separator: str = ",") -> Column:
    """The first k of a sorted array and how many more there are."""
    more = F.when(F.size(values) > k, F.concat(F.lit(" and "), F.size(values) - k, F.lit(" more"))).otherwise("")
    return F.concat(F.array_join(F.slice(values, 1, k), separator), more)


def collapse_runs(rows: DataFrame, key: list[str], order: list[str], value: str, ends: bool = False) -> DataFrame:
    """rows without those whose value is that of the row before; ends: the first and the last of a key always stay."""
    w = Window.partitionBy(*key).orderBy(*order)
    seen = rows.withColumn("__before", F.struct(F.lit(True).alias("any"), F.col(value).alias("v")))
    seen = seen.withColumn("__before", F.lag("__before").over(w))
    keep = F.col("__before").isNull() | ~F.col(value).eqNullSafe(F.col("__before.v"))
    if ends:
        seen = seen.withColumn("__last", F.lead(F.lit(1)).over(w).isNull())
        keep = keep | F.col("__last")
    return seen.filter(keep).drop("__before", "__last")


def ranked(rows: DataFrame, key: list[str], order: list[Column], name: str) -> DataFrame:
    """rows with their dense rank in each key's order."""
    return rows.withColumn(name, F.dense_rank().over(Window.partitionBy(*key).orderBy(*order)).cast("long"))


def within_budget(rows: DataFrame, key: list[str], order: list[str], weight: str, budget: float) -> DataFrame:
    """rows of each key, in order, while the running total of weight stays within the budget."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("__total", F.sum(weight).over(w)).filter(F.col("__total") <= budget).drop("__total")


def located(flows: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """flows (source, sink, category, id) with src_path, src_line, sink_path and sink_line."""
    at = lambda df, name, short: df.select(F.col("id").alias(name), F.col("path").alias(f"{short}_path"), F.col("line").alias(f"{short}_line"))
    return flows.join(at(sinks, "sink", "sink"), "sink").join(at(sources, "source", "src"), "source")


def document_order(rows: DataFrame) -> DataFrame:
    """Located flows in the order of a document: sink's place, source's place, category, id."""
    return rows.orderBy("sink_path", "sink_line", "src_path", "src_line", "category", "id")


def overlap(sites: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """(shared, only_a, only_b): different sites that two tools report; a and b say whether a row is of the tool."""
    g = sites.groupBy(*key).agg(F.max(a).alias("__a"), F.max(b).alias("__b"))
    return g.agg(F.count_if(F.col("__a") & F.col("__b")).alias("shared"), F.count_if(F.col("__a") & ~F.col("__b")).alias("only_a"), F.count_if(~F.col("__a") & F.col("__b")).alias("only_b"))


def final_label(one: Column, two: Column) -> Column:
    """What two reviewers agree on, else `unsure`."""
    return F.when(one.eqNullSafe(two), one.cast("string")).otherwise("unsure")


def line_counts(files: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, files, lines) of each language; an empty text has one line."""
    return files.groupBy(lang).agg(F.count(F.lit(1)).alias("files"), F.sum(F.size(F.split(text, "\n"))).alias("lines"))


def candidate_sites(files: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, line, call): what looks like a sink in a text, with its line from 1 on."""
    lines = files.select(key, F.posexplode(F.split(text, "\n")).alias("n", "t"))
    return lines.select(key, (F.col("n") + 1).alias("line"), F.explode(F.regexp_extract_all("t", F.lit(f"({pattern})"), F.lit(1))).alias("call"))


def lines_at(files: DataFrame, key: str, text: str, wanted: Column) -> DataFrame:
    """(key, pos, line): the lines of each text that `wanted`, a condition on pos from 0, takes."""
    return files.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).filter(wanted)
