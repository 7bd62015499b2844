"""Systems, their edges, data uses and datasets from attributed flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.catalogue import purposes

#: Data uses proposed by sink class.
PURPOSES = purposes()[1]


def edges(attributed: DataFrame) -> DataFrame:
    """(system, endpoint, class, categories, n_flows, n_sinks, declared, citation): data between systems and processors.

    attributed: (system, endpoint, class, category, flow, sink, declared, citation).
    Flows and sinks of an edge are counted, since they grow with the data. A flow
    has one sink, so flows are counted by sink and their numbers added up: two
    distinct counts at once would make three rows of each.
    """
    by_sink = attributed.groupBy("system", "endpoint", "class", "sink").agg(
        F.collect_set("category").alias("categories"),
        F.count_distinct("flow").alias("n_flows"),
        F.max("declared").alias("declared"),
        F.min("citation").alias("citation"),
    )
    return by_sink.groupBy("system", "endpoint", "class").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("categories")))).alias("categories"),
        F.sum("n_flows").alias("n_flows"),
        F.count("sink").alias("n_sinks"),
        F.max("declared").alias("declared"),
        F.min("citation").alias("citation"),
    )


def declarations(edges: DataFrame, by_processor: DataFrame) -> DataFrame:
    """(system, data_use, evidence, categories): uses by processor, else by class.

    by_processor: (endpoint, data_use). An edge without a known use needs none.
    """
    by_class = F.create_map(*[F.lit(x) for kv in PURPOSES.items() for x in kv])
    use = F.coalesce("data_use", F.try_element_at(by_class, F.col("class")))
    rows = edges.join(by_processor, "endpoint", "left").withColumn("use", use).filter("use is not null")
    return rows.groupBy("system", F.col("use").alias("data_use")).agg(F.count(F.lit(1)).alias("evidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("categories")))).alias("categories"))


def user_input(sites: DataFrame, shown: int = 5) -> DataFrame:
    """(system, categories, sites, n): what users enter, the first places and how many there are.

    sites: (system, category, path, line). The first places are found by rank, so
    a system may have any number.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("system").orderBy("path", "line")
    places = sites.select("system", "path", "line").distinct().withColumn("k", F.row_number().over(w)).filter(F.col("k") <= shown)
    first = places.groupBy("system").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "path", "line"))), lambda x: F.concat(x["path"], F.lit(":"), x["line"])), ",").alias("sites"))
    counts = sites.groupBy("system").agg(F.array_sort(F.collect_set("category")).alias("categories"), F.count_distinct("path", "line").alias("n"))
    return counts.join(first, "system").select("system", "categories", "sites", "n")


def field_categories(fields, depth: int = 3):
    """Sorted categories of fields and of those nested in them, to `depth` levels."""
    own = F.flatten(F.transform(fields, lambda f: f["categories"]))
    if depth > 1:
        own = F.concat(own, F.flatten(F.transform(fields, lambda f: field_categories(f["fields"], depth - 1))))
    return F.array_sort(F.array_distinct(own))


def consolidate(nodes: DataFrame, identity: str, order: str) -> DataFrame:
    """One node an identity: the first value in order, the union of the sets."""
    return nodes.groupBy(identity).agg(F.min_by("value", order).alias("value"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def proposed_use(processor: Column, sink_class: Column, by_processor: dict[str, str], by_class: dict[str, str]) -> Column:
    """The data use proposed for what is sent to a processor: by its name, else by the sink's class, else none."""
    table = lambda of: F.create_map(*[F.lit(x) for kv in of.items() for x in kv])
    return F.coalesce(F.try_element_at(table(by_processor), processor), F.try_element_at(table(by_class), sink_class))
