"""Connected components over edge tables: union-find by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Up to so many edges one task finds the components in memory; of more, rounds over tables do.
SMALL = 1 << 22


def least_labels(a, b):
    """(nodes, roots) of edges a[k], b[k]: sorted nodes, each with the least one of its component."""
    import numpy as np

    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(left):
        x, y = label[left], label[right]
        apart = x != y
        left, right, x, y = left[apart], right[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))  # labels are roots here, so trees hang under trees
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label]


def _solve(batches):
    import numpy as np
    import pyarrow as pa

    parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if parts:
        nodes, roots = least_labels(np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts]))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b): root is the least node of its component.

    Up to SMALL edges are one task's work: rounds over small tables are all stages,
    threads and plans of the driver, whose memory they fill. Of more edges, each
    round a node takes the least label next to it, then its label's label; rounds
    go on until nothing changes, some log2 of the longest path. Labels live in the
    shared checkpoint folder; only one row reaches the driver. Minima are taken
    before rows are dealt, so a hub's many edges don't meet.
    """
    once = cut(edges.filter("a <> b").select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).distinct())
    if once.count() <= SMALL:
        return cut(once.coalesce(1).mapInArrow(_solve, "node long, root long"))
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(once.select(F.inline(ways)))
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).select(F.col("a").alias("node"), F.col("root").alias("low"), F.lit(None).cast("long").alias("old"))
        own = labels.select("node", F.col("root").alias("low"), F.col("root").alias("old"))
        lower = near.unionByName(own).groupBy("node").agg(F.min("low").alias("low"), F.max("old").alias("old"))
        up = labels.select(F.col("node").alias("at"), F.col("root").alias("above"))
        moved = cut(lower.join(up, F.col("low") == F.col("at")).select("node", "old", F.least("low", "above").alias("root")))
        labels = moved.select("node", "root")
        if moved.filter("old <> root").isEmpty():
            return labels
