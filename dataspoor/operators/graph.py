"""Recursive operators: bounded closures and flow reachability, round by round.

A round joins what is new with the edges, drops what is known by an anti-join,
and writes the rest to the checkpoint folder that all executors share, so that
neither plans nor lineage grow and a lost executor repeats one round at most.
The driver sees a row count only: edges and what is known are merged and never
broadcast, since a broadcast in each round would pass through the driver.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOP, PHI = "TOP", "PHI"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one of our own only under a local master."""
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if known:
        if not context.getCheckpointDir():
            context.setCheckpointDir(known)
        return known
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="dataspoor-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute df once into the shared checkpoint folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys into a fixed number of parts before they are made distinct or grouped.

    An aggregation before the exchange holds a task's rows in a hash table when
    few share a key, and adaptive execution makes as few tasks as there are cores
    of what it deals itself; parts of a fixed number are not merged.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def store(df: DataFrame, path: str | None = None) -> DataFrame:
    """Compute df once as Parquet in the shared folder and go on from there.

    For large tables and those of which each reader needs a few columns; a
    checkpoint holds whole rows uncompressed, some ten times as large.
    """
    path = path or _new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/rows-{uuid.uuid4().hex}"


def _drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables that nothing reads any more."""
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _rounds(start: DataFrame, step, key: list[str], most: int | None, wide: bool = False) -> DataFrame:
    """start and all that step gives of what is new, until nothing is, or for up to `most` rounds.

    Rounds are checkpoints, which Spark's cleaner deletes when they have been merged;
    those of wide rows are Parquet, deleted here.
    """
    spark, paths = start.sparkSession, []

    def held(df: DataFrame) -> DataFrame:
        if not wide:
            return cut(df)
        paths.append(_new_path(spark))
        out = store(df, paths[-1])
        if len(paths) % 2 == 0:
            spark._jvm.System.gc()  # shuffle files of rounds gone by go when the driver forgets them
        return out

    new = held(start)
    parts = [new]
    for _ in count() if most is None else range(most):
        seen = reduce(DataFrame.unionByName, parts).select(*key)
        new = held(step(new).join(seen.hint("merge"), key, "left_anti"))
        if new.isEmpty():
            break
        parts.append(new)
        if len(parts) > 12:  # few files and short plans in long chains
            parts = [held(reduce(DataFrame.unionByName, parts))]
            _drop(spark, paths[:-2])  # the next step still reads what is new, though it is merged too
            del paths[:-2]
    return reduce(DataFrame.unionByName, parts)


def closure(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """(start, node, depth): what each start reaches over edges (a, b), with the least number of steps.

    starts: (start, node), at depth 0. At most `most` steps are taken, without it all.
    """
    step = lambda new: new.join(edges.hint("merge"), new["node"] == edges["a"]).groupBy("start", F.col("b").alias("node")).agg((F.min("depth") + 1).alias("depth"))
    return _rounds(starts.select("start", "node", F.lit(0).alias("depth")), step, ["start", "node"], most)


def transfer(kind: Column, key: Column, token: Column, removed: Column | None = None) -> Column:
    """The token after an edge, null where the edge stops it.

    copy keeps it, collapse gives TOP, load lets TOP and its own key pass to TOP,
    store gives its key, sanitize gives TOP unless it removes the category.
    """
    passes = F.lit(True) if removed is None else ~removed
    return (
        F.when(kind == "copy", token)
        .when(kind == "collapse", F.lit(TOP))
        .when((kind == "load") & ((token == TOP) | (token == key)), F.lit(TOP))
        .when(kind == "store", key)
        .when((kind == "sanitize") & passes, F.lit(TOP))
    )


def reach(edges: DataFrame, seeds: DataFrame, stops: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(seed, var, token, dist): states that seeds reach, with the least number of edges.

    edges: (a, kind, key, b); seeds: (seed, var) and maybe their category, which
    start with TOP; stops (var): variables that a flow enters but doesn't leave.
    A sanitize edge stops the categories below its key. Tokens are few for a
    variable, so states are bounded by its stored fields, and rounds end by
    themselves; `most` bounds them (see `reach_gaps` for what that cuts).
    """
    step, about = _flow_step(edges, seeds, stops)
    return _rounds(seeds.select(*about, "var", F.lit(TOP).alias("token"), F.lit(0).alias("dist")), step, ["seed", "var", "token"], most, wide=True)


def _flow_step(edges: DataFrame, seeds: DataFrame, stops: DataFrame | None):
    """(step, columns of a seed): one round of `reach`."""
    go = edges if stops is None else edges.join(stops.select(F.col("var").alias("a")), "a", "left_anti")
    about = ["seed", "category"] if "category" in seeds.columns else ["seed"]
    removed = None
    if len(about) > 1:
        removed = F.coalesce((F.col("key") == "*") | (F.col("category") == F.col("key")) | F.col("category").startswith(F.concat("key", F.lit("."))), F.lit(False))

    def step(new: DataFrame) -> DataFrame:
        moved = new.join(go.hint("merge"), new["var"] == go["a"]).select(*about, F.col("b").alias("var"), transfer(F.col("kind"), F.col("key"), F.col("token"), removed).alias("token"), "dist")
        return moved.filter("token is not null").groupBy(*about, "var", "token").agg((F.min("dist") + 1).alias("dist"))

    return step, about


def reach_gaps(reached: DataFrame, edges: DataFrame, seeds: DataFrame, bound: int, stops: DataFrame | None = None) -> DataFrame:
    """(seed, var, token, dist): states one edge over the bound of `reach` that nothing within it reaches."""
    step, _ = _flow_step(edges, seeds, stops)
    return step(reached.filter(F.col("dist") == bound)).join(reached.select("seed", "var", "token"), ["seed", "var", "token"], "left_anti")


def depth_gaps(reached: DataFrame, edges: DataFrame, bound: int) -> DataFrame:
    """(start, node) one step over the bound that nothing within it reaches: second stratum, after the first has ended."""
    over = reached.filter(F.col("depth") == bound).join(edges, F.col("node") == F.col("a")).select("start", F.col("b").alias("node")).distinct()
    return over.join(reached.select("start", "node"), ["start", "node"], "left_anti")


def pareto(rows: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    """Rows of each key that no other has both x and y at most as large as: the skyline, by one window."""
    from pyspark.sql import Window

    best = rows.groupBy(*key, x).agg(F.min(y).alias(y))
    w = Window.partitionBy(*key).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    return best.withColumn("__least", F.min(y).over(w)).filter(F.col("__least").isNull() | (F.col(y) < F.col("__least"))).drop("__least")
