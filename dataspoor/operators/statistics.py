"""Statistics of labelled samples: proportions, agreement, stratified estimates, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.959964


def wilson(k: Column, n: Column, z: float = Z) -> Column:
    """Struct (p, lo, hi) of a proportion's 95 % interval, to 4 places; null where n is 0."""
    p, d = k / n, 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n > 0, F.struct(F.round(p, 4).alias("p"), F.round(F.greatest(F.lit(0.0), mid - half), 4).alias("lo"), F.round(F.least(F.lit(1.0), mid + half), 4).alias("hi")))


def kappa(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """(by, n, agreement, kappa) of two raters; kappa is null where chance agreement is 1.

    One count a (group, a, b) is taken first; what follows works on those few
    counts, so a group that holds most rows does no harm.
    """
    if not by:
        return kappa(pairs.withColumn("__all", F.lit(1)), ["__all"], a, b).drop("__all")
    cells = pairs.groupBy(*by, F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("m"))
    sides = cells.select(*by, F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("m").alias("ma"), F.lit(0).alias("mb")), F.struct(F.col("b").alias("c"), F.lit(0).alias("ma"), F.col("m").alias("mb")))).alias("x"))
    margins = sides.groupBy(*by, "x.c").agg((F.sum("x.ma") * F.sum("x.mb")).alias("both")).groupBy(*by).agg(F.sum("both").alias("both"))
    same = cells.groupBy(*by).agg(F.sum("m").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("m")).otherwise(0)).alias("same"))
    po, pe = F.col("same") / F.col("n"), F.col("both") / (F.col("n") * F.col("n"))
    return same.join(margins, by).select(*by, "n", F.round(po, 4).alias("agreement"), F.when(pe < 1, F.round((po - pe) / (1 - pe), 4)).alias("kappa"))


def stratified(observed: DataFrame, population: DataFrame, strata: list[str], by: list[str]) -> DataFrame:
    """(by, n, estimate, lo, hi): strata weighted by their population, normal interval.

    observed: a row for each label (strata, by, ok boolean); population: (strata,
    size). The variance has the finite-population correction; a stratum with one
    label adds none.
    """
    cells = observed.groupBy(*by, *[s for s in strata if s not in by]).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("ok").cast("double")).alias("p"))
    sized = cells.join(population, strata)
    spread = F.when(F.col("n") > 1, F.col("size") * F.col("size") * F.greatest(1 - F.col("n") / F.col("size"), F.lit(0.0)) * F.col("p") * (1 - F.col("p")) / (F.col("n") - 1)).otherwise(0.0)
    g = sized.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("size").alias("total"), F.sum(F.col("size") * F.col("p")).alias("hits"), F.sum(spread).alias("var"))
    est, half = F.col("hits") / F.col("total"), Z * F.sqrt("var") / F.col("total")
    return g.select(*by, "n", F.round(est, 4).alias("estimate"), F.round(F.greatest(est - half, F.lit(0.0)), 4).alias("lo"), F.round(F.least(est + half, F.lit(1.0)), 4).alias("hi"))


def hash_sample(rows: DataFrame, strata: list[str], key: str, k: int, salt: str) -> DataFrame:
    """k rows a stratum by the order of salted hashes: the same ones on every run.

    Rows come with `place` from 1. The rank is limited as it is taken, so each task
    hands on k rows a stratum only.
    """
    mark = F.sha2(F.concat_ws("\x1f", F.lit(salt), *strata, F.col(key).cast("string")), 256)
    w = Window.partitionBy(*strata).orderBy("__mark", key)
    return rows.withColumn("__mark", mark).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).drop("__mark")
