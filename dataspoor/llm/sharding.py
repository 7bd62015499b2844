"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has CELLS cells. A key's cell comes from the high bits of its hash, and
each virtual node of each shard sits on a cell; a key belongs to the first node
at or after its cell. No shard may take more than its capacity: what a full
shard can't take goes on clockwise to the next node, round by round, so that
loads are bounded whatever the keys.

Only counts per cell reach the driver (CELLS numbers at most, however large the
table); the walk there yields intervals "ranks lo..hi of cell c go to shard s
from slot b", which are broadcast (at most CELLS plus one for each overflow) and
applied to the rank that each row has in its cell.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELLS = 1 << 14


def ring(n_shards: int, vnodes: int, seed: int = 0) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise. A shard's nodes depend on it alone."""
    at = lambda s, v: int.from_bytes(hashlib.blake2b(f"{seed}/{s}/{v}".encode(), digest_size=8).digest(), "big") % CELLS
    return sorted((at(s, v), s) for s in range(n_shards) for v in range(vnodes))


def capacities(total: int, n_shards: int, load_factor: float) -> list[int]:
    """At 1.0 the shards' room is exactly the rows, so counts are at most one apart."""
    if load_factor <= 1.0:
        return [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    return [-int(-(load_factor * total) // n_shards)] * n_shards


def walk(counts: dict[int, int], nodes: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(cell, lo, hi, shard, slot of lo): ranks lo..hi-1 of a cell, dealt clockwise under the shards' room."""
    where = [c for c, _ in nodes]
    waiting: dict[int, list[tuple[int, int, int]]] = {}
    for cell in sorted(counts):
        waiting.setdefault(bisect_left(where, cell) % len(nodes), []).append((cell, 0, counts[cell]))
    used, out = [0] * len(room), []
    while waiting:
        moved: dict[int, list[tuple[int, int, int]]] = {}
        for node in sorted(waiting):
            shard = nodes[node][1]
            for cell, lo, hi in waiting[node]:
                take = min(hi - lo, room[shard] - used[shard])
                if take:
                    out.append((cell, lo, lo + take, shard, used[shard]))
                    used[shard] += take
                if lo + take < hi:
                    moved.setdefault((node + 1) % len(nodes), []).append((cell, lo + take, hi))
        waiting = moved
    return out


def assign_shards(docs: DataFrame, n_shards: int = 40, vnodes: int = 64, load_factor: float = 1.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every row: (id_col, size, text_crc32, ring_cell, home_shard, shard, slot).

    size: UTF-8 bytes of the text plus 16 (null: 16); text_crc32 of those bytes
    (null: 0, as for no bytes). home_shard: the ring's choice before loads count.
    slot runs from 0 without gaps in each shard. A row's place on the ring is
    its id's hash; rows with a null id are placed by their text instead. Repeated rows are
    dealt like any others; equal rows are interchangeable. An empty table gives
    no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    ident, text = F.col(id_col), F.col(text_col)
    if docs.filter(ident.isNull()).limit(1).count():
        key = F.when(ident.isNull(), F.xxhash64(F.lit(seed), F.lit("text"), text)).otherwise(F.xxhash64(F.lit(seed), ident))
    else:
        key = F.xxhash64(F.lit(seed), ident)
    keyed = docs.withColumns({"__pos": key})
    cell = F.shiftrightunsigned("__pos", 50).cast("int")
    counts = {r["cell"]: r["n"] for r in keyed.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()}
    nodes = ring(n_shards, vnodes, seed)
    plan = walk(counts, nodes, capacities(sum(counts.values()), n_shards, load_factor))
    where = [c for c, _ in nodes]
    intervals = spark.createDataFrame([(c, lo, hi, s, b, nodes[bisect_left(where, c) % len(nodes)][1]) for c, lo, hi, s, b in plan], "ring_cell int, lo long, hi long, shard int, base long, home_shard int")
    rows = keyed.select(
        ident.alias("__id"),
        F.col("__pos"),
        cell.alias("ring_cell"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    by_cell = Window.partitionBy("ring_cell").orderBy("__pos", "__id", "size", "text_crc32")
    ranked = rows.withColumn("__rank", F.row_number().over(by_cell).cast("long") - 1)
    placed = ranked.join(F.broadcast(intervals), (ranked["ring_cell"] == intervals["ring_cell"]) & (F.col("__rank") >= F.col("lo")) & (F.col("__rank") < F.col("hi")))
    return placed.select(F.col("__id").alias(id_col), "size", "text_crc32", ranked["ring_cell"], "home_shard", "shard", (F.col("base") + F.col("__rank") - F.col("lo")).alias("slot"))


def op3_ring_shards(spark, sf_dir: str) -> DataFrame:
    """All documents over 40 shards; law `rows`: counts are at most one apart."""
    placed = assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard", (F.col("shard") != F.col("home_shard")).alias("overflowed"))
