"""Near-duplicate documents: SuperMinHash, banding, verification, union-find.

1. A document's set is its distinct 5-word shingles (64-bit hashes). Equal sets
   are one class, taken by a 128-bit sum over the set.
2. SuperMinHash gives each class a signature: every element ranks the slots by a
   permutation of its own, its j-th slot gets j plus a random fraction, and each
   slot keeps the least. Ranks are dealt one layer at a time and a document stops
   as soon as its slots are all filled, since later layers can only be larger.
3. BANDS bands of ROWS slots: classes that share a band are candidates. At a
   similarity of 0.85 all bands differ with a chance below 1e-6.
4. Stars first: each class is compared with the one class, the least of a shared
   band, that it shares most bands with. A group of near copies, of
   any size, becomes one component by as many comparisons as it has classes.
5. Bands that then hold two components or more are open: their classes hang
   together in groups. A group of up to BLOCK classes is one piece of work: exact
   intersections of full sets for all its pairs by matrix products, of which a
   spanning forest is returned. In a larger group only classes that share a band
   meet: each of its bands, those with equal members once, goes to blocks of BLOCK
   classes, and each pair of blocks is one piece of work. Blocks of one large
   component aren't compared with each other.
6. Union-find over all verified links gives components. A pair that shares a band
   is either compared or already in one component, so no component is missed.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .coding import small_batches
from .common import cut, new_path
from .components import components

WORDS = 5
BANDS, ROWS = 24, 5
#: Verified when PERCENT * union <= 100 * intersection.
PERCENT = 85
#: Classes in a block; two blocks meet in one piece of work.
BLOCK = 384
#: Word hashes kept per worker, of words of so many bytes at most.
ROOM, LONGEST = 500_000, 64
_COLUMNS = 4096
#: Key of the blocks that small components share; no id is taken to be this.
_MIXED = -(1 << 63)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        out = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST:
            self[word] = out
        return out


_HASHES = _Hashes()
#: Odd factors of the words' hashes by place in a shingle.
_WEIGHTS = [pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WORDS)]


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None):
    """Sorted distinct shingle hashes of a whole text, A-Z lowered; a shorter text is one shingle."""
    import numpy as np

    words = (text or "").encode().lower().split()
    h = np.empty(len(words), np.uint64)
    for k in range(0, len(words), ROOM):
        if len(_HASHES) > ROOM:
            _HASHES.clear()
        some = words[k : k + ROOM]
        h[k : k + len(some)] = np.fromiter(map(_HASHES.__getitem__, some), np.uint64, len(some))
    if not len(h):
        return h
    size = min(WORDS, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out += h[k : len(h) - size + 1 + k] * np.uint64(_WEIGHTS[k])
    out = _mix(out)
    return np.unique(out)


def signatures(sets: list, slots: int = BANDS * ROWS):
    """SuperMinHash of non-empty sets of hashes: one row of `slots` unsigned 64-bit values each.

    A value's top byte is the layer, its rest the fraction.
    """
    import numpy as np

    sizes = np.array([len(s) for s in sets])
    item, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    out = np.full((len(sets), slots), np.iinfo(np.uint64).max, np.uint64)
    flat, order = out.reshape(-1), None
    for layer in range(slots):
        r = _mix(item + np.uint64((layer * 0x9E3779B97F4A7C15 + 0x1234567) & (1 << 64) - 1))
        value = (r >> np.uint64(8)) | np.uint64(layer << 56)
        pick = layer + ((r & np.uint64(0xFFFFFF)) % np.uint64(slots - layer)).astype(np.int64)
        if order is None:
            slot = pick
        else:
            at = np.arange(len(item))
            slot = order[at, pick].astype(np.int64)
            order[at, pick] = order[at, layer]
        np.minimum.at(flat, doc * slots + slot, value)
        open_ = (out >> np.uint64(56)).max(axis=1) > layer
        if not open_.any():
            break
        stay = open_[doc]
        if order is None:
            pick = pick[stay]
            order = np.tile(np.arange(slots, dtype=np.uint8), (len(pick), 1))
            order[np.arange(len(pick)), pick] = 0
        else:
            order = order[stay]
        item, doc = item[stay], doc[stay]
    return out


def _sign(batches):
    import numpy as np
    import pyarrow as pa

    for b in batches:
        sets = [shingles(t) for t in b.column("text").to_pylist()]
        full = [k for k, s in enumerate(sets) if len(s)]
        fp = [(None, None)] * len(sets)
        bands: list = [None] * len(sets)
        if full:
            got = signatures([sets[k] for k in full]).reshape(len(full), BANDS, ROWS)
            key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(full), 1))
            for r in range(ROWS):
                key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + got[:, :, r])
            for n, k in enumerate(full):
                one, two = _mix(sets[k]).sum(dtype=np.uint64), _mix(sets[k] ^ np.uint64(0x5555555555555555)).sum(dtype=np.uint64)
                fp[k] = (int(one.view(np.int64)), int(two.view(np.int64)))
                bands[k] = key[n].view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in fp], pa.int64()), pa.array([y for _, y in fp], pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "fp1", "fp2", "bands"],
        )


def _sets(batches):
    import pyarrow as pa

    for b in batches:
        got = pa.array([shingles(t).view("int64") for t in b.column("text").to_pylist()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column("node"), b.column("root"), b.column("row"), b.column("col"), b.column("side"), got], ["node", "root", "row", "col", "side", "set"])


def forest(ids: list, sets: list, split: int | None) -> list[tuple]:
    """(a, b): what the verified links connect, each id with the least one of its tree.

    split: only pairs across the first `split` and the rest are compared; None: all pairs.
    """
    import numpy as np

    n, sizes = len(ids), np.array([len(s) for s in sets])
    _, where, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    shared = often[where] > 1
    number = np.cumsum(often > 1) - 1
    row, col = row[shared], number[where[shared]]
    by_col = np.argsort(col, kind="stable")
    row, col = row[by_col], col[by_col]
    both = np.zeros((n, n), np.float32) if split is None else np.zeros((split, n - split), np.float32)
    width = int(col[-1]) + 1 if len(col) else 0
    for lo in range(0, width, _COLUMNS):
        s, e = np.searchsorted(col, [lo, lo + _COLUMNS])
        part = np.zeros((n, min(_COLUMNS, width - lo)), np.float32)
        part[row[s:e], col[s:e] - lo] = 1
        both += part @ part.T if split is None else part[:split] @ part[split:].T
    left, right = (sizes, sizes) if split is None else (sizes[:split], sizes[split:])
    linked = both * (100 + PERCENT) >= PERCENT * (left[:, None] + right[None, :]).astype(np.float64)
    order = np.argsort(np.array(ids), kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    label, shift = rank.copy(), 0 if split is None else split
    a, b = np.nonzero(linked)
    b = b + shift
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[order[new]])
        if (new == label).all():
            break
        label = new
    return [(ids[k], ids[order[label[k]]]) for k in range(n) if label[k] != rank[k]]


def _verify(batches):
    """Pieces of work arrive one after the other, sorted; each is handled when it is complete."""
    import numpy as np
    import pyarrow as pa

    def done():
        if len(ids) < 2:
            return []
        split = None if row == col else sides.count(0)
        return [] if split is not None and split in (0, len(ids)) else forest(ids, sets, split)

    key, ids, sets, sides = None, [], [], []
    row = col = 0
    for b in batches:
        links = []
        lists = b.column("set")
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        for k, (node, root, r, c, side) in enumerate(zip(*[b.column(x).to_pylist() for x in ("node", "root", "row", "col", "side")])):
            if (root, r, c) != key:
                links += done()
                key, row, col, ids, sets, sides = (root, r, c), r, c, [], [], []
            ids.append(node), sides.append(side), sets.append(np.array(flat[offsets[k] : offsets[k + 1]]))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])
    links = done()
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])


def _candidates(rows: DataFrame, open_: DataFrame) -> DataFrame:
    """Whole texts of the classes that share a band, written once to the shared folder."""
    path = new_path(rows.sparkSession, "candidates")
    rows.join(open_.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.parquet(path)


def _with_roots(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) under the links so far."""
    return nodes.select("node").distinct().join(components(links), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _open_bands(rooted: DataFrame) -> DataFrame:
    """(band, node, root) of bands that hold two components or more: what is left to verify."""
    open_ = rooted.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most").select("band")
    return rooted.join(open_, "band").select("band", "node", "root")


def _best_hubs(open_: DataFrame) -> DataFrame:
    """(node, hub): for each node the hub that it shares most bands with; a hub is its band's least node."""
    hubs = open_.groupBy("band").agg(F.min("node").alias("hub"))
    shared = open_.join(hubs, "band").filter("node <> hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("n"))
    return shared.groupBy("node").agg(F.max_by("hub", F.struct("n", F.negative("hub"))).alias("hub"))


def _star(pairs: DataFrame) -> DataFrame:
    """(node, root, row, col, side): work that compares each node with its hub; a hub with many nodes meets them in parts of BLOCK."""
    parts = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    spokes = pairs.join(parts, "hub").select("node", F.col("hub").alias("root"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("row"), F.lit(1).alias("side"))
    centres = parts.select(F.col("hub").alias("node"), F.col("hub").alias("root"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("row"), F.lit(0).alias("side"))
    return centres.unionByName(spokes).withColumn("col", F.col("row") + 1)


def _units(open_: DataFrame) -> DataFrame:
    """(root, node, comp): sets of classes to compare, so that every two of an open band are in one of them.

    root: a group of up to BLOCK classes that hang together by open bands, or one
    band of a larger group.
    """
    ties = open_.join(open_.groupBy("band").agg(F.min("node").alias("b")), "band").filter("node <> b").select(F.col("node").alias("a"), "b").distinct()
    nodes = open_.select("node", F.col("root").alias("comp")).distinct().join(components(ties), "node")
    large = nodes.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK).select("root")
    small = nodes.join(large, "root", "left_anti").select("root", "node", "comp")
    in_large = open_.select("band", "node", F.col("root").alias("comp")).join(nodes.join(large, "root", "left_semi").select("node"), "node", "left_semi")
    mark = [F.sum(F.pmod(F.xxhash64(F.lit(k), "node"), F.lit(1 << 31))).alias(f"h{k}") for k in range(4)]
    alike = in_large.groupBy("band").agg(F.count(F.lit(1)).alias("n"), *mark).groupBy("n", "h0", "h1", "h2", "h3").agg(F.min("band").alias("band")).select("band")
    return small.unionByName(in_large.join(alike, "band", "left_semi").select(F.col("band").alias("root"), "node", "comp"))


def _groups(open_: DataFrame) -> DataFrame:
    """(node, root, row, col, side): units in blocks, a row for each pair of blocks to compare.

    A component with BLOCK nodes or more in its unit has blocks of its own, which
    aren't compared with each other; all other nodes share mixed blocks.
    """
    nodes = cut(_units(open_))
    sizes = nodes.groupBy("root", "comp").agg(F.count(F.lit(1)).alias("n")).withColumn("pure", F.when(F.col("n") >= BLOCK, F.col("comp")))
    lots = sizes.groupBy("root", "pure").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    numbered = cut(lots.withColumn("first", (F.sum("blocks").over(Window.partitionBy("root").orderBy("pure").rowsBetween(Window.unboundedPreceding, 0)) - F.col("blocks")).cast("int")))
    large = sizes.filter("pure is not null").select("root", "comp", "pure")
    placed = nodes.join(large, ["root", "comp"], "left").withColumn("key", F.coalesce("pure", F.lit(_MIXED)))
    lot = numbered.select("root", F.coalesce("pure", F.lit(_MIXED)).alias("key"), "blocks", "first")
    placed = placed.join(lot, ["root", "key"]).withColumn("own", F.col("first") + F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = lot.select("root", F.col("key").alias("other_key"), F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1)).alias("other"))
    pairs = placed.select("node", "root", "key", "own").join(others, "root").filter((F.col("key") != F.col("other_key")) | (F.col("key") == _MIXED))
    return pairs.select("node", "root", F.least("own", "other").alias("row"), F.greatest("own", "other").alias("col"), (F.col("own") > F.col("other")).cast("int").alias("side"))


def _verified(texts: DataFrame, work: DataFrame) -> DataFrame:
    """(a, b): a spanning forest of the links that the work finds; each (root, row, col) is compared in one task as its rows stream by."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = work.join(texts, F.col("doc_id") == F.col("node")).select("node", "root", "text", "row", "col", "side")
    sets = rows.mapInArrow(_sets, "node long, root long, row int, col int, side int, set array<long>")
    return sets.repartition(parts, "root", "row", "col").sortWithinPartitions("root", "row", "col", "side", "node").mapInArrow(_verify, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept) of every row.

    component_id: the least id reachable over links of a similarity of PERCENT
    percent or more; kept: the row's id is that one. A text without words (null,
    empty, blank) has no shingle and stays by itself. Ids are integers; rows with
    one id are one document and kept together; a row whose id is null links
    nothing but to equal sets that have ids. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = cut(rows.mapInArrow(_sign, "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>"))
    classes = signed.filter("fp1 is not null and doc_id is not null").groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"))
    classes = cut(classes)
    banded = classes.select("node", F.explode("bands").alias("band"))
    open_ = cut(_open_bands(banded.withColumn("root", F.col("node"))))
    texts = _candidates(rows, open_)
    links = cut(_verified(texts, _star(_best_hubs(open_))))
    rooted = open_.drop("root").join(_with_roots(open_, links), "node")
    rest = cut(_open_bands(rooted))
    links = links.unionByName(_verified(texts, _groups(rest)))
    found = components(links)
    of_class = classes.join(found, "node", "left").select("fp1", "fp2", F.col("n_shingles").alias("n"), F.coalesce("root", "node").alias("component"))
    named = signed.join(of_class, (signed["fp1"] == of_class["fp1"]) & (signed["fp2"] == of_class["fp2"]) & (F.col("n_shingles") == F.col("n")), "left")
    out = named.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def op7_superminhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
