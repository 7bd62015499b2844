"""Nearest neighbours by a permutation index.

A vector is represented by the order of its PREFIX nearest pivots and posted in
the inverted files of the LISTED first of them. A query asks the files of its own
first pivots, ranks what is posted there by footrule distance between the orders,
and reranks what is near enough by exact inner products. A pair meets once: in
the file of the query's first pivot that lists the vector.

Pivots grow as the root of the table, so files do too. How many files a query
asks and which footrule distance is near enough are set on a sample of at most
SAMPLE vectors, so that their nearest neighbours there are met with a chance of
RECALL each: data of low dimension need few files, data without structure most.
No count of candidates is capped.

A file longer than SEGMENT vectors is dealt to several segments, and the queries
of a much asked one to several chunks. A task holds one segment at a time, built
once, while its queries stream by; each gives its k best, and those are merged,
in rounds of at most FAN where there are more.

Inner products order as angles do once an added component makes all vectors
equally long (a query's is 0), so pivots are lifted vectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .coding import small_batches
from .common import cut

#: Pivots: twice the root of the number of vectors, within these bounds.
PIVOTS = (64, 2048)
#: Vectors that the two settings are measured on, beside the pivots.
SAMPLE = 2048
#: Of the sample's nearest neighbours, those met by the files asked, and of these those within the distance.
RECALL = 0.975
PREFIX, LISTED = 32, 2
#: Queries are compared with a segment so many at a time that their tables of places stay within this many entries.
ROOM = 1 << 20
SEGMENT, CHUNK, FAN = 2048, 32768, 256
_HIT = "array<struct<score:double,vec_id:long>>"


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, and not zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.coalesce(~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def lifted(vectors, longest: float):
    """Vectors over the longest norm, with the component that makes them unit vectors."""
    import numpy as np

    x = np.asarray(vectors, np.float64) / longest
    return np.hstack([x, np.sqrt(np.maximum(1.0 - (x * x).sum(axis=1), 0.0))[:, None]])


def orders(vectors, pivots, prefix: int):
    """Nearest pivots of each row, nearest first, ties to the first pivot."""
    import numpy as np

    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :prefix].astype(np.int32)


def places(order, n_pivots: int):
    """Place of each pivot (rows) in each order (columns); the order's length where it isn't in it."""
    import numpy as np

    out = np.full((n_pivots, len(order)), order.shape[1], np.int16)
    out[order.T, np.arange(len(order))[None, :]] = np.arange(order.shape[1], dtype=np.int16)[:, None]
    return out


def footrule(order, place):
    """Footrule distances of truncated orders (rows) to those that `places` holds (columns).

    A pivot in one order only counts as far as the end is from its place.
    """
    import numpy as np

    length = order.shape[1]
    got = place[order]
    far = np.abs(got - np.arange(length, dtype=np.int16)[None, :, None])
    far += got
    return far.sum(axis=1, dtype=np.int32) + (length * (length - 1) // 2 + length - length * length)


def settings(sample, pivots, k: int, of: int, recall: float = RECALL) -> tuple[int, int]:
    """(files to ask, footrule distance that is near enough) from lifted vectors other than the pivots.

    of: size of the whole table; its k nearest are about as near as this many of the sample are.
    """
    import numpy as np

    if len(sample) < 2:
        return len(pivots), 2 * PREFIX * PREFIX
    k = max(1, min(len(sample) - 1, round(k * len(sample) / max(1, of))))
    asking = sample.copy()
    asking[:, -1] = 0.0
    theirs, own = orders(sample, pivots, PREFIX), orders(asking, pivots, len(pivots))
    first, far = [], []
    for n, x in enumerate(asking):
        score = sample @ x
        score[n] = -np.inf
        near = np.argpartition(-score, k - 1)[:k]
        at = np.empty(len(pivots), np.int32)
        at[own[n]] = np.arange(len(pivots))
        first.append(at[theirs[near, :LISTED]].min(axis=1))
        far.append(footrule(own[n : n + 1, :PREFIX], places(theirs[near], len(pivots)))[0])
    first, far = np.concatenate(first), np.concatenate(far)
    return int(np.quantile(first, recall, method="higher")) + 1, int(np.quantile(far, recall, method="higher"))


def _posting(pivots, longest: float):
    """Vectors with their orders, and in which files they stand."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        p = np.asarray(pivots)
        for b in batches:
            if b.num_rows:
                order = orders(lifted(_matrix(b.column("v")), longest), p, PREFIX)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(order), pa.list_(pa.int32()))], ["vec_id", "v", "ord"])

    return run


def _asking(pivots, longest: float, asked: int):
    """A row for each file that a query asks; earlier: bits of the files that it asks before."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        p = np.asarray(pivots)
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column("v"))
            whole = orders(np.hstack([v / longest, np.zeros((len(v), 1))]), p, max(asked, PREFIX))
            n, each = len(v), min(asked, len(p))
            files = whole[:, :each]
            earlier = np.zeros((n, each, len(p)), bool)
            for j in range(1, each):
                earlier[:, j] = earlier[:, j - 1]
                earlier[np.arange(n), j, files[:, j - 1]] = True
            bits = np.packbits(earlier.reshape(n * each, -1), axis=1)
            at = pa.array(np.repeat(np.arange(n), each))
            order = pa.array(list(whole[:, :PREFIX]), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(at), b.column("v").take(at), order.take(at), pa.array(files.reshape(-1), pa.int32()), pa.array([x.tobytes() for x in bits], pa.binary())], ["vec_id", "v", "ord", "pivot", "earlier"])

    return run


def _matrix(column):
    """Lists of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _meet(n_pivots: int, k: int, near: int):
    """Rows come sorted by segment, its vectors (side 0) before its queries; a query's row gives its k best there.

    A query without `earlier` is scored against every vector of the segment.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        key, held, built = None, [], None
        kind = pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())]))

        def build():
            v, ids, order = (np.concatenate(x) for x in zip(*held))
            at = np.argsort(ids, kind="stable")
            return v[at], ids[at], order[at][:, :LISTED], places(order[at], n_pivots)

        def best(q, qid, order, earlier):
            """(score, id) of each query's best, in rows padded with -inf."""
            v, ids, listed, place = built
            ok = ids[None, :] != qid[:, None]
            if earlier is not None:
                ok &= ~earlier[:, listed].any(axis=2)
                far = np.where(ok, footrule(order, place), np.iinfo(np.int32).max)
                bound = np.full(len(q), near)
                if len(v) > k:
                    bound = np.maximum(bound, np.partition(far, k - 1, axis=1)[:, k - 1])
                ok &= far <= bound[:, None]
            score = np.full(ok.shape, -np.inf)
            a, b = np.nonzero(ok)
            score[a, b] = (v[b] * q[a]).sum(axis=1)
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            return np.take_along_axis(score, top, axis=1), ids[top]

        for b in batches:
            if not b.num_rows:
                continue
            v, order = _matrix(b.column("v")), _matrix(b.column("ord"))
            ids, side = b.column("vec_id").to_numpy(), b.column("side").to_numpy()
            where = np.stack([b.column(c).to_numpy() for c in ("pivot", "part", "chunk")], axis=1)
            ends = [0, *(np.flatnonzero((np.diff(where, axis=0) != 0).any(axis=1) | (np.diff(side) != 0)) + 1), b.num_rows]
            found, segment, scores, owners = [], [], [], []
            for s, e in zip(ends, ends[1:]):
                if (here := tuple(where[s])) != key:
                    key, held, built = here, [], None
                if side[s] == 0:
                    held.append((v[s:e].copy(), ids[s:e].copy(), order[s:e].copy()))
                elif held:
                    built = build() if built is None else built
                    step = max(1, ROOM // (order.shape[1] * len(built[1])))
                    for lo in range(s, e, step):
                        hi = min(e, lo + step)
                        bits = b.column("earlier").slice(lo, hi - lo)
                        earlier = None if bits.null_count else np.unpackbits(np.frombuffer(b"".join(bits.to_pylist()), np.uint8).reshape(hi - lo, -1), axis=1, count=n_pivots).astype(bool)
                        score, who = best(v[lo:hi], ids[lo:hi], order[lo:hi], earlier)
                        for n in range(hi - lo):
                            m = int(np.isfinite(score[n]).sum())
                            if m:
                                found.append(ids[lo + n]), segment.append(here[0] * 1_000_003 + here[1]), scores.append(score[n, :m]), owners.append(who[n, :m])
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate(scores) if scores else [], pa.float64()), pa.array(np.concatenate(owners) if owners else [], pa.int64())], fields=list(kind.value_type))
            offsets = pa.array(np.cumsum([0, *map(len, scores)]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(segment, pa.int64()), pa.ListArray.from_arrays(offsets, flat, type=kind)], ["query_id", "segment", "top"])

    return run


def _merged(hits: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best of several lists: highest score first, ties to the smaller id."""
    flat = F.array_sort(F.transform(F.flatten(F.collect_list("top")), lambda h: F.struct((-h["score"]).alias("away"), h["vec_id"].alias("vec_id"))))
    back = F.transform(F.slice(flat, 1, k), lambda h: F.struct((-h["away"]).alias("score"), h["vec_id"].alias("vec_id")))
    return hits.groupBy("query_id", *by).agg(back.alias("top"))


def _one_length(rows: DataFrame, n: int, longest: float, k: int, recall: float) -> DataFrame:
    """(query_id, top) of usable vectors of one length; rows: vec_id, v, asks."""
    spark = rows.sparkSession
    small_batches(spark, 256)
    most = max(PIVOTS[0], min(PIVOTS[1], int(2 * n**0.5)))
    drawn = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(most + SAMPLE).collect()
    sample = lifted([r["v"] for r in drawn], longest)
    pivots, others = sample[:most], sample[most:] if len(sample) > most + 1 else sample
    asked, near = settings(others, pivots, k, n, recall=recall)
    coded = cut(rows.select("vec_id", "v").mapInArrow(_posting(pivots, longest), "vec_id long, v array<double>, ord array<int>"))
    queries = rows.filter("asks").select("vec_id", "v")
    posted = coded.withColumn("pivot", F.explode(F.slice("ord", 1, LISTED)))
    asking = cut(queries.mapInArrow(_asking(pivots, longest, asked), "vec_id long, v array<double>, ord array<int>, pivot int, earlier binary"))
    counts = posted.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).join(asking.groupBy("pivot").agg(F.count(F.lit(1)).alias("m")), "pivot")
    # One row for each pivot, PIVOTS[1] at most; files that nobody asks are left out.
    files = [(r["pivot"], -(-r["n"] // SEGMENT), -(-r["m"] // CHUNK)) for r in counts.collect()]
    meet = _meet(len(pivots), k, near)
    best = cut(_met(posted, asking, files, meet, k, asked))
    # A query whose files hold fewer than it may have is scored against all rows.
    short = queries.select("vec_id").join(best.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").filter(F.coalesce(F.size("top"), F.lit(0)) < min(k, n - 1)).select("vec_id").distinct()
    m = short.count()
    if not m:
        return best
    late = asking.join(short, "vec_id", "left_semi").dropDuplicates(["vec_id"]).withColumns({"pivot": F.lit(0), "earlier": F.lit(None).cast("binary")})
    whole = _met(coded.withColumn("pivot", F.lit(0)), late, [(0, -(-n // SEGMENT), -(-m // CHUNK))], meet, k, 1)
    return best.join(short.withColumnRenamed("vec_id", "query_id"), "query_id", "left_anti").unionByName(whole)


def _met(posted: DataFrame, asking: DataFrame, files: list[tuple[int, int, int]], meet, k: int, asked: int) -> DataFrame:
    """(query_id, top): posted (pivot, vec_id, v, ord) met by asking (also earlier) in the segments that files (pivot, parts, chunks) says."""
    spark, home = posted.sparkSession, F.xxhash64("vec_id", "v")
    dealt = spark.createDataFrame(files, "pivot int, parts int, chunks int")
    index = posted.join(dealt, "pivot").select("pivot", F.pmod(home, F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("side"), "vec_id", "v", "ord", F.lit(None).cast("binary").alias("earlier"))
    queries = asking.join(dealt, "pivot").select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(home, F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("side"), "vec_id", "v", "ord", "earlier")
    by = ("pivot", "part", "chunk")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = index.unionByName(queries).repartition(tasks, *by).sortWithinPartitions(*by, "side", "vec_id")
    hits = met.mapInArrow(meet, f"query_id long, segment long, top {_HIT}")
    lists = asked * max([parts for _, parts, _ in files], default=1)
    while lists > FAN:
        lists = -(-lists // FAN)
        hits = _merged(hits.withColumn("segment", F.pmod(F.xxhash64("segment", F.lit(lists)), F.lit(lists))), k, "segment")
    return _merged(hits, k)


def search(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query among all other rows.

    Nearest: largest inner product in double precision, ties to the smaller id. A
    row is never its own neighbour; is_query is a condition on the id column.
    Unusable vectors (see `usable`) and null ids take no part; vectors of different
    lengths are searched among those of their own length. With fewer than k
    candidates all are returned; with none, or no query, there are no rows. Ids are
    unique; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("asks"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("longest"), F.count_if("asks").alias("asking")).collect()
    best = spark.createDataFrame([], f"query_id long, top {_HIT}")
    for d, n, longest, asking in sorted(lengths):
        if n > 1 and asking:
            best = best.unionByName(_one_length(rows.filter(F.size("v") == d), n, longest, k, recall))
    return best.select("query_id", F.posexplode("top").alias("p", "h")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("h.vec_id").alias("vec_id"), F.col("h.score").alias("score"))


def op4_permutation_index(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
