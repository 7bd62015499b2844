"""Packing into sequences by bin completion, with best-fit solutions as incumbents.

Only how many pieces there are of each length matters for the packing, and
lengths are at most the capacity: the driver gets that histogram (2048 numbers
at most, whatever the corpus). Bin completion runs on it: around the largest
remaining length all undominated fillings of the gap are enumerated, those of
least waste first, each as often as its lengths last or fewer times, and a branch
whose waste exceeds what the incumbent allows is cut. Which sums the remaining
lengths reach is known by bit sets, so the enumeration has no dead ends. The plan
is a list of patterns with multiplicities, which pieces then find by their rank
among the pieces of their length.

The incumbent is returned when it meets a lower bound, when all branches are
done, or after `steps` steps; with steps=None the search is exact.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .coding import coder, small_batches
from .common import cut, unused

CAPACITY = 2048
#: Ranks within one length are taken in parts of so many pieces, or of a 65,536th of all where that is more.
PART_ROWS, MOST_PARTS = 4096, 1 << 16
#: Fillings and branches that the search looks at before the incumbent stands; None: as many as there are.
STEPS: int | None = 10_000

#: Frames of the search that keep what they enumerate, about half a megabyte each.
LIVE = 64

Pattern = tuple[int, ...]
Plan = list[tuple[Pattern, int]]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences needed at least: by the total, and by large pieces that can't share with each other."""
    number, weight = [0], [0]  # of pieces up to each length
    for x in range(1, capacity + 1):
        n = counts.get(x, 0)
        number.append(number[-1] + n)
        weight.append(weight[-1] + n * x)
    half, best = capacity // 2, -(-weight[capacity] // capacity)
    for least in range(1, half + 1):
        # Pieces over capacity - least are alone; those over half don't share, and leave room for smaller ones.
        large = number[capacity] - number[half]
        room = capacity * (number[capacity - least] - number[half]) - (weight[capacity - least] - weight[half])
        best = max(best, large + max(0, -(-(weight[half] - weight[least - 1] - room) // capacity)))
    return best


def _reached(counts: dict[int, int], sizes: list[int], gap: int) -> list[int]:
    """For each k the bit set of the sums up to gap of pieces of the k smallest lengths."""
    full, out = (1 << gap + 1) - 1, [1]
    for x in sizes:
        bits, left, step = out[-1], min(counts[x], gap // x), 1
        while left and bits != full:
            take = min(step, left)
            bits |= bits << take * x & full
            left, step = left - take, step * 2
        out.append(bits)
    return out


def _exactly(counts: dict[int, int], sizes: list[int], reached: list[int], target: int, most: int) -> Iterator[Pattern]:
    """All fillings that sum to target by the `most` smallest lengths, the largest pieces first."""
    if target == 0:
        yield ()
        return
    for k in range(min(most, bisect_right(sizes, target)) - 1, -1, -1):
        x = sizes[k]
        if not reached[k + 1] >> target & 1:
            return
        for n in range(min(counts[x], target // x), 0, -1):
            if reached[k] >> target - n * x & 1:
                for rest in _exactly(counts, sizes, reached, target - n * x, k):
                    yield (x,) * n + rest


def _dominated(filling: Pattern, waste: int, counts: dict[int, int], free: int) -> bool:
    """Whether a length that is left fits beside the filling, or stands for some of its pieces without more than the waste.

    free: bit set of the lengths left. A filling is dominated by another one just
    if it is by such an exchange.
    """
    free_bits = free
    for x in set(filling):
        if counts[x] <= filling.count(x):
            free_bits &= ~(1 << x)
    if free_bits & (1 << waste + 1) - 2:  # a length that still fits beside the filling
        return True
    one = two = 0
    for x in filling:  # sums of one piece, and of two or more
        two |= (one | two) << x
        one |= 1 << x
    spread, width = two, 1
    while width <= waste:
        step = min(width, waste + 1 - width)
        spread |= spread << step
        width += step
    if free_bits & spread:
        return True
    above, width = one << 1, 1
    while waste and width < waste:
        step = min(width, waste - width)
        above |= above << step
        width += step
    return bool(waste and free_bits & above)


def fillings(counts: dict[int, int], gap: int, waste: int | None = None) -> Iterator[Pattern]:
    """All undominated fillings of gap that leave no more than waste, least first, then those of the largest pieces."""
    return (f for f in _judged(counts, gap, gap if waste is None else waste) if f is not None)


def _judged(counts: dict[int, int], gap: int, waste: int) -> Iterator[Pattern | None]:
    """fillings, with None for each one that is dominated, so that a caller can stop in between."""
    sizes = [x for x in sorted(counts) if counts[x] and x <= gap]
    reached, free = _reached(counts, sizes, gap), sum(1 << x for x in sizes)
    for lost in range(min(gap, waste) + 1):
        if reached[-1] >> gap - lost & 1:
            for f in _exactly(counts, sizes, reached, gap - lost, len(sizes)):
                yield None if _dominated(f, lost, counts, free) else f


def _times(counts: dict[int, int], pattern: Pattern) -> int:
    return min(counts[x] // pattern.count(x) for x in set(pattern))


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Patterns: the largest remaining length, then always the longest that still fits."""
    counts = dict(counts)
    sizes = sorted(counts)
    out = []
    while sizes:
        pattern, left = (sizes[-1],), capacity - sizes[-1]
        while True:
            k = bisect_right(sizes, left) - 1
            while k >= 0 and counts[sizes[k]] <= pattern.count(sizes[k]):
                k -= 1
            if k < 0:
                break
            pattern, left = (*pattern, sizes[k]), left - sizes[k]
        n = _times(counts, pattern)
        out.append((pattern, n))
        for x in set(pattern):
            counts[x] -= n * pattern.count(x)
            if not counts[x]:
                del counts[x]
                sizes.remove(x)
    return out


def _less(counts: dict[int, int], pattern: Pattern, n: int) -> dict[int, int]:
    rest = dict(counts)
    for x in set(pattern):
        rest[x] -= n * pattern.count(x)
        if not rest[x]:
            del rest[x]
    return rest


def _branches(counts: dict[int, int], capacity: int, waste: int, after: tuple | None) -> Iterator[tuple[Pattern, int] | None]:
    """(pattern, times) around the largest length: most times first, then halves, then all other numbers; None: a dominated one.

    after: order of the pattern that the same length took before; equal lengths
    take theirs in order, so that no set of sequences is met twice.
    """
    top = max(counts)
    for f in _judged(_less(counts, (top,), 1), capacity - top, waste):
        if f is None:
            yield None
            continue
        if after is not None and (capacity - top - sum(f), [-x for x in f]) <= (after[0], after[1]):
            yield None
            continue
        pattern = (top, *f)
        most = min(_times(counts, pattern), waste // lost if (lost := capacity - sum(pattern)) else 1 << 62)
        first = [most >> k for k in range(most.bit_length())]
        yield from ((pattern, n) for n in first)
        yield from ((pattern, n) for n in range(most, 0, -1) if n not in first)


def bin_completion(histogram: dict[int, int], capacity: int = CAPACITY, steps: int | None = STEPS) -> Plan:
    """Patterns and how often each is used; never more sequences than best fit needs, and the fewest with steps=None."""
    total = sum(x * n for x, n in histogram.items())
    bound = lower_bound(histogram, capacity)
    best = best_fit(histogram, capacity)
    bins = sum(n for _, n in best)

    def spare() -> int:
        """Waste of a plan with one sequence less."""
        return (bins - 1) * capacity - total

    # Depth first on one table of counts. A frame holds its branches to come, how many were taken, the sequences and the
    # waste so far, the waste left, and `after`; only the last LIVE frames keep their branches, others make them again.
    counts, used = dict(histogram), []
    frames: list[list] = [[None, 0, 0, 0, spare(), None]] if bins > bound else []
    taken = 0
    while frames and bins > bound and (steps is None or taken < steps):
        frame = frames[-1]
        if frame[0] is None:
            frame[0] = islice(_branches(counts, capacity, frame[4], frame[5]), frame[1], None)
            taken += frame[1]
        branch = next(frame[0], ((), 0))
        frame[1] += 1
        taken += 1
        if branch is None:
            continue
        pattern, n = branch
        if not n:
            frames.pop()
            if used:
                _add(counts, *used.pop())
            continue
        lost = frame[3] + n * (capacity - sum(pattern))
        if lost > spare():
            continue
        _add(counts, pattern, -n)
        used.append((pattern, n))
        if not counts:
            bins, best = frame[2] + n, list(used)
            _add(counts, *used.pop())
            continue
        after = (capacity - sum(pattern), [-x for x in pattern[1:]]) if all(counts.get(x, 0) >= pattern.count(x) for x in set(pattern)) else None
        frames.append([None, 0, frame[2] + n, lost, spare() - lost, after])
        if len(frames) > LIVE:
            frames[-LIVE - 1][0] = None
    return best


def _add(counts: dict[int, int], pattern: Pattern, n: int) -> None:
    for x in set(pattern):
        left = counts.get(x, 0) + n * pattern.count(x)
        if left:
            counts[x] = left
        else:
            del counts[x]


def places(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, lo, hi, first sequence, copies, offset): ranks lo..hi-1 of a length, copies in each sequence."""
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, n in plan:
        at = 0
        for x in sorted(set(pattern), reverse=True):
            copies = pattern.count(x)
            lo = rank.get(x, 0)
            rank[x] = lo + n * copies
            out.append((x, lo, rank[x], sequence, copies, at))
            at += x * copies
        sequence += n
    return out


def _cutter(path: str, split: str, end_id: int, capacity: int, with_ids: bool):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        c, end, step = coder(path, split), np.uint32(end_id).tobytes(), 4 * capacity
        for b, coded in c.encode_batches(batches):
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for k, x in enumerate(coded):
                x += end
                for p, s in enumerate(range(0, len(x), step)):
                    y = x[s : s + step]
                    at.append(k), piece.append(p), start.append(s // 4), length.append(len(y) // 4), crc.append(zlib.crc32(y))
                    if with_ids:
                        ids.append(np.frombuffer(y, np.int32))
            cols = [b.column("doc_id").take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return run


def cut_pieces(docs: DataFrame, vocabulary: str, end_id: int = 0, split: str = "blank", capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every whole text's ids (null: empty) with end_id: only texts over capacity are cut."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_cutter(vocabulary, split, end_id, capacity, with_ids), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def pack(pieces: DataFrame, capacity: int = CAPACITY, steps: int | None = STEPS) -> DataFrame:
    """pieces (doc_id, piece, length, ...) with sequence_id and offset, each piece placed once.

    Lengths must be 1..capacity. Repeated rows are placed one by one. Without
    rows the result has none. A piece of the whole capacity is a sequence of its
    own, numbered below 0, and is not moved. `pieces` is read three times; hand
    over a written table.
    """
    spark = pieces.sparkSession
    part, rank, row, base_, key = unused(pieces, "part", "rank", "row", "base", "key")
    whole = pieces.filter(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    short = pieces.filter(F.col("length") < capacity)
    histogram = {r["length"]: r["n"] for r in short.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    room = max(PART_ROWS, -(-sum(histogram.values()) // MOST_PARTS))
    parts = spark.createDataFrame([(x, -(-n // room)) for x, n in histogram.items()], f"{key} int, n_parts int")
    dealt = short.join(F.broadcast(parts), F.col("length") == F.col(key)).withColumn(part, F.pmod(F.xxhash64("doc_id", "piece"), F.col("n_parts")).cast("int")).drop(key, "n_parts")
    sizes = dealt.groupBy("length", part).agg(F.count(F.lit(1)).alias("n")).collect()  # MOST_PARTS plus capacity rows at most
    bases, seen = [], dict.fromkeys(histogram, 0)
    for x, p, n in sorted(sizes):
        bases.append((x, p, seen[x]))
        seen[x] += n
    plan = spark.createDataFrame(places(bin_completion(histogram, capacity, steps)), f"{key} long, lo long, hi long, first long, copies long, at long")
    base = spark.createDataFrame(bases, f"length long, {part} int, {base_} long")
    order = Window.partitionBy("length", part).orderBy("doc_id", "piece", *[c for c in ("ids_crc32",) if c in pieces.columns])
    ranked = dealt.withColumn(row, F.row_number().over(order).cast("long") - 1).join(F.broadcast(base), ["length", part]).withColumn(rank, F.col(base_) + F.col(row))
    k = F.col(rank) - F.col("lo")
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col(key)) & (F.col(rank) >= F.col("lo")) & (F.col(rank) < F.col("hi")))
    placed = placed.select(*[F.col(c) for c in pieces.columns], (F.col("first") + F.floor(k / F.col("copies"))).cast("long").alias("sequence_id"), (F.col("at") + F.pmod(k, F.col("copies")) * F.col("length")).alias("offset"))
    return placed.unionByName(whole)


def op9_bin_completion(spark, sf_dir: str) -> DataFrame:
    """All documents in as few sequences of at most 2048 ids as bin completion finds."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))


def pack_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all documents."""
    return pack(cut(cut_pieces(docs, vocabulary)))
