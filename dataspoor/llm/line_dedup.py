"""Line dedup: a suffix array over line ids by prefix doubling, later copies of repeated runs deleted.

A text's lines are its \\n-split lines that hold a word, each with the wordless
lines after it; a line's id is the 128-bit hash of the line without outer white
space. The corpus is read in the order of ids (null first), then lines.

1. Only lines that come twice or more can stand in a repeated run, so suffixes
   start at those; a text falls into runs of consecutive ones.
2. Prefix doubling: rank 0 is the line's rank among the ids, rank k+1 the rank of
   the pair (rank k here, rank k 2**k lines on) among the pairs that come twice or
   more. Ranks are dealt by a range partitioning of the distinct pairs, so they
   follow the suffix order and no task sees a whole group of equal suffixes.
3. Suffixes that share a prefix are an interval of the suffix array. Those whose
   shared prefix reaches min_words are the longest-common-prefix intervals that
   count: the prefix of `len` lines, known by the ranks of its first and its last
   2**k lines. All of an interval's suffixes but the first in corpus order are
   later copies. Taking from each line the shortest prefix of min_words words, and
   the shortest such stretch that ends there, is enough: their union is the union
   of all maximal runs, since every line of a repeated run of min_words words lies
   in one of the two kinds within that run. So doubling ends at log2(min_words).
4. Overlapping copies merge into maximal runs, which are cut from the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, let, unused

#: Words that a repeated run holds at least.
MIN_WORDS = 50
_NEXT_LINE = r"\n(?=[\x20\x09\x0B-\x0D]*[^\x20\x09-\x0D])"
_BLANKS = " \t\n\x0b\f\r"
_KEY = ("id", "dg")


def lines_of(text: Column) -> Column:
    """Lines, each with the wordless ones after it; a wordless start is an item of its own."""
    return F.split(text, _NEXT_LINE)


def _id(docs: DataFrame, id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))


def _ranked(pairs: DataFrame, *by: str) -> DataFrame:
    """(by, r): r ascending in the order of the distinct keys, none of which may repeat."""
    return pairs.repartitionByRange(*by).sortWithinPartitions(*by).select(*by, F.monotonically_increasing_id().alias("r"))


def _suffixes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, dg, i, w, r): lines that come twice or more, with words and rank."""
    text = F.col(text_col)
    lines = docs.select(_id(docs, id_col).alias("id"), F.xxhash64(text).alias("dg"), F.posexplode(lines_of(text)).alias("i", "line"))
    lines = lines.select("id", "dg", "i", F.regexp_count("line", F.lit(WORD)).alias("w"), F.btrim("line", F.lit(_BLANKS)).alias("line")).filter("w > 0")
    lines = cut(lines.select("id", "dg", "i", "w", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")))
    apart = [F.min(c) != F.max(c) for c in ("id", "dg", "i")]
    often = lines.groupBy("h1", "h2").agg((apart[0] | apart[1] | apart[2]).alias("often")).filter("often").select("h1", "h2")
    return lines.join(_ranked(often, "h1", "h2"), ["h1", "h2"]).select("id", "dg", "i", "w", "r")


def _runs(suffixes: DataFrame, min_words: int) -> DataFrame:
    """(id, dg, start, names, windows): ranks of each run's lines; windows (b, len) from the start."""
    a = suffixes.repartition(*_KEY).groupBy(*_KEY, "i").agg(F.first("w").alias("w"), F.first("r").alias("r"))
    a = a.withColumn("run", F.col("i") - F.row_number().over(Window.partitionBy(*_KEY).orderBy("i")))
    run = Window.partitionBy(*_KEY, "run")
    a = a.withColumn("c", F.sum("w").over(run.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))).withColumn("s", F.col("c") - F.col("w"))
    a = a.withColumns({"all": F.sum("w").over(run), "start": F.min("i").over(run)}).filter(F.col("all") >= min_words)
    ahead, back = run.orderBy("s").rangeBetween(0, min_words - 1), run.orderBy("c").rangeBetween(1 - min_words, 0)
    a = a.withColumns({"to": F.max("i").over(ahead), "reach": F.max("c").over(ahead), "since": F.min("i").over(back), "before": F.min("s").over(back)})
    window = lambda ok, b, e: F.when(ok >= min_words, F.struct((b - F.col("start")).alias("b"), (e - b + 1).alias("len")))
    fore = window(F.col("reach") - F.col("s"), F.col("i"), F.col("to"))
    rear = window(F.col("c") - F.col("before"), F.col("since"), F.col("i"))
    both = F.array_distinct(F.concat(F.collect_list(fore), F.collect_list(rear)))
    return a.groupBy(*_KEY, "start").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "r"))), lambda x: x["r"]).alias("names"), both.alias("windows"))


def _doubled(runs: DataFrame, k: int) -> DataFrame:
    """Ranks of 2**(k+1) lines from those of 2**k; null where the stretch comes once."""
    step = 1 << k
    names, windows = F.col("names"), F.col("windows")
    pair = lambda j: F.struct(F.get(names, j).alias("a"), F.get(names, j + step).alias("b"), F.when(j == 0, windows).alias("windows"))
    rows = runs.select(*_KEY, "start", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(names) - step - 1), pair)).alias("i", "p")).select(*_KEY, "start", "i", "p.*")
    full, gaps = rows.filter("a is not null and b is not null"), rows.filter("a is null or b is null")
    often = full.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a", "b")
    named = full.join(_ranked(often, "a", "b"), ["a", "b"], "left").select(*_KEY, "start", "i", "r", "windows")
    named = named.unionByName(gaps.select(*_KEY, "start", "i", F.lit(None).cast("long").alias("r"), "windows"))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("i", "r"))), lambda x: x["r"])
    return named.groupBy(*_KEY, "start").agg(in_order.alias("names"), F.first("windows", ignorenulls=True).alias("windows"))


def _intervals(runs: DataFrame, k: int) -> DataFrame:
    """Stretches of 2**k to 2**(k+1)-1 lines by the ranks of their first and last 2**k lines."""
    step = 1 << k
    here = F.filter("windows", lambda x: (x["len"] >= step) & (x["len"] < 2 * step))
    keyed = F.transform(here, lambda x: F.struct(x["b"].alias("b"), x["len"].alias("len"), F.get("names", x["b"]).alias("first"), F.get("names", x["b"] + x["len"] - step).alias("last")))
    return runs.select(*_KEY, "start", F.explode(keyed).alias("x")).filter("x.first is not null and x.last is not null").select(*_KEY, (F.col("start") + F.col("x.b")).alias("i"), "x.len", F.lit(k).alias("k"), "x.first", "x.last")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, dg, s, e): maximal runs of lines s..e-1 of a text that are later copies.

    id: the row's id as a long (null: the least long), dg: 64-bit hash of its
    text. A run counts with min_words words or more. Rows equal in id and text
    are one text.
    """
    runs = cut(_runs(_suffixes(docs, id_col, text_col), min_words))
    longest = runs.agg(F.max(F.array_max(F.transform("windows", lambda x: x["len"])))).first()[0] or 0
    found, k = _intervals(runs, 0), 0
    while (2 << k) <= longest:
        longer = runs.filter(F.exists("windows", lambda x: x["len"] >= (2 << k)))
        runs = cut(_doubled(longer, k))
        k += 1
        found = found.unionByName(_intervals(runs, k))
    at = ("k", "len", "first", "last")
    firsts = found.groupBy(*at).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "dg", "i")).alias("head")).filter("n > 1").drop("n")
    later = found.join(firsts, list(at)).filter(F.struct("id", "dg", "i") > F.col("head")).select(*_KEY, "i", (F.col("i") + F.col("len")).alias("e"))
    order = Window.partitionBy(*_KEY).orderBy("i", "e")
    known = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = later.withColumn("new", F.coalesce((F.col("i") > known).cast("int"), F.lit(1)))
    grouped = fresh.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*_KEY, "run").agg(F.min("i").alias("s"), F.max("e").alias("e")).drop("run")


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with later copies of repeated runs cut from text_col, n_lines and n_removed (long).

    n_lines: lines with a word (null text: 0). The first copy in the order of
    ids, then lines, stays; copies that overlap within one text lose all but the
    first too. A null text stays null, a wordless one as it is; a text that is all
    copies becomes empty. Rows equal in id and text are one text and stay or go
    together; ids are integers. An empty table stays empty. Input columns named
    n_lines or n_removed are replaced, all others kept.
    """
    kept = docs.drop("n_lines", "n_removed")
    at, dg, cuts, left = unused(docs, "id", "dg", "cuts", "left")
    text, gone, n = F.col(text_col), F.col(cuts), F.size(cuts)
    found = repeated_runs(docs.select(id_col, text_col), min_words, id_col, text_col).groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias(cuts))
    keyed = kept.withColumns({at: _id(docs, id_col), dg: F.xxhash64(text)})
    joined = keyed.join(found.withColumnsRenamed({"id": at, "dg": dg}), [at, dg], "left")
    begin = lambda j: F.coalesce(F.get(gone, j - 1)["e"], F.lit(0))
    stays = lambda lines: F.flatten(F.transform(F.sequence(F.lit(0), n), lambda j: F.slice(lines, begin(j) + 1, F.coalesce(F.get(gone, j)["s"], F.size(lines)) - begin(j))))
    rest = F.when(gone.isNull(), text).otherwise(let(lines_of(text), lambda lines: F.array_join(stays(lines), "\n")))
    worded = let(lines_of(text), lambda x: F.size(x) - F.when(F.get(x, 0).rlike(r"[^\x20\x09-\x0D]"), 0).otherwise(1))
    removed = F.aggregate(gone, F.lit(0), lambda a, x: a + x["e"] - x["s"])
    out = joined.withColumns({"n_lines": F.coalesce(worded, F.lit(0)).cast("long"), "n_removed": F.coalesce(removed, F.lit(0)).cast("long"), left: rest})
    return out.select(*[F.col(left).alias(c) if c == text_col else F.col(c) for c in kept.columns], "n_lines", "n_removed")


def op1_suffix_lines(spark, sf_dir: str) -> DataFrame:
    """What every document keeps: its lines, lines cut as later copies, and the digest of the rest."""
    cleaned = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("text_md5"))
