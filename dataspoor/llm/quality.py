"""Quality rules as a short-circuit cascade, on Spark's own functions only.

Each rule rejects by one expression. On a sample of at most SAMPLE_ROWS rows
(thinned by a hash over several partitions; it decides the order of evaluation
and never the verdict) each rule is timed, and which rows it rejects is noted;
rules then run by rejections per second, each judged among the rows that the
rules before it leave, inside one CASE that stops at the first rule that rejects.
"""

from __future__ import annotations

from dataclasses import dataclass
from time import perf_counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let

#: Rows that cost and selectivity are estimated on, and how many partitions they may come from. Verdicts don't depend on it.
SAMPLE_ROWS, SAMPLE_PARTITIONS = 1000, 8
#: Each rule is timed so often; the least time counts.
TIMED = 3


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def word_chars(text: Column) -> Column:
    return F.coalesce(F.char_length(F.translate(text, " \t\n\x0b\f\r", "")), F.lit(0)).cast("long")


def n_symbols(text: Column) -> Column:
    return F.coalesce(F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", "")), F.lit(0)).cast("long")


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.coalesce(let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))), F.lit(0)).cast("long")


def _covered(hashes: Column) -> Column:
    """Words in 5-word windows whose hash comes twice or more: the union of their spans."""

    def spans(starts: Column) -> Column:
        return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(5), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    def starts(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda e, k: (F.get(ordered, k - 1)["h"].eqNullSafe(e["h"])) | (F.get(ordered, k + 1)["h"].eqNullSafe(e["h"])))
        return F.array_sort(F.transform(twice, lambda e: e["i"]))

    paired = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(paired, lambda o: spans(starts(o))))


def n_repeat_words(words: Column) -> Column:
    """words: an array that is at hand as a column or a lambda's variable."""
    window = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)])
    return F.when(F.size(words) < 6, F.lit(0).cast("long")).otherwise(let(F.transform(F.sequence(F.lit(0), F.size(words) - 5), window), _covered).cast("long"))


def n_stutter(words: Column) -> Column:
    """Words equal to the word before them; words as in n_repeat_words."""
    return F.size(F.filter(words, lambda w, k: w == F.get(words, k - 1))).cast("long")


def base_stats(text: Column) -> Column:
    """Struct of the base counts of a whole text and n_stutter; a null text counts as one without words."""
    return let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            word_chars(text).alias("word_chars"),
            n_symbols(text).alias("n_symbols"),
            n_dup_lines(text).alias("n_dup_lines"),
            n_repeat_words(w).alias("n_repeat_words"),
            n_stutter(w).alias("n_stutter"),
        ),
    )


@dataclass(frozen=True)
class Rule:
    """rejects: of the row."""

    name: str
    rejects: Column


def production_rules(text: Column | None = None, stats: Column | None = None) -> list[Rule]:
    """Shares are of whole texts; bounds are loose, so that only plain junk goes.

    text: the column of that name by default; stats: base_stats(text) where it is at hand as a column, so that nothing is
    counted twice.
    """
    text = F.col("text") if text is None else text
    letters = F.char_length(F.regexp_replace(text, r"\P{L}+", ""))
    upper = F.char_length(F.regexp_replace(text, r"\P{Lu}+", ""))
    of = (lambda name, count: count(text)) if stats is None else (lambda name, count: stats[name])
    words, symbols, dups, in_words = of("n_words", n_words), of("n_symbols", n_symbols), of("n_dup_lines", n_dup_lines), of("word_chars", word_chars)
    repeats = let(words_of(text), lambda w: n_repeat_words(w) * 100 > F.size(w) * 20) if stats is None else stats["n_repeat_words"] * 100 > words * 20
    stutter = let(words_of(text), lambda w: n_stutter(w) * 10 > F.size(w) * 3) if stats is None else stats["n_stutter"] * 10 > words * 3
    return [
        Rule("few_words", words < 10),
        Rule("repeats", repeats),
        Rule("stutter", stutter),
        Rule("symbols", symbols * 10 > words),
        Rule("duplicate_lines", dups * 2 > F.coalesce(F.size(F.split(text, "\n")), F.lit(0))),
        Rule("word_length", ~in_words.between(words * 2, words * 16)),
        Rule("few_letters", F.coalesce(letters * 2 < in_words, F.lit(False))),
        Rule("shouting", F.coalesce(upper * 2 > letters, F.lit(False))),
    ]


def sample_of(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Up to `rows` rows, read partition by partition until there are enough, so that few of a large table are read."""
    share = rows / SAMPLE_PARTITIONS / max(1.0, docs.count() / max(1, len(docs.inputFiles())))
    thin = F.shiftrightunsigned(F.xxhash64(*docs.columns), 11) / float(1 << 53) < share
    return docs.sparkSession.createDataFrame(docs.filter(thin).limit(rows).collect(), docs.schema).coalesce(1)


def _seconds(sample: DataFrame, rejects: Column) -> float:
    """Least time of TIMED runs, so that compiling and waiting don't count."""
    took = []
    for _ in range(TIMED):
        began = perf_counter()
        sample.agg(F.count_if(rejects)).collect()
        took.append(perf_counter() - began)
    return min(took)


def plan_order(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejections per second on a sample; without rows they keep their order.

    docs: the columns that the rules read and no others, since the sample holds them all.
    """
    if not rules or not docs.columns:
        return list(rules)
    sample = sample_of(docs, sample_rows).cache()
    try:
        flags = F.struct(*[F.coalesce(r.rejects, F.lit(False)).alias(f"r{k}") for k, r in enumerate(rules)])
        seen = sample.select(flags.alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n")).collect()
        if not seen:
            return list(rules)
        idle = _seconds(sample, F.lit(None).cast("boolean"))
        cost = [max(1e-4, _seconds(sample, r.rejects) - idle) for r in rules]
    finally:
        sample.unpersist()
    return ordered(rules, cost, [(tuple(r["f"]), r["n"]) for r in seen])


def ordered(rules: list[Rule], cost: list[float], seen: list[tuple[tuple[bool, ...], int]]) -> list[Rule]:
    """Greedy: the rule with most rejections per cost among the rows that are left, then the cheapest; seen: (verdicts, rows)."""
    left, alive, out = list(range(len(rules))), list(seen), []
    while left:
        hits = {k: sum(n for f, n in alive if f[k]) for k in left}
        best = max(left, key=lambda k: (hits[k] / cost[k], -cost[k], -k))
        out.append(rules[best])
        left.remove(best)
        alive = [(f, n) for f, n in alive if not f[best]]
    return out


def rejected_by(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does; later rules aren't evaluated."""
    out = None
    for r in rules:
        out = (F if out is None else out).when(F.coalesce(r.rejects, F.lit(False)), F.lit(r.name))
    return F.lit(None).cast("string") if out is None else out.otherwise(F.lit(None).cast("string"))


def quality_cascade(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS, text_col: str = "text") -> DataFrame:
    """docs with `rejected_by` (null: kept), all other columns as they are.

    A null, empty or blank text has no word and goes by few_words. Copies are
    judged alike. An empty table stays empty. An input column named rejected_by
    is replaced. Whether a row is rejected follows from its text alone; which of
    several rules gets the credit follows from the order that the sample gave.
    """
    read = docs.select(text_col) if rules is None else docs
    rules = production_rules(F.col(text_col)) if rules is None else rules
    return docs.withColumn("rejected_by", rejected_by(plan_order(read, rules, sample_rows)))


def op5_quality_cascade(spark, sf_dir: str) -> DataFrame:
    """Base counts, base_failed and the cascade's verdict for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    order = [r.name for r in plan_order(docs.select("text"), production_rules()) if r.name not in ("few_words", "repeats")]
    rules = {r.name: r for r in production_rules(F.col("text"), F.col("b"))}
    counted = docs.withColumn("b", base_stats(F.col("text"))).select("doc_id", "b", rejected_by([rules[n] for n in order]).alias("rule"))
    failed = (F.col("b.n_words") < 10) | (F.col("b.n_repeat_words") * 100 > F.col("b.n_words") * 20)
    return counted.select("doc_id", *[f"b.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], failed.alias("base_failed"), (~failed & F.col("rule").isNull()).alias("kept"))
