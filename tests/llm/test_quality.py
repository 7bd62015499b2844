"""Quality counts against plain Python; the cascade's order never changes its verdict."""

import random
import re

from pyspark.sql import functions as F

from dataspoor.llm import quality as q


def base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    spots: dict = {}
    for k in range(len(w) - 4):
        spots.setdefault(tuple(w[k : k + 5]), []).append(k)
    stutter = sum(a == b for a, b in zip(w, w[1:]))
    hit = {p + j for v in spots.values() if len(v) > 1 for p in v for j in range(5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), stutter)


def texts():
    r = random.Random(3)
    made = [" ".join(r.choice("a b c dd e# f* 😀 é".split()) for _ in range(r.randrange(0, 60))) for _ in range(150)]
    return [*made, None, "", "\n\n", "a\nb\na\n a\na", "x " * 3000, "SHOUTING WORDS ARE LOUD AND THEY GO ON FOR A WHILE NOW YES"]


def test_base_counts(spark):
    rows = list(enumerate(texts()))
    got = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", q.base_stats(F.col("text")).alias("b")).select("doc_id", "b.*").collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == {d: base(t) for d, t in rows}


def test_order_by_rejections_per_second_keeps_the_verdict(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    rules = q.production_rules()
    planned = q.plan_order(df, rules)
    assert {r.name for r in planned} == {r.name for r in rules}
    forth = {r.doc_id for r in df.filter(q.rejected_by(rules).isNull()).select("doc_id").collect()}
    back = {r.doc_id for r in df.filter(q.rejected_by(planned[::-1]).isNull()).select("doc_id").collect()}
    assert forth == back == {r.doc_id for r in q.quality_cascade(df).filter("rejected_by is null").select("doc_id").collect()}


def test_order_follows_measured_costs(spark):
    df = spark.createDataFrame([(k, "some words to read " * 400) for k in range(400)], "doc_id long, text string")
    dear = F.length(F.regexp_replace("text", "(s|w|r)(.?)(e|d)", "$3$1")) > 0
    rules = [q.Rule("never", F.lit(False)), q.Rule("dear", dear), q.Rule("cheap", F.length("text") > 0)]
    assert [r.name for r in q.plan_order(df, rules)] == ["cheap", "dear", "never"] or [r.name for r in q.plan_order(df, rules)] == ["cheap", "never", "dear"]
    seen = [((True, False, False), 10), ((True, True, False), 50), ((False, False, True), 30)]
    assert [r.name for r in q.ordered([q.Rule(x, F.lit(x)) for x in "abc"], [4.0, 1.0, 1.0], seen)] == ["b", "c", "a"]


def test_the_sample_is_small_and_spread(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(40_000).selectExpr("id", "concat('text ', id) AS text").repartition(16).write.parquet(path)
    got = q.sample_of(spark.read.parquet(path).select("text"), 800)
    assert 400 < got.count() <= 800
