"""The corpus pipeline, stage by stage, on a small corpus with planted cases."""

import random

import corpus_pipeline
import pytest


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    r = random.Random(1)
    en = "the of and to in that is was for it with as his on be at by had not are but from or have an they which one you were".split()
    es = "el la de que y en un ser se no haber por con su para como estar tener le lo todo pero más hacer o poder decir este ir".split()
    prose = lambda words, n: "\n".join(" ".join(r.choice(words) + r.choice(["a", "er", "ing", "o", ""]) for _ in range(12)) + "." for _ in range(n))
    rows = [(k, prose(en if k % 2 else es, 12), "en" if k % 2 else "es") for k in range(60)]
    copy, passage = prose(en, 12), " ".join(r.choice(en) + str(r.randrange(50)) for _ in range(60))
    near = copy.split("\n")
    rows += [(100, copy, "en"), (101, copy, "en"), (102, prose(en, 8) + "\n" + passage, "en"), (103, prose(en, 8) + "\n" + passage, "en"), (104, "#### ||| $$$ %%% &&& <<<", None), (105, None, None), (106, " ".join(["again and again and"] * 40), "en")]
    one = " ".join(r.choice(en) + str(r.randrange(99)) for _ in range(200))
    rows += [(110, one, "en"), (111, one.replace(" ", "  ", 1) + " tail", "en"), (112, "\n".join([*near[:6], prose(en, 6)]), "en")]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(d, t, lang, f"s{d % 3}", len(t) if t else None) for d, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "packing":
            assert docs.columns == columns
    assert not {104, 105, 106} & set(seen["quality"])
    assert 101 not in seen["lines"] and 100 in seen["lines"]
    passage = seen["language"][102].text.split("\n")[-1]
    assert passage in seen["lines"][102].text and passage not in seen["lines"][103].text
    assert seen["lines"][103].n_chars == len(seen["lines"][103].text)
    assert 110 in seen["near"] and 111 not in seen["near"]
    assert len(seen["near"]) >= 58
    assert set(seen["packing"]) == set(seen["near"])
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == set(seen["packing"])
