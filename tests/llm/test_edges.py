"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from dataspoor.llm import language, licenses, line_dedup, near_dedup, neighbours, packing, pieces, quality, sharding, token_store
from dataspoor.llm.common import new_path

PROSE = "The quick brown fox jumps over the lazy dog while seven other animals look on and say nothing at all about it."
LONG = "\n".join(f"{PROSE} number {k}" for k in range(3000))
ROWS = [
    (None, PROSE, "en"),
    (1, None, None),
    (2, "", "en"),
    (3, " \n\t ", "en"),
    (4, PROSE, "en"),
    (4, PROSE, "en"),
    (5, PROSE, None),
    (6, LONG, "en"),
    (7, "El perro come y la casa es de los gatos que no están aquí con nosotros hoy.", "es"),
    (8, "😀 ▁x  licensed under the MIT Licence \x00 <s>", "en"),
]
SCHEMA = "doc_id long, text string, lang string"
CLASH = ["id", "dg", "n_lines", "n_removed", "rejected_by", "lang_pred", "score", "shard", "slot", "node", "root", "length", "ids", "a", "b", "__id"]


def docs(spark, rows=None):
    return spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)


def wide(spark, rows=None):
    return docs(spark, rows).withColumns({c: F.lit(7) for c in CLASH})


def all_ops():
    byte, word, piece = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))

    def tokens(df):
        path = new_path(df.sparkSession, "tokens")
        token_store.write_tokens(df, path, byte, 2)
        return token_store.read_places(df.sparkSession.read.parquet(path))

    return {
        "line_dedup": line_dedup.remove_repeats,
        "language": lambda df: language.identify(df, language.learn(df)),
        "sharding": lambda df: sharding.assign_shards(df, n_shards=3),
        "quality": quality.quality_cascade,
        "pieces": lambda df: pieces.encode_pieces(df, piece),
        "near_dedup": near_dedup.near_duplicates,
        "token_store": tokens,
        "packing": lambda df: packing.pack_documents(df, word).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")),
        "licenses": licenses.scan_licenses,
    }


def same(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("name", list(all_ops()))
def test_odd_rows_and_clashing_columns(spark, name):
    run = all_ops()[name]
    plain, extra = run(docs(spark)), run(wide(spark))
    rows = plain.collect()
    assert len(rows) == (len({r[0] for r in ROWS}) if name == "packing" else len(ROWS))
    own = [c for c in plain.columns if name != "quality" or c != "rejected_by"]  # which of several rules gets the credit isn't set
    assert same(plain.select(*own).collect()) == same(extra.select(*own).collect())
    kept = [c for c in CLASH if c in extra.columns and c not in plain.columns]
    assert all(r[c] == 7 for r in extra.select(*kept).collect() for c in kept)
    if name in ("line_dedup", "language", "quality"):
        assert set(CLASH) <= {*plain.columns, *extra.columns}


def values(name, spark, column):
    """Values of a column by (doc_id, text)."""
    out: dict = {}
    for r in all_ops()[name](docs(spark)).collect():
        out.setdefault((r.doc_id, r.text) if "text" in r else r.doc_id, set()).add(r[column])
    return out


def test_values_of_odd_rows(spark):
    kept = {k for k, v in values("quality", spark, "rejected_by").items() if v == {None}}
    assert {d for d, _ in kept} == {None, 4, 5, 7}  # 6 repeats itself
    lang = values("language", spark, "lang_pred")
    assert lang[1, None] == lang[2, ""] == lang[3, " \n\t "] == {"und"} and lang[4, PROSE] == {"en"} == lang[6, LONG] and lang[7, ROWS[8][1]] == {"es"}
    removed = values("line_dedup", spark, "n_removed")
    assert all(v == {0} for v in removed.values()) and values("line_dedup", spark, "n_lines")[6, LONG] == {3000}
    component = values("near_dedup", spark, "component_id")
    assert component[4] == component[5] == component[None] == {4} and component[1] == {1} and component[6] == {6}
    assert values("near_dedup", spark, "n_shingles")[1] == values("near_dedup", spark, "n_shingles")[3] == {0}
    tokens = values("token_store", spark, "n_tokens")
    assert tokens[1] == tokens[2] == {1} and values("token_store", spark, "start")[None] == {0}
    pieces_ = values("pieces", spark, "n_pieces")
    assert pieces_[1] == pieces_[2] == {0} and len(pieces_[4]) == 1
    labels = values("licenses", spark, "labels")
    assert labels[8] == {"mit"} and labels[1] == labels[2] == labels[4] == {""}
    size = values("sharding", spark, "size")
    assert size[1] == size[2] == {16} and size[4] == {16 + len(PROSE)}
    assert values("packing", spark, "n")[1] == {1}


def test_long_repeated_lines_go_in_every_later_copy(spark):
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.remove_repeats(docs(spark, [(1, LONG, None), (2, LONG + "\nand one more line", None), (3, None, None)]).withColumn("__id", F.lit(5))).collect()}
    assert got == {1: (3000, 0, LONG), 2: (3001, 3000, "and one more line"), 3: (0, 0, None)}


@pytest.mark.parametrize("name", list(all_ops()))
def test_empty_table(spark, name):
    assert all_ops()[name](docs(spark, [])).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_neighbours_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, None, 1), (8, [0.5, 0.5], 1), (20, [-1.0, 0.0], 1), (None, [1.0, 1.0], 1), (9, [1.0, 2.0, 3.0], 1)]
    got = neighbours.search(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in got if r.query_id == 0] == [(1, 1, 1.0), (2, 2, 1.0), (3, 8, 0.5), (4, 20, -1.0)]
    assert {r.query_id for r in got} == {0, 20}
    wide = vectors(spark, rows).withColumns({c: F.lit(7) for c in ("v", "asks", "ord", "pivot", "side", "part", "top", "query_id", "score")})
    assert neighbours.search(wide, F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect() == got
    assert neighbours.search(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.search(vectors(spark, [(20, [1.0], 1)]), F.col("vec_id") % 20 == 0).count() == 0


def test_pipeline_stages_on_odd_tables(spark):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(d, t, lang, "s", len(t or "")) for d, t, lang in ROWS]
    names = ["rejected_by", "score", "lang_pred", "rejected", "n_lines", "n_removed", "__id", "__kept", "_kept0", "kept", "N_LINES2"]
    for made in (rows, []):
        plain = spark.createDataFrame(made, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            wide = plain.withColumns({c: F.lit(f"own {c}") for c in names})
            out = stage(spark, wide, "")
            assert out.columns == wide.columns
            got = out.collect()
            assert all(r[c] == f"own {c}" for r in got for c in names)
            assert same(out.select(*plain.columns).collect()) == same(stage(spark, plain, "").collect()), name
            assert bool(got) == bool(made)
        last = corpus_pipeline.STAGES[-1][1](spark, plain, "")
        assert last.count() >= len(made) and last.agg(F.sum("length")).first()[0] != 0
