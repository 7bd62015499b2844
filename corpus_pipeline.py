"""Corpus pipeline: quality, language, repeated lines, near duplicates, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns what its stage keeps, with the columns of documents but for the last.
run() writes each stage's rows as Parquet in the shared folder and reads them
again, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataspoor.llm.common import new_path, unused
from dataspoor.llm.language import held_out, identify, learn
from dataspoor.llm.line_dedup import remove_repeats
from dataspoor.llm.near_dedup import near_duplicates
from dataspoor.llm.packing import pack_documents
from dataspoor.llm.quality import quality_cascade

#: Columns that the operators read; all others pass through a stage under names that no operator uses.
READ = ("doc_id", "text", "lang", "n_chars")


def apart(docs: DataFrame) -> tuple[DataFrame, list]:
    """docs with every column but READ renamed, and the columns that give the old names back."""
    others = [c for c in docs.columns if c not in READ]
    named = dict(zip(others, unused(docs, *[f"kept{k}" for k in range(len(others))])))
    return docs.withColumnsRenamed(named), [F.col(named.get(c, c)).alias(c) for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the cascade rejects."""
    rows, back = apart(docs)
    return quality_cascade(rows).filter(F.col("rejected_by").isNull()).select(*back)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found by more than the margin."""
    rows, back = apart(docs)
    model = learn(rows.filter(~held_out(F.col("doc_id"))))
    return identify(rows, model).filter(~F.col("rejected")).select(*back)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated runs; documents that were nothing else go."""
    rows, back = apart(docs)
    left = remove_repeats(rows).filter((F.col("n_lines") == 0) | (F.col("n_removed") < F.col("n_lines")))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return left.select(*back)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    (key,) = unused(docs, "kept")
    kept = near_duplicates(docs.select("doc_id", "text")).filter("kept").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(key)), "left_semi").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("language", language), ("lines", lines), ("near", near), ("packing", packing)]

#: zstandard sizes and tokenizer ids can't be had from SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
