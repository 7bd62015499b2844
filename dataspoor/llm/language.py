"""Language by compression: the language whose dictionary packs a text smallest.

Each language has a raw-content zstandard dictionary made of labelled texts. A
whole text, in lower case, is compressed in blocks of BLOCK bytes, each with
every dictionary; the language with the smallest sum is chosen, among equals the
one with most labelled rows. Where the next one comes within MARGIN of it the
choice is rejected.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .coding import small_batches

#: The sample that dictionaries are made of: so many rows a language, all of which count.
SAMPLE_ROWS = 400
#: Characters that a row may bring: a longer text brings STRETCHES stretches from its start to its end.
SAMPLE_CHARS, STRETCHES = 2048, 8
#: Bytes of a dictionary, dealt among the sample's rows: what short rows leave, long rows share.
DICTIONARY = 192 << 10
#: Rows are thinned to so many times the sample before they are ranked.
THINNED = 4
BLOCK = 8 << 10
LEVEL = 6
#: Share of the second smallest size that the smallest must lie below it.
MARGIN = 0.005
UNKNOWN = "und"
_MODELS: dict = {}


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _stretches(text: Column, chars: int) -> Column:
    """A whole text of up to chars characters; of a longer one stretches dealt evenly from start to end."""
    width, n = chars // STRETCHES, F.char_length(text)
    at = F.transform(F.sequence(F.lit(0), F.lit(STRETCHES - 1)), lambda k: F.substring(text, (k * (n - width) / (STRETCHES - 1)).cast("int") + 1, F.lit(width)))
    return F.when(n <= chars, text).otherwise(F.array_join(at, " "))


def _shares(sizes: list[int], room: int) -> list[int]:
    """How much of room each size gets: all of it if it asks for no more than the rest's even share."""
    out = [0] * len(sizes)
    for left, k in zip(range(len(sizes), 0, -1), sorted(range(len(sizes)), key=sizes.__getitem__)):
        out[k] = min(sizes[k], room // left)
        room -= out[k]
    return out


def _spread(data: bytes, size: int) -> bytes:
    """data, or if it is longer than size, its stretches cut down alike."""
    if len(data) <= size:
        return data
    width, n = size // STRETCHES, len(data)
    return b"".join(data[k * (n - width) // (STRETCHES - 1) :][:width] for k in range(STRETCHES)) if width else data[:size]


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, size: int = DICTIONARY) -> dict[str, bytes]:
    """Dictionary of each non-null lang, most rows first, from a sample chosen by the hash of id and text.

    docs: doc_id, text, lang; hand over the training fold only. rows bounds the
    sample of a language and rows * chars what of it reaches the driver; every
    row of the sample is in the dictionary. Rows without text are left out. The
    model holds one dictionary for each language of the labels.
    """
    some = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    seen = {r["lang"]: r["n"] for r in some.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not seen:
        return {}
    thin = F.create_map(*[F.lit(x) for k, n in seen.items() for x in (k, min(1.0, THINNED * rows / n))])
    key = F.xxhash64("doc_id", "text")
    drawn = some.filter(F.shiftrightunsigned(key, 11) / float(1 << 53) < F.element_at(thin, F.col("lang")))
    drawn = drawn.select("lang", key.alias("key"), F.lower(_stretches(F.col("text"), chars)).alias("text"))
    ranked = drawn.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("key", "text")))
    sample: dict[str, list[bytes]] = {}
    for r in sorted(ranked.filter(F.col("n") <= rows).collect(), key=lambda r: (r["lang"], r["n"])):
        sample.setdefault(r["lang"], []).append(r["text"].encode() + b"\n")
    out = {}
    for lang in sorted(sample, key=lambda k: (-seen[k], k)):
        texts = sample[lang]
        out[lang] = b"".join(_spread(t, n) for t, n in zip(texts, _shares([len(t) for t in texts], size)))
    return out


class Sizer:
    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as zs

        self.langs = list(dictionaries)
        level = zs.ZstdCompressionParameters.from_level(LEVEL)
        self.compress = []
        for k in self.langs:
            d = zs.ZstdCompressionDict(dictionaries[k], dict_type=zs.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=level)
            self.compress.append(zs.ZstdCompressor(dict_data=d, compression_params=level).compress)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, margin): margin 0 to 1; ties go to the first language of the model."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        data = text.lower().encode()
        blocks = [data[k : k + BLOCK] for k in range(0, len(data), BLOCK)]
        sizes = [sum(len(c(b)) for b in blocks) for c in self.compress]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min((s for k, s in enumerate(sizes) if k != best), default=len(data))
        return self.langs[best], max(0.0, min(1.0, 1 - sizes[best] / second))


def _predict(key: str, dictionaries: dict[str, bytes], text_col: str):
    def run(batches):
        import pyarrow as pa

        if key not in _MODELS:
            _MODELS.clear()
            _MODELS[key] = Sizer(dictionaries)
        model = _MODELS[key]
        for b in batches:
            got = [model.predict(t) for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in got], pa.string()), pa.array([y for _, y in got], pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score (the margin, 0 to 1) and rejected (margin too narrow, or `und`).

    A null text, or one without letters, is `und` with score 0 and rejected. With
    no dictionary all are. Input columns of these three names are replaced.
    Equal texts are treated alike; other columns stay.
    """
    small_batches(docs.sparkSession)
    rows = docs.drop("lang_pred", "score", "rejected")
    key = "/".join(f"{k}:{len(v)}:{zlib.crc32(v)}" for k, v in dictionaries.items())
    schema = StructType([*rows.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(_predict(key, dictionaries, text_col), schema).withColumn("rejected", (F.col("score") < margin) | (F.col("lang_pred") == UNKNOWN))


def op2_zstd_language(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs.filter(~held_out(F.col("doc_id"))))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
