"""Token ids as Parquet list columns that can be read in part.

Documents are dealt by ranges of their id and encoded in ascending order, so
the files' order is the documents' order. A file holds `doc_id`, `part`,
`local_start`, `n_tokens` and `ids`; ids get dictionary pages (delta ones where
a dictionary wouldn't pay), the numbers delta pages, row groups and pages are
of set sizes, and page indexes let a reader skip to the rows it asks for.
Reading lengths or places touches no ids.
"""

from __future__ import annotations

import zlib
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .coding import coder, small_batches
from .common import new_path

#: Parquet writer settings: version 2 gives delta pages and page indexes.
WRITER = {
    "compression": "snappy",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
}


def _encoder(path: str, split: str, end_id: int, id_type):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        c, at, end = coder(path, split), 0, np.uint32(end_id).tobytes()
        part = TaskContext.get().partitionId()
        for b, ids in c.encode_batches(batches):
            ids = [x + end for x in ids]
            n = [len(x) // 4 for x in ids]
            starts = list(accumulate(n, initial=at))
            at = starts.pop()
            offsets = np.zeros(len(n) + 1, np.int32)
            np.cumsum(n, out=offsets[1:])
            flat = np.frombuffer(b"".join(ids), np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([part] * len(n), pa.int32()), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                ["doc_id", "part", "local_start", "n_tokens", "ids"],
            )

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, split: str = "lead", id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text (null: empty), append end_id, write Parquet in ascending id order.

    Null ids come first; rows with equal ids are all written, next to each
    other. An empty table writes files without rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    ordered = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id")
    coded = ordered.mapInArrow(_encoder(vocabulary, split, end_id, kind), f"doc_id {kind}, part int, local_start long, n_tokens long, ids array<int>")
    coded.write.options(**WRITER).parquet(path)


def read_places(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens) from the lengths alone; no ids are read."""
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return files.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens")


def read_range(files: DataFrame, first, last) -> DataFrame:
    """ids of the documents first..last, found by row-group statistics and page indexes."""
    return files.filter(F.col("doc_id").between(first, last)).select("doc_id", "ids")


def _crc(batches):
    import numpy as np
    import pyarrow as pa

    for b in batches:
        lists = b.column("ids")
        offsets, flat = lists.offsets.to_numpy(), np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")
        crc = [zlib.crc32(flat[s:e].tobytes()) for s, e in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("local_start"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])


def op8_parquet_tokens(spark, sf_dir: str) -> DataFrame:
    """Write all documents' ids as Parquet, read the files back, and digest each document."""
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    files = spark.read.parquet(path)
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    kind = dict(files.dtypes)["doc_id"]
    digests = files.select("doc_id", "part", "local_start", "ids").mapInArrow(_crc, f"doc_id {kind}, part int, local_start long, n_tokens long, ids_crc32 long")
    return digests.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
