"""Token ids as Parquet list columns, in ascending document order, readable in parts.

Ids are dictionary-encoded, the metadata columns delta-encoded; row groups and pages have set sizes and page
indexes, so a reader of a few documents or of the metadata alone touches little of a file. Each file knows the
place of its documents within it; the place in the whole corpus is one sum per file away.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skytally.llm.common import lists, pieces, texts_of
from skytally.llm.tokens import encoder_of

SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


def file_options(row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, page_rows: int = 1_000) -> dict[str, str]:
    """Writer settings: delta encoding (format 2) for metadata, dictionaries for ids only, set groups and pages."""
    plain = {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "local_start", "n_tokens")}
    return plain | {
        "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": str(page_rows), "parquet.dictionary.page.size": str(1 << 20), "compression": "zstd",
    }


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = None, options: dict[str, str] | None = None) -> None:
    """Encode whole texts and write their ids in ascending ``doc_id`` order, ``end_id`` after each document.

    Null or empty text gives the end id alone; a null ``doc_id`` comes first; repeated rows are kept, ordered by
    text among equal ids. Other columns of ``docs`` are left behind. An empty table gives files without rows.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(vocabulary)
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def encode(batches):
        encoder, place, part = encoder_of(shipped.value), 0, TaskContext.get().partitionId()
        for batch in pieces(batches):
            ids = [x + end for x in encoder.encode(batch.column("text").to_pylist())]
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            starts = place + np.cumsum(sizes) - sizes
            place += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), pa.array(sizes),
                 lists(np.frombuffer(b"".join(ids), "<i4"), sizes)],
                names=["doc_id", "part", "local_start", "n_tokens", "ids"])

    ordered = texts_of(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, SCHEMA).write.options(**(options or file_options())).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def with_start(tokens: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Adds ``start``, the number of ids of all documents before; sums come from the metadata columns alone."""
    totals = read_tokens(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    return tokens.join(before, "part").withColumn("start", F.col("base") + F.col("local_start")).drop("base", "local_start", "part")


def with_crc32(tokens: DataFrame) -> DataFrame:
    """``ids`` replaced by the unsigned crc32 of them as little-endian unsigned 32-bit integers."""

    def digest(batches):
        for batch in batches:
            ids = batch.column("ids")
            offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "ids"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sums, pa.int64())], names=[*[n for n in batch.schema.names if n != "ids"], "ids_crc32"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tokens.schema if f.name != "ids")
    return tokens.mapInArrow(digest, f"{kept}, ids_crc32 long")


def token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> DataFrame:
    """Write the files, read them back, and describe each document by what was read."""
    write_tokens(docs, path, vocabulary, end_id)
    spark = docs.sparkSession
    return with_start(with_crc32(read_tokens(spark, path)), spark, path)


