"""What the operators of this package share: columns, scratch tables and arrow columns."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytally.operators.stages import shared_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` as long, ``text`` as string and the named columns; other columns are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`") for c in more])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, name: str, key: str, **options) -> DataFrame:
    """``stored`` in files by the hash of ``key``, so that groups of it are read without a shuffle; as many buckets as a shuffle has partitions."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    table_name = f"`{path.rsplit('/', 1)[1].replace('-', '_')}`"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.options(path=path, **options).format("parquet").bucketBy(buckets, key).saveAsTable(table_name)
    out = spark.table(table_name)
    spark.sql(f"DROP TABLE {table_name}")  # of the catalog only: the files stay, as those of ``stored``
    return out


def in_fold(modulus: int, remainder: int) -> F.Column:
    """Whether crc32 of ``doc_id`` as text has this remainder; a null ``doc_id`` counts as empty text."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % modulus == remainder


def pieces(batches, size: int = 1_500_000, column: str = "text"):
    """Arrow batches cut where the text column passes ``size`` bytes, so that memory does not follow the batch size."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


_KEPT: dict = {}


def kept(key, make):
    """What a task needs and later tasks of the same Python worker will need again; only the last such thing is kept."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def lists(values: np.ndarray, lengths, kind: pa.DataType | None = None) -> pa.ListArray:
    """List column from the concatenated values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
