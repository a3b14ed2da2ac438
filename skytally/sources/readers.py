"""Frames tables from files, batch or stream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME_SCHEMA = ("frame_id long, frame string, ts timestamp, ts12 long, signal double, source string, receiver string")
FORMATS = ("parquet", "orc", "csv", "json")


def _normal(df: DataFrame) -> DataFrame:
    """Upper-case hex without blanks; anything else than 7 or 14 bytes of hex is dropped."""
    text = F.upper(F.trim(F.col("frame")))
    return df.withColumn("frame", text).where(F.col("frame").rlike("^([0-9A-F]{14}|[0-9A-F]{28})$"))


def read_frames(spark: SparkSession, path, fmt: str = "parquet", schema: str = FRAME_SCHEMA) -> DataFrame:
    """Frames from Parquet, ORC, CSV with header or JSON lines; no schema inference."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}")
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return _normal(reader.format(fmt).load(path))


def read_frame_stream(spark: SparkSession, path=None, fmt: str = "parquet", schema: str = FRAME_SCHEMA,
                      max_files_per_trigger: int = 100, options: dict | None = None) -> DataFrame:
    """Endless frames from a folder of files, or from Kafka with JSON values."""
    if fmt == "kafka":
        raw = spark.readStream.format("kafka").options(**(options or {})).load()
        parsed = raw.select(F.from_json(F.col("value").cast("string"), schema).alias("f")).select("f.*")
        return _normal(parsed)
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        reader = reader.option("header", True)
    return _normal(reader.options(**(options or {})).format(fmt).load(path))


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """Rows of several receivers in one table, tagged with their source; nothing is de-duplicated."""
    tagged = [df.withColumn("source", F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
