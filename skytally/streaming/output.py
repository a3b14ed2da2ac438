"""Event time, late rows and several outputs from one stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from skytally.operators.folds import interval_micros
from skytally.operators.listing import in_sectors, outline_candidates, range_outline
from skytally.operators.ordered import as_list
from skytally.operators.tracks import enrich
from skytally.sources.registry import latest_release, normalize_registry, read_registry


def with_event_time(df: DataFrame, ts: str = "ts", delay: str = "10 seconds") -> DataFrame:
    """Declare the event-time column; rows later than ``delay`` behind the newest are dropped."""
    typed = df if df.schema[ts].dataType.simpleString() == "timestamp" else df.withColumn(ts, F.col(ts).cast("timestamp"))
    return typed.withWatermark(ts, delay)


def late_rows(query: StreamingQuery) -> int:
    """Rows dropped as late so far, as the query's progress reports them."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])


def split_late(ts: str, delay: str, on_time: Callable[[DataFrame, int], None], late: Callable[[DataFrame, int], None],
               marks: str) -> Callable[[DataFrame, int], None]:
    """Sink that hands rows on to ``on_time`` or, where they are late, to ``late``, so that none is dropped.

    A row is late if it is not newer than the newest row of all earlier micro-batches less ``delay``, which is Spark's own
    rule for a watermark; a null time is on time. The stream itself declares no watermark. ``marks`` is a folder with one row per
    micro-batch (``late_counts``): the newest time so far, the rows, the late ones. A batch reads only the row of the one before
    it, so a repeated batch is split as it was and a restarted stream goes on. One stream a folder, numbered from 0.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = None
        if number:
            before = spark.read.schema(MARKS).parquet(f"{marks.rstrip('/')}/batch={number - 1}").first()["newest_us"]
        us = F.unix_micros(F.col(f"`{ts}`").cast("timestamp"))
        limit = F.lit(None if before is None else before - interval_micros(spark, delay)).cast("long")
        is_late = F.coalesce(us <= limit, F.lit(False))
        newest = F.greatest(F.max(us), F.lit(before).cast("long")).alias("newest_us")
        counts = batch.agg(newest, F.count(F.lit(1)).alias("rows"), F.count_if(is_late).alias("late"))
        batch_table(marks)(counts.coalesce(1), number)
        on_time(batch.where(~is_late), number)
        late(batch.where(is_late), number)

    return write


def trailing_outline(receiver_lat: float, receiver_lon: float, ts: str, sink: Callable[[DataFrame, int], None], kept: str, sector: int = 5,
                     max_nm: float = 300.0, retain: str = "4 hours", lat: str = "lat", lon: str = "lon") -> Callable[[DataFrame, int], None]:
    """Sink that hands on the range outline at the end of every micro-batch, whose time is the newest so far.

    ``kept`` is a folder that has, by micro-batch, the positions that are or may still become the farthest of their sector
    (``outline_candidates``), so an expired one yields its exact successor. A batch reads only what the one before it kept:
    repeated batches give the same, and a restarted stream goes on. Late positions count while they are within ``retain``;
    rows without time are left out. One stream a folder, numbered from 0.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(F.col(f"`{ts}`").cast("timestamp").alias("ts"), *[F.col(f"`{c}`").cast("double").alias(n) for c, n in ((lat, "lat"), (lon, "lon"))])
        if number:
            rows = rows.unionByName(spark.read.schema(KEPT).parquet(f"{kept.rstrip('/')}/batch={number - 1}"))
        newest = rows.agg(F.max("ts").alias("ts"))
        at = F.timestamp_micros(F.lit(newest.select(F.unix_micros("ts")).first()[0]).cast("long"))
        near = in_sectors(rows, receiver_lat, receiver_lon, "ts", at, sector, max_nm, retain)
        # The newest time is kept as a row without position.
        time = newest.select("ts", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))
        batch_table(kept)(outline_candidates(near, "ts").select("ts", "lat", "lon").unionByName(time), number)
        stairs = spark.read.schema(KEPT).parquet(f"{kept.rstrip('/')}/batch={number}")
        sink(range_outline(stairs, receiver_lat, receiver_lon, "ts", at, sector, max_nm, retain), number)

    return write


KEPT = "ts timestamp, lat double, lon double"
MARKS = "newest_us long, rows long, late long"


def late_counts(spark: SparkSession, marks: str) -> DataFrame:
    """Rows and late rows of every micro-batch that ``split_late`` has written marks of."""
    found = spark.read.schema(f"{MARKS}, batch long").parquet(marks)
    return found.select("batch", F.timestamp_micros("newest_us").alias("newest"), "rows", "late")


def session_counts(df: DataFrame, key, ts: str, timeout: str = "60 seconds") -> DataFrame:
    """Tracks as session windows: rows of a key no more than the time-out apart, with their count."""
    window = F.session_window(F.col(ts), timeout)
    out = df.groupBy(*as_list(key), window.alias("w")).agg(F.count(F.lit(1)).alias("total_messages"))
    return out.select(*as_list(key), F.col("w.start").alias("first_seen"), F.col("w.end").alias("expires_at"), "total_messages")


def fan_out(df: DataFrame, sinks: list[Callable[[DataFrame, int], None]]) -> DataStreamWriter:
    """One stream to several sinks: every micro-batch is computed once and handed to each.

    The batch is persisted for the time of its writes; a lost executor's part of it is
    computed again from the source. A sink gets the batch and its number and must accept a
    number it has already seen, since a failed batch is repeated.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for sink in sinks:
                sink(batch, number)
        finally:
            batch.unpersist()

    return df.writeStream.foreachBatch(write)


def batch_table(path: str, fmt: str = "parquet") -> Callable[[DataFrame, int], None]:
    """Sink into a table at ``path`` partitioned by ``batch``. A repeated batch replaces its own rows and changes nothing else,
    so the rows stay as they are when a batch fails half-way or is written twice. One stream a path."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").format(fmt).save(f"{path.rstrip('/')}/batch={number}")

    return write


def newest_registry(spark: SparkSession, folder: str, fmt: str = "parquet") -> DataFrame:
    """The newest release below ``folder``, files or folders named ``<name>_<year>.<quarter>.w<week>_r<revision>.<fmt>``; empty if none.

    Only names are read to choose it. A release must be whole when it gets its name.
    """
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(
        F.regexp_extract("path", rf"^(.*?_\d{{4}}\.[1-4]\.w\d{{2}}_r\d+\.{fmt})(/.*)?$", 1).alias("path"))
    found = latest_release(names.where("path <> ''").distinct(), extension=fmt).select("path").collect()  # one row at most
    if found:
        return read_registry(spark, found[0]["path"], fmt)
    return normalize_registry(spark.range(0).select(F.col("id").cast("string").alias("icao")))


def with_registry(folder: str, sink: Callable[[DataFrame, int], None], key: str = "icao", fmt: str = "parquet") -> Callable[[DataFrame, int], None]:
    """Sink that hands each micro-batch on with the registry's columns, nulls for an unknown address.

    The release is chosen anew for every micro-batch, so a new one takes effect without a restart (a repeated
    batch takes the release that is newest then).
    """

    def write(batch: DataFrame, number: int) -> None:
        sink(enrich(batch, newest_registry(batch.sparkSession, folder, fmt), key), number)

    return write
