"""Streaming operators replayed over the events file; the check SQL is the batch operator's."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

from skytally import streaming
from skytally.operators.stages import shared_folder
from skytally.plans.catalog import ORACLES, query, table
from skytally.plans.event_queries import _ADDRESSED_SQL, _ICAO, _ICAO_SQL, _LEVEL, LOCATED_SQL, bearing_sql, located, nm_sql, public_registry
from skytally.streaming.keyed import STATE_STORE

ORDER = ["ts", "event_id"]
STORE_KEY = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS_KEY = "spark.sql.shuffle.partitions"


@contextmanager
def settings(spark):
    """The state store that keyed streams need, and one of them per slot: partitions are kept for the life of a stream."""
    before = {k: spark.conf.get(k, None) for k in (STORE_KEY, PARTITIONS_KEY)}
    spark.conf.set(STORE_KEY, STATE_STORE)
    spark.conf.set(PARTITIONS_KEY, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def replay(spark, folder, transform, files_per_trigger: int = 8):
    """Run a stream over the events to its end into a table in the shared folder."""
    with settings(spark):
        return finished(transform(streaming.with_event_time(event_stream(spark, folder, files_per_trigger), "ts", "1 day")))


def event_stream(spark, folder, files_per_trigger: int = 8):
    schema = table(spark, folder, "events").schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
        .option("maxFilesPerTrigger", files_per_trigger).parquet(folder).drop("props")
    )


def finished(out):
    """Run a stream to the end of what is there now, into a table in the shared folder."""
    spark = out.sparkSession
    base = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    run = out.writeStream.format("parquet").option("path", f"{base}/out").option(
        "checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


@query("stream_rate_limit", ORACLES["rate_limit"])
def stream_rate_query(spark, folder):
    out = replay(spark, folder, lambda df: streaming.rate_limit_stream(df, "user_id", "ts", "24 hours", ORDER))
    return out.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("stream_dedup", ORACLES["dedup_within"])
def stream_dedup_query(spark, folder):
    keys = ["user_id", "event_type"]
    out = replay(spark, folder, lambda df: streaming.dedup_stream(df, keys, "ts", "12 hours", ORDER))
    return out.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), *keys)


@query("stream_changed_only", ORACLES["changed_only"])
def stream_changed_query(spark, folder):
    def changed(df):
        return streaming.changed_only_stream(df.withColumn("level", F.expr(_LEVEL)).drop("value"), "user_id", "ts", ORDER)

    return replay(spark, folder, changed).select("event_id", "user_id", "event_type", "level")


@query("stream_gate", f"SELECT event_id, user_id, ts FROM ({ORACLES['confidence_gate']})")
def stream_gate_query(spark, folder):
    out = replay(spark, folder, lambda df: streaming.gate_stream(df, "user_id", "ts", 5, "24 hours", ORDER))
    return out.select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("stream_lifecycle", f"SELECT user_id, session, event, \"at\" FROM ({ORACLES['lifecycle_events']}) WHERE event <> 'expired'")
def stream_lifecycle_query(spark, folder):
    """Beginnings and updates; when a track's end is told depends on the watermark."""
    out = replay(spark, folder, lambda df: streaming.lifecycle_stream(df, "user_id", "ts", "6 hours", ORDER))
    at = F.timestamp_micros("at_us").cast("timestamp_ntz").alias("at")
    return out.where("event <> 'expired'").select("user_id", "session", "event", at)


@query("stream_enrich", f"""WITH {_ADDRESSED_SQL} SELECT event_id, e.icao, registration, operator_name, military
    FROM (SELECT event_id, {_ICAO_SQL} AS icao FROM events) e LEFT JOIN reg ON e.icao = reg.icao""")
def stream_enrich_query(spark, folder):
    """Every event with the newest of two registry releases, in a table that repeated batches do not change."""
    base = f"{shared_folder(spark)}/enrich-{uuid.uuid4().hex}"
    released = public_registry(spark, folder).selectExpr("icao", "registration AS aircraft_registration", "operator_name", "cast(military AS int) AS military")
    released.withColumn("operator_name", F.lit("old")).write.parquet(f"{base}/releases/base_2024.4.w52_r9.parquet")
    released.write.parquet(f"{base}/releases/base_2025.1.w01_r1.parquet")
    sink = streaming.with_registry(f"{base}/releases", streaming.batch_table(f"{base}/out"))
    rows = event_stream(spark, folder).select("event_id", F.expr(_ICAO).alias("icao"))
    streaming.fan_out(rows, [sink]).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select("event_id", "icao", "registration", "operator_name", "military")


#: Events reach the stream up to six days after their time, in four deliveries of nine days.
_DELIVERY = "least(3, (unix_micros(cast(ts AS timestamp)) + event_id % 7 * 86400000000 - 1704067200000000) div 777600000000)"
_DELIVERED_SQL = """d AS (SELECT event_id, user_id, ts, least(3, (epoch_us(ts) + event_id % 7 * 86400000000 - 1704067200000000) // 777600000000) AS batch FROM events),
    b AS (SELECT batch, max(ts) AS newest, count(*) AS n FROM d GROUP BY batch),
    m AS (SELECT batch, max(newest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
        max(newest) OVER (ORDER BY batch) AS newest, n FROM b),
    l AS (SELECT d.*, coalesce(ts <= before - INTERVAL 2 DAY, false) AS late FROM d JOIN m USING (batch))"""


def delivered(spark, folder, rows, sinks):
    """A stream of the events that is started anew for each delivery; ``sinks`` takes the folder for its tables, which is returned."""
    base = f"{shared_folder(spark)}/delivered-{uuid.uuid4().hex}"
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    for delivery in range(4):
        rows.where(F.expr(_DELIVERY) == delivery).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        streaming.fan_out(stream, sinks(base)).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return base


def late_replay(spark, folder):
    """Folder of a stream's rows on time, its late rows and its marks."""
    def sinks(base):
        return [streaming.split_late("ts", "2 days", streaming.batch_table(f"{base}/on-time"), streaming.batch_table(f"{base}/late"), f"{base}/marks")]

    return delivered(spark, folder, table(spark, folder, "events").select("event_id", "user_id", "ts"), sinks)


@query("stream_late_rows", f"WITH {_DELIVERED_SQL} SELECT event_id, user_id, ts, late FROM l")
def stream_late_query(spark, folder):
    """Both outputs of the split: no row is dropped."""
    base = late_replay(spark, folder)
    out = [spark.read.parquet(f"{base}/{name}").withColumn("late", F.lit(name == "late")) for name in ("on-time", "late")]
    return out[0].unionByName(out[1]).select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "late")


@query("stream_late_counts", f"""WITH {_DELIVERED_SQL}
    SELECT batch, newest, n AS "rows", (SELECT count(*) FROM l WHERE late AND l.batch = m.batch) AS late FROM m""")
def stream_late_counts_query(spark, folder):
    """Rows and late rows of every micro-batch."""
    return streaming.late_counts(spark, f"{late_replay(spark, folder)}/marks").withColumn("newest", F.col("newest").cast("timestamp_ntz"))


@query("stream_outline", f"""WITH {_DELIVERED_SQL}, {LOCATED_SQL}, ends AS (SELECT batch, newest FROM m),
    p AS (SELECT ends.batch, loc.ts, lat, lon, {nm_sql(43.0, 16.0, 'lat', 'lon')} AS nm, {bearing_sql(43.0, 16.0, 'lat', 'lon')} AS brg
      FROM ends JOIN d ON d.batch <= ends.batch JOIN loc USING (event_id) WHERE loc.ts <= newest AND loc.ts >= newest - INTERVAL 96 HOUR),
    k AS (SELECT *, CAST(floor(brg / 5) % 72 AS INT) AS sector FROM p WHERE nm <= 300),
    f AS (SELECT *, row_number() OVER (PARTITION BY batch, sector ORDER BY nm DESC, ts) AS rn FROM k)
    SELECT batch, sector, lat, lon, round(nm, 6) AS nm, ts AS seen_at FROM f WHERE rn = 1 QUALIFY count(*) OVER (PARTITION BY batch) >= 3""")
def stream_outline_query(spark, folder):
    """The outline at the end of every micro-batch."""
    def sinks(base):
        return [streaming.trailing_outline(43.0, 16.0, "ts", streaming.batch_table(f"{base}/out"), f"{base}/kept", retain="96 hours")]

    rows = located(table(spark, folder, "events")).select("event_id", "ts", "lat", "lon")
    out = spark.read.parquet(f"{delivered(spark, folder, rows, sinks)}/out")
    return out.select(F.col("batch").cast("long").alias("batch"), "sector", "lat", "lon", F.round("nm", 6).alias("nm"), F.col("seen_at").cast("timestamp_ntz").alias("seen_at"))
