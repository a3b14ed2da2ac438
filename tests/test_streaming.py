"""Streams replayed from files give what the batch operators give."""

import os
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytally import streaming
from skytally.operators import aircraft, frames, history, listing, tracks
from skytally.operators.folds import rate_limit
from skytally.plans.derive import FLAT_COLUMNS, RECEIVER, frames_from_events
from skytally.sinks import to_basestation
from skytally.streaming.keyed import use_state_store
from skytally.streaming.lines import gate_marks

ORDER = ["ts", "event_id"]


@pytest.fixture(scope="module")
def source(spark, folder):
    """300 events in time order, as two files read one after the other."""
    use_state_store(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    rows = spark.read.parquet(f"{folder}/events.parquet").drop("props").orderBy("ts").limit(300)
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp")).cache()
    path = tempfile.mkdtemp(prefix="stream-")
    rows.where("event_id < 150").coalesce(1).write.mode("append").parquet(path)
    rows.where("event_id >= 150").coalesce(1).write.mode("append").parquet(path)
    yield rows, lambda: streaming.with_event_time(
        spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path), "ts", "200 hours")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def replay(spark, df, name):
    query = df.writeStream.format("memory").queryName(name).option(
        "checkpointLocation", tempfile.mkdtemp(prefix="check-")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    return spark.table(name)


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    left, right = (sorted(map(repr, x.select(*columns).collect())) for x in (a, b))
    assert left == right and left


def test_dedup(spark, source):
    rows, stream = source
    keys = ["user_id", "event_type"]
    same(replay(spark, streaming.dedup_stream(stream(), keys, "ts", "12 hours", ORDER), "s_dedup"),
         frames.dedup_within(rows, keys, "ts", "12 hours", ORDER))


def test_gate_with_trusted(spark, source):
    rows, stream = source
    marked = stream().withColumn("ok", F.col("event_type") == "error")
    batch = rows.withColumn("ok", F.col("event_type") == "error")
    same(replay(spark, streaming.gate_stream(marked, "user_id", "ts", 5, "24 hours", ORDER, "ok"), "s_gate"),
         frames.confidence_gate(batch, "user_id", "ts", 5, "24 hours", ORDER, F.col("ok")).drop("detections"))


def test_rate_limit(spark, source):
    rows, stream = source
    same(replay(spark, streaming.rate_limit_stream(stream(), "user_id", "ts", "24 hours", ORDER), "s_rate"),
         rate_limit(rows, "user_id", "ts", "24 hours", ORDER).where("emit").drop("emit"))


def test_changed_only(spark, source):
    rows, stream = source
    narrow = ["user_id", "ts", "event_id", "event_type"]
    same(replay(spark, streaming.changed_only_stream(stream().select(*narrow), "user_id", "ts", ORDER), "s_changed"),
         listing.changed_only(rows.select(*narrow), "user_id", ORDER))


def test_lifecycle(spark, source):
    rows, stream = source
    got = replay(spark, streaming.lifecycle_stream(stream(), "user_id", "ts", "6 hours", ORDER), "s_life")
    want = tracks.lifecycle_events(rows, "user_id", "ts", "6 hours", ORDER).selectExpr(
        "user_id", "session", "event", "unix_micros(at) AS at_us")
    same(got.select("user_id", "session", "event", "at_us"), want)


def test_expiry_timer_fires(spark, folder):
    """With a short watermark the silent keys expire by timer, not only at their next row."""
    rows = spark.range(0, 40).selectExpr("CASE WHEN id < 3 THEN 'a' ELSE 'b' END AS k", "timestamp_seconds(1700000000 + id * 30) AS ts")
    path = tempfile.mkdtemp(prefix="expiry-")
    for low in (0, 20, 39):
        rows.where(f"unix_seconds(ts) >= {1700000000 + low * 30} AND unix_seconds(ts) < {1700000000 + {0: 20, 20: 39, 39: 99}[low] * 30}").coalesce(
            1).write.mode("append").parquet(path)
    use_state_store(spark)
    stream = streaming.with_event_time(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path), "ts", "1 second")
    out = replay(spark, streaming.lifecycle_stream(stream, "k", "ts", "60 seconds"), "s_expiry")
    assert out.where("k = 'a' AND event = 'expired'").select("at_us").collect() == [((1700000060 + 60) * 1_000_000,)]


def test_sessions_count_on_after_the_timer(spark):
    """Key ``a`` expires by timer while only ``b`` is heard, then comes back."""
    path = tempfile.mkdtemp(prefix="expiry-")
    for part in ("('a', 0), ('b', 10)", "('b', 300)", "('b', 600)", "('b', 900), ('a', 901)"):
        spark.sql(f"SELECT k, timestamp_seconds(1700000000 + s) AS ts FROM VALUES {part} AS t(k, s)").coalesce(1).write.mode("append").parquet(path)
    use_state_store(spark)
    schema = spark.read.parquet(path).schema
    stream = streaming.with_event_time(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), "ts", "1 second")
    out = replay(spark, streaming.lifecycle_stream(stream, "k", "ts", "60 seconds"), "s_again")
    got = [(r["event"], r["session"], r["at_us"] // 1_000_000 - 1700000000) for r in out.where("k = 'a'").orderBy("at_us").collect()]
    assert got[:3] == [("added", 1, 0), ("expired", 1, 60), ("added", 2, 901)]


def test_session_counts(spark, source):
    rows, stream = source
    out = replay(spark, streaming.session_counts(stream(), "user_id", "ts", "6 hours").where("false OR true"), "s_sessions")
    assert set(out.columns) == {"user_id", "first_seen", "expires_at", "total_messages"}


def test_fan_out_runs_every_sink(spark, source):
    rows, stream = source
    seen: dict = {"a": 0, "b": 0}

    def sink(name):
        def write(batch, number):
            seen[name] += batch.count()
        return write

    query = streaming.fan_out(stream(), [sink("a"), sink("b")]).option(
        "checkpointLocation", tempfile.mkdtemp(prefix="check-")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert seen == {"a": 300, "b": 300}
    assert streaming.late_rows(query) == 0


CHAIN = {"n": 5, "track_timeout": "120 seconds", "pair_age": "60 seconds", "receiver": RECEIVER}


@pytest.fixture(scope="module")
def tracked(spark, folder):
    """All frames and a stream of them in three micro-batches, and the batch's messages and positions."""
    use_state_store(spark)
    rows = frames_from_events(spark.read.parquet(f"{folder}/events.parquet")).withColumn("ts", F.col("ts").cast("timestamp")).cache()
    path = in_pieces(rows, 3)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    messages = aircraft.received_messages(rows, confidence=5, track_timeout="120 seconds").cache()
    yield messages, aircraft.track_positions(messages, RECEIVER, "60 seconds", "120 seconds").cache(), lambda: streaming.with_event_time(
        spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path), "ts", "1 second")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def in_pieces(rows, n):
    """The rows in order of time as ``n`` files, one micro-batch each."""
    path = tempfile.mkdtemp(prefix="frames-")
    low, high = rows.selectExpr("min(unix_micros(ts))", "max(unix_micros(ts))").first()
    for i in range(n):
        rows.where(f"floor({n} * (unix_micros(ts) - {low}) / ({high} - {low} + 1)) = {i}").coalesce(1).write.mode("append").parquet(path)
    return path


def leaves(schema, prefix=""):
    """Every value of nested rows; coordinates to nine digits."""
    out = []
    for f in schema.fields:
        name = f"{prefix}`{f.name}`"
        out += leaves(f.dataType, name + ".") if hasattr(f.dataType, "fields") else [name if f.dataType.simpleString() != "double" else f"round({name}, 9)"]
    return out


def test_state_stream_equals_batch_in_all_sections(spark, tracked):
    messages, positions, stream = tracked
    got = replay(spark, streaming.state_stream(stream(), **CHAIN), "s_state")
    newest = got.groupBy("icao_raw", "session").agg(F.max_by(F.struct(*got.columns), "status.total_messages").alias("s")).select("s.*")
    want = aircraft.aircraft_state(messages, positions)
    assert got.count() > want.count() and newest.schema.simpleString() == want.schema.simpleString()
    for section in want.columns[2:]:
        names = leaves(want.select(section).schema)
        names = ["icao_raw", "session", *names]
        left, right = ({tuple(r[:2]): tuple(r[2:]) for r in d.selectExpr(*[f"{x} AS c{i}" for i, x in enumerate(names)]).collect()} for d in (newest, want))
        assert set(left) == set(right)
        for k in right:
            differ = {n: (a, b) for n, a, b in zip(names[2:], left[k], right[k]) if a != b}
            assert not differ, (section, k, differ)
    assert want.where("position.on_ground AND position.lat IS NOT NULL").count() > 0


def test_track_stream_equals_batch(spark, tracked):
    messages, positions, stream = tracked
    columns = ["icao_raw", "session", "icao", "frame_id", "baro_ft", "geo_ft", "speed_kt", "ground_speed_kt", "vertical_rate", "nac_p", "round(lat, 9) AS lat", "round(lon, 9) AS lon"]
    got = replay(spark, streaming.track_stream(stream(), **CHAIN), "s_track")
    same(got.selectExpr(*columns), aircraft.tracked_rows(messages, positions).selectExpr(*columns))


@pytest.mark.parametrize("kind", ["position", "altitude", "velocity", "state"])
def test_histories_of_a_stream_equal_batch(spark, tracked, kind):
    messages, positions, stream = tracked
    want = getattr(history, f"{kind}_history")(aircraft.tracked_rows(messages, positions), ["icao_raw", "session"], ["ts", "frame_id"])
    got = replay(spark, streaming.track_stream(stream(), history=kind, **CHAIN), f"s_{kind}")
    columns = [f"round({c}, 9) AS {c}" if c in ("lat", "lon") else c for c in want.columns if c != "ts"]
    same(got.selectExpr(*columns), want.selectExpr(*columns))
    with pytest.raises(ValueError):
        streaming.track_stream(stream(), history="other")


def test_text_lines_over_batches(spark, source):
    rows, stream = source
    columns = ["event_id", "ts", "user_id", *FLAT_COLUMNS, "concat('4', lpad(cast(user_id as string), 5, '0')) AS icao"]
    batch = tracks.sessionize(rows, "user_id", "ts", "6 hours", ORDER).selectExpr("session", *columns)
    same(replay(spark, streaming.text_line_stream(stream().selectExpr(*columns), "user_id", "ts", "6 hours", ORDER), "s_lines"),
         to_basestation(batch, "user_id", "ts", ORDER))


def test_gate_marks_do_not_depend_on_the_cut():
    draw = random.Random(2)
    for _ in range(60):
        n = draw.randrange(2, 40)
        t = np.cumsum([draw.choice([0, 1, 5, 30]) for _ in range(n)])
        flags = [np.array([draw.random() < 0.3 for _ in range(n)]) for _ in range(3)]
        whole, end = gate_marks(t, *flags, 10, None)
        cut = draw.randrange(1, n)
        first, state = gate_marks(t[:cut], *(f[:cut] for f in flags), 10, None)
        second, state = gate_marks(t[cut:], *(f[cut:] for f in flags), 10, state)
        assert state == end and all((np.append(first[k], second[k]) == whole[k]).all() for k in whole)


def test_new_registry_release_takes_effect_between_batches(spark):
    base = tempfile.mkdtemp(prefix="registry-")
    out = f"{base}/out"
    tmp = f"{base}/releases"
    os.mkdir(tmp)
    sink = streaming.with_registry(tmp, streaming.batch_table(out))
    batch = spark.sql("SELECT * FROM VALUES ('A1', 1), ('B2', 2), (NULL, 3) AS t(icao, n)")
    release = spark.sql("SELECT 'a1' AS icao, 'N1' AS aircraft_registration")
    sink(batch, 0)
    release.write.parquet(f"{tmp}/base_2024.4.w52_r2.parquet")
    sink(batch, 1)
    release.withColumn("aircraft_registration", F.lit("N2")).write.parquet(f"{tmp}/base_2024.4.w52_r10.parquet")
    sink(batch, 2)
    found = {(r["batch"], r["n"]): r["registration"] for r in spark.read.parquet(out).collect()}
    assert found == {(b, n): None for b in range(3) for n in (1, 2, 3)} | {(1, 1): "N1", (2, 1): "N2"}
    sink(batch, 2)
    assert spark.read.parquet(out).count() == 9  # a repeated batch changes nothing


def test_late_rows_are_kept(spark):
    """Ties with the limit are late, null times are not; a repeated batch and an empty one change nothing."""
    base = tempfile.mkdtemp(prefix="late-")
    sink = streaming.split_late("ts", "10 seconds", streaming.batch_table(f"{base}/on-time"), streaming.batch_table(f"{base}/late"), f"{base}/marks")
    batches = [[1, 100, 50, None], [90, 91, 89, 200], [], [190, 190, 191, None, 5], [300]]
    frames_of = [spark.createDataFrame([(n, s) for s in b], "n int, s long").select("n", F.timestamp_seconds("s").alias("ts")) for n, b in enumerate(batches)]
    for number in (0, 1, 1, 2, 3, 1, 2, 3, 4):  # the batches 1 to 3 are written again
        sink(frames_of[number], number)
    got = {name: sorted((r["n"], r["s"]) for r in spark.read.parquet(f"{base}/{name}").selectExpr("n", "coalesce(unix_seconds(ts), -1) AS s").collect())
           for name in ("on-time", "late")}
    assert got["late"] == [(1, 89), (1, 90), (3, 5), (3, 190), (3, 190)]
    assert got["on-time"] == [(0, -1), (0, 1), (0, 50), (0, 100), (1, 91), (1, 200), (3, -1), (3, 191), (4, 300)]
    counts = streaming.late_counts(spark, f"{base}/marks").orderBy("batch").selectExpr("batch", "unix_seconds(newest) AS newest", "rows", "late").collect()
    assert [tuple(r) for r in counts] == [(0, 100, 4, 0), (1, 200, 4, 2), (2, 200, 0, 0), (3, 200, 5, 3), (4, 300, 1, 0)]


def test_outline_moves_with_the_window(spark):
    """Every batch end gives the batch's outline of all rows so far, with ties, late rows, rows without place or time and an empty batch."""
    draw = random.Random(11)
    base = tempfile.mkdtemp(prefix="outline-")
    sink = streaming.trailing_outline(46.9, 19.7, "ts", streaming.batch_table(f"{base}/out"), f"{base}/kept", retain="30 minutes")
    rows, sent = [], []
    for number in range(5):
        new = [(1_700_000_000 + 900 * number + draw.randrange(-1500, 900), draw.choice([46.0, 46.5, 47.5, 48.0]) + draw.randrange(3) / 10, 19.7 + draw.randrange(-9, 9) / 10)
               for _ in range(0 if number == 3 else 300)]
        rows.append([*new, (None, 50.0, 20.0), (1_700_000_000 + 900 * number, None, None)] if new else [])
    for number in (0, 1, 2, 1, 2, 3, 4):
        batch = spark.createDataFrame(rows[number], "s long, lat double, lon double").select(F.timestamp_seconds("s").alias("ts"), "lat", "lon")
        sink(batch, number)
    for number in range(5):
        sent += rows[number]
        newest = max(s for s, _, _ in sent if s is not None)
        every = spark.createDataFrame(sent, "s long, lat double, lon double").select(F.timestamp_seconds("s").alias("ts"), "lat", "lon")
        want = listing.range_outline(every, 46.9, 19.7, "ts", F.timestamp_seconds(F.lit(newest)), retain="30 minutes")
        got = spark.read.parquet(f"{base}/out/batch={number}")
        columns = ["sector", "nm", "seen_at"]
        same(got.select(*columns), want.select(*columns))
        kept = spark.read.parquet(f"{base}/kept/batch={number}").count()
        assert kept < 300


def test_history_carries_only_its_fields(spark, folder, monkeypatch):
    from skytally.plans.frame_queries import raw
    from skytally.streaming import tracking

    made, processor = [], tracking.TrackProcessor

    def record(fields, *rest):
        made.append(set(fields))
        return processor(fields, *rest)

    monkeypatch.setattr(tracking, "TrackProcessor", record)
    frames = streaming.with_event_time(raw(spark, folder), "ts", "1 second")
    tracking.track_stream(frames, history="altitude")
    tracking.state_stream(frames)
    assert made[0] == {"icao", "callsign", "squawk", *[r.name for r in tracking.HISTORY_RULES]}
    assert made[1] == {r.name for r in tracking.RULES}


@pytest.mark.parametrize("kind", ["all sections", "position", "altitude"])
def test_addresses_share_calls_and_state(spark, tracked, monkeypatch, kind):
    """With one bucket a micro-batch is one keyed call and one row of state, however many addresses it has, and the rows stay the batch's."""
    from skytally.streaming import tracking

    monkeypatch.setattr(tracking, "BUCKETS", 1, raising=False)
    monkeypatch.setattr(tracking, "ROWS_AT_ONCE", 300, raising=False)
    messages, positions, stream = tracked
    out = streaming.state_stream(stream(), **CHAIN) if kind == "all sections" else streaming.track_stream(stream(), history=kind, **CHAIN)
    name = f"s_shared_{kind.replace(' ', '_')}"
    query = out.writeStream.format("memory").queryName(name).option("checkpointLocation", tempfile.mkdtemp(prefix="check-")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert messages.select("icao_raw").distinct().count() > 10
    assert [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]] == [1, 1, 1]
    if kind == "all sections":
        got = spark.table(name)
        got = got.groupBy("icao_raw", "session").agg(F.max_by(F.struct(*got.columns), "status.total_messages").alias("s")).select("s.*")
        want = aircraft.aircraft_state(messages, positions)
        columns = ["icao_raw", "session", *[x for section in want.columns[2:] for x in leaves(want.select(section).schema)]]
    else:
        got, want = spark.table(name), getattr(history, f"{kind}_history")(aircraft.tracked_rows(messages, positions), ["icao_raw", "session"], ["ts", "frame_id"])
        columns = [f"round({c}, 9)" if c in ("lat", "lon") else c for c in want.columns if c != "ts"]
    same(*(d.selectExpr(*[f"{x} AS c{i}" for i, x in enumerate(columns)]) for d in (got, want)))


def test_track_that_ended_leaves_its_number(spark):
    """Addresses of one bucket: of those that fell silent only numbers are kept, in one table, and they count on from them."""
    from types import SimpleNamespace

    from skytally.streaming import tracking

    fields = {r.name: None for r in tracking.RULES}
    kinds = dict.fromkeys(fields, SimpleNamespace(simpleString=lambda: "double"))
    processor = tracking.TrackProcessor(kinds, "messages", {}, 50_000, 5, 30_000_000, 120_000_000, 60_000_000, None)
    seen = SimpleNamespace(watermark=1_000, tables=None, timer=None)
    seen.getCurrentWatermarkMs = lambda: seen.watermark
    seen.update = lambda tables: setattr(seen, "tables", tables)
    seen.setTimeoutTimestamp = lambda at: setattr(seen, "timer", at)

    def table(n, names, **values):
        return {c: np.asarray(values.get(c, np.full(n, None, object) if c == "name" else np.full(n, np.nan))) for c in names}

    tracks = table(3, ["address", "until", *processor.carried], address=[7.0, 8.0, 9.0], until=[900.0, 950.0, 2_000.0], session=[4.0, np.nan, 2.0])
    gates = table(3, ["address", "name", "seen", "last"], address=[7.0, 8.0, 9.0], name=np.array(["Sdr"] * 3, object), seen=[5.0, 1.0, 6.0], last=[0.0] * 3)
    processor.keep([tracks, table(1, ["address", "session"], address=[3.0], session=[1.0]), gates, table(0, ["address", "name", "last"])], seen)
    left, ended, open_gates, _ = (tracking._unpacked(data, names, processor.texts) for data, names in zip(
        seen.tables, (["address", "until", "session"], ["address", "session"], ["address", "name"], ["address"])))
    assert (left["address"].tolist(), left["session"].tolist(), open_gates["address"].tolist(), seen.timer) == ([9.0], [2.0], [9.0], 2_000)
    assert list(zip(ended["address"].tolist(), ended["session"].tolist())) == [(3.0, 1.0), (7.0, 4.0)]
