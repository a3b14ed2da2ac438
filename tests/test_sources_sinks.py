"""Captures, registry, exports and argument checks."""

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from skytally.operators import aircraft, history, listing
from skytally.plans.derive import frames_from_events, registry_from_customers
from skytally.sinks import to_ndjson, to_wire, write_history
from skytally.sources import check_registry, latest_release, read_captures, read_frames, read_registry
from skytally.sources.captures import parse_capture
from skytally.sources.registry import normalize_registry


@pytest.fixture(scope="module")
def frames(spark, folder):
    return frames_from_events(spark.read.parquet(f"{folder}/events.parquet"))


def test_wire_round_trip_through_a_capture_file(spark, frames):
    rows = to_wire(frames).orderBy("ts", "frame_id").collect()
    data = b"junk" + b"".join(bytes(r["wire"]) for r in rows[:500]) + b"\x1a\xe3" + bytes(8) + b"".join(bytes(r["wire"]) for r in rows[500:])
    folder = tempfile.mkdtemp(prefix="capture-")
    with open(f"{folder}/north.bin", "wb") as f:
        f.write(data)
    back = read_captures(spark, f"{folder}/*.bin", "2024-01-01 00:00:00").orderBy("position").collect()
    assert [(r["frame"], r["ts12"]) for r in back] == [(r["frame"], r["ts12"]) for r in rows]
    assert {r["receiver"] for r in back} == {"north.bin"}
    assert all(abs(a["signal"] - b["signal"]) < 1.1 for a, b in zip(back, rows))


def test_escaped_bytes_are_undone():
    frame = bytes.fromhex("1A1A001A5500FF")
    body = bytes([0x1A, 0, 0, 0, 0, 1]) + bytes([0x1A]) + frame
    record = b"\x1a2" + body.replace(b"\x1a", b"\x1a\x1a")
    assert [(f, t) for _, f, t, _ in parse_capture(b"\x00\x1a\x99" + record)] == [("1A1A001A5500FF", 0x1A0000000001)]


def test_truncated_record_is_left_out():
    whole = b"\x1a2" + bytes(14)
    assert len(list(parse_capture(whole + whole[:9]))) == 1


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json", "orc"])
def test_read_frames(spark, frames, fmt):
    path = tempfile.mkdtemp(prefix="frames-") + "/t"
    rows = frames.limit(50).withColumn("frame", F.lower("frame")).withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.option("header", True).format(fmt).save(path)
    out = read_frames(spark, path, fmt)
    assert out.count() == 50 and out.where("frame <> upper(frame)").count() == 0


def test_registry_reader(spark):
    path = tempfile.mkdtemp(prefix="registry-") + "/r"
    spark.sql("SELECT 'a1b2c3' AS icao, 'N1' AS aircraft_registration, 1 AS military, 0 AS faa_pia, cast(null as int) AS faa_ladd").write.parquet(path)
    row = read_registry(spark, path).collect()[0]
    assert (row["icao"], row["registration"], row["military"], row["pia"], row["ladd"], row["model"]) == ("A1B2C3", "N1", True, False, None, None)
    assert len(normalize_registry(spark.read.parquet(path)).columns) == 13


def test_release_choice_ignores_other_names(spark):
    names = ["x/base_2024.4.w52_r9.sqlite", "base_2025.1.w01_r2.sqlite", "base_2025.1.w01_r10.sqlite", "base_2025.5.w01_r1.sqlite", "notes.txt"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    assert latest_release(df).collect()[0]["path"] == "base_2025.1.w01_r10.sqlite"
    assert latest_release(df.where("path = 'notes.txt'")).count() == 0
    assert check_registry(df, 5).collect()[0]["matches"]


@pytest.fixture(scope="module")
def state(spark, frames, folder):
    messages = aircraft.received_messages(frames, confidence=5)
    positions = aircraft.track_positions(messages, (46.9, 19.7), "60 seconds", "120 seconds")
    out = aircraft.current_tracks(aircraft.aircraft_state(messages, positions))
    registry = registry_from_customers(spark.read.parquet(f"{folder}/customer.parquet"))
    out = out.join(registry.select("icao", F.struct("registration", "military").alias("database_record")), "icao", "left")
    return out.cache()


def test_json_lines_have_all_sections(state):
    row = json.loads(to_ndjson(state).limit(1).collect()[0]["json"])
    assert list(row) == ["Timestamp", "Identification", "DatabaseRecord", "Status", "Position", "VelocityAndDynamics", "Autopilot",
                         "Meteorology", "Acas", "Capabilities", "DataQuality"]
    assert "Squawk" in row["Identification"]  # nulls are kept


def test_list_has_23_fields_with_a_two_column_coordinate(state):
    flat = listing.aircraft_list(state)
    assert len(flat.columns) == 24 and flat.count() == state.count()


def test_detail_sections(state):
    icao = state.select("icao").orderBy("icao").limit(1).collect()[0][0]
    assert listing.detail(state, icao.lower()).columns == ["icao", *listing.SECTIONS]
    out = listing.detail(state, icao, "status, VelocityAndDynamics")
    assert out.columns == ["icao", "status", "velocity_and_dynamics"] and out.count() == 1
    with pytest.raises(ValueError):
        listing.detail(state, icao, "History")
    with pytest.raises(ValueError):
        listing.detail(state, "12345G")


@pytest.mark.parametrize("bounds", [(10, 0, 5, 1), (-91, 0, 1, 1), (0, -181, 1, 1), (0, 0, 91, 1), ("a", 0, 1, 1)])
def test_bad_bounds(state, bounds):
    with pytest.raises(ValueError):
        listing.within_bounds(state, *bounds)


def test_bounds_and_search_exclude_each_other(state):
    with pytest.raises(ValueError):
        listing.search(state, "x", bounds=(0, 0, 1, 1))


@pytest.mark.parametrize("arguments", [{"limit": 0}, {"limit": -1}, {"limit": "x"}, {"kind": "state", "after": -1},
                                       {"kind": "state", "after": "x"}, {"after": 3}, {"kind": "speed"}])
def test_bad_history_arguments(state, arguments):
    with pytest.raises(ValueError):
        history.history_page(state, "icao", ["seq"], **arguments)


def test_identification_only_track_has_no_history(spark):
    rows = spark.sql("SELECT 1 AS k, timestamp_seconds(1) AS ts, cast(null as double) AS lat, cast(null as double) AS lon, cast(null as int) AS nac_p")
    assert history.position_history(rows, "k", ["ts"]).count() == 0


def test_history_numbers_survive_the_cap(spark):
    rows = spark.range(30).selectExpr("1 AS k", "timestamp_seconds(id) AS ts", "id % 7 AS v")
    out = history.change_history(rows, "k", ["ts"], ["v"], 5).orderBy("seq").collect()
    assert [r["seq"] for r in out] == [26, 27, 28, 29, 30]


def test_history_tables_prune_by_date(spark, frames):
    path = tempfile.mkdtemp(prefix="history-") + "/h"
    write_history(frames.withColumn("kind", F.lit("position")), path)
    plan = spark.read.parquet(path).where("date = '2024-01-01' AND kind = 'position'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
