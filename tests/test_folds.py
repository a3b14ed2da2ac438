"""Folds against a plain loop."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytally.operators import folds
from skytally.operators.folds import plausible_track, rate_limit
from skytally.operators.ordered import split_hot_keys
from skytally.operators.weather import derived_weather


def test_rate_limit_measures_from_the_last_emitted_row(spark):
    offsets = [0, 400, 900, 1000, 1700, 2100]
    df = spark.createDataFrame([(1, o) for o in offsets], "k int, ms long").withColumn("ts", F.expr("timestamp_millis(ms)"))
    out = rate_limit(df, "k", "ts").where("emit").select("ms").collect()
    assert sorted(r["ms"] for r in out) == [0, 1000, 2100]


def nm(a, b):
    la1, lo1, la2, lo2 = map(math.radians, (*a, *b))
    h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    return 3440.065 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_fifth_rejection_clears_the_position(spark):
    rows = [(0, 45.0)] + [(i, 50.0) for i in range(1, 7)]
    df = spark.createDataFrame([(1, t, la, 10.0) for t, la in rows], "k int, s long, lat double, lon double")
    out = plausible_track(df.withColumn("ts", F.timestamp_seconds("s")), "k", "ts").orderBy("s").collect()
    assert [r["track_lat"] for r in out] == [45.0, 45.0, 45.0, 45.0, 45.0, None, 50.0]
    assert [r["rejections"] for r in out] == [0, 1, 2, 3, 4, 0, 0]


def test_plausible_track_equals_a_loop(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet").selectExpr(
        "user_id", "event_id", "ts", "40 + value / 90 AS lat", "10 + value / 130 AS lon", "cast(event_id % 7 as double) AS speed")
    got = {r["event_id"]: (r["track_lat"], r["accepted"], r["rejections"]) for r in plausible_track(
        events, "user_id", "ts", ["ts", "event_id"], speed="speed", timeout="40 hours").collect()}
    by_user: dict = {}
    for r in events.orderBy("ts", "event_id").collect():
        by_user.setdefault(r["user_id"], []).append(r)
    for rows in by_user.values():
        place = last = None
        rejects = 0
        for r in rows:
            here = (r["lat"], r["lon"])
            ok = place is None
            if not ok:
                dt = (r["ts"] - last).total_seconds()
                ok = dt > 72000 or nm(place, here) <= (dt + 1) * r["speed"] / 3600
            if ok:
                if here != place:
                    last = r["ts"]
                place, rejects = here, 0
            elif rejects >= 4:
                place, rejects, last = None, 0, r["ts"]
            else:
                rejects += 1
            assert got[r["event_id"]] == (place and place[0], ok, rejects)


def test_weather_once_per_second_and_reports_restart_it(spark):
    rows = [(i, i * 400, i == 3) for i in range(8)]
    df = spark.createDataFrame([(1, *r) for r in rows], "k int, i int, ms long, reports boolean").withColumn(
        "ts", F.expr("timestamp_millis(ms)")).selectExpr(
        "*", "false AS on_ground", "90.0D AS true_heading", "95.0D AS track", "cast(400 + i as double) AS tas", "380.0D AS gs",
        "0.7D AS mach", "ts AS dynamics_ts", "ts AS velocity_ts", "NOT reports AS computes", "99 AS report_wind_speed",
        "10.0D AS report_wind_direction", "-50.0D AS report_temperature")
    out = derived_weather(df, "k", "ts", ["ts"]).orderBy("i").collect()
    # 0 ms computed, 1200 ms report, 2400 ms computed: 1000 ms and 1600 ms fall short.
    assert [r["weather_changed"] for r in out] == [True, False, False, True, False, False, True, False]
    assert [r["wind_speed"] == 99 for r in out] == [False, False, False, True, True, True, False, False]


def test_old_inputs_give_no_weather(spark):
    df = spark.sql("""SELECT 1 AS k, timestamp_seconds(100) AS ts, false AS on_ground, 90.0D AS true_heading, 95.0D AS track, 400.0D AS tas,
        380.0D AS gs, 0.7D AS mach, timestamp_seconds(97) AS dynamics_ts, timestamp_seconds(97) AS velocity_ts, true AS computes,
        false AS reports, 0 AS report_wind_speed, 0.0D AS report_wind_direction, 0.0D AS report_temperature""")
    row = derived_weather(df, "k", "ts", ["ts"]).collect()[0]
    assert row["wind_speed"] is None and row["static_temperature"] is None


def one_by_one(columns, state, bypass):
    """The position filter row by row: outputs and the last state."""
    group, place, last, rejects = None, None, None, 0
    if state is not None:
        group, la, lo, last, rejects = state
        place = None if la is None else (la, lo)
    out = []
    for t, la, lo, speed, surface, session in zip(*(columns[c].tolist() for c in ("_t", "_lat", "_lon", "_speed", "_surface", "_session")), strict=True):
        if session != group:
            group, place, last, rejects = session, None, None, 0
        known, ok = la == la, False
        if surface:
            place, ok, last = (la, lo) if known else place, known, t
        elif known:
            limit = 900.0 if speed != speed else speed
            ok = place is None or last is None or t - last > bypass or nm(place, (la, lo)) <= ((t - last) / 1e6 + 1) * limit / 3600
            if ok:
                last, place, rejects = last if place == (la, lo) else t, (la, lo), 0
            elif rejects >= 4:
                place, last, rejects = None, t, 0
            else:
                rejects += 1
        out.append((place, last, ok, rejects))
    return out, (group, *(place or (None, None)), last, rejects)


def drawn(seed, n, sessions=False):
    draw = np.random.default_rng(seed)
    track = draw.integers(0, 2, n)  # two aircraft under one address, each plausible by itself
    lat = 45 + 5 * (track if seed % 3 else 0) + np.cumsum(draw.normal(0, 0.001, n)) + np.where(draw.random(n) < 0.1, 3, 0)
    lat = np.round(lat, 2 if seed % 2 else 6)
    lat[draw.random(n) < 0.15] = np.nan
    return {"_t": np.cumsum(draw.integers(0, 4_000_000, n)), "_lat": lat, "_lon": np.where(np.isnan(lat), np.nan, 10.0), "_speed": np.where(draw.random(n) < 0.3, np.nan, 400.0),
            "_surface": draw.random(n) < (0.1 if seed % 4 == 0 else 0), "_session": np.cumsum(draw.random(n) < 0.02) + 1 if sessions else np.ones(n, np.int64)}


@pytest.mark.parametrize("seed", range(24))
def test_position_filter_in_batches_and_from_summaries(seed):
    columns, bypass = drawn(seed, 400, seed % 5 == 0), 30_000_000
    want, _ = one_by_one(columns, None, bypass)
    state, entered, summaries, cuts = None, None, [], [0, 7, 8, 60, 61, 200, 203, 400]
    got = []
    for low, high in zip(cuts, cuts[1:]):
        part = {c: v[low:high] for c, v in columns.items()}
        told = folds.plausible_through(folds.plausible_transfer(part, bypass), state, bypass)
        out, state = folds.plausible_step(part, state, bypass)
        assert told is folds.UNKNOWN or told == state
        summaries.append(told)
        places = [None if a != a else (a, b) for a, b in zip(out["track_lat"].tolist(), out["track_lon"].tolist())]
        got += list(zip(places, out["position_us"], out["accepted"].tolist(), out["rejections"].tolist()))
    assert got == want
    assert sum(s is folds.UNKNOWN for s in summaries) <= 2


def test_position_filter_takes_two_passes(spark, monkeypatch):
    """Nine slices of one session: one pass of summaries, one that writes, and no slice is run again."""
    passes = []
    for name in ("_transfers", "_end_states"):
        monkeypatch.setattr(folds, name, lambda *a, name=name, run=getattr(folds, name): (passes.append(name), run(*a))[1])
    rows = spark.range(0, 900).selectExpr("1 AS k", "id", "timestamp_seconds(id) AS ts", "45 + id / 100000 + CASE WHEN id % 37 = 0 THEN 2 ELSE 0 END AS lat", "10.0D AS lon")
    cut = plausible_track(split_hot_keys(rows, "k", ["ts", "id"], 100), "k", "ts", ["ts", "id"])
    assert len([c for c in cut.columns if c.startswith("_slice")]) == 1
    whole = plausible_track(rows, "k", "ts", ["ts", "id"])
    columns = ["id", "track_lat", "position_us", "accepted", "rejections"]
    assert sorted(map(tuple, cut.select(*columns).collect())) == sorted(map(tuple, whole.select(*columns).collect()))
    assert passes == ["_transfers"]


def test_position_filter_over_many_groups_at_once():
    """Groups of equal and different session numbers, cut into batches at and within groups."""
    bypass, groups = 30_000_000, [drawn(seed, n, seed % 5 == 0) for seed, n in enumerate((40, 1, 7, 90, 2, 33, 1, 60))]
    want = [row for columns in groups for row in one_by_one(columns, None, bypass)[0]]
    whole = {c: np.concatenate([g[c] for g in groups]) for c in groups[0]}
    begins = np.cumsum([0] + [len(g["_t"]) for g in groups])
    for cuts in ([0, 234], [0, 40, 41, 100, 138, 140, 200, 234], list(range(0, 234, 5)) + [234]):
        got, state = [], None
        for low, high in zip(cuts, cuts[1:]):
            starts = sorted({low, *begins[(begins >= low) & (begins < high)].tolist()})
            out, state = folds.plausible_steps({c: v[low:high] for c, v in whole.items()}, [s - low for s in starts], None if low in begins else state, bypass)
            places = [None if a != a else (a, b) for a, b in zip(out["track_lat"].tolist(), out["track_lon"].tolist())]
            got += list(zip(places, out["position_us"], out["accepted"].tolist(), out["rejections"].tolist()))
        assert got == want


def test_position_filter_is_called_once_per_batch(spark, tmp_path):
    from skytally.operators.folds import Kernel, fold

    rows = spark.range(3000).selectExpr("id % 1000 AS k", "id", "id AS v")
    calls = str(tmp_path)

    def steps(columns, starts, state):
        import uuid
        open(f"{calls}/{uuid.uuid4().hex}", "w").close()
        return {"twice": columns["v"] * 2}, (int(columns["v"][-1]),)

    kernel = Kernel(("v",), "last long", "twice long", None, None, None, steps=steps)
    assert fold(rows, "k", ["id"], kernel).where("twice <> 2 * v").count() == 0
    assert len(list(tmp_path.iterdir())) <= 20


def test_positions_of_many_tracks_together_equal_each_alone():
    """Tracks one after the other, each entered with a state or none, give what the filter gives for each by itself."""
    draw = np.random.default_rng(5)
    for _ in range(40):
        parts, states = [], []
        for session in range(int(draw.integers(1, 7))):
            n = int(draw.integers(1, 30))
            lat = np.where(draw.random(n) < 0.2, np.nan, 45 + draw.integers(0, 3, n) * np.where(draw.random(n) < 0.3, 2.0, 0.001))
            parts.append({"_t": 1_000_000_000 + np.cumsum(draw.integers(0, 4, n)) * 1_000_000, "_lat": lat, "_lon": np.where(np.isnan(lat), np.nan, 10.0),
                          "_speed": np.where(draw.random(n) < 0.5, np.nan, 300.0), "_surface": draw.random(n) < 0.1, "_session": np.full(n, session)})
            states.append([None, (session, 45.0, 10.0, 999_000_000, 2), (session, None, None, 998_000_000, 0), (session - 1, 45.0, 10.0, 999_000_000, 4)][int(draw.integers(4))])
        entry = [[], [], [], []]
        for part, state in zip(parts, states):
            handed = folds._state_in(state, int(part["_session"][0]))
            for column, value, nothing in zip(entry, handed, (np.nan, np.nan, np.nan, 0)):
                column.append(np.full(len(part["_t"]), nothing if value is None else value))
        whole = folds.plausible_sessions({c: np.concatenate([p[c] for p in parts]) for c in parts[0]}, [np.concatenate(c) for c in entry], 60_000_000)
        alone = [folds.plausible_step(p, s, 60_000_000)[0] for p, s in zip(parts, states)]
        for got, name in zip(whole, ("track_lat", "track_lon", "position_us", "accepted", "rejections")):
            want = [x for a in alone for x in np.asarray(a[name], object).tolist()]
            assert [None if x is None or x != x else x for x in want] == [None if x != x or (name == "position_us" and x < 0) else x for x in got.tolist()]
