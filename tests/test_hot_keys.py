"""Slicing hot keys changes how the work is spread, never the result."""

import pytest
from pyspark.sql import functions as F

from skytally.operators import frames, history, listing, tracks
from skytally.operators.folds import fold, plausible_track, rate_limit  # noqa: F401
from skytally.operators.ordered import (
    Highest,
    Latest,
    Next,
    Previous,
    RowsAfter,
    Total,
    drop_slices,
    row_numbers,
    scan,
    slice_column,
    split_hot_keys,
)
from skytally.operators.positions import pair_latest

ORDER = ["ts", "event_id"]


@pytest.fixture(scope="module")
def skewed(spark, folder):
    """A third of all rows on one user, the rest as they are."""
    rows = spark.read.parquet(f"{folder}/events.parquet").drop("props")
    return rows.withColumn("user_id", F.expr("CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END")).cache()


@pytest.fixture(scope="module")
def sliced(skewed):
    out = split_hot_keys(skewed, [["user_id"], ["user_id", "event_type"]], ORDER, rows_per_slice=40)
    assert slice_column("user_id") in out.columns
    return out


def same(a, b):
    a, b = drop_slices(a), drop_slices(b)
    assert sorted(a.columns) == sorted(b.columns)
    columns = sorted(a.columns)
    left = sorted(map(repr, a.select(*columns).collect()))
    right = sorted(map(repr, b.select(*columns).collect()))
    assert left == right and left


def test_looking_for_hot_keys_reads_the_rows_once(spark, skewed):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = skewed.select("user_id", "ts", "event_id")
    split_hot_keys(rows.mapInArrow(counted, rows.schema), "user_id", ORDER, rows_per_slice=40, rows=skewed.count())
    assert read.value == skewed.count()


def test_small_tables_are_left_alone(skewed):
    assert split_hot_keys(skewed, "user_id", ORDER).columns == skewed.columns


def largest(rows):
    return rows.groupBy("user_id", slice_column("user_id")).count().agg(F.max("count")).first()[0]


def test_slices_bound_a_group(sliced, skewed):
    assert largest(sliced) <= 80
    assert sliced.where(f"{slice_column('user_id')} > 0").count() > 0 and sliced.where(f"{slice_column('user_id')} = 0").count() > 0
    assert sliced.count() == skewed.count()


BURSTS = {
    "burst": "CASE WHEN id % 20 = 0 THEN timestamp_seconds(id * 60) ELSE timestamp_millis(86400000 + id % 1000) END",
    "instant": "timestamp_seconds(0)",
    "missing": "CASE WHEN id % 10 > 0 THEN timestamp_seconds(id % 977) END",
}


@pytest.mark.parametrize("kind", BURSTS)
def test_bursts_and_missing_times(spark, kind):
    rows = spark.range(6_000).selectExpr("CASE WHEN id % 3 = 0 THEN 1 WHEN id % 50 = 1 THEN NULL ELSE id % 100 END AS user_id", f"{BURSTS[kind]} AS ts",
                                         "id AS event_id", "pmod(xxhash64(id), 7) AS value", "'x' AS event_type")
    cut = split_hot_keys(rows, "user_id", ORDER, rows_per_slice=200)
    assert largest(cut) <= 400
    specs = {"n": row_numbers(), "a": Previous(F.col("value")), "b": Next(F.col("value")), "s": Total(F.col("value")),
             "l": Latest(F.col("value"), F.col("value") > 3), "g": RowsAfter()}
    same(scan(rows, "user_id", ORDER, **specs), scan(cut, "user_id", ORDER, **specs))


def test_keys_without_many_rows_are_left_whole(spark, skewed):
    rows = spark.range(2_000).selectExpr("id % 20 AS user_id", "timestamp_seconds(id) AS ts", "id AS event_id")
    assert split_hot_keys(rows, "user_id", ORDER, rows_per_slice=150).columns == rows.columns
    cut = split_hot_keys(skewed, "user_id", ORDER, rows_per_slice=100)
    assert [r[0] for r in cut.where(f"{slice_column('user_id')} > 0").select("user_id").distinct().collect()] == [-1]


def test_receiver_dedup_on_hot_frames(spark, folder, monkeypatch):
    from skytally.plans import catalog, frame_queries

    plain = catalog.QUERIES["receiver_dedup"](spark, folder)
    raw = frame_queries.raw(spark, folder)
    same_frame = raw.withColumn("frame", F.expr("CASE WHEN frame_id % 3 = 0 THEN '5D4840D6F8A5B1' ELSE frame END"))
    monkeypatch.setattr(frame_queries, "raw", lambda *_: same_frame)
    whole = catalog.QUERIES["receiver_dedup"](spark, folder)
    monkeypatch.setattr(frame_queries, "split_hot_keys", lambda df, keys, order, rows: split_hot_keys(df, keys, order, 60, rows=rows))
    same(whole, catalog.QUERIES["receiver_dedup"](spark, folder))
    monkeypatch.setattr(frame_queries, "raw", lambda *_: raw)
    same(plain, catalog.QUERIES["receiver_dedup"](spark, folder))


def test_slices_serve_one_order(sliced):
    with pytest.raises(ValueError):
        scan(sliced, "user_id", ["ts"], n=row_numbers())


def test_scans(skewed, sliced):
    specs = {"a": Previous(F.col("value")), "b": Next(F.col("value")), "c": Total(F.col("event_id")), "d": Highest(F.col("value")),
             "e": Latest(F.col("value"), F.col("event_type") == "view"),
             "f": Latest(F.expr("CASE WHEN value > 50 THEN value END"), F.col("event_type") == "click"), "g": RowsAfter()}
    same(scan(skewed, "user_id", ORDER, **specs), scan(sliced, "user_id", ORDER, **specs))


OPERATORS = {
    "dedup": lambda df: frames.dedup_within(df, ["user_id", "event_type"], "ts", "12 hours", ORDER),
    "gate": lambda df: frames.confidence_gate(df, "user_id", "ts", 5, "6 hours", ORDER),
    "trusted": lambda df: frames.confidence_gate(df, "user_id", "ts", 5, "6 hours", ORDER, F.col("event_type") == "error"),
    "sessions": lambda df: tracks.sessionize(df, "user_id", "ts", "3 hours", ORDER),
    "lifecycle": lambda df: tracks.lifecycle_events(df, "user_id", "ts", "3 hours", ORDER),
    "as_of": lambda df: tracks.state_as_of(
        tracks.sessionize(df, "user_id", "ts", "3 hours", ORDER), "user_id", ORDER,
        [tracks.overwrite("v", "CASE WHEN value < 90 THEN value END", "event_type = 'view'"),
         tracks.keep_known("p", "value", "event_type = 'purchase'")], "session"),
    "pairs": lambda df: pair_latest(df.withColumn("odd", F.expr("CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 0 END")),
                                    "user_id", "odd", "ts", ["value"], "6 hours", ORDER),
    "history": lambda df: history.change_history(df.withColumn("level", F.expr("floor(value / 50)")), "user_id", ORDER, ["level"], 25),
    "changed": lambda df: listing.changed_only(df.withColumn("value", F.expr("floor(value / 50)")), "user_id", ORDER),
    "rate_limit": lambda df: rate_limit(df, "user_id", "ts", "5 hours", ORDER),
    "rate_limit_forced": lambda df: rate_limit(
        df.withColumns({"may": F.col("event_type") != "view", "must": F.col("event_type") == "error"}),
        "user_id", "ts", "5 hours", ORDER, "may", "must"),
    "plausible": lambda df: plausible_track(
        tracks.sessionize(df, "user_id", "ts", "30 hours", ORDER).withColumns(
            {"lat": F.expr("40 + value / 100 + CASE WHEN event_id % 4 = 0 THEN 6 ELSE 0 END"), "lon": F.expr("15 - value / 120"),
             "speed": F.lit(4.0), "surface": F.expr("event_type = 'signup'")}),
        "user_id", "ts", ORDER, speed="speed", surface="surface", session="session", timeout="60 hours"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_on_hot_key(skewed, sliced, name):
    same(OPERATORS[name](skewed), OPERATORS[name](sliced))


def test_fold_keeps_the_sort_it_is_given(skewed):
    plan = rate_limit(skewed, "user_id", "ts", "5 hours", ORDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Exchange ") == 1


@pytest.mark.parametrize("gap", [0.3, 0.05, 2.0])
def test_regular_arrival_takes_two_passes(spark, monkeypatch, gap):
    from skytally.operators import folds

    monkeypatch.setattr(folds, "_end_states", None)  # the passes that grew with the slices
    rows = spark.range(900).selectExpr("1 AS user_id", f"timestamp_micros(cast(id * {gap} * 1000000 AS bigint)) AS ts", "id AS event_id")
    cut = split_hot_keys(rows, "user_id", ORDER, rows_per_slice=20)
    assert cut.select(slice_column("user_id")).distinct().count() > 30
    same(rate_limit(rows, "user_id", "ts", "1 second", ORDER), rate_limit(cut, "user_id", "ts", "1 second", ORDER))


@pytest.fixture(scope="module")
def hot_frames(skewed):
    from skytally.plans.derive import frames_from_events

    return frames_from_events(skewed.withColumn("user_id", F.expr("CASE WHEN user_id = -1 THEN 77 ELSE user_id END")))


def chain(frames_, rows_per_slice):
    from skytally.operators import aircraft

    messages = aircraft.received_messages(frames_, confidence=5, track_timeout="120 seconds", rows_per_slice=rows_per_slice)
    return messages, aircraft.track_positions(messages, (46.9, 19.7), "60 seconds", "120 seconds")


def test_whole_chain_on_a_hot_address(hot_frames):
    from skytally.operators import aircraft

    plain, sliced_ = chain(hot_frames, None), chain(hot_frames, 60)
    assert "_slice__icao_raw" in sliced_[0].columns
    columns = ["frame_id", "icao_raw", "session", "msg_type", "bds"]
    same(plain[0].select(*columns), sliced_[0].select(*columns))
    same(plain[1], sliced_[1])
    states = [aircraft.current_tracks(aircraft.aircraft_state(m, p)) for m, p in (plain, sliced_)]
    same(*states)


def test_histories_on_a_hot_address(hot_frames):
    from skytally.operators import aircraft

    tracked = [aircraft.tracked_rows(m, p) for m, p in (chain(hot_frames, None), chain(hot_frames, 60))]
    assert "_slice__icao_raw" in tracked[1].columns
    same(*tracked)
    for kind in history.KINDS:
        same(*[getattr(history, f"{kind}_history")(t, aircraft.TRACK, ["ts", "frame_id"]) for t in tracked])


def test_histories_need_only_their_fields(hot_frames):
    from skytally.operators import aircraft

    full = aircraft.received_messages(hot_frames, confidence=5, track_timeout="120 seconds")
    lean = aircraft.received_messages(hot_frames, confidence=5, track_timeout="120 seconds", fields=aircraft.HISTORY_FIELDS).where(
        F.col("msg_type").isin(*aircraft.HISTORY_FIELDS))
    assert "bds" not in lean.columns and lean.select("velocity.*").columns == aircraft.HISTORY_FIELDS["velocity"]
    assert lean.count() < full.count()
    tracked = [aircraft.tracked_rows(m, aircraft.track_positions(m, (46.9, 19.7), "60 seconds", "120 seconds")) for m in (full, lean)]
    for kind in history.KINDS:
        same(*[getattr(history, f"{kind}_history")(t, aircraft.TRACK, ["ts", "frame_id"]) for t in tracked])


def test_hot_addresses_are_looked_for_on_a_drawn_share(spark, hot_frames):
    from skytally.operators import aircraft

    drawn, made = [], spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    def sample(share):
        drawn.append(share)
        return hot_frames.sample(share, seed=7)

    frames_ = hot_frames.mapInArrow(counted, hot_frames.schema).cache()
    aircraft.received_messages(frames_.where("true"), confidence=5, rows_per_slice=10**6, rows=3 * 10**6, sample=sample)
    assert drawn and made.value == 0


def test_histories_take_no_join(hot_frames):
    from skytally.operators import aircraft

    plan = aircraft.tracked_rows(*chain(hot_frames, None))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_compiled_methods_of_the_histories(spark, hot_frames):
    """The JVM leaves a method of more than 8,000 bytes to the interpreter."""
    from skytally.operators import aircraft, stages

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    frames_ = stages.cut_lineage(aircraft.received_messages(hot_frames, confidence=5, fields={}).drop("tc", "msg_type"))
    sizes = []
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the whole plan is made at once
    try:
        messages = aircraft.decode_messages(frames_, fields=aircraft.HISTORY_FIELDS)
        parts = aircraft.track_positions(messages, (46.9, 19.7))._jdf.queryExecution().debug().codegenToSeq().iterator()
        while parts.hasNext():
            sizes.append(parts.next()._3().maxMethodCodeSize())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sizes and max(sizes) <= 8000
