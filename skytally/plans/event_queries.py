"""Operators run on the events table: users as aircraft, event types as message kinds, hours as seconds."""

from __future__ import annotations

from pyspark.sql import functions as F

from skytally import functions as fn
from skytally.operators import frames, history, listing, tracks
from skytally.operators.folds import plausible_track, rate_limit
from skytally.operators.positions import pair_latest
from skytally.plans.catalog import events, query, table
from skytally.plans.derive import RECEIVER, REGISTRY_SQL, registry_from_customers
from skytally.sources import check_registry, latest_release, union_sources

ORDER = ["ts", "event_id"]
USER = ["user_id"]
AT = "timestamp_ntz '2024-01-20 12:00:00'"
AT_SQL = "TIMESTAMP '2024-01-20 12:00:00'"
W = "PARTITION BY user_id ORDER BY ts, event_id"
#: Positions made of integers, so that both engines hold the same doubles.
LAT = "(cast(400000 + (user_id % 50) * 1000 + cast(round(value * 100) as bigint) as double) / 10000)"
LON = "(cast(150000 + (user_id % 40) * 1000 - cast(round(value * 100) as bigint) as double) / 10000)"


def located(df):
    return df.withColumns({"lat": F.expr(LAT), "lon": F.expr(LON)})


LOCATED_SQL = f"loc AS (SELECT *, {LAT} AS lat, {LON} AS lon FROM events)"


def angle_sql(lat1, lon1, lat2, lon2):
    a = (f"pow(sin((({lat2}) - ({lat1})) * pi() / 180 / 2), 2) + cos(({lat1}) * pi() / 180) * cos(({lat2}) * pi() / 180) "
         f"* pow(sin((({lon2}) - ({lon1})) * pi() / 180 / 2), 2)")
    return f"(2 * atan2(sqrt({a}), sqrt(1 - ({a}))))"


def nm_sql(lat1, lon1, lat2, lon2):
    return f"(3440.065 * {angle_sql(lat1, lon1, lat2, lon2)})"


def bearing_sql(lat1, lon1, lat2, lon2):
    la1, la2, dl = f"(({lat1}) * pi() / 180)", f"(({lat2}) * pi() / 180)", f"((({lon2}) - ({lon1})) * pi() / 180)"
    return (f"fmod(atan2(sin({dl}) * cos({la2}), cos({la1}) * sin({la2}) - sin({la1}) * cos({la2}) * cos({dl})) "
            f"* 180 / pi() + 360, 360)")


# --- sources ----------------------------------------------------------------------------


@query("union_sources", """
    SELECT CASE event_type WHEN 'error' THEN 'Mlat' WHEN 'view' THEN 'Beast' ELSE 'Sdr' END AS source,
           count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1""")
def union_sources_query(spark, folder):
    rows = events(spark, folder)
    parts = {"Mlat": rows.where("event_type = 'error'"), "Beast": rows.where("event_type = 'view'"),
             "Sdr": rows.where("event_type NOT IN ('error', 'view')")}
    return union_sources(parts).groupBy("source").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


_RELEASE = "concat('base_', 2020 + event_id % 6, '.', event_id % 5, '.w', lpad(cast(event_id % 60 as {t}), 2, '0'), '_r', event_id % 12, '.sqlite')"


@query("latest_release", f"""
    WITH f AS (SELECT {_RELEASE.format(t='varchar')} AS path FROM events),
    p AS (SELECT path, regexp_extract(path, '^[^/]*_([0-9]{{4}})\\.([1-4])\\.w([0-9]{{2}})_r([0-9]+)\\.sqlite$',
          ['y', 'q', 'w', 'r']) AS v FROM f),
    n AS (SELECT path, CAST(v.y AS INT) AS y, CAST(v.q AS INT) AS q, CAST(v.w AS INT) AS w, CAST(v.r AS INT) AS r
          FROM p WHERE v.y <> '')
    SELECT path, y AS year, q AS quarter, w AS week, r AS revision FROM n ORDER BY y DESC, q DESC, w DESC, r DESC LIMIT 1""")
def latest_release_query(spark, folder):
    return latest_release(events(spark, folder).selectExpr(f"{_RELEASE.format(t='string')} AS path"))


@query("check_registry", "SELECT count(*) AS n_rows, CAST(1000 AS BIGINT) AS expected, count(*) = 1000 AS matches FROM customer")
def check_registry_query(spark, folder):
    return check_registry(registry_from_customers(table(spark, folder, "customer")), 1000)


# --- filtering --------------------------------------------------------------------------


@query("dedup_within", """
    SELECT event_id, ts, user_id, event_type FROM (
      SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p FROM events)
    WHERE p IS NULL OR epoch_us(ts) - epoch_us(p) > 43200000000""")
def dedup_query(spark, folder):
    rows = events(spark, folder, ["user_id", "event_type"])
    return frames.dedup_within(rows, ["user_id", "event_type"], "ts", "12 hours", ORDER).select(
        "event_id", "ts", "user_id", "event_type")


_DETECT = f"""g AS (SELECT *, CASE WHEN lag(ts) OVER ({W}) IS NULL
        OR epoch_us(ts) - epoch_us(lag(ts) OVER ({W})) > 86400000000 THEN 1 ELSE 0 END AS gap FROM {{t}}),
    s AS (SELECT *, sum(gap) OVER ({W} ROWS UNBOUNDED PRECEDING) AS ses FROM g),
    d AS (SELECT *, CAST(sum({{w}}) OVER (PARTITION BY user_id, ses ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT)
        AS detections FROM s)"""


@query("confidence_gate", f"""WITH {_DETECT.format(t='events', w='1')}
    SELECT event_id, user_id, ts, detections FROM d WHERE detections >= 5""")
def gate_query(spark, folder):
    rows = events(spark, folder, USER)
    return frames.confidence_gate(rows, "user_id", "ts", 5, "24 hours", ORDER).select(
        "event_id", "user_id", "ts", "detections")


@query("trusted_gate", f"""WITH {_DETECT.format(t='events', w="CASE WHEN event_type = 'error' THEN 5 ELSE 1 END")}
    SELECT event_id, user_id, detections FROM d WHERE detections >= 5 AND event_type <> 'error'""")
def trusted_gate_query(spark, folder):
    rows = events(spark, folder, USER)
    return frames.trusted_gate(rows.where("event_type <> 'error'"), rows.where("event_type = 'error'"), "user_id",
                               "ts", 5, "24 hours", ORDER).select("event_id", "user_id", "detections")


@query("confirmed_keys", f"""WITH {_DETECT.format(t='events', w='1')}
    SELECT user_id, count(*) AS total, count(*) FILTER (detections >= 5) AS confident,
           min(ts) FILTER (detections >= 5) AS confirmed_at, arg_max(detections, (ts, event_id)) >= 5 AS is_confirmed,
           count(*) FILTER (event_type = 'view') AS clear_count, count(*) FILTER (event_type <> 'view') AS overlay_count
    FROM d GROUP BY user_id""")
def confirmed_query(spark, folder):
    rows = events(spark, folder, USER).withColumn("clear", F.expr("event_type = 'view'"))
    return frames.confirmed_keys(rows, "user_id", "ts", 5, "24 hours", ORDER, "clear")


# --- tracks -----------------------------------------------------------------------------

_SESSION = f"""g6 AS (SELECT *, CASE WHEN lag(ts) OVER ({W}) IS NULL
        OR epoch_us(ts) - epoch_us(lag(ts) OVER ({W})) > 21600000000 THEN 1 ELSE 0 END AS gap FROM events),
    ses AS (SELECT *, CAST(sum(gap) OVER ({W} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g6)"""


@query("sessionize", f"WITH {_SESSION} SELECT event_id, user_id, session FROM ses")
def sessionize_query(spark, folder):
    return tracks.sessionize(events(spark, folder, USER), "user_id", "ts", "6 hours", ORDER).select(
        "event_id", "user_id", "session")


RULES = [
    tracks.overwrite("last_type", "event_type"),
    tracks.overwrite("last_value", "value"),
    tracks.overwrite("view_value", "CASE WHEN value < 100 THEN value END", "event_type = 'view'"),
    tracks.keep_known("purchase_value", "CASE WHEN event_type = 'purchase' THEN value END"),
    tracks.keep_known("small_click", "CASE WHEN value < 20 THEN value END", "event_type = 'click'"),
]


@query("latest_state", """
    SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, arg_max(value, (ts, event_id)) AS last_value,
      (arg_max({'v': CASE WHEN value < 100 THEN value END}, (ts, event_id)) FILTER (event_type = 'view')).v AS view_value,
      arg_max(value, (ts, event_id)) FILTER (event_type = 'purchase') AS purchase_value,
      arg_max(value, (ts, event_id)) FILTER (event_type = 'click' AND value < 20) AS small_click
    FROM events GROUP BY user_id""")
def latest_state_query(spark, folder):
    return tracks.latest_state(events(spark, folder), "user_id", ORDER, RULES)


@query("state_as_of", f"""WITH {_SESSION},
    w AS (SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER
            (PARTITION BY user_id, session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS purchase_value,
          last_value(CASE WHEN event_type = 'view' THEN {{'v': CASE WHEN value < 100 THEN value END}} END IGNORE NULLS) OVER
            (PARTITION BY user_id, session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS view_value FROM ses)
    SELECT event_id, purchase_value, view_value.v AS view_value FROM w""")
def state_as_of_query(spark, folder):
    rows = tracks.sessionize(events(spark, folder, USER), "user_id", "ts", "6 hours", ORDER)
    rules = [r for r in RULES if r.name in ("purchase_value", "view_value")]
    return tracks.state_as_of(rows, "user_id", ORDER, rules, "session").select("event_id", "purchase_value", "view_value")


@query("message_counters", """
    SELECT user_id, count(*) AS total_messages, count(*) FILTER (event_type IN ('view', 'signup')) AS position_messages,
      count(*) FILTER (event_type = 'click') AS velocity_messages, count(*) FILTER (event_type = 'purchase') AS identification_messages,
      min(ts) AS first_seen, max(ts) AS last_seen, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seen_seconds,
      (epoch_us(max(ts)) - max(epoch_us(ts)) FILTER (event_type IN ('view', 'signup'))) / 1e6 AS seen_pos_seconds
    FROM events GROUP BY user_id""")
def counters_query(spark, folder):
    return tracks.message_counters(events(spark, folder), "user_id", "ts", "event_type", ("view", "signup"), ("click",),
                                   ("purchase",))


@query("lifecycle_events", f"""WITH {_SESSION},
    n AS (SELECT *, lag(session) OVER ({W}) AS ps, coalesce(lead(ts) OVER ({W}), TIMESTAMP '2024-01-31') AS nx FROM ses)
    SELECT user_id, session, event_id, CASE WHEN ps IS DISTINCT FROM session THEN 'added' ELSE 'updated' END AS event, ts AS at FROM n
    UNION ALL SELECT user_id, session, event_id, 'expired', ts + INTERVAL 6 HOUR FROM n
    WHERE epoch_us(nx) - epoch_us(ts) > 21600000000""")
def lifecycle_query(spark, folder):
    rows = events(spark, folder, USER)
    return tracks.lifecycle_events(rows, "user_id", "ts", "6 hours", ORDER, F.expr("timestamp_ntz '2024-01-31'"))


@query("active_at", f"""
    SELECT user_id, max(ts) AS last_seen, arg_max(value, (ts, event_id)) FILTER (event_type = 'purchase') AS purchase_value
    FROM events WHERE ts <= {AT_SQL} GROUP BY user_id HAVING epoch_us({AT_SQL}) - epoch_us(max(ts)) <= 21600000000""")
def active_query(spark, folder):
    rules = [r for r in RULES if r.name == "purchase_value"]
    return tracks.active_at(events(spark, folder), "user_id", "ts", F.expr(AT), "6 hours", ORDER, rules)


@query("mlat_flag", "SELECT user_id, coalesce(bool_or(event_type = 'error' AND value > 300), false) AS had_mlat FROM events GROUP BY 1")
def mlat_query(spark, folder):
    rows = events(spark, folder).withColumn("source", F.expr("CASE WHEN event_type = 'error' AND value > 300 THEN 'Mlat' ELSE 'Sdr' END"))
    return tracks.mlat_flag(rows, "user_id")


_ICAO = "lpad(hex(4194304 + user_id * 2 % 4194304), 6, '0')"
_ICAO_SQL = "upper(lpad(to_hex(4194304 + user_id * 2 % 4194304), 6, '0'))"


def addressed(spark, folder):
    """One row per user with an address; the registry covers every address of the test tables."""
    return events(spark, folder).selectExpr(f"{_ICAO} AS icao", "event_id").groupBy("icao").agg(F.count("*").alias("n"))


_ADDRESSED_SQL = f"{REGISTRY_SQL}, reg AS (SELECT * FROM registry WHERE NOT pia), t AS (SELECT {_ICAO_SQL} AS icao, count(*) AS n FROM events GROUP BY 1)"


def public_registry(spark, folder):
    return registry_from_customers(table(spark, folder, "customer")).where("NOT pia")


@query("enrich", f"WITH {_ADDRESSED_SQL} SELECT t.icao, n, registration, country, type_code, operator_name, military, ladd, pia "
                 "FROM t LEFT JOIN reg ON t.icao = reg.icao")
def enrich_query(spark, folder):
    return tracks.enrich(addressed(spark, folder), public_registry(spark, folder))


@query("registered", f"WITH {_ADDRESSED_SQL} SELECT icao, n FROM t WHERE EXISTS (SELECT 1 FROM reg WHERE reg.icao = t.icao)")
def registered_query(spark, folder):
    return tracks.registered(addressed(spark, folder), public_registry(spark, folder))


@query("unregistered", f"WITH {_ADDRESSED_SQL} SELECT icao, n FROM t WHERE NOT EXISTS (SELECT 1 FROM reg WHERE reg.icao = t.icao)")
def unregistered_query(spark, folder):
    return tracks.unregistered(addressed(spark, folder), public_registry(spark, folder))


@query("pair_latest", f"""
    WITH k AS (SELECT *, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 END AS odd FROM events),
    p AS (SELECT event_id, last_value(CASE WHEN odd = 0 THEN {{'ts': ts, 'v': value}} END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS e,
        last_value(CASE WHEN odd = 1 THEN {{'ts': ts, 'v': value}} END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS o FROM k)
    SELECT event_id, e.v AS even_value, o.v AS odd_value, e.ts AS even_ts, o.ts AS odd_ts FROM p
    WHERE abs(epoch_us(e.ts) - epoch_us(o.ts)) < 43200000000""")
def pair_query(spark, folder):
    rows = events(spark, folder, USER).withColumn("odd", F.expr("CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 END"))
    out = pair_latest(rows, "user_id", "odd", "ts", ["value"], "12 hours", ORDER)
    return out.where("paired").select("event_id", "even_value", "odd_value", "even_ts", "odd_ts")


_JUMPS = "CASE WHEN event_id % 9 = 0 THEN 3.0 ELSE 0.0 END"
_TRACK_LAT = "(cast(400000 + (user_id % 50) * 1000 + cast(round(value * 10) as bigint) as double) / 10000)"


@query("plausible_track", f"""
    WITH RECURSIVE p AS (SELECT event_id, user_id, ts, epoch_us(ts) AS us, {_TRACK_LAT} + {_JUMPS} AS lat, {LON} AS lon,
        row_number() OVER ({W}) AS rn FROM events),
    r AS (SELECT event_id, user_id, rn, lat AS clat, lon AS clon, us AS last, 0 AS rejects, true AS accepted FROM p WHERE rn = 1
      UNION ALL
      SELECT event_id, user_id, rn, CASE WHEN ok THEN lat WHEN rejects >= 4 THEN NULL ELSE clat END,
             CASE WHEN ok THEN lon WHEN rejects >= 4 THEN NULL ELSE clon END,
             CASE WHEN ok THEN CASE WHEN clat IS DISTINCT FROM lat OR clon IS DISTINCT FROM lon THEN us ELSE last END
                  WHEN rejects >= 4 THEN us ELSE last END,
             CASE WHEN ok OR rejects >= 4 THEN 0 ELSE rejects + 1 END, ok
      FROM (SELECT p.*, r.clat, r.clon, r.last, r.rejects, r.clat IS NULL OR p.us - r.last > 216000000000
              OR {nm_sql('r.clat', 'r.clon', 'p.lat', 'p.lon')} <= ((p.us - r.last) / 1e6 + 1) * 3 / 3600 AS ok
            FROM r JOIN p ON p.user_id = r.user_id AND p.rn = r.rn + 1))
    SELECT event_id, user_id, round(clat, 6) AS track_lat, round(clon, 6) AS track_lon, accepted, rejects AS rejections FROM r""")
def plausible_query(spark, folder):
    rows = events(spark, folder, USER).withColumns({
        "lat": F.expr(f"{_TRACK_LAT} + {_JUMPS}"), "lon": F.expr(LON), "speed": F.lit(3.0)})
    out = plausible_track(rows, "user_id", "ts", ORDER, speed="speed", timeout="120 hours")
    return out.select("event_id", "user_id", F.round("track_lat", 6).alias("track_lat"),
                      F.round("track_lon", 6).alias("track_lon"), "accepted", "rejections")


@query("rate_limit", """
    WITH RECURSIVE r AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id
      UNION ALL SELECT r.user_id, min(e.ts) FROM r JOIN events e ON e.user_id = r.user_id AND e.ts >= r.ts + INTERVAL 24 HOUR GROUP BY r.user_id)
    SELECT user_id, ts FROM r WHERE ts IS NOT NULL""")
def rate_limit_query(spark, folder):
    rows = events(spark, folder, USER).drop("event_type", "value")
    return rate_limit(rows, "user_id", "ts", "24 hours", ORDER).where("emit").select("user_id", "ts")


@query("derive_altitude", f"""
    WITH m AS (SELECT *, CASE WHEN event_type = 'view' THEN CAST(floor(value) * 100 AS BIGINT) END AS baro,
        CASE WHEN event_type = 'click' THEN CAST(floor(value) * 100 AS BIGINT) END AS geo,
        CASE WHEN event_type = 'error' THEN CAST(floor(value) AS BIGINT) END AS dlt FROM events),
    a AS (SELECT *, last_value(baro IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS baro_ft FROM m),
    b AS (SELECT *, last_value(CASE WHEN geo IS NOT NULL AND baro_ft IS NOT NULL THEN geo - baro_ft ELSE dlt END IGNORE NULLS)
        OVER ({W} ROWS UNBOUNDED PRECEDING) AS delta_ft FROM a)
    SELECT event_id, baro_ft, delta_ft, last_value(CASE WHEN geo IS NOT NULL THEN geo WHEN baro + delta_ft BETWEEN -2000 AND 126700
        THEN baro + delta_ft END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS geo_ft FROM b""")
def altitude_query(spark, folder):
    rows = events(spark, folder, USER).withColumns({
        "baro_report": F.expr("CASE WHEN event_type = 'view' THEN cast(floor(value) * 100 as bigint) END"),
        "geo_report": F.expr("CASE WHEN event_type = 'click' THEN cast(floor(value) * 100 as bigint) END"),
        "delta_report": F.expr("CASE WHEN event_type = 'error' THEN cast(floor(value) as bigint) END")})
    return tracks.derive_altitude(rows, "user_id", ORDER).select("event_id", "baro_ft", "delta_ft", "geo_ft")


# --- history ----------------------------------------------------------------------------

_LEVEL = "cast(floor(value / 50) as bigint)"
_HIST = f"""c AS (SELECT event_id, user_id, ts, {_LEVEL} AS level,
        lag({_LEVEL}) OVER ({W}) AS p, row_number() OVER ({W}) AS rn FROM events),
    h AS (SELECT event_id, user_id, ts, level, row_number() OVER ({W}) AS seq FROM c WHERE rn = 1 OR p IS DISTINCT FROM level)"""


def levels(spark, folder):
    rows = events(spark, folder, USER).withColumn("level", F.expr(_LEVEL))
    return rows.drop("value", "event_type")


@query("collapse_changes", f"WITH {_HIST} SELECT event_id, user_id, level FROM h")
def collapse_query(spark, folder):
    return history.collapse_changes(levels(spark, folder), "user_id", ORDER, ["level"]).select("event_id", "user_id", "level")


@query("with_seq", f"WITH {_HIST} SELECT event_id, user_id, seq FROM h")
def seq_query(spark, folder):
    return history.change_history(levels(spark, folder), "user_id", ORDER, ["level"], None).select("event_id", "user_id", "seq")


@query("cap_history", f"WITH {_HIST}, m AS (SELECT *, max(seq) OVER (PARTITION BY user_id) AS mx FROM h) "
                      "SELECT event_id, user_id, seq, level FROM m WHERE seq > mx - 7")
def cap_query(spark, folder):
    return history.change_history(levels(spark, folder), "user_id", ORDER, ["level"], 7).select(
        "event_id", "user_id", "seq", "level")


@query("history_page_limit", f"WITH {_HIST}, m AS (SELECT *, max(seq) OVER (PARTITION BY user_id) AS mx FROM h) "
                             "SELECT event_id, user_id, seq FROM m WHERE seq > mx - 3")
def page_limit_query(spark, folder):
    rows = history.change_history(levels(spark, folder), "user_id", ORDER, ["level"]).withColumn("kind", F.lit("state"))
    return history.history_page(rows, "user_id", ORDER, "State", limit="3").select("event_id", "user_id", "seq")


@query("history_page_after", f"WITH {_HIST} SELECT event_id, user_id, seq FROM h WHERE seq > 20")
def page_after_query(spark, folder):
    rows = history.change_history(levels(spark, folder), "user_id", ORDER, ["level"]).withColumn("kind", F.lit("state"))
    return history.history_page(rows, "user_id", ORDER, "state", limit=5, after=20).select("event_id", "user_id", "seq")


@query("history_meta", f"""WITH {_HIST}, m AS (SELECT *, max(seq) OVER (PARTITION BY user_id) AS mx FROM h)
    SELECT user_id, 7 AS capacity, count(*) AS n_entries, min(seq) AS min_seq, max(seq) AS max_seq FROM m WHERE seq > mx - 7 GROUP BY user_id""")
def meta_query(spark, folder):
    rows = history.change_history(levels(spark, folder), "user_id", ORDER, ["level"], 7)
    return history.history_meta(rows, "user_id", 7)


@query("trail", f"""WITH {LOCATED_SQL}, g AS (SELECT *, floor(lat * 2) / 2 AS y, floor(lon * 2) / 2 AS x FROM loc),
    c AS (SELECT *, lag(y) OVER ({W}) AS py, lag(x) OVER ({W}) AS px, row_number() OVER ({W}) AS rn FROM g)
    SELECT user_id, row_number() OVER ({W}) AS point, y, x FROM c WHERE rn = 1 OR y IS DISTINCT FROM py OR x IS DISTINCT FROM px""")
def trail_query(spark, folder):
    rows = located(events(spark, folder, USER)).withColumns({
        "y": F.expr("cast(floor(lat * 2) as double) / 2"), "x": F.expr("cast(floor(lon * 2) as double) / 2")})
    return history.trail(rows, "user_id", ORDER, "y", "x")


def _profile_sql(lo, hi):
    s = [f"greatest(1.0, mag * {m})" for m in (1, 2, 5, 10)]
    fits = " ".join(f"WHEN (ceil(hi / {x}) * {x} - floor(lo / {x}) * {x}) / {x} + 1 <= 6.000001 THEN {x}" for x in s)
    return f"""b AS (SELECT user_id, {lo} AS lo, {hi} AS hi FROM events GROUP BY user_id),
        m AS (SELECT *, pow(10.0, floor(log10((hi - lo) / 5))) AS mag FROM b), st AS (SELECT *, CASE {fits} ELSE {s[-1]} END AS step FROM m)
        SELECT user_id, CAST(step AS DOUBLE) AS step, CAST(floor(lo / step) * step AS DOUBLE) AS axis_min,
          CAST(floor(lo / step) * step + step * 5 AS DOUBLE) AS axis_max FROM st"""


@query("profile_range", "WITH " + _profile_sql("min(value)", "max(value)"))
def profile_query(spark, folder):
    return history.profile_range(events(spark, folder), "value", ["user_id"])


@query("profile_range_from_zero", "WITH " + _profile_sql("least(min(value), 0.0)", "max(value)"))
def profile_zero_query(spark, folder):
    return history.profile_range(events(spark, folder), "value", ["user_id"], from_zero=True)


# --- functions --------------------------------------------------------------------------

R_LAT, R_LON = RECEIVER


@query("distances", f"""WITH {LOCATED_SQL} SELECT event_id, round({nm_sql(R_LAT, R_LON, 'lat', 'lon')}, 6) AS nm,
    round({nm_sql(R_LAT, R_LON, 'lat', 'lon')} * 1.852, 6) AS km, round({nm_sql(R_LAT, R_LON, 'lat', 'lon')} * 1.15078, 6) AS mi,
    round(6371.0 * {angle_sql(R_LAT, R_LON, 'lat', 'lon')}, 6) AS map_km, round({bearing_sql(R_LAT, R_LON, 'lat', 'lon')}, 6) AS bearing
    FROM loc""")
def distances_query(spark, folder):
    place = (R_LAT, R_LON, F.col("lat"), F.col("lon"))
    return located(events(spark, folder)).select(
        "event_id", F.round(fn.distance_nm(*place), 6).alias("nm"), F.round(fn.distance_km(*place), 6).alias("km"),
        F.round(fn.distance_mi(*place), 6).alias("mi"), F.round(fn.map_distance_km(*place), 6).alias("map_km"),
        F.round(fn.bearing(*place), 6).alias("bearing"))


@query("units", """WITH v AS (SELECT event_id, CAST(floor(value * 80) AS INT) AS ft, CAST(floor(value) AS INT) AS kt, value FROM events)
    SELECT event_id, CAST(round_even(ft * 0.3048::DOUBLE, 0) AS INT) AS meters, ft // 100 AS fl,
      CAST(round_even(kt * 1.852::DOUBLE, 0) AS INT) AS kmh, CAST(round_even(kt * 1.15078::DOUBLE, 0) AS INT) AS mph,
      round(kt * 0.514444::DOUBLE, 6) AS mps, CAST(floor(kt * 1.852::DOUBLE + 0.5) AS BIGINT) AS kmh_map,
      CAST(round_even(ft / 0.3048::DOUBLE, 0) AS INT) AS feet, round(value / 1.852::DOUBLE, 1) AS nm, round(value * 0.621371::DOUBLE, 1) AS miles,
      round(CASE WHEN value > 50 THEN 10 * log10((value - 50) / 255) END, 6) AS dbfs FROM v""")
def units_query(spark, folder):
    rows = events(spark, folder).selectExpr("event_id", "cast(floor(value * 80) as int) AS ft", "cast(floor(value) as int) AS kt", "value")
    ft, kt = F.col("ft"), F.col("kt")
    return rows.select(
        "event_id", fn.feet_to_meters(ft).alias("meters"), fn.flight_level(ft).alias("fl"), fn.knots_to_kmh(kt).alias("kmh"),
        fn.knots_to_mph(kt).alias("mph"), F.round(fn.knots_to_mps(kt), 6).alias("mps"),
        fn.round_half_up(kt * 1.852).alias("kmh_map"), fn.meters_to_feet(ft).alias("feet"),
        fn.km_to_nm(F.col("value")).alias("nm"), fn.km_to_miles(F.col("value")).alias("miles"),
        F.round(fn.dbfs(F.col("value") - 50), 6).alias("dbfs"))


_WEATHER_IN = """cast(event_id % 360 as double) AS hdg, cast((event_id * 7 + user_id) % 360 as double) AS trk,
    cast(200 + event_id % 300 as double) AS tas, cast(180 + event_id % 350 as double) AS gs, cast(event_id % 100 as double) / 100 AS mach,
    cast(event_id % 21 - 10 as double) / 2 AS decl"""


@query("wind", f"""WITH i AS (SELECT event_id, {_WEATHER_IN} FROM events),
    c AS (SELECT *, tas - cos((hdg - trk) * pi() / 180) * gs AS head, sin((hdg - trk) * pi() / 180) * gs AS cross_c FROM i)
    SELECT event_id, CASE WHEN sqrt(head * head + cross_c * cross_c) < 250 THEN round(sqrt(head * head + cross_c * cross_c), 6) END AS wind_speed,
      CASE WHEN sqrt(head * head + cross_c * cross_c) < 250
           THEN round(fmod(fmod((hdg * pi() / 180 + atan2(cross_c, head)) * 180 / pi(), 360) + 360, 360), 5) END AS wind_direction FROM c""")
def wind_query(spark, folder):
    rows = events(spark, folder).selectExpr("event_id", *_split(_WEATHER_IN))
    rows = rows.withColumn("w", fn.wind(F.col("hdg"), F.col("trk"), F.col("tas"), F.col("gs")))
    return rows.select("event_id", F.round("w.speed", 6).alias("wind_speed"), F.round("w.direction", 5).alias("wind_direction"))


def _split(text: str) -> list[str]:
    """Top-level comma split of a select list."""
    parts, depth, current = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(current)
            current = ""
        else:
            current += ch
    return [p.strip() for p in [*parts, current]]


@query("temperature", f"""WITH i AS (SELECT event_id, {_WEATHER_IN} FROM events),
    o AS (SELECT *, CASE WHEN mach >= 0.395 THEN pow(tas / (661.47 * mach), 2) * 288.15 - 273.15 END AS raw FROM i),
    c AS (SELECT *, CASE WHEN raw BETWEEN -80 AND 100 THEN raw END AS oat FROM o),
    t AS (SELECT *, (oat + 273.15) * (1 + 0.2 * mach * mach) - 273.15 AS tat_raw FROM c)
    SELECT event_id, round(oat, 6) AS oat, CASE WHEN tat_raw BETWEEN -80 AND 100 THEN round(tat_raw, 6) END AS tat FROM t""")
def temperature_query(spark, folder):
    rows = events(spark, folder).selectExpr("event_id", *_split(_WEATHER_IN))
    rows = rows.withColumn("oat", fn.outside_air_temperature(F.col("tas"), F.col("mach")))
    tat = fn.total_air_temperature(F.col("oat"), F.col("mach"))
    return rows.select("event_id", F.round("oat", 6).alias("oat"), F.round(tat, 6).alias("tat"))


@query("true_heading", f"""WITH i AS (SELECT event_id, {_WEATHER_IN} FROM events), h AS (SELECT *, fmod(hdg + decl + 360, 360) AS th,
      CASE WHEN event_id % 5 = 0 THEN NULL ELSE trk END AS t FROM i)
    SELECT event_id, CASE WHEN t IS NULL OR abs(th - t - 360 * CASE WHEN th - t > 180 THEN 1 WHEN th - t < -180 THEN -1 ELSE 0 END) < 45
      THEN round(th, 6) END AS heading FROM h""")
def true_heading_query(spark, folder):
    rows = events(spark, folder).selectExpr("event_id", *_split(_WEATHER_IN))
    heading = fn.true_heading(F.col("hdg"), F.col("decl"), F.expr("CASE WHEN event_id % 5 = 0 THEN NULL ELSE trk END"))
    return rows.select("event_id", F.round(heading, 6).alias("heading"))


@query("declination", f"""WITH {LOCATED_SQL}, grid AS (SELECT CAST(floor(lat) AS INT) AS cell_lat, CAST(floor(lon) AS INT) AS cell_lon, 2024 AS year,
      CAST(count(*) % 23 AS DOUBLE) / 4 AS declination FROM loc WHERE lat < 44 GROUP BY 1, 2)
    SELECT event_id, declination FROM loc LEFT JOIN grid ON floor(lat) = cell_lat AND floor(lon) = cell_lon AND year(ts) = grid.year""")
def declination_query(spark, folder):
    rows = located(events(spark, folder))
    grid = rows.where("lat < 44").selectExpr("cast(floor(lat) as int) AS cell_lat", "cast(floor(lon) as int) AS cell_lon").groupBy(
        "cell_lat", "cell_lon").agg((F.count("*") % 23 / 4.0).cast("double").alias("declination")).withColumn("year", F.lit(2024))
    return fn.with_declination(rows, grid).select("event_id", "declination")


@query("display_classes", """WITH v AS (SELECT event_id, CAST(floor(value * 100) AS INT) AS ft, event_id % 5 = 0 AS mil, event_id % 7 = 0 AS ladd,
        CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 11 = 0 END AS pia, event_id FROM events),
    c AS (SELECT *, CASE WHEN mil THEN 'military' WHEN ladd OR coalesce(pia, false) THEN 'privacy' ELSE 'normal' END AS class FROM v),
    st AS (SELECT * FROM (VALUES ('normal', 0, 10000, 179, 102, 217, 178, 255, 255), ('normal', 10000, 25000, 102, 51, 178, 153, 255, 255),
        ('normal', 25000, 40000, 51, 0, 153, 97, 255, 146), ('military', 0, 10000, 179, 102, 230, 194, 179, 102),
        ('military', 10000, 25000, 102, 51, 194, 163, 102, 51), ('military', 25000, 40000, 51, 0, 163, 110, 51, 0),
        ('privacy', 0, 10000, 255, 255, 179, 102, 179, 102), ('privacy', 10000, 25000, 255, 220, 102, 50, 102, 50),
        ('privacy', 25000, 40000, 220, 160, 50, 0, 50, 0)) AS t(class, lo, hi, r0, r1, g0, g1, b0, b1))
    SELECT event_id, c.class AS css_class, least(greatest(ft, 0), 40000) // 2000 * 2000 AS band,
      CAST(floor(r0 + least(ft - lo, hi - lo) / (hi - lo)::DOUBLE * (r1 - r0) + 0.5) AS INT) AS r,
      CAST(floor(g0 + least(ft - lo, hi - lo) / (hi - lo)::DOUBLE * (g1 - g0) + 0.5) AS INT) AS g,
      CAST(floor(b0 + least(ft - lo, hi - lo) / (hi - lo)::DOUBLE * (b1 - b0) + 0.5) AS INT) AS b, '0x' || upper(lpad(to_hex(ft), 4, '0')) AS mask
    FROM c JOIN st ON c.class = st.class AND ((ft = 0 AND lo = 0) OR (ft > lo AND (ft <= hi OR hi = 40000)))""")
def display_query(spark, folder):
    rows = events(spark, folder).selectExpr(
        "event_id", "cast(floor(value * 100) as int) AS ft", "event_id % 5 = 0 AS mil", "event_id % 7 = 0 AS ladd",
        "CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 11 = 0 END AS pia")
    rows = rows.withColumn("css_class", fn.priority_class(F.col("mil"), F.col("ladd"), F.col("pia")))
    rows = rows.withColumn("c", fn.altitude_color(F.col("ft"), F.col("css_class")))
    return rows.select("event_id", "css_class", fn.altitude_band(F.col("ft")).alias("band"), "c.r", "c.g", "c.b",
                       fn.hex_mask(F.col("ft"), 4).alias("mask"))


@query("range_rings", """WITH s AS (SELECT s_suppkey, CAST(s_suppkey % 50 + 10 AS DOUBLE) AS lat, CAST(s_suppkey % 90 AS DOUBLE) AS lon FROM supplier),
    g AS (SELECT s_suppkey, CAST(radius AS DOUBLE) AS radius_nm, CAST(point AS INT) AS point, lat * pi() / 180 AS la, lon * pi() / 180 AS lo,
      radius * 1.852 / 6371 AS d, point / 64.0::DOUBLE * 2 * pi() AS a FROM s, unnest([100, 150, 200]) AS r(radius), range(0, 65) AS p(point)),
    h AS (SELECT *, asin(sin(la) * cos(d) + cos(la) * sin(d) * cos(a)) AS y FROM g)
    SELECT s_suppkey, radius_nm, point, round(y * 180 / pi(), 6) AS ring_lat,
      round((lo + atan2(sin(a) * sin(d) * cos(la), cos(d) - sin(la) * sin(y))) * 180 / pi(), 6) AS ring_lon FROM h""")
def rings_query(spark, folder):
    sites = table(spark, folder, "supplier").selectExpr(
        "s_suppkey", "cast(s_suppkey % 50 + 10 as double) AS lat", "cast(s_suppkey % 90 as double) AS lon")
    return fn.range_rings(sites).select("s_suppkey", "radius_nm", "point", F.round("ring_lat", 6).alias("ring_lat"),
                                        F.round("ring_lon", 6).alias("ring_lon"))


# --- listing ----------------------------------------------------------------------------

_STATE_SQL = f"""t AS (SELECT user_id, {_ICAO_SQL} AS icao, max(ts) AS last_seen, arg_max(event_type, (ts, event_id)) AS callsign,
      arg_max(value, (ts, event_id)) FILTER (event_type = 'purchase' AND value > 60) AS altitude,
      arg_max(CAST(event_id AS VARCHAR), (ts, event_id)) FILTER (event_type = 'click') AS squawk,
      arg_max({LAT}, (ts, event_id)) FILTER (event_type <> 'error' AND value < 100) AS lat,
      arg_max({LON}, (ts, event_id)) FILTER (event_type <> 'error' AND value < 100) AS lon FROM events GROUP BY user_id)"""


def user_state(spark, folder, rows=None):
    """One row per user, with unknown values in some columns."""
    placed = "event_type <> 'error' AND value < 100"
    rules = [tracks.overwrite("last_seen", "ts"), tracks.overwrite("callsign", "event_type"),
             tracks.keep_known("altitude", "value", "event_type = 'purchase' AND value > 60"),
             tracks.keep_known("squawk", "cast(event_id as string)", "event_type = 'click'"),
             tracks.keep_known("lat", LAT, placed), tracks.keep_known("lon", LON, placed)]
    state = tracks.latest_state(events(spark, folder) if rows is None else rows, "user_id", ORDER, rules)
    return state.withColumn("icao", F.expr(_ICAO))


@query("within_bounds", f"WITH {_STATE_SQL} SELECT icao, lat, lon FROM t WHERE lat BETWEEN 41.0 AND 43.5 AND lon BETWEEN 14.5 AND 17.25")
def bounds_query(spark, folder):
    return listing.within_bounds(user_state(spark, folder), 41.0, 14.5, 43.5, 17.25).select("icao", "lat", "lon")


@query("search", f"WITH {_STATE_SQL} SELECT icao, callsign, squawk FROM t WHERE contains(lower(icao), '1a') OR contains(lower(callsign), '1a') "
                 "OR coalesce(contains(lower(squawk), '1a'), false) OR coalesce(contains(lower(squawk), '99'), false)")
def search_query(spark, folder):
    state = user_state(spark, folder)
    a = listing.search(state, " 1A ", ("icao", "callsign", "squawk"))
    b = listing.search(state, "99", ("squawk",))
    return a.unionByName(b).select("icao", "callsign", "squawk").distinct()


@query("search_short", f"WITH {_STATE_SQL} SELECT icao, callsign FROM t WHERE contains(lower(icao), 'si') OR contains(lower(callsign), 'si')")
def search_short_query(spark, folder):
    return listing.search_short(user_state(spark, folder), "SI").select("icao", "callsign")


@query("rank_altitude", f"WITH {_STATE_SQL} SELECT row_number() OVER (ORDER BY altitude DESC NULLS LAST, icao) AS place, icao, altitude FROM t "
                        "ORDER BY altitude DESC NULLS LAST, icao LIMIT 40")
def rank_query(spark, folder):
    ranked = listing.page(listing.rank(user_state(spark, folder), "altitude", True), 0, 40).select("icao", "altitude")
    return _numbered(ranked, F.col("altitude").desc_nulls_last(), 0)


def _numbered(ranked, by, start):
    """Places of a page of a ranked list; the page is a top-k result of a few rows."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(F.lit(1)).orderBy(by, F.col("icao"))
    return ranked.withColumn("place", (F.row_number().over(w) + start).cast("long"))


@query("rank_callsign_page", f"WITH {_STATE_SQL} SELECT row_number() OVER (ORDER BY callsign, icao) AS place, icao, callsign FROM t "
                             "ORDER BY callsign, icao LIMIT 25 OFFSET 5")
def rank_page_query(spark, folder):
    ranked = listing.page(listing.rank(user_state(spark, folder), "callsign"), 5, 25).select("icao", "callsign")
    return _numbered(ranked, F.col("callsign"), 5)


@query("rank_web", f"""WITH {_STATE_SQL} SELECT icao, round(6371.0 * {angle_sql(R_LAT, R_LON, 'lat', 'lon')}, 6) AS distance_km FROM t
    WHERE lat IS NOT NULL ORDER BY 2 DESC, icao LIMIT 30""")
def rank_web_query(spark, folder):
    ranked = listing.rank_web(user_state(spark, folder), "distance_km", True, RECEIVER)
    return listing.page(ranked, 0, 30).select("icao", F.round("distance_km", 6).alias("distance_km"))


@query("range_outline", f"""WITH {LOCATED_SQL}, d AS (SELECT *, {nm_sql(43.0, 16.0, 'lat', 'lon')} AS nm, {bearing_sql(43.0, 16.0, 'lat', 'lon')} AS brg
      FROM loc WHERE ts <= {AT_SQL} AND ts >= {AT_SQL} - INTERVAL 96 HOUR),
    k AS (SELECT *, CAST(floor(brg / 5) % 72 AS INT) AS sector FROM d WHERE nm <= 300),
    f AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY nm DESC, ts) AS rn FROM k)
    SELECT sector, lat, lon, round(nm, 6) AS nm, ts AS seen_at FROM f WHERE rn = 1""")
def outline_query(spark, folder):
    out = listing.range_outline(located(events(spark, folder)), 43.0, 16.0, "ts", F.expr(AT), retain="96 hours")
    return out.withColumn("nm", F.round("nm", 6))


@query("stream_stats", """SELECT count(*) AS total_frames, count(*) FILTER (event_type <> 'error') AS valid_frames,
      count(*) FILTER (event_type = 'error') AS errors, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS uptime_seconds,
      round_even(count(*) FILTER (event_type <> 'error') / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 1) AS frames_per_second FROM events""")
def stats_query(spark, folder):
    return listing.stream_stats(events(spark, folder), "ts", F.expr("event_type <> 'error'"))


@query("health", f"""WITH l AS (SELECT user_id, max(ts) AS m, min(ts) AS f FROM events WHERE ts <= {AT_SQL} GROUP BY 1)
    SELECT 'OK' AS status, count(*) FILTER (epoch_us({AT_SQL}) - epoch_us(m) <= 21600000000) AS active,
      CAST(floor((epoch_us({AT_SQL}) - epoch_us(min(f))) / 1e6) AS BIGINT) AS uptime_seconds FROM l""")
def health_query(spark, folder):
    return listing.health(events(spark, folder), "user_id", "ts", F.expr(AT), "6 hours")


@query("bbox", f"WITH {_STATE_SQL} SELECT min(lat) AS south, min(lon) AS west, max(lat) AS north, max(lon) AS east FROM t")
def bbox_query(spark, folder):
    return listing.bbox(user_state(spark, folder))


@query("changed_only", f"""WITH c AS (SELECT event_id, user_id, event_type, {_LEVEL} AS level, row_number() OVER ({W}) AS rn,
      lag(event_type) OVER ({W}) AS pt, lag({_LEVEL}) OVER ({W}) AS pl FROM events)
    SELECT event_id, user_id, event_type, level FROM c WHERE rn = 1 OR pt <> event_type OR pl <> level""")
def changed_query(spark, folder):
    rows = events(spark, folder, USER).withColumn("level", F.expr(_LEVEL)).drop("value")
    return listing.changed_only(rows, "user_id", ORDER).select("event_id", "user_id", "event_type", "level")


@query("viewport_diff", f"""WITH a AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS v, max(ts) AS m FROM events WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY 1
      HAVING epoch_us(TIMESTAMP '2024-01-20') - epoch_us(max(ts)) <= 21600000000),
    b AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS v, max(ts) AS m FROM events WHERE ts <= {AT_SQL} GROUP BY 1
      HAVING epoch_us({AT_SQL}) - epoch_us(max(ts)) <= 21600000000)
    SELECT coalesce(a.user_id, b.user_id) AS user_id, b.v AS callsign, CASE WHEN a.user_id IS NULL THEN 'entered' WHEN b.user_id IS NULL THEN 'left' ELSE 'changed' END AS event
    FROM a FULL OUTER JOIN b ON a.user_id = b.user_id WHERE (a.v IS DISTINCT FROM b.v OR a.m IS DISTINCT FROM b.m)
      AND NOT (b.user_id IS NULL AND a.user_id = 8)""")
def viewport_query(spark, folder):
    rules = [tracks.overwrite("callsign", "event_type")]

    def snapshot(at):
        return tracks.active_at(events(spark, folder), "user_id", "ts", F.expr(at), "6 hours", ORDER, rules)

    out = listing.viewport_diff(snapshot("timestamp_ntz '2024-01-20'"), snapshot(AT), "user_id", pinned=8)
    return out.select("user_id", "callsign", "event")


@query("windowed_rates", """SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS window_start, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') + INTERVAL 6 HOUR AS window_end,
      count(*) AS total_frames, count(*) FILTER (event_type <> 'error') AS valid_frames, count(*) FILTER (event_type <> 'error') / 21600.0::DOUBLE AS frames_per_second
    FROM events GROUP BY 1, 2""")
def rates_query(spark, folder):
    out = listing.windowed_rates(events(spark, folder), "ts", "6 hours", valid=F.expr("event_type <> 'error'"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("windowed_rates_sliding", """WITH s AS (SELECT ts, time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '2024-01-01') - to_hours(CAST(2 * k AS INT)) AS w, event_type FROM events, range(0, 3) AS r(k))
    SELECT w AS window_start, w + INTERVAL 6 HOUR AS window_end, count(*) AS total_frames, count(*) AS valid_frames, count(*) / 21600.0::DOUBLE AS frames_per_second FROM s GROUP BY 1, 2""")
def sliding_query(spark, folder):
    out = listing.windowed_rates(events(spark, folder), "ts", "6 hours", "2 hours")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})
