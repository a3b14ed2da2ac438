"""Positions from compact position reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytally.functions.geo import distance_nm
from skytally.operators.folds import interval_micros, plausible_track
from skytally.operators.ordered import Latest, as_list, micros, scan
from skytally.operators.stages import compute_once
from skytally.operators.tracks import latest_state, overwrite

# Latitudes at which the number of longitude zones drops by one, from 59.
ZONE_LATITUDES = (
    10.47047130, 14.82817437, 18.18626357, 21.02939493, 23.54504487, 25.82924707, 27.93898710, 29.91135686,
    31.77209708, 33.53993436, 35.22899598, 36.85025108, 38.41241892, 39.92256684, 41.38651832, 42.80914012,
    44.19454951, 45.54626723, 46.86733252, 48.16039128, 49.42776439, 50.67150166, 51.89342469, 53.09516153,
    54.27817472, 55.44378444, 56.59318756, 57.72747354, 58.84763776, 59.95459277, 61.04917774, 62.13216659,
    63.20427479, 64.26616523, 65.31845310, 66.36171008, 67.39646774, 68.42322022, 69.44242631, 70.45451075,
    71.45986473, 72.45884545, 73.45177442, 74.43893416, 75.42056257, 76.39684391, 77.36789461, 78.33374083,
    79.29428225, 80.24923213, 81.19801349, 82.13956981, 83.07199445, 83.99173563, 84.89166191, 85.75541621,
    86.53536998, 87.00000000,
)
CPR_SCALE = 131072.0
MAX_RANGE_NM = 300.0


def pair_latest(df: DataFrame, key, odd: str, ts: str, values, max_age="10 seconds", order=None) -> DataFrame:
    """Attach the newest even and the newest odd row of the key so far, the row itself included.

    Adds ``even_<v>`` and ``odd_<v>`` for each value column, ``even_ts``, ``odd_ts`` and
    ``paired``: both are known and less than ``max_age`` apart. Rows with a null ``odd``
    belong to neither kind.
    """
    limit = interval_micros(df.sparkSession, max_age)
    values = as_list(values)
    report = F.struct(F.col(ts).alias("ts"), *[F.col(v).alias(v) for v in values])
    flag = F.col(odd).cast("int")
    out = scan(df, key, order or [ts], _even=Latest(report, flag == 0), _odd=Latest(report, flag == 1))
    out = out.withColumns({
        **{f"even_{v}": F.col(f"_even.{v}") for v in [*values, "ts"]},
        **{f"odd_{v}": F.col(f"_odd.{v}") for v in [*values, "ts"]},
    }).drop("_even", "_odd")
    apart = F.abs(micros("even_ts") - micros("odd_ts")) < limit
    return out.withColumn("paired", F.coalesce(apart, F.lit(False)))


def zones_sql(latitude: str) -> str:
    """Number of longitude zones at a latitude, 59 near the equator to 1 at the poles."""
    passed = " + ".join(f"cast(abs({latitude}) >= {t!r}D as int)" for t in ZONE_LATITUDES)
    return f"(59 - ({passed}))"


def decode_airborne_cpr(df: DataFrame, even_lat="even_cpr_lat", even_lon="even_cpr_lon", odd_lat="odd_cpr_lat",
                        odd_lon="odd_cpr_lon", even_ts="even_ts", odd_ts="odd_ts", paired="paired") -> DataFrame:
    """Add ``lat`` and ``lon`` from an even / odd pair; null where the pair does not decode.

    The newer report gives the position, the even one if both are equally old. The two
    latitudes must lie in bands with the same number of zones.
    """
    out = compute_once(df, {"_j": f"floor(59 * ({even_lat} / {CPR_SCALE}D) - 60 * ({odd_lat} / {CPR_SCALE}D) + 0.5D)"})
    south = "CASE WHEN {0} >= 270 THEN {0} - 360 ELSE {0} END"
    lat0 = f"(6.0D * (pmod(_j, 60) + {even_lat} / {CPR_SCALE}D))"
    lat1 = f"((360.0D / 59.0D) * (pmod(_j, 59) + {odd_lat} / {CPR_SCALE}D))"
    out = compute_once(out, {"_lat0": south.format(lat0), "_lat1": south.format(lat1),
                             "_odd": f"coalesce({odd_ts} > {even_ts}, false)"})
    # One by one: the JVM does not compile a method of more than 8,000 bytes.
    out = compute_once(compute_once(out, {"_nl0": zones_sql("_lat0")}), {"_nl1": zones_sql("_lat1")})
    good = f"{paired} AND _lat0 BETWEEN -90 AND 90 AND _lat1 BETWEEN -90 AND 90 AND _nl0 = _nl1"
    out = compute_once(out, {
        "_ni": "greatest(_nl0 - cast(_odd as int), 1)",
        "_m": f"floor({even_lon} / {CPR_SCALE}D * (_nl0 - 1) - {odd_lon} / {CPR_SCALE}D * _nl0 + 0.5D)",
        "lat": f"CASE WHEN {good} THEN CASE WHEN _odd THEN _lat1 ELSE _lat0 END END",
    })
    share = f"(CASE WHEN _odd THEN {odd_lon} ELSE {even_lon} END / {CPR_SCALE}D)"
    out = compute_once(out, {"_lon": f"360.0D / _ni * (pmod(_m, _ni) + {share})"})
    out = out.withColumn("lon", F.expr("CASE WHEN lat IS NOT NULL THEN CASE WHEN _lon > 180 THEN _lon - 360 ELSE _lon END END"))
    return out.drop("_j", "_lat0", "_lat1", "_odd", "_nl0", "_nl1", "_ni", "_m", "_lon")


def range_guard(df: DataFrame, receiver_lat, receiver_lon, nm: float = MAX_RANGE_NM, lat="lat", lon="lon") -> DataFrame:
    """Null a position farther than ``nm`` from the receiver; without a receiver keep all.

    The receiver is two numbers or two columns (null: unknown).
    """
    if receiver_lat is None or receiver_lon is None:
        return df
    near = ~(F.coalesce(distance_nm(receiver_lat, receiver_lon, F.col(lat), F.col(lon)), F.lit(0.0)) > nm)
    return df.withColumn("_near", near).withColumns({
        lat: F.when(F.col("_near"), F.col(lat)), lon: F.when(F.col("_near"), F.col(lon)),
    }).drop("_near")


def decode_surface_cpr(df: DataFrame, receiver_lat=None, receiver_lon=None, cpr_lat="cpr_lat", cpr_lon="cpr_lon",
                       odd="cpr_odd") -> DataFrame:
    """Add ``lat`` and ``lon`` of surface reports, decoded around the receiver; null without one.

    Zones are 1.5 degrees of latitude wide and lose one longitude zone per step.
    """
    if receiver_lat is None or receiver_lon is None:
        return df.withColumns({"lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double")})

    def as_column(value) -> Column:
        return value.cast("double") if isinstance(value, Column) else F.lit(float(value))

    out = df.withColumns({"_rlat": as_column(receiver_lat), "_rlon": as_column(receiver_lon)})

    def place(reference, step, share):
        zone = f"(floor({reference} / {step}) + floor(0.5D + pmod({reference}, {step}) / {step} - {share}))"
        return f"({step} * ({zone} + {share}))"

    out = compute_once(out, {
        "_dlat": f"CASE WHEN cast({odd} as int) = 0 THEN 90.0D / 60.0D ELSE 90.0D / 59.0D END",
        "_yz": f"{cpr_lat} / {CPR_SCALE}D",
        "_xz": f"{cpr_lon} / {CPR_SCALE}D",
    })
    out = compute_once(out, {"_lat": place("_rlat", "_dlat", "_yz")})
    turned = "(CASE WHEN _lat >= 270 THEN _lat - 360 WHEN _lat <= -270 THEN _lat + 360 ELSE _lat END)"
    out = compute_once(out, {"_lat": turned})
    out = compute_once(out, {
        "_dlon": "CASE WHEN _lat BETWEEN -90 AND 90 AND floor(abs(_lat) / 1.5D) < 60 "
                 "THEN 90.0D / greatest(59 - floor(abs(_lat) / 1.5D), 1) END"})
    out = compute_once(out, {"_lon": place("_rlon", "_dlon", "_xz")})
    return out.withColumns({
        "lat": F.expr("CASE WHEN _dlon IS NOT NULL THEN _lat END"),
        "lon": F.expr("CASE WHEN _lon >= 180 THEN _lon - 360 WHEN _lon <= -180 THEN _lon + 360 ELSE _lon END"),
    }).drop("_rlat", "_rlon", "_dlat", "_yz", "_xz", "_lat", "_dlon", "_lon")


def expire_pairs(df: DataFrame, key, order, as_of: Column, max_age="10 minutes") -> DataFrame:
    """Halves that still wait for a partner at ``as_of``: one row per key of a paired-up table.

    Takes the output of ``pair_latest``. A half older than ``max_age`` is forgotten. In a
    batch the pairing's own age limit is tighter, so this is a report, not a filter.
    """
    limit = interval_micros(df.sparkSession, max_age)
    newest = latest_state(df, key, order, [overwrite("paired"), overwrite("even_ts"), overwrite("odd_ts")])
    waiting = newest.where(~F.col("paired")).withColumn("waiting_since", F.greatest("even_ts", "odd_ts"))
    return waiting.where(micros(as_of) - micros("waiting_since") <= limit).drop("paired", "even_ts", "odd_ts")


__all__ = ["decode_airborne_cpr", "decode_surface_cpr", "expire_pairs", "pair_latest", "plausible_track",
           "range_guard", "zones_sql"]
