"""Great-circle geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the distance formulas.
EARTH_RADIUS_NM = 3440.065
MAP_EARTH_RADIUS_KM = 6371.0
KM_PER_NM = 1.852
MILES_PER_NM = 1.15078


def _as_col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def _rad(value: Column) -> Column:
    return value * F.pi() / 180.0


def central_angle(lat1, lon1, lat2, lon2) -> Column:
    """Haversine central angle in radians between two points given in degrees."""
    lat1, lon1, lat2, lon2 = map(_as_col, (lat1, lon1, lat2, lon2))
    half_lat = F.sin(_rad(lat2 - lat1) / 2.0)
    half_lon = F.sin(_rad(lon2 - lon1) / 2.0)
    a = half_lat * half_lat + F.cos(_rad(lat1)) * F.cos(_rad(lat2)) * half_lon * half_lon
    return 2.0 * F.atan2(F.sqrt(a), F.sqrt(1.0 - a))


def distance_nm(lat1, lon1, lat2, lon2) -> Column:
    return F.lit(EARTH_RADIUS_NM) * central_angle(lat1, lon1, lat2, lon2)


def distance_km(lat1, lon1, lat2, lon2) -> Column:
    return distance_nm(lat1, lon1, lat2, lon2) * KM_PER_NM


def distance_mi(lat1, lon1, lat2, lon2) -> Column:
    return distance_nm(lat1, lon1, lat2, lon2) * MILES_PER_NM


def map_distance_km(lat1, lon1, lat2, lon2) -> Column:
    """Distance as the map list states it: haversine on a 6371 km sphere."""
    return F.lit(MAP_EARTH_RADIUS_KM) * central_angle(lat1, lon1, lat2, lon2)


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing from the first point to the second, 0 to 360 degrees."""
    lat1, lon1, lat2, lon2 = map(_as_col, (lat1, lon1, lat2, lon2))
    d_lon = _rad(lon2 - lon1)
    east = F.sin(d_lon) * F.cos(_rad(lat2))
    north = F.cos(_rad(lat1)) * F.sin(_rad(lat2)) - F.sin(_rad(lat1)) * F.cos(_rad(lat2)) * F.cos(d_lon)
    return (F.atan2(east, north) * 180.0 / F.pi() + 360.0) % 360.0


def range_rings(receivers: DataFrame, radii_nm=(100, 150, 200), points: int = 64,
                lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Points of circles around each receiver: one row per (receiver, radius, point).

    ``points + 1`` rows close the ring. Both generators are stated constants, so the
    output is a fixed multiple of the receivers.
    """
    ring = receivers.withColumn("radius_nm", F.explode(F.array(*[F.lit(float(r)) for r in radii_nm])))
    ring = ring.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points))))
    angle = F.col("point") / float(points) * 2.0 * F.pi()
    reach = F.col("radius_nm") * KM_PER_NM / MAP_EARTH_RADIUS_KM
    lat0, lon0 = _rad(F.col(lat)), _rad(F.col(lon))
    ring_lat = F.asin(F.sin(lat0) * F.cos(reach) + F.cos(lat0) * F.sin(reach) * F.cos(angle))
    ring = ring.withColumn("_ring_lat", ring_lat)
    ring_lon = lon0 + F.atan2(
        F.sin(angle) * F.sin(reach) * F.cos(lat0),
        F.cos(reach) - F.sin(lat0) * F.sin(F.col("_ring_lat")),
    )
    return ring.withColumns({
        "ring_lat": F.col("_ring_lat") * 180.0 / F.pi(),
        "ring_lon": ring_lon * 180.0 / F.pi(),
    }).drop("_ring_lat")
