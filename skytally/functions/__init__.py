"""Column functions: bit fields, geometry, units and derived weather."""

from skytally.functions.bits import bit_field, hex_mask, hex_to_long, long_to_hex
from skytally.functions.geo import (
    bearing,
    distance_km,
    distance_mi,
    distance_nm,
    map_distance_km,
    range_rings,
)
from skytally.functions.units import (
    altitude_band,
    altitude_color,
    best_altitude,
    best_speed,
    dbfs,
    feet_to_meters,
    flight_level,
    km_to_miles,
    km_to_nm,
    knots_to_kmh,
    knots_to_mph,
    knots_to_mps,
    meters_to_feet,
    priority_class,
    round_half_up,
)
from skytally.functions.weather import (
    outside_air_temperature,
    total_air_temperature,
    true_heading,
    wind,
    with_declination,
)

__all__ = [
    "altitude_band",
    "altitude_color",
    "bearing",
    "best_altitude",
    "best_speed",
    "bit_field",
    "dbfs",
    "distance_km",
    "distance_mi",
    "distance_nm",
    "feet_to_meters",
    "flight_level",
    "hex_mask",
    "hex_to_long",
    "km_to_miles",
    "km_to_nm",
    "knots_to_kmh",
    "knots_to_mph",
    "knots_to_mps",
    "long_to_hex",
    "map_distance_km",
    "meters_to_feet",
    "outside_air_temperature",
    "priority_class",
    "range_rings",
    "round_half_up",
    "total_air_temperature",
    "true_heading",
    "wind",
    "with_declination",
]
