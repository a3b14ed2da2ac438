"""One JSON object per aircraft state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from skytally.functions.labels import label_sql
from skytally.operators.listing import section_fields

# Exported names per section, with the state field or SQL text behind each.
_ALTITUDE = "CASE WHEN {f} IS NOT NULL THEN named_struct('Type', '{t}', 'Feet', {f}, 'Meters', cast(rint({f} * 0.3048D) as int), 'FlightLevel', cast({f} / 100 as int)) END"
_SPEED = ("CASE WHEN {f} IS NOT NULL THEN named_struct('Type', {t}, 'Knots', {f}, 'KilometersPerHour', cast(rint({f} * 1.852D) as int), "
          "'MilesPerHour', cast(rint({f} * 1.15078D) as int), 'MetersPerSecond', {f} * 0.514444D) END")


#: Exported names of the registry's fields.
_RECORD_NAMES = {
    "registration": "Registration", "country": "Country", "type_code": "TypeCode", "type_description": "TypeDescription",
    "type_icao_class": "TypeIcaoClass", "model": "Model", "manufacturer_icao": "ManufacturerIcao",
    "manufacturer_name": "ManufacturerName", "operator_name": "OperatorName", "pia": "Pia", "ladd": "Ladd", "military": "Military",
}


def _altitude(field, kind="Barometric"):
    return _ALTITUDE.format(f=field, t=kind)


def _speed(field, kind):
    return _SPEED.format(f=field, t=kind)


def _fields() -> dict[str, dict[str, str]]:
    i, p, v, a = "identification", "position", "velocity", "autopilot"
    m, c, k, q, d, s = "meteorology", "acas", "capabilities", "data_quality", "dynamics", "status"
    return {
        "Identification": {
            "ICAO": f"{i}.icao", "Callsign": f"{i}.callsign", "Squawk": f"{i}.squawk", "Category": label_sql(f"{i}.category", "category"),
            "EmergencyState": label_sql(f"coalesce({i}.emergency, 0)", "emergency"), "FlightStatus": label_sql(f"{i}.flight_status", "flight_status"),
            "AdsbVersion": label_sql(f"{i}.version", "version"),
        },
        "Status": {
            "FirstSeen": f"{s}.first_seen", "LastSeen": f"{s}.last_seen", "TotalMessages": f"{s}.total_messages",
            "PositionMessages": f"{s}.position_messages", "VelocityMessages": f"{s}.velocity_messages",
            "IdentificationMessages": f"{s}.identification_messages",
            "SignalStrength": f"CASE WHEN {s}.signal > 0 THEN 10.0D * log10({s}.signal / 255.0D) END",
        },
        "Position": {
            "Coordinate": f"CASE WHEN {p}.lat IS NOT NULL THEN named_struct('Latitude', {p}.lat, 'Longitude', {p}.lon) END",
            "BarometricAltitude": _altitude(f"{p}.baro_ft"), "GeometricAltitude": _altitude(f"{p}.geo_ft", "Geometric"),
            "GeometricBarometricDelta": f"{p}.delta_ft", "IsOnGround": f"coalesce({p}.on_ground, false)",
            "MovementCategory": label_sql(f"{p}.movement", "movement"), "Source": label_sql(f"{p}.position_source", "source"),
            "HadMlatPosition": f"{p}.had_mlat", "LastUpdate": f"{p}.position_ts",
        },
        "VelocityAndDynamics": {
            "Speed": _speed(f"{v}.speed_kt", f"{v}.speed_type"), "IndicatedAirspeed": _speed(f"{v}.commb_ias_kt", "'IndicatedAirspeed'"),
            "TrueAirspeed": _speed(f"{v}.commb_tas_kt", "'TrueAirspeed'"), "GroundSpeed": _speed(f"{v}.commb_gs_kt", "'GroundSpeed'"),
            "MachNumber": f"{d}.mach", "Track": f"{v}.track", "TrackAngle": f"{v}.track_angle", "MagneticHeading": f"{d}.magnetic_heading",
            "TrueHeading": f"{d}.true_heading",
            "Heading": f"{v}.heading", "HeadingType": label_sql(f"{q}.heading_type", "heading_type"),
            "HorizontalReference": label_sql(f"{q}.hrd", "hrd"), "VerticalRate": f"{v}.vertical_rate", "BarometricVerticalRate": f"{d}.baro_rate",
            "InertialVerticalRate": f"{d}.inertial_rate", "RollAngle": f"{d}.roll", "TrackRate": f"{d}.track_rate",
            "SpeedOnGround": _speed(f"{v}.ground_speed_kt", "'GroundSpeed'"), "TrackOnGround": f"{v}.ground_track", "LastUpdate": f"{v}.velocity_ts",
        },
        "Autopilot": {
            "AutopilotEngaged": f"{a}.autopilot_engaged", "SelectedAltitude": _altitude(f"{a}.selected_altitude_ft"),
            "AltitudeSource": f"{a}.altitude_source", "SelectedHeading": f"{a}.selected_heading", "BarometricPressureSetting": f"{a}.pressure_mb",
            "VerticalMode": label_sql(f"{a}.vertical_mode", "mode"), "HorizontalMode": label_sql(f"{a}.horizontal_mode", "mode"),
            "VNAVMode": f"{a}.vnav", "LNAVMode": f"{a}.lnav", "AltitudeHoldMode": f"{a}.altitude_hold", "ApproachMode": f"{a}.approach",
            "LastUpdate": f"{a}.autopilot_ts",
        },
        "Meteorology": {
            "WindSpeed": f"{m}.wind_speed_kt", "WindDirection": f"{m}.wind_direction", "TotalAirTemperature": f"{m}.total_temperature", "StaticAirTemperature": f"{m}.static_temperature",
            "Pressure": f"{m}.pressure", "RadioHeight": f"{m}.radio_height_ft", "Turbulence": label_sql(f"{m}.turbulence", "severity"),
            "WindShear": label_sql(f"{m}.wind_shear", "severity"), "Microburst": label_sql(f"{m}.microburst", "severity"),
            "Icing": label_sql(f"{m}.icing", "severity"), "WakeVortex": label_sql(f"{m}.wake_vortex", "severity"),
            "Humidity": f"{m}.humidity", "FigureOfMerit": f"{m}.figure_of_merit", "LastUpdate": f"{m}.weather_ts",
        },
        "Acas": {
            "TCASOperational": f"{c}.tcas_operational", "SensitivityLevel": f"{c}.sensitivity", "CrossLinkCapability": f"{c}.cross_link",
            "ReplyInformation": label_sql(f"{c}.reply_information", "reply_information"), "TCASRAActive_BDS30": f"{c}.tcas_ra_active",
            "TCASRAActive_TC31": f"{k}.ra_active_mode", "ResolutionAdvisoryTerminated": f"{c}.ra_terminated",
            "MultipleThreatEncounter": f"{c}.multiple_threat", "RACNotBelow": f"{c}.not_below", "RACNotAbove": f"{c}.not_above",
            "RACNotLeft": f"{c}.not_left", "RACNotRight": f"{c}.not_right", "LastUpdate": f"{c}.acas_ts",
        },
        "Capabilities": {
            "AdsbVersion": label_sql(f"{i}.version", "version"), "TransponderLevel": label_sql(f"{k}.transponder_level", "transponder_level"),
            "ADSB1090ES": f"{k}.es1090", "UAT978Support": f"{k}.uat978", "LowPower1090ES": f"{k}.low_power", "TCASCapability": f"{k}.tcas_capability",
            "CockpitDisplayTraffic": f"{k}.cockpit_display", "AirReferencedVelocity": f"{k}.air_referenced", "TargetStateReporting": f"{k}.target_reporting",
            "TrajectoryChangeLevel": label_sql(f"{k}.trajectory_level", "trajectory_level"), "PositionOffsetApplied": f"{k}.position_offset",
            "IdentSwitchActive": f"{k}.ident_active", "ReceivingATCServices": f"{k}.atc_services", "LengthMeters": f"{k}.length_m",
            "WidthMeters": f"{k}.width_m", "GPSLateralOffset": f"{k}.gps_lateral_m", "GPSLongitudinalOffset": f"{k}.gps_longitudinal_m",
            "LastUpdate": f"{k}.capabilities_ts",
        },
        "DataQuality": {
            "Antenna_TC918": label_sql(f"{p}.antenna", "antenna"), "Antenna_TC31": label_sql(f"{k}.single_antenna", "antenna"),
            "NACp_TC918": label_sql(f"{p}.nac_p", "nac_p"), "NACp_TC29": label_sql(f"{q}.nac_p_target", "nac_p"),
            "NACv_TC19": label_sql(f"{v}.nac_v", "nac_v"), "NACv_TC31": label_sql(f"{k}.nac_v_report", "nac_v"),
            "NICbaro_TC918": label_sql(f"{p}.nic_baro", "nic_baro"), "NICbaro_TC29": label_sql(f"{q}.nic_baro_target", "nic_baro"),
            "NICSupplementA": f"{q}.nic_a", "NICSupplementC": f"{k}.nic_c", "SIL_TC918": label_sql(f"{p}.sil", "sil"),
            "SIL_TC29": label_sql(f"{q}.sil_target", "sil"), "SILSupplement": label_sql(f"{q}.sil_supplement", "sil_supplement"),
            "GeometricVerticalAccuracy": label_sql(f"{q}.gva", "gva"), "SystemDesignAssurance": label_sql(f"{k}.design_assurance", "design_assurance"),
            "LastUpdate": f"{q}.quality_ts",
        },
    }


#: Sections that are null as a whole when none of the state behind them is known.
OPTIONAL = {"Autopilot": ("autopilot",), "Meteorology": ("meteorology",), "Acas": ("acas",), "Capabilities": ("capabilities",),
            "DataQuality": ("data_quality", "capabilities")}


def to_ndjson(state: DataFrame) -> DataFrame:
    """``icao`` and ``json``: one object with a timestamp and ten sections, nulls written out.

    ``DatabaseRecord`` is null without a registry and has null fields for an address that the registry lacks.
    """
    types = {f.name: f.dataType for f in state.schema.fields}
    sections = []
    for name, fields in _fields().items():
        body = "named_struct(" + ", ".join(f"'{n}', {sql}" for n, sql in fields.items()) + ")"
        if name in OPTIONAL:
            paths = [f"cast({s}.`{f}` as string)" for s in OPTIONAL[name] for f in types[s].names]
            body = f"CASE WHEN coalesce({', '.join(paths)}) IS NOT NULL THEN {body} END"
        sections.append(f"'{name}', {body}")
        if name == "Identification":
            fields = section_fields(state, "database_record")
            record = ", ".join(f"'{_RECORD_NAMES.get(f, f)}', {path}" for f, path in fields.items())
            sections.append("'DatabaseRecord', " + (f"named_struct({record})" if fields else "cast(null as string)"))
    packed = f"named_struct('Timestamp', status.last_seen, {', '.join(sections)})"
    return state.selectExpr("icao", f"to_json({packed}, map('ignoreNullFields', 'false')) AS json")
