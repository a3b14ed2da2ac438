"""Text labels of coded fields, as exported."""

from __future__ import annotations

# Label of every code.
LABELS: dict[str, dict[int, str]] = {
    "category": {
        0: "Reserved", 10: "No Information", 21: "Surface Emergency Vehicle", 23: "Surface Service Vehicle",
        31: "Ground Obstacle (Point)", 32: "Ground Obstacle (Cluster)", 33: "Ground Obstacle (Line)", 40: "No Category",
        41: "Light", 42: "Small", 43: "Large", 44: "High Vortex Large", 45: "Heavy", 46: "High Performance", 47: "Rotorcraft",
    },
    "emergency": {
        0: "No Emergency", 1: "General Emergency", 2: "Lifeguard/Medical", 3: "Minimum Fuel", 4: "No Communications",
        5: "Unlawful Interference", 6: "Downed Aircraft", 7: "Reserved",
    },
    "flight_status": {
        0: "Airborne", 1: "On Ground", 2: "Airborne (Alert)", 3: "On Ground (Alert)", 4: "Alert + SPI", 5: "SPI",
        6: "Reserved", 7: "Not Assigned",
    },
    "version": {0: "DO-260", 1: "DO-260A", 2: "DO-260B"},
    "antenna": {0: "Diversity", 1: "Single"},
    "movement": {
        0: "No Information", 1: "Stopped", 2: "< 0.125 kts", 3: "0.125-1 kts", 4: "1-2 kts", 5: "2-5 kts", 6: "5-10 kts",
        7: "10-15 kts", 8: "15-20 kts", 9: "20-30 kts", 10: "30-40 kts", 11: "40-50 kts", 12: "50-60 kts", 13: "60-70 kts",
        14: "70-80 kts", 15: "80-90 kts", 16: "90-100 kts", 17: "100-110 kts", 18: "110-120 kts", 19: "120-130 kts",
        20: "130-140 kts", 21: "140-150 kts", 22: "150-160 kts", 23: "160-175 kts", 24: "175-199 kts", 124: "≥ 199 kts",
        127: "Reserved",
    },
    "nac_p": {
        0: "Unknown", 1: "< 10 NM", 2: "< 4 NM", 3: "< 2 NM", 4: "< 1 NM", 5: "< 0.5 NM", 6: "< 0.3 NM", 7: "< 0.1 NM",
        8: "< 93 m", 9: "< 30 m", 10: "< 10 m", 11: "< 3 m", 12: "Reserved", 13: "Reserved", 14: "Reserved", 15: "Reserved",
    },
    "nac_v": {
        0: "Unknown", 1: "< 10 m/s", 2: "< 3 m/s", 3: "< 1 m/s", 4: "< 0.3 m/s", 5: "Reserved", 6: "Reserved", 7: "Reserved",
    },
    "sil": {0: "Unknown", 1: "10⁻³ per hour", 2: "10⁻⁵ per hour", 3: "10⁻⁷ per hour"},
    "nic_baro": {0: "Not Cross-Checked", 1: "Cross-Checked"},
    "gva": {0: "Unknown or ≥ 150 m", 1: "< 150 m", 2: "< 45 m", 3: "Reserved"},
    "design_assurance": {0: "Unknown", 1: "Minor", 2: "Major", 3: "Hazardous"},
    "sil_supplement": {0: "Per Hour", 1: "Per Sample"},
    "hrd": {0: "True North", 1: "Magnetic North"},
    "heading_type": {0: "Track", 1: "Heading"},
    "mode": {0: "None", 1: "Acquiring", 2: "Capturing or Maintaining"},
    "severity": {0: "Nil", 1: "Light", 2: "Moderate", 3: "Severe"},
    "trajectory_level": {0: "None", 1: "TC+0 Report Only", 2: "Multiple TC Reports", 3: "Reserved"},
    "transponder_level": {
        0: "Level 1", 1: "Reserved", 2: "Reserved", 3: "Reserved", 4: "Level 2+ (On Ground)", 5: "Level 2+ (Airborne)",
        6: "Level 2+ (On Ground or Airborne)", 7: "DR ≠ 0 or Special Flight Status",
    },
    "reply_information": {
        0: "No ACAS", 2: "RA Capability Inhibited", 3: "Vertical RA Only", 4: "Vertical and Horizontal RA",
        8: "No Max Airspeed Data", 9: "Max Airspeed < 75 kts", 10: "Max Airspeed 75-150 kts", 11: "Max Airspeed 150-300 kts",
        12: "Max Airspeed 300-600 kts", 13: "Max Airspeed 600-1200 kts", 14: "Max Airspeed > 1200 kts",
    },
    "source": {"Sdr": "SDR", "Beast": "Beast", "Mlat": "MLAT"},
}


def label_sql(value: str, kind: str) -> str:
    """The label of a code as SQL text; codes without one give null."""
    def literal(code):
        return f"'{code}'" if isinstance(code, str) else str(code)

    cases = " ".join(f"WHEN {literal(code)} THEN '{text}'" for code, text in LABELS[kind].items())
    return f"(CASE {value} {cases} END)"
