"""Fixed values of the data model: bounds, rules and code lists of vessel position reports."""

from pyspark.sql import types as T

# Bounds and rules.
LON_MIN, LON_MAX = 5.0, 17.0
LAT_MIN, LAT_MAX = 54.0, 59.0
SPEED_MAX = 30.0
COG_MAX = 360.0
KNOT = 0.514444
GAP_S = 7200
LEAST_ROWS, LEAST_S = 20, 4 * 3600
TICK_S = 300
CHUNK_TICKS, LEAST_TICKS = 288, 48
SLOW_KNOTS, SLOW_SHARE = 2.0, 0.8
EDGE_REACH, EDGE_LEAST_S = 4, 2
CAP = 0.9999
DEFAULT_TYPE = 59
UNKNOWN_NAV = 15
CLS, SEP, IGNORED = -1.0, -2.0, -100.0
#: Rows of a sequence with its first and last: no trajectory of ``CHUNK_TICKS`` steps is cut.
MAX_LEN = 512

# Navigational status texts and their codes.
NAV_STATUS = {
    "Under way using engine": 0,
    "At anchor": 1,
    "Not under command": 2,
    "Restricted maneuverability": 3,
    "Constrained by her draught": 4,
    "Moored": 5,
    "Aground": 6,
    "Engaged in fishing": 7,
    "Under way sailing": 8,
    "Reserved for future amendment [HSC]": 9,
    "Reserved for future amendment [WIG]": 10,
    "Power-driven vessel towing astern": 11,
    "Power-driven vessel pushing ahead or towing alongside": 12,
    "Reserved for future use": 13,
    "Unknown value": 15,
}

# Ship type texts and their codes.
SHIP_TYPE = {
    "Cargo": 70,
    "Tanker": 80,
    "Fishing": 30,
    "Passenger": 60,
    "HSC": 40,
    "Tug": 52,
    "Towing": 31,
    "Sailing": 37,
    "Pleasure": 36,
    "Pilot": 50,
    "SAR": 51,
    "Diving": 33,
    "Dredging": 34,
    "Law enforcement": 56,
    "Military": 35,
    "Medical": 57,
    "Anti-pollution": 55,
    "Port tender": 58,
    "WIG": 20,
    "Other": 59,
    "Undefined": 0,
    "Spare 1": 0,
    "Spare 2": 0,
    "Reserved": 9,
    "Not party to conflict": 59,
}

VESSEL_CLASSES = ("Cargo", "Tanker", "Fishing", "Sailing/Pleasure", "Other")

RAW = T.StructType(
    [
        T.StructField("# Timestamp", T.StringType()),
        T.StructField("MMSI", T.LongType()),
        T.StructField("Latitude", T.DoubleType()),
        T.StructField("Longitude", T.DoubleType()),
        T.StructField("Navigational status", T.StringType()),
        T.StructField("ROT", T.DoubleType()),
        T.StructField("SOG", T.DoubleType()),
        T.StructField("COG", T.DoubleType()),
        T.StructField("Heading", T.LongType()),
        T.StructField("Ship type", T.StringType()),
    ]
)
