"""Declared schemas; nothing in the library infers one."""

from __future__ import annotations

from pyspark.sql import types as T

# lane/station type codes.
STATION_TYPES = [
    (1, "CD", "Coll/Dist"),
    (2, "CH", "Conventional Highway"),
    (3, "FF", "Fwy-Fwy connector"),
    (4, "FR", "Off Ramp"),
    (5, "HV", "HOV"),
    (6, "ML", "Mainline"),
    (7, "OR", "On Ramp"),
]
LANE_TYPES = ["CD", "CH", "FF", "FR", "HV", "ML", "OR"]
DIRECTIONS = ["N", "E", "S", "W"]

# The two direction encodings in use (codes for N, E, S, W).
DIRECTION_FROM_ONE = {"N": 1, "S": 2, "E": 3, "W": 4}
DIRECTION_FROM_ZERO = {"N": 0, "E": 1, "S": 2, "W": 3}

MEASURES = ["total_flow", "occupancy", "speed"]
PROFILE_KEYS = ["station_id", "district_id", "year", "day_of_year", "day_of_week", "direction"]

TIME_FORMAT = "MM/dd/yyyy HH:mm:ss"


def fields(spec: str) -> T.StructType:
    """``"a int, b double"`` as a schema, without needing a session."""
    kinds = {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(),
             "string": T.StringType(), "date": T.DateType()}
    pairs = [item.split() for item in spec.split(",")]
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in pairs])


STATION_META = fields(
    "id long, fwy int, dir string, district int, county int, city int, state_pm string, "
    "abs_pm double, latitude double, longitude double, length double, type string, lanes int, "
    "name string, user_id_1 string, user_id_2 string, user_id_3 string, user_id_4 string")

INCIDENTS = fields(
    "id int, cc_code string, incident_num string, timestamp string, description string, "
    "location string, area string, zoom_map string, tb_xy string, latitude double, "
    "longitude double, district int, county_fips_id int, city_fips_id int, freeway_num int, "
    "freeway_dir string, state_pm string, absolute_pm double, severity string, duration int")

STATION_TYPE_LOOKUP = fields("id int, type string, description string")
ZIP_DENSITY = fields("zip long, density double")


def slot_label(slot: int, minutes: int = 5) -> str:
    """Slot number to ``HHMM``."""
    total = slot * minutes
    return f"{total // 60:02d}{total % 60:02d}"


def wide_columns(measure: str, slots: int = 288) -> list[str]:
    """``total_flow_0000`` ... for one measure; the slots divide the day evenly."""
    minutes = 1440 // slots
    return [f"{measure}_{slot_label(s, minutes)}" for s in range(slots)]


def wide_profile(measures=tuple(MEASURES), slots: int = 288) -> T.StructType:
    """Six integer keys, then one double per measure and slot."""
    keys = [T.StructField(k, T.IntegerType()) for k in PROFILE_KEYS]
    cells = [T.StructField(c, T.DoubleType()) for m in measures for c in wide_columns(m, slots)]
    return T.StructType(keys + cells)


def projected(k: int) -> T.StructType:
    """Six keys stored as doubles, then the coefficients ``V0`` ... ``V{k-1}``."""
    names = PROFILE_KEYS + [f"V{i}" for i in range(k)]
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])
