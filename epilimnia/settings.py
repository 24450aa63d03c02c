"""Fixed values of the study: names, codes, limits and windows. They must stay as they are for right results."""

from __future__ import annotations

from datetime import date

import pyarrow as pa

TREATED = "FCR"
CONTROL = "BVR"
SITES = (TREATED, CONTROL)
MAIN_STATION = 50

# fixed values: sensor column -> standard variable name
SENSOR_NAMES = {
    "EXOTemp_C_1": "Temp_C",
    "EXOSpCond_uScm_1": "SpCond_uScm",
    "EXOChla_ugL_1": "Chla_ugL",
    "EXOfDOM_QSU_1": "fDOM_QSU",
}
# fixed values: oxygen columns, and the depth of the multi-probe by site
OXYGEN_COLUMNS = ("RDO_mgL_9_adjusted", "RDO_mgL_13", "EXODO_mgL_1", "EXODO_mgL_1.5")
PROBE_DEPTH = {TREATED: 1.6, CONTROL: 1.5}

# fixed values: excluded quality codes
SENSOR_BAD_FLAGS = (9, 7, 2, 1, 5, 3)
SAMPLE_BAD_FLAGS = (9, 5, 2)
METALS_BAD_FLAGS = (8, 68)

# fixed values: sample-table names
SAMPLE_NAMES = {"Reservoir": "site_id", "Depth_m": "depth_m", "DateTime": "datetime"}

# fixed values: sampling rate and completeness limits
SAMPLES_PER_DAY = 144
STEP_SECONDS = 600
MIN_N_CONTROL = SAMPLES_PER_DAY // 3
MIN_N_TREATED_CURRENT = SAMPLES_PER_DAY // 2
MIN_N_TREATED_HISTORIC = 6 // 2

# fixed values: layer boundaries and tolerances
LAYER_BOUNDARY = {TREATED: 4.0, CONTROL: 5.0}
TRAP_BOUNDARY = 5.0
FE_TOLERANCE = -0.02
MN_TOLERANCE = -0.06

# fixed values: sensors were moved on this day; offset columns before and after
SENSORS_MOVED_ON = "2021-04-05"
OFFSET_BEFORE = "Offset_before_05APR21"
OFFSET_AFTER = "Offset_after_05APR21"

# fixed values: season with active treatment, by year
ACTIVE_WINDOWS = [
    {"Year": 2018, "start": date(2018, 4, 23), "end": date(2018, 8, 12)},
    {"Year": 2019, "start": date(2019, 6, 3), "end": date(2019, 11, 20)},
    {"Year": 2020, "start": date(2020, 6, 29), "end": date(2020, 12, 2)},
    {"Year": 2021, "start": date(2021, 6, 11), "end": date(2021, 12, 6)},
    {"Year": 2022, "start": date(2022, 5, 19), "end": date(2022, 12, 12)},
    {"Year": 2023, "start": date(2023, 3, 6), "end": date(2023, 12, 4)},
]
ACTIVE_SCHEMA = pa.schema([("Year", pa.int32()), ("start", pa.date32()), ("end", pa.date32())])

# fixed values: phases before turnover in 2018, when only part of the season is comparable
PHASE_WINDOWS = [
    {"Reservoir": TREATED, "Layer": "Epilimnion", "start": date(2018, 1, 1), "end": date(2018, 9, 1), "phase": "Pre_"},
    {"Reservoir": TREATED, "Layer": "Hypolimnion", "start": date(2018, 1, 1), "end": date(2018, 7, 21), "phase": "Pre_"},
    {"Reservoir": TREATED, "Layer": "Epilimnion", "start": date(2018, 9, 2), "end": date(2018, 10, 21), "phase": "Pre"},
    {"Reservoir": TREATED, "Layer": "Hypolimnion", "start": date(2018, 7, 22), "end": date(2018, 10, 21), "phase": "Pre"},
    {"Reservoir": CONTROL, "Layer": "Epilimnion", "start": date(2018, 9, 6), "end": date(2018, 10, 21), "phase": "Pre"},
    {"Reservoir": CONTROL, "Layer": "Hypolimnion", "start": date(2018, 8, 1), "end": date(2018, 10, 21), "phase": "Pre"},
]
PHASE_SCHEMA = pa.schema(
    [
        ("Reservoir", pa.string()),
        ("Layer", pa.string()),
        ("start", pa.date32()),
        ("end", pa.date32()),
        ("phase", pa.string()),
    ]
)

# fixed values: turnover days added by hand
EXTRA_TURNOVERS = [
    {"datetime": date(2018, 10, 24), "Reservoir": CONTROL, "Year": 2018},
    {"datetime": date(2019, 11, 2), "Reservoir": CONTROL, "Year": 2019},
]
TURNOVER_SCHEMA = pa.schema([("datetime", pa.date32()), ("Reservoir", pa.string()), ("Year", pa.int32())])

# fixed values: handheld oxygen used where loggers are missing: site, depth, first day, last day
HANDHELD_WINDOWS = [
    (CONTROL, 10.0, date(2018, 5, 4), date(2018, 12, 5)),
    (CONTROL, 10.0, date(2019, 5, 18), date(2020, 3, 14)),
    (TREATED, 9.0, date(2018, 1, 1), date(2018, 8, 18)),
]

# fixed values: rows without a value that break the oxygen line
OXYGEN_BREAKS = [
    {"Reservoir": CONTROL, "Site": 50, "Date": date(2020, 1, 1), "Year": 2020, "Depth_m": "10", "Method": "edi.725.5"},
    {"Reservoir": CONTROL, "Site": 50, "Date": date(2020, 5, 15), "Year": 2020, "Depth_m": "10", "Method": "edi.198.13"},
]
BREAKS_SCHEMA = pa.schema(
    [
        ("Reservoir", pa.string()),
        ("Site", pa.int32()),
        ("Date", pa.date32()),
        ("Year", pa.int32()),
        ("Depth_m", pa.string()),
        ("Method", pa.string()),
    ]
)

# fixed values: colour-scale limits of the day x depth figures
SCALE_LIMITS = {
    "Temp_C": (-1.0, 30.0),
    "DO_mgL": (-1.0, 16.0),
    "pH": (5.5, 10.5),
    "Turbidity_NTU": (0.0, 100.0),
    "TMn_mgL": (0.0, 2.5),
    "SMn_mgL": (0.0, 2.5),
    "TFe_mgL": (0.0, 20.0),
    "SFe_mgL": (0.0, 20.0),
    "Fe_ratio": (0.0, 1.0),
    "Mn_ratio": (0.0, 1.0),
}

# fixed values: spans and thresholds
SPAN = ("2018-01-01", "2024-01-01")
DENSITY_DIFF = 0.1
MIN_ROWS_PER_YEAR = 300
TURNOVER_AFTER_DAY = 200
ONSET_MIN_DAYS = 7
GRID_STEP = 0.5
GRID_MIN_DEPTH = 0.1
MAX_TURBIDITY = 100.0

# fixed values: first year and wrong readings of the buoyancy comparison
BUOYANCY_SINCE = 2021
WRONG_PROFILE_POINTS = [{"site_id": CONTROL, "datetime": date(2022, 6, 21), "depth_m": 0.0}]
# fixed values: depths that a cast of these waters can have
DEPTH_RANGE = (0.0, 100.0)
