"""Values fixed by the field trial: bounds, clock steps, seasons, unit factors, nutrient analyses.

Everything here is data that results depend on; operators take these as default arguments and any
of them can be replaced by the caller.
"""

from __future__ import annotations

import math

# fixed values: experiment layout
STRIPS = ("S1", "S2", "S3", "S4")
LOCATIONS = ("T", "M", "B")
DEPTHS = ("1", "2", "3")
STRIP_PAIRS = (("S1", "S2"), ("S3", "S4"))
DEPTH_INCHES = {"1": 6, "2": 12, "3": 18}
GROUP_STRIPS = {"S1_S2": ("S1", "S2"), "S3_S4": ("S3", "S4")}

# fixed values: sentinels and bounds (VWC in percent, T in Fahrenheit, EC in dS/m)
SENTINEL = 10000.0
BOUNDS = {
    "VWC": (1.0, 80.0),
    "T": (-30.0, 110.0),
    "EC": (-0.05, 20.0),
}
RAW_BOUNDS_BATTERY = (11.0, 13.0)

# fixed values: soil cylinder seen by one probe, ratio guard
CYLINDER_M3 = math.pi * 0.04 * 0.04 * 0.10
LITRES_PER_GALLON = 3.78541
CYLINDER_L = CYLINDER_M3 * 1000.0
CYLINDER_GAL = CYLINDER_L / LITRES_PER_GALLON
RATIO_EPS = 1e-3

# fixed values: field geometry used for rates
STRIP_WIDTH_FT = 47.0
STRIP_LENGTH_FT = 370.0
ACRE_FT2 = 43560.0
GALLONS_PER_FT3 = 7.48052
GALLONS_PER_FT3_PROFILE = 7.48051945

# fixed values: clock corrections per logger, (from this time on, minutes to add), applied in order
CLOCK_STEPS = {
    "S1B": [("2024-02-23 15:30:00", 60)],
    "S1M": [("2024-02-23 15:15:00", 60)],
    "S1T": [("2024-02-23 10:45:00", 60)],
    "S2B": [("2024-02-23 15:45:00", 60)],
    "S2M": [("2026-02-23 08:45:00", 60)],
    "S2T": [("2024-04-02 16:00:00", -60)],
    "S3B": [("2023-04-28 10:45:00", -60), ("2024-03-28 17:15:00", -120), ("2026-02-23 08:45:00", -60)],
    "S3M": [("2023-09-04 10:30:00", -60), ("2024-07-07 06:30:00", -120), ("2025-01-16 23:45:00", -180)],
    "S3T": [("2024-02-23 11:30:00", 60)],
    "S4B": [("2023-09-04 10:30:00", -60), ("2023-09-20 18:30:00", -120), ("2026-02-23 09:00:00", -60)],
    "S4M": [("2024-02-23 14:30:00", 60)],
    "S4T": [("2024-02-23 11:45:00", 60)],
}

# fixed values: default seasons, month-day bounds
SEASONS = (
    {"code": "Q1_Winter", "label": "Winter", "start": "11-01", "end": "03-31"},
    {"code": "Q2_Early_Growing", "label": "Growing Season", "start": "04-01", "end": "10-31"},
)

# fixed values: event search, plateau, target and battery limits
BASELINE_HOURS = 2.0
PEAK_HOURS = 24.0
MIN_PEAK_INCREASE = 0.5
PLATEAU_HOURS = 16.0
PLATEAU_POINTS = 4
PLATEAU_SLOPE = 0.12
PLATEAU_RUN = 4
FALLBACK_HOURS = 4.0
TARGET_K = 0.5
TARGET_MIN_EVENTS = 3
TARGET_CAP = 0.95
BATTERY_OK = (11.0, 13.0)
MIN_RESPONSE_DELAY_HOURS = 0.5
PRE_START_HOURS = 6.0
MIN_RAIN_IN = 0.01
