"""Constants of the domain; fixed values."""

STALE_AFTER_S = 10_800
HORIZONS = (15, 30, 45)
LABEL_TOLERANCE = 7.5
NEIGHBOUR_M, WALK_M, DETOUR = 300.0, 500.0, 1.3
LAGS, LAG_TOLERANCE = (15, 30, 60), 7.5
SLOT_MIN = 15
TRIP_MIN, TRIP_MAX = 1.0, 180.0
PEAK_FROM, PEAK_TO = 510, 630
PEAK_SLOTS = (34, 41)
SATURATED = 0.10
BIKE_KMH, WALK_KMH, MIN_PAIR_TRIPS, MAX_TRIP_MIN = 12.0, 4.8, 20, 90.0
PICKUP_M, PICKUPS = 600.0, 4
EARTH_M = 6_371_000.0
EPS = 1e-6
#: Where holidays and mornings are those of the place; six hours behind UTC all year since 2022.
ZONE = "America/Mexico_City"
#: Minutes that live features look back.
LOOKBACK_MIN = 69.5
HOLIDAYS = (
    "2024-01-01", "2024-02-05", "2024-03-18", "2024-03-28", "2024-03-29", "2024-05-01", "2024-09-16", "2024-10-01", "2024-11-18", "2024-12-25",
    "2025-01-01", "2025-02-03", "2025-03-17", "2025-04-17", "2025-04-18", "2025-05-01", "2025-09-16", "2025-11-17", "2025-12-25",
    "2026-01-01", "2026-02-02", "2026-03-16", "2026-04-02", "2026-04-03", "2026-05-01", "2026-09-16", "2026-11-16", "2026-12-25",
)
#: Periods of a model's life by local day, both ends included; days between them are left out everywhere.
PERIODS = (
    ("train", "2024-09-01", "2025-06-30"), ("fit", "2025-08-01", "2025-09-30"), ("report", "2025-10-01", "2025-12-31"),
    ("test", "2026-01-01", "2026-01-31"), ("test_late", "2026-09-11", "2026-09-30"),
)
