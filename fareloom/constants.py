"""Fixed values of the price-index domain, stated once."""

#: Market share of each carrier, and of one that is not listed.
CARRIER_SHARES = {"6E": 0.60, "AI": 0.15, "IX": 0.10, "QP": 0.10, "SG": 0.05}
UNKNOWN_SHARE = 0.01
#: Share of each booking window in a composite fare.
WINDOW_WEIGHTS = {"T+1": 0.20, "T+7": 0.32, "T+15": 0.26, "T+30": 0.14, "T+45": 0.08}
#: Base-fare ratio where nothing was measured: of the route plus the carrier's offset, else of the carrier, else the
#: default; kept inside the clamp.
CARRIER_BASE_RATIO = {"6E": 0.78, "AI": 0.81, "IX": 0.76, "QP": 0.76, "SG": 0.74}
CARRIER_BASE_OFFSET = {"6E": 0.00, "AI": 0.03, "IX": -0.02, "QP": -0.02, "SG": -0.04}
ROUTE_BASE_RATIO = {
    "DEL-BOM": 0.78,
    "BOM-DEL": 0.78,
    "DEL-BLR": 0.81,
    "BLR-DEL": 0.81,
    "BOM-BLR": 0.74,
    "BLR-BOM": 0.74,
    "DEL-HYD": 0.77,
    "HYD-DEL": 0.77,
    "DEL-CCU": 0.78,
    "CCU-DEL": 0.78,
    "DEL-MAA": 0.81,
    "MAA-DEL": 0.81,
    "BLR-HYD": 0.72,
    "HYD-BLR": 0.72,
}
DEFAULT_BASE_RATIO = 0.78
BASE_RATIO_CLAMP = (0.60, 0.90)
#: Names of carriers; one that is not listed goes by its code.
CARRIER_NAMES = {"6E": "IndiGo", "AI": "Air India", "IX": "Air India Express", "QP": "Akasa Air", "SG": "SpiceJet", "UK": "Vistara"}
#: Portals that belong to a carrier; every other portal is an agency.
DIRECT_PORTALS = {"indigo": "6E", "spicejet": "SG", "airindia": "AI"}
#: Portal names that are a carrier's own whatever the carrier, and the brand in the names of a carrier's own portals.
DIRECT_SITES = ["indigo", "spicejet", "airindia", "air_india", "akasa", "akasa_air", "vistara", "6e", "sg", "ai", "qp", "uk", "airline_direct", "direct", "carrier_direct"]
CARRIER_SITES = {"6E": "indigo", "SG": "spicejet", "AI": "air_india", "QP": "akasa", "UK": "vistara"}
#: Spellings of a flight status (lower case, with underscores) and the canonical one.
STATUS_ALIASES = {
    "scheduled": "scheduled",
    "schedule": "scheduled",
    "cancelled": "cancelled",
    "canceled": "cancelled",
    "sold_out": "sold_out",
    "soldout": "sold_out",
}
#: Statuses of a collection run that are failures; every other one, unknown ones included, is a success.
FAILED_STATUSES = ("FAILED", "ERROR", "TIMEOUT", "BLOCKED", "BANNED", "RATE_LIMITED", "CAPTCHA")
#: Labels that cite nothing.
BARE_SOURCES = ("mospi", "mospi_official", "nso", "official")
#: Values of the reference series that were withdrawn, by column and month.
WITHDRAWN = {
    "headline_cpi": {"2024-01": 185.2, "2025-12": 195.8, "2026-01": 196.4},
    "cpi_transport_index": {"2024-01": 174.5},
}
NOT_PAYABLE = ("cancelled", "sold_out")
#: Weights and normalisers of the surge score, its levels, the thresholds of its rules and their codes.
SURGE_WEIGHTS = {"z": 0.35, "multiple": 0.25, "dod": 0.20, "outlier": 0.10, "concentration": 0.10}
SURGE_NORMS = {"z": 3.5, "multiple": 1.5, "dod": 0.50, "concentration": 0.50}
SURGE_LEVELS = {"critical": 0.65, "warning": 0.35}
DOD_WARNING = 0.25
VIOLATION_CODES = {
    "sigma": "DGCA_CAR_SECTION_3_SERIES_M_3SIGMA",
    "dod": "DGCA_CAR_SERIES_M_EXCESSIVE_DOD",
    "multiple": "DGCA_CAR_TARIFF_CEILING_BREACH",
    "concentration": "DGCA_ANTI_COMPETITIVE_SURGE",
}
#: Baseline of a route and window without one: mean, deviation and previous fare.
DEFAULT_BASELINE = (5000.0, 500.0, 5000.0)
#: Concentration where none is measured: of the daily run, and of the carriers' shares (the sum of their squares, four places).
DAILY_HHI = 0.42
SHARES_HHI = round(sum(share**2 for share in CARRIER_SHARES.values()), 4)
Z_WARNING, Z_CRITICAL, DOD_CRITICAL, MULTIPLE_LIMIT, HHI_LIMIT, HHI_Z = 2.0, 3.0, 0.40, 2.50, 0.40, 2.5
EPSILON = 1e-9

#: Cities as traffic tables spell them, and their airports.
CITY_CODES = {"DELHI": "DEL", "MUMBAI": "BOM", "BENGALURU": "BLR", "BANGALORE": "BLR", "KOLKATA": "CCU", "CALCUTTA": "CCU", "HYDERABAD": "HYD", "CHENNAI": "MAA", "MADRAS": "MAA"}
