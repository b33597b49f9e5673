"""Thresholds of the engine, in one place. Results depend on every one of them."""

from __future__ import annotations

#: Metres. Clustering and evidence use the first radius, dispersion features the second.
EARTH_RADIUS_M = 6_371_000.0
FEATURE_EARTH_RADIUS_M = 6_371_008.8
CLUSTER_RADIUS_M = 750.0
CLUSTER_MIN_POINTS = 3
EVIDENCE_RADIUS_KM = 10.0

#: Identity: probability bands.
LOW, CORE, STRONG, RESCUE = 0.405, 0.885, 0.975, 0.965

#: Temporal state, in days (months for the third of PERSISTENT).
RECENT_DAYS, DORMANT_DAYS, GAP_DAYS, PERSISTENT_LIFETIME = 30, 90, 90, 90
PERSISTENT_MONTHS, PERSISTENT_DAYS = 3, 6
STATES = ("REACTIVATED", "NEW", "PERSISTENT", "DORMANT", "INTERMITTENT")

#: Anomaly: history that is needed, recursions, severity bands.
MIN_HISTORY, MIN_SPAN_DAYS, MIN_GAPS = 5, 30, 3
EWMA_ALPHA, CUSUM_K, CUSUM_CAP, RESET_GAP_DAYS, Z_CAP = 0.35, 2.0, 50.0, 30, 20.0
ELEVATED, ANOMALOUS, CRITICAL = 0.95, 0.99, 0.999
MAD_SCALE, IQR_SCALE, SCALE_FLOOR, SCALE_SHARE, SCALE_LEAST = 1.4826, 1.349, 1e-4, 0.05, 1e-3
GROUPS = ("intensity", "density", "recurrence_burst", "change")

#: Decision.
SEVERITIES = ("NONE", "INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
STACK_VERSION = "2026-09-04-r1"

#: What an alert says.
HEADLINES = {
    "CRITICAL_INDUSTRIAL_ANOMALY": "Critical thermal anomaly detected at industrial facility",
    "INDUSTRIAL_REACTIVATION_ANOMALY": "Industrial site thermally abnormal after extended dormancy",
    "HIGH_INDUSTRIAL_ANOMALY": "Significant thermal anomaly detected at industrial facility",
    "UNKNOWN_CRITICAL_REVIEW": "Urgent analyst review required: critical thermal anomaly at unclassified source",
    "UNKNOWN_ANOMALY_REVIEW": "Unclassified thermal source exhibiting anomalous behavior",
    "INDUSTRIAL_ELEVATION": "Elevated thermal activity observed at industrial site",
    "NEW_SOURCE_REVIEW": "New thermal source identified; awaiting baseline accumulation",
    "NORMAL_INDUSTRIAL_OPERATION": "Industrial facility operating within expected thermal baseline",
    "NONINDUSTRIAL_ACTIVITY": "Non-industrial thermal activity detected",
    "NO_ALERT": "Thermal observations consistent with background activity",
}

#: Sources: the one that is preferred, and those that deliver the same observations.
LIVE_SOURCE, ARCHIVE_SOURCE = "VIIRS_NOAA20_NRT", "VIIRS_NOAA20_SP"
FAMILY = (ARCHIVE_SOURCE, LIVE_SOURCE)

#: Identity features, in the model's order.
FEATURES = (
    "mean_frp", "median_frp", "max_frp", "std_frp", "frp_cv", "frp_p10", "frp_p25", "frp_p75", "frp_p90", "frp_iqr", "night_ratio",
    "detections", "active_days", "source_lifetime_days", "active_days_7", "active_days_30", "active_days_90", "active_days_365", "mean_recurrence_gap_days", "median_recurrence_gap_days", "detections_per_active_day",
    "spatial_median_m", "spatial_p90_m", "spatial_std_m",
    "tree_fraction", "shrub_fraction", "grass_fraction", "crop_fraction", "built_fraction", "bare_fraction", "water_fraction", "wetland_fraction", "mangrove_fraction",
)

#: Land cover: class code and feature name.
LAND_COVER = {10: "tree", 20: "shrub", 30: "grass", 40: "crop", 50: "built", 60: "bare", 80: "water", 90: "wetland", 95: "mangrove"}
