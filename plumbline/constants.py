"""Values that results depend on."""

from __future__ import annotations

# ---- fixed values: statuses, sentinel, check vocabulary, thresholds ---------

PASS = "PASS"
WARN = "WARN"
FAIL = "FAIL"
NOT_RUN = "NOT_RUN"
UNKNOWN = "UNKNOWN"

ACTIVE_EXPIRY = "9999-12-31 23:59:59"

FRESHNESS = "FRESHNESS"
VOLUME = "VOLUME"
SCHEMA = "SCHEMA"
OPS = "OPS"
SLA_COUNTDOWN = "SLA_COUNTDOWN"
ZERO_ROW = "ZERO_ROW"
BREAKING_CHANGE = "BREAKING_CHANGE"
DISTRIBUTION = "DISTRIBUTION"
TIMESTAMP_SANITY = "TIMESTAMP_SANITY"
CLASSIFICATION_WEIGHTED = "CLASSIFICATION_WEIGHTED"
SOURCE_SYSTEM_HEALTH = "SOURCE_SYSTEM_HEALTH"
CORRELATION = "CORRELATION"
INFERRED_SLA = "INFERRED_SLA"
LINEAGE = "LINEAGE"
ORPHAN_DETECTION = "ORPHAN_DETECTION"
CROSS_DESTINATION = "CROSS_DESTINATION"
DQS_SCORE = "DQS_SCORE"

CHECK_TYPES = (
    FRESHNESS, VOLUME, SCHEMA, OPS, SLA_COUNTDOWN, ZERO_ROW, BREAKING_CHANGE,
    DISTRIBUTION, TIMESTAMP_SANITY, CLASSIFICATION_WEIGHTED,
    SOURCE_SYSTEM_HEALTH, CORRELATION, INFERRED_SLA, LINEAGE,
    ORPHAN_DETECTION, CROSS_DESTINATION, DQS_SCORE,
)

# check type -> the detail row that carries its status
SCORED_DETAILS = {
    FRESHNESS: "freshness_status",
    VOLUME: "volume_status",
    SCHEMA: "schema_status",
    OPS: "ops_status",
}
DEFAULT_WEIGHTS = {FRESHNESS: 0.30, VOLUME: 0.30, SCHEMA: 0.20, OPS: 0.20}
STATUS_SCORES = {PASS: 100.0, WARN: 50.0, FAIL: 0.0}
SCORE_PASS_AT = 80.0
SCORE_WARN_AT = 50.0

BASELINE_ROWS = 30
#: Values kept per metric between batches: a baseline and ten days that may run again.
KEPT_ROWS = 40
BASELINE_MIN_SAMPLES = 2

PERCENTILE_ACCURACY = 10000
Z_WARN = 2.0
Z_FAIL = 3.0

FUTURE_TOLERANCE_DAYS = 1
MAX_AGE_YEARS = 10
BAD_TIMESTAMP_SHARE = 0.05

SLA_WARN_SHARE = 0.20
INFERRED_SLA_DAYS = 30
INFERRED_SLA_MIN_POINTS = 7
INFERRED_SLA_SIGMAS = 2.0
INFERRED_SLA_TIE = 1e-12               # share of the limit that counts as no difference

SOURCE_HEALTH_DAYS = 7
SOURCE_HEALTH_FAIL_BELOW = 60.0
SOURCE_HEALTH_WARN_BELOW = 75.0

CORRELATION_DAYS = 8
CORRELATION_DROP = 10.0
CORRELATION_FAIL_AT = 0.50
CORRELATION_WARN_AT = 0.25

UPSTREAM_FAIL_BELOW = 60.0
DESTINATION_MAX_DEVIATION = 15.0

CLASSIFICATION_MULTIPLIERS = {"Tier 1 Critical": 2.0, "Tier 2 Standard": 1.0}
OTHER_CLASSIFICATION_MULTIPLIER = 0.5

TIME_RANGES = {"7d": 7, "30d": 30, "90d": 90}
TREND_DIRECTION_POINTS = 2.0
SCORE_BANDS = (80.0, 60.0)
DATA_AGE_STALE_HOURS = 24
SEARCH_LIMIT = 10
PATH_PREFIX = "/prod/datalake/"

# ---- end of fixed values -----------------------------------------------------

KEYS = ("dataset_name", "partition_date")
SEVERITY = {PASS: 0, WARN: 1, FAIL: 2}
