"""Data model: schemas, fixed domain values and argument checks."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. These names, thresholds and orders must equal the source
# application's so that results agree; they are stated here once, plainly.
# ---------------------------------------------------------------------------
GEO_KEYS = ("country", "city", "zone")
DIMENSIONS = ("country", "city", "zone", "zone_type", "zone_prioritization")
GRAIN_KEYS = ("country", "city", "zone", "metric", "week")
AGGREGATIONS = ("mean", "sum", "min", "max", "median", "count")
SORT_ORDERS = ("asc", "desc")
CONDITION_OPERATORS = ("high", "low", "gt", "lt", "eq")
LOGICAL_OPERATORS = ("and", "or")
ORDERS_METRIC = "Orders"
MIN_WEEK, MAX_WEEK = 0, 8
# group_by drill-down when the grouping dimension is also fixed in filters
DRILL_DOWN = {
    "country": "city",
    "city": "zone",
    "zone": "zone_type",
    "zone_type": "zone_prioritization",
}
# metrics where a rising value is a deterioration
LOWER_IS_BETTER = ("Restaurants Markdowns / GMV", "Non-Pro PTC > OP")
# metric pairs checked for correlation, in this order
CORRELATION_PAIRS = (
    ("Lead Penetration", "Perfect Orders"),
    ("Perfect Orders", "Orders"),
    ("Gross Profit UE", "Orders"),
)
# insight categories in detector order, and their priority bonus
CATEGORIES = ("anomalies", "trends", "benchmarking", "correlations", "opportunities")
CATEGORY_BONUS = {
    "opportunities": 8.0,
    "trends": 7.0,
    "anomalies": 6.0,
    "benchmarking": 5.0,
    "correlations": 4.0,
}
CATEGORY_TITLES = (
    ("anomalies", "Anomalies"),
    ("trends", "Concerning Trends"),
    ("benchmarking", "Benchmarking"),
    ("correlations", "Correlations"),
    ("opportunities", "Opportunities"),
)
# data-quality rules
CRITICAL_FIELDS = ("country", "city", "zone", "metric", "week", "value")
WEEK_LABEL_PATTERN = r"^l[0-8]w(_roll)?$"
NULL_CRITICAL_RATIO = 0.05
# week columns of the wide exports: L<n>W or L<n>W_ROLL (after canonical naming)
WEEK_COLUMN_PATTERN = r"^l(\d+)w(_roll)?$"
# numbers accepted when coercing text to double (after trimming)
NUMERIC_TEXT_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
# metric display formats (value_format, decimals); everything else: number, 2
METRIC_DISPLAY = {
    "Perfect Orders": ("percentage_ratio", 2),
    "Lead Penetration": ("number", 2),
    "Gross Profit UE": ("number", 2),
    "Orders": ("integer", 0),
}
DEFAULT_DISPLAY = ("number", 2)

# ---------------------------------------------------------------------------
# Schemas of the long tables.
# ---------------------------------------------------------------------------
METRICS_LONG_COLUMNS = (
    "country", "city", "zone", "zone_type", "zone_prioritization",
    "metric", "week", "week_label", "value",
)
ORDERS_LONG_COLUMNS = ("country", "city", "zone", "metric", "week", "week_label", "value")
FEATURE_COLUMNS = (
    "country", "city", "zone", "metric",
    "current_value", "value_1w_ago", "value_5w_ago", "delta_1w", "delta_5w",
)

METRICS_LONG_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in METRICS_LONG_COLUMNS[:6]]
    + [
        T.StructField("week", T.IntegerType()),
        T.StructField("week_label", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)
ORDERS_LONG_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ORDERS_LONG_COLUMNS[:4]]
    + [
        T.StructField("week", T.IntegerType()),
        T.StructField("week_label", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def require_columns(df, columns, context: str) -> None:
    """Refuse at plan time, before any job, a frame without all of ``columns``."""
    absent = sorted(set(columns) - set(df.columns))
    if absent:
        raise ValueError(f"{context}: no column named {', '.join(absent)} (there are {', '.join(df.columns)})")


def check_choice(name: str, value, allowed) -> str:
    text = str(value).strip().lower()
    if text not in allowed:
        raise ValueError(f"{name} must be one of {list(allowed)}, got {value!r}")
    return text


def check_week(week) -> int:
    week = 0 if week is None else int(week)
    if week < MIN_WEEK or week > MAX_WEEK:
        raise ValueError(f"week {week} lies outside {MIN_WEEK}..{MAX_WEEK}")
    return week


def check_range(name: str, value, low: int, high: int | None = None) -> int:
    """``value`` as an int of at least ``low`` (and at most ``high``, if there is a limit)."""
    number = None if value is None else int(value)
    if number is None or number < low or (high is not None and number > high):
        raise ValueError(f"{name}: expected {low} to {'any' if high is None else high}, got {value!r}")
    return number


def clean_filters(filters) -> dict:
    """Filters as a dict over the five dimensions; booleans and None are dropped."""
    if filters is None:
        return {}
    if not isinstance(filters, dict):
        raise ValueError("filters must be a dict.")
    unknown = set(filters) - set(DIMENSIONS)
    if unknown:
        raise ValueError(f"unknown filter fields: {sorted(unknown)}")
    return {k: v for k, v in filters.items() if v is not None and not isinstance(v, bool)}
