"""Data-quality checks over the long tables.

Every check returns finding rows ``(dataset, check, item, count, severity)``
with severity ``critical``, ``warning``, ``ok`` or ``info``; J11 folds them
into one status. Each check is one aggregation (partial before the shuffle);
the null, week and label checks of a table share a single pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonepulse.model import (
    CRITICAL_FIELDS,
    DIMENSIONS,
    FEATURE_COLUMNS,
    GEO_KEYS,
    GRAIN_KEYS,
    NULL_CRITICAL_RATIO,
    ORDERS_METRIC,
    WEEK_LABEL_PATTERN,
    require_columns,
)
from zonepulse.functions.columns import union_all
from zonepulse.operators.slices import distinct_count_with_null


def _row(dataset: str, check: str, item: str | Column, count: Column, severity: Column) -> list[Column]:
    item_col = item if isinstance(item, Column) else F.lit(item)
    return [
        F.lit(dataset).alias("dataset"),
        F.lit(check).alias("check"),
        item_col.cast(T.StringType()).alias("item"),
        count.cast(T.LongType()).alias("count"),
        severity.alias("severity"),
    ]


def _flag(count: Column, level: str) -> Column:
    return F.when(count > 0, F.lit(level)).otherwise(F.lit("ok"))


def _union(frames: list[DataFrame]) -> DataFrame:
    return union_all(frames)


def profile_columns() -> list[Column]:
    """Aggregates of one pass: row count, nulls per critical field, bad weeks, bad labels."""
    week_num = F.col("week").cast(T.StringType()).try_cast(T.DoubleType())
    label_ok = F.coalesce(F.col("week_label").cast(T.StringType()).rlike(WEEK_LABEL_PATTERN), F.lit(False))
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in CRITICAL_FIELDS]
    aggs += [
        F.count_if(week_num.isNull()).alias("week_non_numeric"),
        F.count_if(week_num.isNotNull() & ~week_num.between(0, 8)).alias("week_out_of_range"),
        F.count_if(~label_ok).alias("bad_labels"),
    ]
    return aggs


def _profile(df: DataFrame) -> DataFrame:
    return df.agg(*profile_columns())


def _null_rows(dataset: str, columns) -> list[list[Column]]:
    rows = []
    for c in columns:
        n = F.col(f"null_{c}")
        share = n / F.greatest(F.col("n_rows"), F.lit(1))
        level = F.when(n == 0, "ok").when(share >= NULL_CRITICAL_RATIO, "critical").otherwise("warning")
        rows.append(_row(dataset, "nulls", c, n, level))
    return rows


def _week_rows(dataset: str) -> list[list[Column]]:
    return [_row(dataset, name, "", F.col(name), _flag(F.col(name), "critical")) for name in ("week_non_numeric", "week_out_of_range")]


def _label_rows(dataset: str) -> list[list[Column]]:
    return [_row(dataset, "week_label_format", "", F.col("bad_labels"), _flag(F.col("bad_labels"), "warning"))]


def _exploded(profile: DataFrame, rows: list[list[Column]]) -> DataFrame:
    """One row per finding from the one row of a profile."""
    return profile.select(F.explode(F.array(*[F.struct(*r) for r in rows])).alias("f")).select("f.*")


def check_nulls(df: DataFrame, dataset: str, columns=CRITICAL_FIELDS) -> DataFrame:
    """Null count per critical column; ≥5% critical, >0 warning."""
    require_columns(df, columns, dataset)
    return _exploded(_profile(df), _null_rows(dataset, columns))


def check_weeks(df: DataFrame, dataset: str) -> DataFrame:
    """Non-numeric weeks and weeks outside 0–8 (both critical)."""
    require_columns(df, ["week"], dataset)
    return _exploded(_profile(df), _week_rows(dataset))


def check_labels(df: DataFrame, dataset: str) -> DataFrame:
    """Week labels not matching l[0-8]w(_roll)? (a null label is bad)."""
    require_columns(df, ["week_label"], dataset)
    return _exploded(_profile(df), _label_rows(dataset))


def profile_findings(df: DataFrame, dataset: str) -> DataFrame:
    """J1 + J2 + J3 from a single aggregation pass over the table."""
    require_columns(df, [*CRITICAL_FIELDS, "week_label"], dataset)
    return _exploded(_profile(df), _null_rows(dataset, CRITICAL_FIELDS) + _week_rows(dataset) + _label_rows(dataset))


def week_values(df: DataFrame, dataset: str) -> DataFrame:
    """Every distinct week and label with its number of rows and
    whether the checks accept it."""
    week = F.col("week").cast(T.StringType())
    label = F.col("week_label").cast(T.StringType())
    number = week.try_cast(T.DoubleType())
    cells = F.array(
        F.struct(F.lit("week").alias("field"), week.alias("value"), F.coalesce(number.between(0, 8), F.lit(False)).alias("accepted")),
        F.struct(F.lit("week_label").alias("field"), label.alias("value"), F.coalesce(label.rlike(WEEK_LABEL_PATTERN), F.lit(False)).alias("accepted")),
    )
    seen = df.select(F.explode(cells).alias("c")).groupBy("c.field", "c.value", "c.accepted").agg(F.count("*").alias("count"))
    return seen.select(F.lit(dataset).alias("dataset"), "field", "value", "accepted", "count")


def duplicate_keys(df: DataFrame, dataset: str, keys=GRAIN_KEYS) -> DataFrame:
    """Every grain key that several rows share (null keys compare equal), with their number."""
    require_columns(df, keys, dataset)
    shared = df.groupBy(*keys).agg(F.count("*").alias("count")).filter(F.col("count") > 1)
    return shared.select(F.lit(dataset).alias("dataset"), *keys, "count")


def check_duplicates(df: DataFrame, dataset: str, keys=GRAIN_KEYS, level: str = "critical",
                     check: str = "duplicate") -> DataFrame:
    """How many rows share a grain key, and how many such keys there are."""
    agg = duplicate_keys(df, dataset, keys).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("keys"))
    return _exploded(agg, [_row(dataset, f"{check}_{c}", "", F.col(c), _flag(F.col(c), level)) for c in ("rows", "keys")])


def geography_tuples(metrics: DataFrame) -> DataFrame:
    """The distinct (country, city, zone, zone_type, zone_prioritization) tuples."""
    return metrics.select(*DIMENSIONS).distinct()


def check_geography(metrics: DataFrame, dataset: str = "metrics_long") -> DataFrame:
    """J5 + J6: tuple count, and zones mapped to more than one zone_type or
    zone_prioritization (a null counts as a value)."""
    tuples = geography_tuples(metrics)
    per_zone = tuples.na.drop(subset=list(GEO_KEYS)).groupBy(*GEO_KEYS).agg(
        distinct_count_with_null("zone_type").alias("n_type"),
        distinct_count_with_null("zone_prioritization").alias("n_prio"),
    )
    conflicts = per_zone.agg(
        F.count_if(F.col("n_type") > 1).alias("type_conflicts"),
        F.count_if(F.col("n_prio") > 1).alias("prio_conflicts"),
    )
    n_tuples = tuples.agg(F.count(F.lit(1)).alias("n"))
    return _union([
        n_tuples.select(*_row(dataset, "geography_tuples", "", F.col("n"), F.lit("info"))),
        conflicts.select(*_row(dataset, "zone_type_conflicts", "", F.col("type_conflicts"), _flag(F.col("type_conflicts"), "critical"))),
        conflicts.select(*_row(dataset, "zone_prioritization_conflicts", "", F.col("prio_conflicts"), _flag(F.col("prio_conflicts"), "critical"))),
    ])


def check_enrichment(orders: DataFrame, metrics: DataFrame, dataset: str = "orders_long") -> DataFrame:
    """The orders ⋈ geography-tuples join must not add rows (critical);
    order zones without a geography are reported (warning).

    Row growth is computed from per-zone counts on both sides (each side
    aggregated before the join), never from the multiplied join itself.
    """
    keys = list(GEO_KEYS)
    o = orders.groupBy(*keys).agg(F.count(F.lit(1)).alias("o_n"))
    g = geography_tuples(metrics).groupBy(*keys).agg(F.count(F.lit(1)).alias("g_n"))
    g = g.select(*[F.col(k).alias(f"g_{k}") for k in keys], "g_n")
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"g_{k}")) for k in keys])
    j = o.join(g, on, "left")
    stats = j.agg(
        (F.sum(F.col("o_n") * F.coalesce(F.col("g_n"), F.lit(1))) - F.sum("o_n")).alias("growth"),
        F.count_if(F.col("g_n").isNull()).alias("unmatched"),
    )
    return _union([
        stats.select(*_row(dataset, "enrichment_row_growth", "", F.coalesce(F.col("growth"), F.lit(0)), _flag(F.col("growth"), "critical"))),
        stats.select(*_row(dataset, "enrichment_unmatched", "", F.col("unmatched"), _flag(F.col("unmatched"), "warning"))),
    ])


def check_orders_in_base(orders: DataFrame, base: DataFrame, dataset: str = "analytics_base") -> DataFrame:
    """Orders rows in the base vs orders_long (more: critical, fewer:
    warning) and duplicate grain among them (critical)."""
    base_orders = base.filter(F.col("metric").cast(T.StringType()) == ORDERS_METRIC)
    n_orders = orders.select(F.count(F.lit(1))).scalar()
    diff = base_orders.agg((F.count(F.lit(1)) - n_orders).alias("d"))
    sev = F.when(F.col("d") > 0, "critical").when(F.col("d") < 0, "warning").otherwise("ok")
    return _union([
        diff.select(*_row(dataset, "orders_row_count_diff", "", F.col("d"), sev)),
        check_duplicates(base_orders, dataset, check="orders_duplicate"),
    ])


def inventory_columns() -> list[Column]:
    """Aggregates of J9: rows, and how many of them are Orders rows."""
    is_orders = F.col("metric").cast(T.StringType()) == ORDERS_METRIC
    return [F.count_if(is_orders).alias("k"), F.count(F.lit(1)).alias("rows")]


def _inventory_rows(dataset: str) -> list[list[Column]]:
    """J9 findings of one of the long tables from (n, k, rows)."""
    missing = lambda level: ((F.col("k") == 0).cast("long"), F.when(F.col("k") == 0, level).otherwise("ok"))
    share = F.col("k") / F.greatest(F.col("rows"), F.lit(1))
    inside = F.when(share > 0.5, "critical").when(F.col("k") > 0, "warning").otherwise("ok")
    distinct = _row(dataset, "distinct_metrics", "", F.col("n"), F.lit("info"))
    return {
        "metrics_long": [distinct, _row(dataset, "orders_rows_in_metrics", "", F.col("k"), inside)],
        "analytics_base": [distinct, _row(dataset, "orders_metric_missing", "", *missing("critical"))],
        "orders_long": [_row(dataset, "orders_metric_missing", "", *missing("warning"))],
    }[dataset]


def check_inventory(metrics: DataFrame, orders: DataFrame, base: DataFrame) -> DataFrame:
    """Distinct metrics; Orders missing from orders (warning) or from the
    base (critical); Orders rows inside metrics (warning, >50% critical)."""
    tables = {"metrics_long": metrics, "analytics_base": base, "orders_long": orders}
    counted = {name: df.agg(F.count_distinct("metric").alias("n"), *inventory_columns()) for name, df in tables.items()}
    return _union([_exploded(counts, _inventory_rows(name)) for name, counts in counted.items()])


# ---------------------------------------------------------------------------
# The same findings from figures that a write has gathered on its way
# ---------------------------------------------------------------------------
def observed_columns() -> list[Column]:
    """What to observe while a long table is written: J1–J3 and J9."""
    metrics = F.size(F.collect_set("metric")).cast("long").alias("n")  # a short list of names
    return [*profile_columns(), *inventory_columns(), metrics]


def findings_of(figures: DataFrame, dataset: str) -> DataFrame:
    """J1–J3 and J9 of a long table from one row of observed figures."""
    rows = _null_rows(dataset, CRITICAL_FIELDS) + _week_rows(dataset) + _label_rows(dataset) + _inventory_rows(dataset)
    return _exploded(figures, rows)


def check_features(features: DataFrame, dataset: str = "metrics_features") -> DataFrame:
    """Feature schema, and duplicates on (country, city, zone, metric) (warning)."""
    require_columns(features, FEATURE_COLUMNS, dataset)
    return check_duplicates(features, dataset, keys=list(GEO_KEYS) + ["metric"], level="warning")


def quality_report(metrics: DataFrame, orders: DataFrame, base: DataFrame, features: DataFrame | None) -> DataFrame:
    """J1–J10 for the three long tables (and features when given)."""
    tables = {"metrics_long": metrics, "orders_long": orders, "analytics_base": base}
    parts = []
    for name, df in tables.items():
        parts += [profile_findings(df, name), check_duplicates(df, name)]
    parts += [check_geography(metrics), check_enrichment(orders, metrics), check_orders_in_base(orders, base),
              check_inventory(metrics, orders, base)]
    if features is not None:
        parts.append(check_features(features))
    return _union(parts)


def overall_status(findings: DataFrame) -> DataFrame:
    """FAIL if any critical finding, WARN if any warning, else PASS."""
    rank = F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    agg = findings.agg(
        F.coalesce(F.max(rank), F.lit(0)).alias("r"),
        F.count_if(F.col("severity") == "critical").alias("critical_count"),
        F.count_if(F.col("severity") == "warning").alias("warning_count"),
    )
    return agg.select(
        F.when(F.col("r") == 2, "FAIL").when(F.col("r") == 1, "WARN").otherwise("PASS").alias("status"),
        "critical_count", "warning_count",
    )
