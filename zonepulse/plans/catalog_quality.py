"""Registered data-quality queries J1–J11 (over the dirty variants) with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonepulse.functions.columns import union_all
from zonepulse.operators import prep as P
from zonepulse.operators import quality as Qy
from zonepulse.plans.catalog_prep import _DIRTY_SQL
from zonepulse.plans.registry import register
from zonepulse.session import materialize
from zonepulse.sources import fixtures as X

TABLES_SQL = _DIRTY_SQL + """,
lookup AS (
  SELECT country, city, zone,
         first(zone_type ORDER BY week DESC, metric) FILTER (WHERE zone_type IS NOT NULL) AS zone_type,
         first(zone_prioritization ORDER BY week DESC, metric) FILTER (WHERE zone_prioritization IS NOT NULL) AS zone_prioritization
  FROM dirty_metrics WHERE country IS NOT NULL AND city IS NOT NULL AND zone IS NOT NULL
  GROUP BY country, city, zone),
dirty_base AS (
  SELECT country, city, zone, zone_type, zone_prioritization, metric, week, week_label, "value" FROM dirty_metrics
  UNION ALL
  SELECT o.country, o.city, o.zone, l.zone_type, l.zone_prioritization, o.metric, o.week, o.week_label, o."value"
  FROM dirty_orders o LEFT JOIN lookup l ON o.country = l.country AND o.city = l.city AND o.zone = l.zone),
features0 AS (
  SELECT country, city, zone, metric FROM dirty_metrics
  WHERE country IS NOT NULL AND city IS NOT NULL AND zone IS NOT NULL AND metric IS NOT NULL AND week IS NOT NULL AND "value" IS NOT NULL
  GROUP BY country, city, zone, metric),
dirty_features AS (SELECT * FROM features0 UNION ALL SELECT * FROM features0 WHERE metric = 'Turbo Adoption')"""

DATASETS = (("metrics_long", "dirty_metrics"), ("orders_long", "dirty_orders"), ("analytics_base", "dirty_base"))
CRIT = ("country", "city", "zone", "metric", "week", "value")


def _tables(spark, sf_dir):
    """Dirty metrics/orders plus their base and features, each checkpointed
    once: every check reads them several times."""
    m, o = X.dirty_tables(spark, sf_dir, materialize=True)
    m, o = materialize(m), materialize(o)
    features = P.metrics_features(m)
    twice = features.unionByName(features.where("metric = 'Turbo Adoption'"))
    return m, o, materialize(P.analytics_base(m, o)), materialize(twice)


def _text_weeks(df):
    """Weeks as text, those of one market segment spelled out."""
    return df.withColumn("week", F.when(F.col("zone").endswith("MACHINERY"), F.concat(F.lit("week "), F.col("week"))).otherwise(F.col("week").cast("string")))


def _flag(expr: str, level: str) -> str:
    return f"CASE WHEN {expr} > 0 THEN '{level}' ELSE 'ok' END"


def _nulls_sql() -> str:
    parts = []
    for name, table in DATASETS:
        for c in CRIT:
            col = '"value"' if c == "value" else c
            parts.append(
                f"SELECT '{name}' AS dataset, 'nulls' AS \"check\", '{c}' AS item, "
                f"CAST(count(*) FILTER (WHERE {col} IS NULL) AS BIGINT) AS \"count\", "
                f"CASE WHEN count(*) FILTER (WHERE {col} IS NULL) = 0 THEN 'ok' "
                f"WHEN count(*) FILTER (WHERE {col} IS NULL) / greatest(count(*), 1) >= 0.05 THEN 'critical' "
                f"ELSE 'warning' END AS severity FROM {table}"
            )
    return "\nUNION ALL ".join(parts)


def _weeks_sql(spelled: bool = False) -> str:
    parts = []
    for name, table in DATASETS:
        words = "zone LIKE '%MACHINERY'" if spelled else "false"
        odd = f"count(*) FILTER (WHERE week IS NULL OR {words})"
        out = f"count(*) FILTER (WHERE week NOT BETWEEN 0 AND 8 AND NOT ({words}))"
        parts.append(f"SELECT '{name}', 'week_non_numeric', '', CAST({odd} AS BIGINT), {_flag(odd, 'critical')} FROM {table}")
        parts.append(f"SELECT '{name}', 'week_out_of_range', '', CAST({out} AS BIGINT), {_flag(out, 'critical')} FROM {table}")
    return ("SELECT * FROM (" + "\nUNION ALL ".join(parts)
            + ') t(dataset, "check", item, "count", severity)')


def _labels_sql() -> str:
    bad = "count(*) FILTER (WHERE NOT coalesce(regexp_full_match(week_label, 'l[0-8]w(_roll)?'), false))"
    parts = [f"SELECT '{n}', 'week_label_format', '', CAST({bad} AS BIGINT), {_flag(bad, 'warning')} FROM {t}"
             for n, t in DATASETS]
    return "SELECT * FROM (" + "\nUNION ALL ".join(parts) + ') t(dataset, "check", item, "count", severity)'


def _dup_sql(name: str, table: str, keys: str, level: str = "critical", check: str = "duplicate") -> str:
    return f"""SELECT '{name}', '{check}_rows', '', CAST(coalesce(sum(c), 0) AS BIGINT), {_flag('coalesce(sum(c), 0)', level)}
  FROM (SELECT count(*) AS c FROM {table} GROUP BY {keys} HAVING count(*) > 1)
UNION ALL SELECT '{name}', '{check}_keys', '', CAST(count(*) AS BIGINT), {_flag('count(*)', level)}
  FROM (SELECT count(*) AS c FROM {table} GROUP BY {keys} HAVING count(*) > 1)"""


GRAIN = "country, city, zone, metric, week"


def _wrap(body: str) -> str:
    return "SELECT * FROM (" + body + ') t(dataset, "check", item, "count", severity)'


@register("dq_nulls", TABLES_SQL + "\n" + _nulls_sql())
def dq_nulls(spark, sf_dir):
    """Null counts of the critical columns in the three tables."""
    m, o, b, _ = _tables(spark, sf_dir)
    return union_all([Qy.check_nulls(m, "metrics_long"), Qy.check_nulls(o, "orders_long"), Qy.check_nulls(b, "analytics_base")])


@register("dq_weeks", TABLES_SQL + "\n" + _weeks_sql(spelled=True))
def dq_weeks(spark, sf_dir):
    """Non-numeric and out-of-range weeks, where one segment's weeks are words."""
    m, o, b, _ = (_text_weeks(t) if "week" in t.columns else t for t in _tables(spark, sf_dir))
    return union_all([Qy.check_weeks(m, "metrics_long"), Qy.check_weeks(o, "orders_long"), Qy.check_weeks(b, "analytics_base")])


@register("dq_labels", TABLES_SQL + "\n" + _labels_sql())
def dq_labels(spark, sf_dir):
    """Week labels not matching l[0-8]w(_roll)?."""
    m, o, b, _ = _tables(spark, sf_dir)
    return union_all([Qy.check_labels(m, "metrics_long"), Qy.check_labels(o, "orders_long"), Qy.check_labels(b, "analytics_base")])


@register("dq_duplicates", TABLES_SQL + "\n" + _wrap("\nUNION ALL ".join(_dup_sql(n, t, GRAIN) for n, t in DATASETS)))
def dq_duplicates(spark, sf_dir):
    """Duplicate grain rows and keys."""
    m, o, b, _ = _tables(spark, sf_dir)
    return union_all([Qy.check_duplicates(m, "metrics_long"), Qy.check_duplicates(o, "orders_long"),
                      Qy.check_duplicates(b, "analytics_base")])


_KEYS_SQL = "\nUNION ALL ".join(
    f"SELECT '{n}' AS dataset, country, city, zone, metric, week, CAST(count(*) AS BIGINT) AS \"count\" FROM {t} "
    f"GROUP BY country, city, zone, metric, week HAVING count(*) > 1" for n, t in DATASETS)


@register("dq_duplicate_keys", TABLES_SQL + "\n" + _KEYS_SQL)
def dq_duplicate_keys(spark, sf_dir):
    """The duplicated grain keys themselves."""
    m, o, b, _ = _tables(spark, sf_dir)
    return union_all([Qy.duplicate_keys(m, "metrics_long"), Qy.duplicate_keys(o, "orders_long"), Qy.duplicate_keys(b, "analytics_base")])


_VALUES_SQL = "\nUNION ALL ".join(
    f"""SELECT '{n}' AS dataset, 'week' AS field, CAST(week AS VARCHAR) AS "value", coalesce(week BETWEEN 0 AND 8, false) AS accepted,
       CAST(count(*) AS BIGINT) AS "count" FROM {t} GROUP BY week
UNION ALL SELECT '{n}', 'week_label', week_label, coalesce(regexp_full_match(week_label, 'l[0-8]w(_roll)?'), false), CAST(count(*) AS BIGINT)
       FROM {t} GROUP BY week_label""" for n, t in DATASETS)


@register("dq_week_values", TABLES_SQL + "\n" + _VALUES_SQL)
def dq_week_values(spark, sf_dir):
    """Distinct weeks and labels, and which of them offend."""
    m, o, b, _ = _tables(spark, sf_dir)
    return union_all([Qy.week_values(m, "metrics_long"), Qy.week_values(o, "orders_long"), Qy.week_values(b, "analytics_base")])


GEO_SQL = """
tuples AS (SELECT DISTINCT country, city, zone, zone_type, zone_prioritization FROM dirty_metrics),
per_zone AS (SELECT country, city, zone,
                    count(DISTINCT zone_type) + max(CASE WHEN zone_type IS NULL THEN 1 ELSE 0 END) AS n_type,
                    count(DISTINCT zone_prioritization) + max(CASE WHEN zone_prioritization IS NULL THEN 1 ELSE 0 END) AS n_prio
             FROM tuples WHERE country IS NOT NULL AND city IS NOT NULL AND zone IS NOT NULL
             GROUP BY country, city, zone)"""


@register("dq_geo_conflicts", TABLES_SQL + "," + GEO_SQL + "\n" + _wrap("""
SELECT 'metrics_long', 'geography_tuples', '', CAST(count(*) AS BIGINT), 'info' FROM tuples
UNION ALL SELECT 'metrics_long', 'zone_type_conflicts', '', CAST(count(*) FILTER (WHERE n_type > 1) AS BIGINT),
                 CASE WHEN count(*) FILTER (WHERE n_type > 1) > 0 THEN 'critical' ELSE 'ok' END FROM per_zone
UNION ALL SELECT 'metrics_long', 'zone_prioritization_conflicts', '', CAST(count(*) FILTER (WHERE n_prio > 1) AS BIGINT),
                 CASE WHEN count(*) FILTER (WHERE n_prio > 1) > 0 THEN 'critical' ELSE 'ok' END FROM per_zone"""))
def dq_geo_conflicts(spark, sf_dir):
    """J5 + J6: geography tuples and zones with conflicting attributes."""
    m, _, _, _ = _tables(spark, sf_dir)
    return Qy.check_geography(m)


ENRICH_SQL = """
tuples AS (SELECT DISTINCT country, city, zone, zone_type, zone_prioritization FROM dirty_metrics),
oz AS (SELECT country, city, zone, count(*) AS o_n FROM dirty_orders GROUP BY country, city, zone),
gz AS (SELECT country, city, zone, count(*) AS g_n FROM tuples GROUP BY country, city, zone),
ej AS (SELECT o_n, g_n FROM oz LEFT JOIN gz ON oz.country IS NOT DISTINCT FROM gz.country
       AND oz.city IS NOT DISTINCT FROM gz.city AND oz.zone IS NOT DISTINCT FROM gz.zone)"""


@register("dq_enrichment", TABLES_SQL + "," + ENRICH_SQL + "\n" + _wrap("""
SELECT 'orders_long', 'enrichment_row_growth', '', CAST(coalesce(sum(o_n * coalesce(g_n, 1)) - sum(o_n), 0) AS BIGINT),
       CASE WHEN sum(o_n * coalesce(g_n, 1)) - sum(o_n) > 0 THEN 'critical' ELSE 'ok' END FROM ej
UNION ALL SELECT 'orders_long', 'enrichment_unmatched', '', CAST(count(*) FILTER (WHERE g_n IS NULL) AS BIGINT),
       CASE WHEN count(*) FILTER (WHERE g_n IS NULL) > 0 THEN 'warning' ELSE 'ok' END FROM ej"""))
def dq_enrichment(spark, sf_dir):
    """Enrichment join safety and unmatched order zones."""
    m, o, _, _ = _tables(spark, sf_dir)
    return Qy.check_enrichment(o, m)


@register("dq_orders_in_base", TABLES_SQL + """,
bo AS (SELECT * FROM dirty_base WHERE metric = 'Orders')
""" + _wrap("""
SELECT 'analytics_base', 'orders_row_count_diff', '', CAST((SELECT count(*) FROM bo) - (SELECT count(*) FROM dirty_orders) AS BIGINT),
       CASE WHEN (SELECT count(*) FROM bo) > (SELECT count(*) FROM dirty_orders) THEN 'critical'
            WHEN (SELECT count(*) FROM bo) < (SELECT count(*) FROM dirty_orders) THEN 'warning' ELSE 'ok' END
UNION ALL """ + _dup_sql("analytics_base", "bo", GRAIN, check="orders_duplicate")))
def dq_orders_in_base(spark, sf_dir):
    """Orders rows inside the analytics base."""
    _, o, b, _ = _tables(spark, sf_dir)
    return Qy.check_orders_in_base(o, b)


@register("dq_inventory", TABLES_SQL + "\n" + _wrap("""
SELECT 'metrics_long', 'distinct_metrics', '', CAST(count(DISTINCT metric) AS BIGINT), 'info' FROM dirty_metrics
UNION ALL SELECT 'analytics_base', 'distinct_metrics', '', CAST(count(DISTINCT metric) AS BIGINT), 'info' FROM dirty_base
UNION ALL SELECT 'orders_long', 'orders_metric_missing', '', CAST(count(*) FILTER (WHERE metric = 'Orders') = 0 AS BIGINT),
       CASE WHEN count(*) FILTER (WHERE metric = 'Orders') = 0 THEN 'warning' ELSE 'ok' END FROM dirty_orders
UNION ALL SELECT 'analytics_base', 'orders_metric_missing', '', CAST(count(*) FILTER (WHERE metric = 'Orders') = 0 AS BIGINT),
       CASE WHEN count(*) FILTER (WHERE metric = 'Orders') = 0 THEN 'critical' ELSE 'ok' END FROM dirty_base
UNION ALL SELECT 'metrics_long', 'orders_rows_in_metrics', '', CAST(count(*) FILTER (WHERE metric = 'Orders') AS BIGINT),
       CASE WHEN count(*) FILTER (WHERE metric = 'Orders') / greatest(count(*), 1) > 0.5 THEN 'critical'
            WHEN count(*) FILTER (WHERE metric = 'Orders') > 0 THEN 'warning' ELSE 'ok' END FROM dirty_metrics"""))
def dq_inventory(spark, sf_dir):
    """Metric inventory and Orders placement."""
    m, o, b, _ = _tables(spark, sf_dir)
    return Qy.check_inventory(m, o, b)


@register("dq_features", TABLES_SQL + "\n" + _wrap(_dup_sql("metrics_features", "dirty_features", "country, city, zone, metric", "warning")))
def dq_features(spark, sf_dir):
    """Duplicate feature keys."""
    _, _, _, f = _tables(spark, sf_dir)
    return Qy.check_features(f)


_ALL_FINDINGS = "\nUNION ALL ".join([
    f"SELECT * FROM ({_nulls_sql()})", _weeks_sql(), _labels_sql(),
    _wrap("\nUNION ALL ".join(_dup_sql(n, t, GRAIN) for n, t in DATASETS)),
])


@register("dq_status", TABLES_SQL + "," + GEO_SQL + "," + ENRICH_SQL.replace(
    "tuples AS (SELECT DISTINCT country, city, zone, zone_type, zone_prioritization FROM dirty_metrics),\n", "") + """,
bo AS (SELECT * FROM dirty_base WHERE metric = 'Orders'),
findings AS (""" + _ALL_FINDINGS + """
  UNION ALL SELECT 'm', 'geo_type', '', 0, CASE WHEN count(*) FILTER (WHERE n_type > 1) > 0 THEN 'critical' ELSE 'ok' END FROM per_zone
  UNION ALL SELECT 'm', 'geo_prio', '', 0, CASE WHEN count(*) FILTER (WHERE n_prio > 1) > 0 THEN 'critical' ELSE 'ok' END FROM per_zone
  UNION ALL SELECT 'o', 'enrich', '', 0, CASE WHEN sum(o_n * coalesce(g_n, 1)) - sum(o_n) > 0 THEN 'critical' ELSE 'ok' END FROM ej
  UNION ALL SELECT 'o', 'unmatched', '', 0, CASE WHEN count(*) FILTER (WHERE g_n IS NULL) > 0 THEN 'warning' ELSE 'ok' END FROM ej
  UNION ALL SELECT 'b', 'bo', '', 0, CASE WHEN (SELECT count(*) FROM bo) > (SELECT count(*) FROM dirty_orders) THEN 'critical'
            WHEN (SELECT count(*) FROM bo) < (SELECT count(*) FROM dirty_orders) THEN 'warning' ELSE 'ok' END
  UNION ALL """ + _dup_sql("b", "bo", GRAIN) + """
  UNION ALL SELECT 'o', 'om', '', 0, CASE WHEN count(*) FILTER (WHERE metric = 'Orders') = 0 THEN 'warning' ELSE 'ok' END FROM dirty_orders
  UNION ALL SELECT 'b', 'om', '', 0, CASE WHEN count(*) FILTER (WHERE metric = 'Orders') = 0 THEN 'critical' ELSE 'ok' END FROM dirty_base
  UNION ALL SELECT 'm', 'oim', '', 0, CASE WHEN count(*) FILTER (WHERE metric = 'Orders') / greatest(count(*), 1) > 0.5 THEN 'critical'
            WHEN count(*) FILTER (WHERE metric = 'Orders') > 0 THEN 'warning' ELSE 'ok' END FROM dirty_metrics
  UNION ALL """ + _dup_sql("f", "dirty_features", "country, city, zone, metric", "warning") + """)
SELECT CASE WHEN max(CASE severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) = 2 THEN 'FAIL'
            WHEN max(CASE severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) = 1 THEN 'WARN' ELSE 'PASS' END AS status,
       CAST(count(*) FILTER (WHERE severity = 'critical') AS BIGINT) AS critical_count,
       CAST(count(*) FILTER (WHERE severity = 'warning') AS BIGINT) AS warning_count
FROM findings""")
def dq_status(spark, sf_dir):
    """Overall status over all findings."""
    m, o, b, f = _tables(spark, sf_dir)
    return Qy.overall_status(Qy.quality_report(m, o, b, f))
