"""Registered prep queries A1–A5 and B4–B9 with oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from zonepulse.operators import fingerprint as Fp
from zonepulse.operators import prep as P
from zonepulse.operators.slices import filter_metric, snapshot_week
from zonepulse.plans.registry import register
from zonepulse.session import shared_path
from zonepulse.sources import fixtures as X
from zonepulse.sources.adapter import zone_tables
from zonepulse.sources.exports import METRICS_EXPORT, find_exports
from zonepulse.sources.tables import read_long_table, read_wide_export, write_report_lines, write_table


@register("unpivot_metrics", """
SELECT country, city, zone, zone_type, zone_prioritization, metric, week, 'l' || CAST(week AS VARCHAR) || 'w_roll' AS week_label,
       round("value", 6) AS "value" FROM metrics_long""")
def unpivot_metrics(spark, sf_dir):
    """Wide metrics export (messy headers, roll set preferred) → metrics_long."""
    m, _ = zone_tables(spark, sf_dir)
    return P.reshape_metrics(X.wide_metrics(m))


@register("unpivot_orders", """
SELECT country, city, zone, metric, week, week_label, round("value", 6) AS "value" FROM orders_long""")
def unpivot_orders(spark, sf_dir):
    """Wide orders export (text cells, no METRIC column) → orders_long."""
    _, o = zone_tables(spark, sf_dir)
    return P.reshape_orders(X.wide_orders(o))


@register("collapse_grain", """
src AS (
  SELECT *, 0 AS src_ord FROM metrics_long
  UNION ALL
  SELECT country, city, zone, NULL, NULL, metric, week, week_label, "value" + 1.0, 1 FROM metrics_long
  WHERE country = 'ASIA' AND week = 4)
SELECT country, city, zone,
       first(zone_type ORDER BY src_ord) FILTER (WHERE zone_type IS NOT NULL) AS zone_type,
       first(zone_prioritization ORDER BY src_ord) FILTER (WHERE zone_prioritization IS NOT NULL) AS zone_prioritization,
       metric, week,
       first(week_label ORDER BY src_ord) FILTER (WHERE week_label IS NOT NULL) AS week_label,
       round(avg("value"), 6) AS "value"
FROM src GROUP BY country, city, zone, metric, week""")
def collapse_grain(spark, sf_dir):
    """ASIA week-4 rows duplicated (value + 1, no zone attributes) and collapsed."""
    m, _ = zone_tables(spark, sf_dir)
    dup = m.filter((F.col("country") == "ASIA") & (F.col("week") == 4)).select(
        "country", "city", "zone", F.lit(None).cast("string").alias("zone_type"),
        F.lit(None).cast("string").alias("zone_prioritization"), "metric", "week", "week_label",
        (F.col("value") + 1.0).alias("value"),
    )
    src = m.withColumn(P.ORD, F.lit(0)).unionByName(dup.withColumn(P.ORD, F.lit(1)))
    return P.collapse_duplicate_grain(src)


_DIRTY_SQL = """
m0 AS (
  SELECT country, city, zone,
         CASE WHEN zone LIKE '%HOUSEHOLD' AND week = 3 THEN NULL ELSE zone_type END AS zone_type,
         zone_prioritization, metric,
         CASE WHEN city = 'NATION_0' THEN week + 9 ELSE week END AS week,
         'l' || CAST(CASE WHEN city = 'NATION_0' THEN week + 9 ELSE week END AS VARCHAR) || 'w' AS week_label,
         CASE WHEN city = 'NATION_1' THEN NULL ELSE "value" END AS "value"
  FROM metrics_long),
dirty_metrics AS (
  SELECT * FROM m0
  UNION ALL SELECT * FROM m0 WHERE week = 4 AND country = 'ASIA'
  UNION ALL SELECT country, city, zone, NULL, NULL, metric, week, week_label, "value" FROM orders_long
            WHERE city = 'NATION_2' AND week = 0),
dirty_orders AS (
  SELECT * FROM orders_long
  UNION ALL SELECT country, city, zone || '_X', metric, week, week_label, "value" FROM orders_long WHERE city = 'NATION_3')"""


@register("geo_lookup", _DIRTY_SQL + """
SELECT country, city, zone,
       first(zone_type ORDER BY week DESC, metric) FILTER (WHERE zone_type IS NOT NULL) AS zone_type,
       first(zone_prioritization ORDER BY week DESC, metric) FILTER (WHERE zone_prioritization IS NOT NULL) AS zone_prioritization
FROM dirty_metrics WHERE country IS NOT NULL AND city IS NOT NULL AND zone IS NOT NULL
GROUP BY country, city, zone""")
def geo_lookup(spark, sf_dir):
    """First non-null zone attributes per zone, over the dirty metrics."""
    m, _ = X.dirty_tables(spark, sf_dir)
    return P.geography_lookup(m)


@register("analytics_base", """
lookup AS (
  SELECT country, city, zone,
         first(zone_type ORDER BY week DESC, metric) FILTER (WHERE zone_type IS NOT NULL) AS zone_type,
         first(zone_prioritization ORDER BY week DESC, metric) FILTER (WHERE zone_prioritization IS NOT NULL) AS zone_prioritization
  FROM metrics_long GROUP BY country, city, zone)
SELECT country, city, zone, zone_type, zone_prioritization, metric, week, week_label, round("value", 6) AS "value"
FROM metrics_long
UNION ALL
SELECT o.country, o.city, o.zone, l.zone_type, l.zone_prioritization, o.metric, o.week, o.week_label, round(o."value", 6)
FROM orders_long o LEFT JOIN lookup l ON o.country = l.country AND o.city = l.city AND o.zone = l.zone""")
def analytics_base(spark, sf_dir):
    """Orders enriched with zone attributes, unioned with metrics."""
    m, o = zone_tables(spark, sf_dir)
    return P.analytics_base(m, o)


@register("features", """
SELECT country, city, zone, metric,
       round(avg(CASE WHEN week = 0 THEN "value" END), 6) AS current_value,
       round(avg(CASE WHEN week = 1 THEN "value" END), 6) AS value_1w_ago,
       round(avg(CASE WHEN week = 5 THEN "value" END), 6) AS value_5w_ago,
       round(avg(CASE WHEN week = 0 THEN "value" END) - avg(CASE WHEN week = 1 THEN "value" END), 6) AS delta_1w,
       round(avg(CASE WHEN week = 0 THEN "value" END) - avg(CASE WHEN week = 5 THEN "value" END), 6) AS delta_5w
FROM metrics_long GROUP BY country, city, zone, metric""")
def features(spark, sf_dir):
    """Point-in-time features per zone and metric."""
    m, _ = zone_tables(spark, sf_dir)
    return P.metrics_features(m)


_MILLIONTHS = "CAST(floor(abs(\"value\") * 1000000 + 0.5) * sign(\"value\") AS BIGINT)"


_FP_COLUMNS = ("country", "city", "zone", "zone_type", "zone_prioritization", "metric", "week", "week_label", "millionths")
_FP_STRUCTURE = "|".join(f"{c}:{ {'week': 'int', 'millionths': 'bigint'}.get(c, 'string') }" for c in _FP_COLUMNS)
_FP_TEXT = " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), 'n')" for c in _FP_COLUMNS)
_FP_SQL = f"""
texts AS (SELECT {_FP_TEXT} AS t FROM (SELECT *, {_MILLIONTHS} AS millionths FROM {{table}})),
summed AS (SELECT count(*) AS row_count, coalesce(sum(CAST('0x' || substring(md5(t), 1, 15) AS BIGINT)), 0) AS sum_a,
                  coalesce(sum(CAST('0x' || substring(md5(t), 18, 15) AS BIGINT)), 0) AS sum_b FROM texts)
SELECT sha256('{_FP_STRUCTURE}#' || CAST(row_count AS VARCHAR) || '#' || CAST(sum_a AS VARCHAR) || '#' || CAST(sum_b AS VARCHAR)) AS fingerprint,
       row_count FROM summed"""


def _whole_millionths(df):
    whole = (F.floor(F.abs("value") * 1000000 + 0.5) * F.signum("value")).cast("long")
    return df.select(*_FP_COLUMNS[:-1], whole.alias("millionths"))


@register("fingerprint", _FP_SQL.format(table="metrics_long"))
def fingerprint(spark, sf_dir):
    """A5: order-insensitive fingerprint of metrics_long, values in whole millionths."""
    m, _ = zone_tables(spark, sf_dir)
    return Fp.fingerprint(_whole_millionths(m))


@register("fingerprint_weeks", """
changed AS (SELECT * REPLACE (CASE WHEN week = 0 THEN "value" + 1 ELSE "value" END AS "value") FROM metrics_long WHERE week <> 3),"""
          + _FP_SQL.format(table="changed"))
def fingerprint_weeks(spark, sf_dir):
    """A5: sums kept per week; week 3 is left out, week 0 replaced, and only week 0 is read again."""
    m, _ = zone_tables(spark, sf_dir)
    known = Fp.partition_sums(_whole_millionths(m), ["week"]).where("week <> 3")
    fresh = _whole_millionths(m.where("week = 0").withColumn("value", F.col("value") + 1))
    sums = Fp.with_partitions(known, Fp.partition_sums(fresh, ["week"]), ["week"])
    return Fp.combined(sums, Fp.structure(fresh))


# ---------------------------------------------------------------------------
# A1–A4: written to the shared folder and read again
# ---------------------------------------------------------------------------
def _folder(spark, name: str) -> str:
    return shared_path(spark, "roundtrip", f"{name}-{uuid.uuid4().hex}")


@register("wide_export_csv", """
SELECT country, city, zone, zone_type, zone_prioritization, metric, week, 'l' || CAST(week AS VARCHAR) || 'w_roll' AS week_label,
       round("value", 6) AS "value" FROM metrics_long""")
def wide_export_csv(spark, sf_dir):
    """A1: the wide metrics export written as CSV files, read as text and reshaped."""
    m, _ = zone_tables(spark, sf_dir)
    path = _folder(spark, "wide") + ".csv"
    write_table(X.wide_metrics(m), path, fmt="csv")
    return P.reshape_metrics(read_wide_export(spark, path))


@register("long_table_csv", """
SELECT country, city, zone, metric, week, week_label, round("value", 6) AS "value" FROM orders_long""")
def long_table_csv(spark, sf_dir):
    """A2, A3: orders_long written as CSV with its columns in another order and read by name."""
    _, o = zone_tables(spark, sf_dir)
    path = _folder(spark, "orders") + ".csv"
    write_table(o.select(*reversed(o.columns)), path, fmt="csv")
    return read_long_table(spark, path, "orders")


@register("long_table_parquet", """
SELECT country, city, zone, zone_type, zone_prioritization, metric, week, week_label, round("value", 6) AS "value",
       lower(metric) AS metric_key FROM metrics_long WHERE week = 2 AND metric = 'Perfect Orders'""")
def long_table_parquet(spark, sf_dir):
    """metrics_long partitioned by week and metric key; one snapshot read from its folder."""
    m, _ = zone_tables(spark, sf_dir)
    path = _folder(spark, "metrics")
    write_table(P.with_key_columns(m), path, partition_by=("week", "metric_key"))
    rows = snapshot_week(filter_metric(read_long_table(spark, path, "metrics"), " perfect orders"), 2)
    return rows.select(*m.columns, "metric_key")


@register("report_file", """
SELECT zone || ' ' || metric AS line, CAST(count(*) AS BIGINT) AS n FROM metrics_long GROUP BY zone, metric""")
def report_file(spark, sf_dir):
    """A4: ordered lines written as one text file and read again."""
    m, _ = zone_tables(spark, sf_dir)
    path = _folder(spark, "lines")
    text = F.concat_ws(" ", "zone", "metric")
    write_report_lines(m.select(F.hash("zone", "metric", "week").cast("long").alias("ord"), text.alias("line")), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@register("wide_exports_by_name", """
SELECT country, city, zone, zone_type, zone_prioritization, metric, week, 'l' || CAST(week AS VARCHAR) || 'w_roll' AS week_label,
       round("value", 6) AS "value" FROM metrics_long""")
def wide_exports_by_name(spark, sf_dir):
    """A1: an export found by name beside a summary; its files differ in the order and number of columns."""
    m, _ = zone_tables(spark, sf_dir)
    folder = _folder(spark, "exports")
    wide = X.wide_metrics(m)
    tidy = P.with_canonical_names(wide)
    for part, (df, test) in enumerate(((wide, "Zone"), (tidy.select(*reversed(tidy.columns)), "zone"), (tidy.withColumn("remark", F.lit("x, y")), "zone"))):
        own = df.where(F.pmod(F.xxhash64(F.col(f"`{test}`")), F.lit(3)) == part)
        write_table(own, f"{folder}/Raw Input-Metrics/{part}", fmt="csv")
    write_table(tidy.groupBy("metric").count(), f"{folder}/RAW_SUMMARY", fmt="csv")
    path = find_exports(spark, folder, (METRICS_EXPORT,))[METRICS_EXPORT]
    return P.reshape_metrics(read_wide_export(spark, f"{path}/*", "csv"))


@register("replaced_weeks", """
SELECT country, city, zone, zone_type, zone_prioritization, metric, week, week_label,
       round(CASE WHEN week = 2 THEN "value" * 2 ELSE "value" END, 6) AS "value" FROM metrics_long
WHERE week <> 2 OR metric <> 'Perfect Orders'""")
def replaced_weeks(spark, sf_dir):
    """A3: one week of a partitioned table written anew (without one of its metrics); the others stay."""
    m, _ = zone_tables(spark, sf_dir)
    path = _folder(spark, "weeks")
    write_table(P.with_key_columns(m), path, partition_by=("week", "metric_key"))
    week = m.where("week = 2 AND metric <> 'Perfect Orders'").withColumn("value", F.col("value") * 2)
    write_table(P.with_key_columns(week), path, partition_by=("week", "metric_key"), only_partitions=True)
    return read_long_table(spark, path, "metrics").select(*m.columns)
