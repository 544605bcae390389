"""Registered queries E1–E7 with oracle SQL."""

from __future__ import annotations

from zonepulse.functions.ranks import numbered
from zonepulse.plans import queries as Q
from zonepulse.plans.registry import r6, register
from zonepulse.plans.results import run_query
from zonepulse.sources.adapter import zone_tables

# ---------------------------------------------------------------------------
# E1 aggregation: one query per aggregate
# ---------------------------------------------------------------------------
_AGG_SPECS = {
    # name: (metric, group_by, aggregation, filters, week, sql aggregate)
    "agg_mean": ("Lead Penetration", "country", "mean", None, 0, 'avg("value")'),
    "agg_sum": ("Orders", "city", "sum", None, 1, 'coalesce(sum("value"), 0.0)'),
    "agg_min": ("Gross Profit UE", "zone_type", "min", {"country": "ASIA"}, 0, 'min("value")'),
    "agg_max": ("Perfect Orders", "zone_prioritization", "max", None, 2, 'max("value")'),
    "agg_median": ("Turbo Adoption", "city", "median", {"zone_type": "Wealthy"}, 0, 'median("value")'),
    "agg_count": ("perfect orders", "zone", "count", None, 3, 'CAST(count("value") AS BIGINT)'),
}


def _filter_sql(filters) -> str:
    terms = [f"lower(trim({k})) = '{str(v).strip().lower()}'" for k, v in (filters or {}).items()]
    return "".join(f" AND {t}" for t in terms)


def _agg_sql(metric, group_by, sql_agg, filters, week) -> str:
    table = "orders_long" if metric.strip().lower() == "orders" else "metrics_long"
    value = sql_agg if "count" in sql_agg else r6(sql_agg)
    return f"""
slice AS (SELECT * FROM {table} WHERE lower(trim(metric)) = '{metric.strip().lower()}'{_filter_sql(filters)} AND week = {week})
SELECT row_number() OVER (ORDER BY {sql_agg} DESC NULLS LAST, {group_by} ASC NULLS LAST) AS position,
       {group_by}, {value} AS "value" FROM slice GROUP BY {group_by}"""


def _make_agg(name, metric, group_by, agg, filters, week, sql_agg):
    def fn(spark, sf_dir):
        m, o = zone_tables(spark, sf_dir)
        return numbered(Q.aggregation(m, o, metric, group_by, agg, filters, week))

    fn.__doc__ = f"E1 {agg} of {metric} by {group_by}"
    register(name, _agg_sql(metric, group_by, sql_agg, filters, week))(fn)


for _name, _spec in _AGG_SPECS.items():
    _make_agg(_name, *_spec)


# ---------------------------------------------------------------------------
# E2 top-N
# ---------------------------------------------------------------------------
@register(
    "top_n_desc",
    """
slice AS (SELECT zone, avg("value") AS v FROM metrics_long
          WHERE lower(trim(metric)) = 'lead penetration' AND week = 0 GROUP BY zone)
SELECT CAST(row_number() OVER (ORDER BY v DESC NULLS LAST, zone ASC NULLS LAST) AS INTEGER) AS "rank",
       zone, round(v, 6) AS "value"
FROM slice QUALIFY "rank" <= 5""",
)
def top_n_desc(spark, sf_dir):
    """Top 5 zones by Lead Penetration this week (the flagship query)."""
    m, o = zone_tables(spark, sf_dir)
    return Q.top_n(m, o, "Lead Penetration", "zone", 5, "desc")


@register(
    "top_n_asc",
    """
slice AS (SELECT city, avg("value") AS v FROM metrics_long
          WHERE lower(trim(metric)) = 'perfect orders' AND week = 1
            AND lower(trim(zone_type)) = 'non wealthy' GROUP BY city)
SELECT CAST(row_number() OVER (ORDER BY v ASC NULLS LAST, city ASC NULLS LAST) AS INTEGER) AS "rank",
       city, round(v, 6) AS "value"
FROM slice QUALIFY "rank" <= 10""",
)
def top_n_asc(spark, sf_dir):
    """Bottom 10 cities by Perfect Orders among Non Wealthy zones, week 1."""
    m, o = zone_tables(spark, sf_dir)
    return Q.top_n(m, o, "Perfect Orders", "city", 10, "asc", {"zone_type": "Non Wealthy"}, 1)


# ---------------------------------------------------------------------------
# E3 group comparison
# ---------------------------------------------------------------------------
@register(
    "group_comparison",
    """
slice AS (SELECT * FROM metrics_long WHERE lower(trim(metric)) = 'perfect orders' AND week = 0)
SELECT row_number() OVER (ORDER BY avg("value") DESC NULLS LAST, zone_type) AS position,
       zone_type, round(avg("value"), 6) AS "value" FROM slice GROUP BY zone_type""",
)
def group_comparison(spark, sf_dir):
    """Perfect Orders Wealthy vs Non Wealthy; the conflicting zone_type filter is cleared."""
    m, o = zone_tables(spark, sf_dir)
    return numbered(Q.group_comparison(m, o, "Perfect Orders", ["Wealthy", "Non Wealthy"], "mean", {"zone_type": "Wealthy"}))


# ---------------------------------------------------------------------------
# E4 trend
# ---------------------------------------------------------------------------
@register(
    "trend",
    """
slice AS (SELECT * FROM metrics_long WHERE lower(trim(metric)) = 'gross profit ue'
          AND lower(trim(country)) = 'europe' AND week BETWEEN 0 AND 5)
SELECT row_number() OVER (ORDER BY week DESC) AS position, week, round(avg("value"), 6) AS "value" FROM slice GROUP BY week""",
)
def trend(spark, sf_dir):
    """Gross Profit UE in EUROPE over the last 6 weeks."""
    m, o = zone_tables(spark, sf_dir)
    return numbered(Q.trend(m, o, "Gross Profit UE", 6, "mean", {"country": "EUROPE"}))


@register(
    "trend_orders",
    """
slice AS (SELECT * FROM orders_long WHERE lower(trim(metric)) = 'orders'
          AND lower(trim(city)) = 'nation_3' AND week BETWEEN 0 AND 8)
SELECT row_number() OVER (ORDER BY week DESC) AS position, week, round(coalesce(sum("value"), 0.0), 6) AS "value" FROM slice GROUP BY week""",
)
def trend_orders(spark, sf_dir):
    """Total Orders in NATION_3 over all 9 weeks."""
    m, o = zone_tables(spark, sf_dir)
    return numbered(Q.trend(m, o, "Orders", 9, "sum", {"city": "NATION_3"}))


# ---------------------------------------------------------------------------
# E5 multivariable filter
# ---------------------------------------------------------------------------
def _multi_sql(conds, logical, filters_sql="", week=0):
    """conds: list of (metric, op, value) → SQL with per-condition CTEs."""
    ctes, sel = [], []
    for i, (metric, op, val) in enumerate(conds):
        table = "orders_long" if metric.lower() == "orders" else "metrics_long"
        ctes.append(
            f"""c{i}_rows AS (SELECT country, city, zone, avg("value") AS v FROM {table}
    WHERE lower(trim(metric)) = '{metric.lower()}' AND week = {week}{filters_sql} GROUP BY country, city, zone)"""
        )
        if op in ("high", "low"):
            q = 0.75 if op == "high" else 0.25
            cmp = ">=" if op == "high" else "<="
            pred = f"v {cmp} (SELECT quantile_cont(v, {q}) FROM c{i}_rows)"
        else:
            cmp = {"gt": ">", "lt": "<", "eq": "="}[op]
            pred = f"v {cmp} {float(val)}"
        ctes.append(f"c{i} AS (SELECT country, city, zone FROM c{i}_rows WHERE {pred})")
        sel.append(f"SELECT country, city, zone FROM c{i}")
    keep = f"= {len(conds)}" if logical == "and" else ">= 1"
    return (
        ",\n".join(ctes)
        + f""",
matches AS ({' UNION ALL '.join(sel)})
SELECT row_number() OVER (ORDER BY count(*) DESC, country, city, zone) AS position,
       country, city, zone, CAST(count(*) AS BIGINT) AS matched_conditions
FROM matches GROUP BY country, city, zone HAVING count(*) {keep}"""
    )


_MULTI_AND = [("Lead Penetration", "high", None), ("Perfect Orders", "low", None)]
_MULTI_OR = [("Turbo Adoption", "high", None), ("Orders", "low", None), ("Gross Profit UE", "lt", 0.0)]
_MULTI_NUM = [("Perfect Orders", "gt", 0.7), ("Lead Penetration", "lt", 0.45), ("Orders", "gt", 8.0)]


_MULTI_EQ = [("Orders", "eq", 10.0), ("Perfect Orders", "gt", 0.0)]


@register("multi_eq", _multi_sql(_MULTI_EQ, "and", "", 1))
def multi_eq(spark, sf_dir):
    """Zones with exactly ten Orders and a positive Perfect Orders share, week 1."""
    m, o = zone_tables(spark, sf_dir)
    return numbered(Q.multivariable_filter(m, o, _MULTI_EQ, "and", None, 1))


@register("multi_and", _multi_sql(_MULTI_AND, "and"))
def multi_and(spark, sf_dir):
    """E5: high Lead Penetration AND low Perfect Orders."""
    m, o = zone_tables(spark, sf_dir)
    return numbered(Q.multivariable_filter(m, o, _MULTI_AND, "and"))


@register("multi_or", _multi_sql(_MULTI_OR, "or", " AND lower(trim(country)) = 'america'", 0))
def multi_or(spark, sf_dir):
    """E5: high Turbo Adoption OR low Orders OR negative Gross Profit UE in AMERICA."""
    m, o = zone_tables(spark, sf_dir)
    return numbered(Q.multivariable_filter(m, o, _MULTI_OR, "or", {"country": "AMERICA"}))


@register("multi_numeric", _multi_sql(_MULTI_NUM, "and", "", 2))
def multi_numeric(spark, sf_dir):
    """E5: numeric thresholds gt/lt across metrics and Orders, week 2."""
    m, o = zone_tables(spark, sf_dir)
    return numbered(Q.multivariable_filter(m, o, _MULTI_NUM, "and", None, 2))


# ---------------------------------------------------------------------------
# E6 growth
# ---------------------------------------------------------------------------
def _growth_sql(last_n, top_k, filters_sql=""):
    return f"""
win AS (SELECT * FROM orders_long WHERE lower(trim(metric)) = 'orders'{filters_sql} AND week BETWEEN 0 AND {last_n - 1}),
oldest AS (SELECT max(week) AS w FROM win),
per_zone AS (
  SELECT zone,
         avg(CASE WHEN week = 0 THEN "value" END) AS cur,
         avg(CASE WHEN week = (SELECT w FROM oldest) THEN "value" END) AS base
  FROM win GROUP BY zone)
SELECT row_number() OVER (ORDER BY cur - base DESC NULLS LAST, zone ASC NULLS LAST) AS position,
       zone, round(cur, 6) AS current_value, round(base, 6) AS baseline_value,
       round(cur - base, 6) AS absolute_growth,
       round(CASE WHEN base <> 0 THEN (cur - base) / abs(base) END, 6) AS growth_rate
FROM per_zone WHERE cur IS NOT NULL AND base IS NOT NULL
ORDER BY cur - base DESC NULLS LAST, zone ASC NULLS LAST LIMIT {top_k}"""


@register("growth", _growth_sql(5, 10))
def growth(spark, sf_dir):
    """Top 10 zones by Orders growth over the last 5 weeks."""
    m, o = zone_tables(spark, sf_dir)
    return numbered(Q.growth(m, o, 5, 10))


@register("growth_filtered", _growth_sql(9, 50, " AND lower(trim(country)) = 'africa'"))
def growth_filtered(spark, sf_dir):
    """All (≤50) AFRICA zones by Orders growth over 9 weeks."""
    m, o = zone_tables(spark, sf_dir)
    return numbered(Q.growth(m, o, 9, 50, {"country": "AFRICA"}))


_GROWTH_META_SQL = """
win AS (SELECT * FROM orders_long WHERE week BETWEEN 0 AND 4)
SELECT CAST((SELECT max(week) FROM win) AS INTEGER) AS baseline_week, f.field, f.value_format, CAST(f.decimals AS INTEGER) AS decimals
FROM (VALUES ('current_value', 'integer', 0), ('baseline_value', 'integer', 0), ('absolute_growth', 'integer', 0),
             ('growth_rate', 'percentage_ratio', 2)) f(field, value_format, decimals)"""


@register("growth_metadata", _GROWTH_META_SQL)
def growth_metadata(spark, sf_dir):
    """The baseline week and the display format of each value column."""
    m, o = zone_tables(spark, sf_dir)
    meta = run_query("growth_analysis", m, o, last_n_weeks=5, top_k=10).metadata
    rows = [(meta["baseline_week"], field, kind, decimals) for field, (kind, decimals) in meta["column_display"].items()]
    return spark.createDataFrame(rows, "baseline_week int, field string, value_format string, decimals int")


# ---------------------------------------------------------------------------
# E7 drill-down
# ---------------------------------------------------------------------------
@register(
    "drill_down",
    """
slice AS (SELECT * FROM metrics_long WHERE lower(trim(metric)) = 'turbo adoption'
          AND lower(trim(country)) = 'asia' AND week = 0)
SELECT row_number() OVER (ORDER BY avg("value") DESC NULLS LAST, city) AS position,
       city, round(avg("value"), 6) AS "value" FROM slice GROUP BY city""",
)
def drill_down(spark, sf_dir):
    """Turbo Adoption by country with country fixed → drills to city."""
    m, o = zone_tables(spark, sf_dir)
    return numbered(Q.aggregation(m, o, "Turbo Adoption", "country", "mean", {"country": "ASIA"}))
