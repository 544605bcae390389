"""Registered detector queries K1–K5 with oracle SQL."""

from __future__ import annotations

from zonepulse.functions.ranks import numbered
from zonepulse.operators import detectors as D
from zonepulse.plans.registry import register
from zonepulse.sources.adapter import zone_tables

NOT_NULL = "country IS NOT NULL AND city IS NOT NULL AND zone IS NOT NULL AND metric IS NOT NULL AND week IS NOT NULL AND \"value\" IS NOT NULL"
BASE_UNION = f"""
base AS (
  SELECT country, city, zone, metric, week, "value" FROM metrics_long WHERE {NOT_NULL}
  UNION ALL
  SELECT country, city, zone, metric, week, "value" FROM orders_long WHERE {NOT_NULL})"""


BODIES: dict[str, str] = {}


def detector_sql(name: str, body: str, doubles: list[str]) -> str:
    """Body ends with an unrounded CTE ``res``; the registered SQL rounds doubles."""
    BODIES[name] = body
    repl = ", ".join(f"round({c}, 6) AS {c}" for c in doubles)
    return body + f"\nSELECT * REPLACE ({repl}) FROM res"


def clamp_sql(x: str) -> str:
    return f"least(greatest({x}, 0.0), 100.0)"


def r2_sql(x: str) -> str:
    return f"floor(({x}) * 100.0 + 0.5) / 100.0"


@register(
    "anomalies",
    detector_sql("anomalies", BASE_UNION + """,
g AS (SELECT country, city, zone, metric,
             avg(CASE WHEN week = 0 THEN "value" END) AS w0,
             avg(CASE WHEN week = 1 THEN "value" END) AS w1
      FROM base WHERE week IN (0, 1) GROUP BY country, city, zone, metric),
c AS (SELECT *, CASE WHEN abs(w1) > 1e-9 THEN (w0 - w1) / abs(w1) END AS pct,
             abs(w0 - w1) AS d, abs(w1) AS bl, (w0 * w1) < 0 AS flip
      FROM g WHERE w0 IS NOT NULL AND w1 IS NOT NULL),
f AS (SELECT *,
        (CASE WHEN bl >= 1.0 THEN 2 WHEN bl >= 0.35 THEN 1 ELSE 0 END)
      + (CASE WHEN d >= 0.5 THEN 2 WHEN d >= 0.2 THEN 1 ELSE 0 END)
      + (CASE WHEN abs(pct) >= 0.4 THEN 2 WHEN abs(pct) >= 0.2 THEN 1 ELSE 0 END)
      - (CASE WHEN flip THEN 2 ELSE 0 END) AS pts
      FROM c WHERE pct IS NOT NULL AND bl >= 0.10 AND d >= 0.05 AND abs(pct) >= 0.10 AND (NOT flip OR d >= 0.20)),
s AS (SELECT *, CASE WHEN bl < 0.3 AND abs(pct) > 2.5 THEN 'low' WHEN pts >= 5 THEN 'high'
                     WHEN pts >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM f),
k AS (SELECT *, """ + clamp_sql("(abs(pct) * 180.0 + least(d, 2.0) * 20.0) * (CASE WHEN flip THEN 0.85 ELSE 1.0 END) * (CASE WHEN confidence = 'medium' THEN 0.93 ELSE 1.0 END)") + """ AS sev
      FROM s WHERE confidence IN ('high', 'medium')),
r AS (SELECT *, row_number() OVER (ORDER BY sev DESC, pct DESC, country, city, zone, metric) AS rnk FROM k),
res AS (SELECT CAST(rnk AS BIGINT) AS "rank", country, city, zone, metric,
       w0 AS week_0_value, w1 AS week_1_value, pct AS pct_change,
       d AS abs_delta, bl AS baseline_abs, flip AS sign_flip, confidence,
       CASE WHEN pct > 0 THEN 'improvement' ELSE 'deterioration' END AS direction,
       sev AS severity, """ + r2_sql("sev") + """ AS severity_score
FROM r)""", ["week_0_value", "week_1_value", "pct_change", "abs_delta", "baseline_abs", "severity", "severity_score"]),
)
def anomalies(spark, sf_dir):
    """K1: week-over-week anomalies."""
    m, o = zone_tables(spark, sf_dir)
    return numbered(D.in_order(D.detect_anomalies(m, o), D.ANOMALY_ORDER), "rank")


@register(
    "trends",
    detector_sql("trends", f"""
wk AS (SELECT country, city, zone, metric, week, avg("value") AS v FROM metrics_long WHERE {NOT_NULL}
       GROUP BY country, city, zone, metric, week),
st AS (SELECT *, lag(week) OVER w AS pw, lag(v) OVER w AS pv,
              count(*) OVER (PARTITION BY country, city, zone, metric) AS n_rows
       FROM wk WINDOW w AS (PARTITION BY country, city, zone, metric ORDER BY week DESC)),
st2 AS (SELECT *, coalesce(pw - week = 1 AND (CASE WHEN metric IN ('Restaurants Markdowns / GMV', 'Non-Pro PTC > OP')
                                                  THEN v > pv ELSE v < pv END), false) AS step FROM st),
isl AS (SELECT *, sum(CASE WHEN step THEN 0 ELSE 1 END) OVER (PARTITION BY country, city, zone, metric
                  ORDER BY week DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM st2),
runs AS (SELECT country, city, zone, metric, island, count(*) FILTER (WHERE step) AS run_length,
                max(week) AS start_week, min(week) AS end_week, arg_max(v, week) AS start_value,
                arg_min(v, week) AS end_value, max(n_rows) AS n_rows
         FROM isl GROUP BY country, city, zone, metric, island),
best AS (SELECT *, row_number() OVER (PARTITION BY country, city, zone, metric
                                      ORDER BY run_length DESC, start_week DESC) AS pick
         FROM runs WHERE n_rows >= 4 AND run_length >= 1),
t AS (SELECT *, CASE WHEN abs(start_value) > 1e-9 THEN (end_value - start_value) / abs(start_value) END AS net
      FROM best WHERE pick = 1 AND run_length >= 3),
k AS (SELECT *, {clamp_sql("least(100.0, run_length * 15.0 + coalesce(abs(net) * 120.0, 0.0))")} AS sev FROM t),
k2 AS (SELECT *, {r2_sql("sev")} AS sev2 FROM k),
r AS (SELECT *, row_number() OVER (ORDER BY sev2 DESC, country, city, zone, metric) AS rnk FROM k2),
res AS (SELECT CAST(rnk AS BIGINT) AS "rank", country, city, zone, metric, run_length, start_week, end_week,
       start_value, end_value, net AS net_change_pct,
       metric NOT IN ('Restaurants Markdowns / GMV', 'Non-Pro PTC > OP') AS higher_is_better,
       sev AS severity, sev2 AS severity_score
FROM r)""", ["start_value", "end_value", "net_change_pct", "severity", "severity_score"]),
)
def trends(spark, sf_dir):
    """K2: longest deteriorating runs of ≥3 weeks."""
    m, o = zone_tables(spark, sf_dir)
    return numbered(D.in_order(D.detect_trends(m, o), D.TREND_ORDER), "rank")


@register(
    "benchmarking",
    detector_sql("benchmarking", f"""
base AS (
  SELECT country, city, zone, zone_type, metric, week, "value" FROM metrics_long WHERE {NOT_NULL}
  UNION ALL
  SELECT country, city, zone, CAST(NULL AS VARCHAR), metric, week, "value" FROM orders_long WHERE {NOT_NULL}),
snap AS (SELECT country, city, zone, zone_type, metric, avg("value") AS v FROM base
         WHERE week = 0 AND zone_type IS NOT NULL GROUP BY country, city, zone, zone_type, metric),
b AS (SELECT *, country || '||' || metric || '||' ||
             CASE WHEN zone_type IS NOT NULL AND trim(zone_type) <> '' THEN zone_type ELSE 'ALL' END AS bucket FROM snap),
st AS (SELECT bucket, sum(v) AS ps, count(v) AS pc FROM b GROUP BY bucket),
j AS (SELECT b.*, ps, pc, round((ps - v) / greatest(pc - 1, 1), 12) AS pm FROM b JOIN st USING (bucket) WHERE pc >= 5),
g AS (SELECT *, (v - pm) / abs(pm) AS gap FROM j WHERE pc > 1 AND abs(pm) > 1e-9),
k AS (SELECT *, {clamp_sql("least(abs(gap) * 180.0, 100.0)")} AS sev FROM g WHERE abs(gap) >= 0.15),
r AS (SELECT *, row_number() OVER (ORDER BY sev DESC, country, city, zone, metric, zone_type NULLS LAST) AS rnk FROM k),
res AS (SELECT CAST(rnk AS BIGINT) AS "rank", country, city, zone, metric, zone_type, v AS zone_value,
       pm AS peer_mean, gap AS gap_pct, pc AS peer_count,
       CASE WHEN gap > 0 THEN 'above' ELSE 'below' END AS direction,
       sev AS severity, {r2_sql("sev")} AS severity_score
FROM r)""", ["zone_value", "peer_mean", "gap_pct", "severity", "severity_score"]),
)
def benchmarking(spark, sf_dir):
    """K3: zones ≥15% away from their peer group's mean."""
    m, o = zone_tables(spark, sf_dir)
    return numbered(D.in_order(D.detect_benchmarking(m, o), D.BENCHMARK_ORDER), "rank")


_PAIRS_SQL = """SELECT country, 0 AS pair, 'Lead Penetration' AS metric_x, 'Perfect Orders' AS metric_y, m1 AS x, m3 AS y FROM wide
  UNION ALL SELECT country, 1, 'Perfect Orders', 'Orders', m3, m2 FROM wide
  UNION ALL SELECT country, 2, 'Gross Profit UE', 'Orders', m0, m2 FROM wide"""


@register(
    "correlations",
    detector_sql("correlations", BASE_UNION + """,
snap AS (SELECT country, city, zone, metric, avg("value") AS v FROM base
         WHERE week = 0 AND metric IN ('Gross Profit UE', 'Lead Penetration', 'Orders', 'Perfect Orders')
         GROUP BY country, city, zone, metric),
wide AS (SELECT country, city, zone,
                avg(CASE WHEN metric = 'Gross Profit UE' THEN v END) AS m0,
                avg(CASE WHEN metric = 'Lead Penetration' THEN v END) AS m1,
                avg(CASE WHEN metric = 'Orders' THEN v END) AS m2,
                avg(CASE WHEN metric = 'Perfect Orders' THEN v END) AS m3
         FROM snap GROUP BY country, city, zone),
pairs AS (""" + _PAIRS_SQL + """),
st AS (SELECT country, pair, metric_x, metric_y, count(*) AS n, corr(x, y) AS rr,
              stddev_pop(x) AS sx, stddev_pop(y) AS sy
       FROM pairs WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY country, pair, metric_x, metric_y),
c AS (SELECT *, CASE WHEN sx > 0 AND sy > 0 THEN rr END AS r FROM st),
k AS (SELECT *, """ + clamp_sql("least(100.0, abs(r) * 100.0 + least(20.0, n * 0.5))") + """ AS sev
      FROM c WHERE n >= 8 AND r IS NOT NULL AND abs(r) >= 0.45),
k2 AS (SELECT *, """ + r2_sql("sev") + """ AS sev2 FROM k),
rk AS (SELECT *, row_number() OVER (ORDER BY sev2 DESC, country, pair) AS rnk FROM k2),
res AS (SELECT CAST(rnk AS BIGINT) AS "rank", country, pair, metric_x, metric_y, r AS correlation,
       n AS sample_size, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction,
       sev AS severity, sev2 AS severity_score
FROM rk)""", ["correlation", "severity", "severity_score"]),
)
def correlations(spark, sf_dir):
    """K4: metric-pair correlations per country at week 0."""
    m, o = zone_tables(spark, sf_dir)
    return numbered(D.in_order(D.detect_correlations(m, o), D.CORRELATION_ORDER), "rank")


MSNAP = f"""
msnap AS (SELECT country, city, zone, zone_type, metric, avg("value") AS v FROM metrics_long
          WHERE {NOT_NULL} AND week = 0 AND zone_type IS NOT NULL
          GROUP BY country, city, zone, zone_type, metric)"""

_RULE1 = MSNAP + f""",
og AS (SELECT country, city, zone, avg(CASE WHEN week = 0 THEN "value" END) AS w0,
              avg(CASE WHEN week = 3 THEN "value" END) AS w3
       FROM orders_long WHERE country IS NOT NULL AND city IS NOT NULL AND zone IS NOT NULL
            AND week IS NOT NULL AND "value" IS NOT NULL AND week IN (0, 3)
       GROUP BY country, city, zone),
g AS (SELECT *, CASE WHEN abs(w3) > 1e-9 THEN (w0 - w3) / abs(w3) END AS gr FROM og),
q AS (SELECT country, city, zone, zone_type, v AS po FROM msnap WHERE metric = 'Perfect Orders'),
med AS (SELECT country, median(po) AS med FROM q GROUP BY country),
j AS (SELECT g.country, g.city, g.zone, q.zone_type, gr, po, med
      FROM g JOIN q ON g.country = q.country AND g.city = q.city AND g.zone = q.zone
      JOIN med ON g.country = med.country
      WHERE gr IS NOT NULL AND med IS NOT NULL AND gr >= 0.10 AND po < med),
rule1 AS (SELECT 1 AS rule, country, city, zone, zone_type, gr AS orders_growth_pct, po AS perfect_orders,
          med AS country_perfect_orders_median,
          {clamp_sql("least(100.0, greatest(0.0, gr - 0.10) * 260.0 + greatest(0.0, CASE WHEN abs(med) > 1e-9 THEN (med - po) / abs(med) ELSE 0.0 END) * 120.0 + 25.0)")} AS severity
          FROM j)"""

_RULE2 = MSNAP + f""",
w2 AS (SELECT country, city, zone, zone_type,
              avg(CASE WHEN metric = 'Perfect Orders' THEN v END) AS po,
              avg(CASE WHEN metric = 'Lead Penetration' THEN v END) AS lp
       FROM msnap WHERE metric IN ('Perfect Orders', 'Lead Penetration') GROUP BY country, city, zone, zone_type),
q2 AS (SELECT country, quantile_cont(po, 0.75) AS p75, quantile_cont(lp, 0.25) AS p25 FROM w2 GROUP BY country),
rule2 AS (SELECT 2 AS rule, w2.country, city, zone, zone_type, po AS perfect_orders, lp AS lead_penetration,
          p75 AS country_quality_p75, p25 AS country_penetration_p25,
          {clamp_sql("least(100.0, 30.0 + greatest(0.0, CASE WHEN abs(p75) > 1e-9 THEN (po - p75) / abs(p75) ELSE 0.0 END) * 120.0 + greatest(0.0, CASE WHEN abs(p25) > 1e-9 THEN (p25 - lp) / abs(p25) ELSE 0.0 END) * 140.0)")} AS severity
          FROM w2 JOIN q2 ON w2.country = q2.country WHERE po >= p75 AND lp <= p25)"""

_RULE3 = MSNAP + f""",
w3 AS (SELECT country, city, zone, zone_type,
              avg(CASE WHEN metric = 'Gross Profit UE' THEN v END) AS gp,
              avg(CASE WHEN metric = 'Turbo Adoption' THEN v END) AS tu
       FROM msnap WHERE metric IN ('Gross Profit UE', 'Turbo Adoption') GROUP BY country, city, zone, zone_type),
q3 AS (SELECT country, quantile_cont(gp, 0.90) AS p90, median(tu) AS tmed FROM w3 GROUP BY country),
rule3 AS (SELECT 3 AS rule, w3.country, city, zone, zone_type, gp AS gross_profit_ue, tu AS turbo_adoption,
          p90 AS country_gp_top_decile, tmed AS country_turbo_median,
          {clamp_sql("least(100.0, 25.0 + greatest(0.0, CASE WHEN abs(p90) > 1e-9 THEN (gp - p90) / abs(p90) ELSE 0.0 END) * 160.0 + greatest(0.0, CASE WHEN abs(tmed) > 1e-9 THEN (tu - tmed) / abs(tmed) ELSE 0.0 END) * 100.0)")} AS severity
          FROM w3 JOIN q3 ON w3.country = q3.country WHERE gp >= p90 AND tu > tmed)"""


def _rule_select(name: str, cols: list[str]) -> str:
    body = ", ".join(f"round({c}, 6) AS {c}" for c in cols)
    return (f"SELECT rule, country, city, zone, zone_type, {body}, round(severity, 6) AS severity, "
            f"round({r2_sql('severity')}, 6) AS severity_score FROM {name}")


_R1_COLS = ["orders_growth_pct", "perfect_orders", "country_perfect_orders_median"]
_R2_COLS = ["perfect_orders", "lead_penetration", "country_quality_p75", "country_penetration_p25"]
_R3_COLS = ["gross_profit_ue", "turbo_adoption", "country_gp_top_decile", "country_turbo_median"]


@register("opp_growth_quality", _RULE1 + "\n" + _rule_select("rule1", _R1_COLS))
def opp_growth_quality(spark, sf_dir):
    """K5 rule 1: orders growth ≥10% with Perfect Orders below the country median."""
    m, o = zone_tables(spark, sf_dir)
    return D.opportunity_growth_quality(m, o)


@register("opp_quality_penetration", _RULE2 + "\n" + _rule_select("rule2", _R2_COLS))
def opp_quality_penetration(spark, sf_dir):
    """K5 rule 2: quality ≥ country p75 with penetration ≤ country p25."""
    m, o = zone_tables(spark, sf_dir)
    return D.opportunity_quality_penetration(m)


@register("opp_replication", _RULE3 + "\n" + _rule_select("rule3", _R3_COLS))
def opp_replication(spark, sf_dir):
    """K5 rule 3: Gross Profit UE ≥ country p90 with Turbo Adoption above the median."""
    m, o = zone_tables(spark, sf_dir)
    return D.opportunity_replication(m)


_ALL_OPP_COLS = _R1_COLS + [c for c in _R2_COLS if c not in _R1_COLS] + _R3_COLS


def _padded(name, cols):
    parts = [f"{c}" if c in cols else f"CAST(NULL AS DOUBLE) AS {c}" for c in _ALL_OPP_COLS]
    return f"SELECT rule, country, city, zone, zone_type, {', '.join(parts)}, severity FROM {name}"


@register(
    "opportunities",
    detector_sql("opportunities", (_RULE1 + "," + _RULE2.replace(MSNAP + ",", "") + "," + _RULE3.replace(MSNAP + ",", "") + f""",
allr AS ({_padded('rule1', _R1_COLS)} UNION ALL {_padded('rule2', _R2_COLS)} UNION ALL {_padded('rule3', _R3_COLS)}),
k AS (SELECT *, {r2_sql('severity')} AS sev2 FROM allr),
rk AS (SELECT *, row_number() OVER (ORDER BY sev2 DESC, rule, country, city, zone, zone_type) AS rnk FROM k),
res AS (SELECT CAST(rnk AS BIGINT) AS "rank", rule, country, city, zone, zone_type,
       {', '.join(_ALL_OPP_COLS)}, severity, sev2 AS severity_score
FROM rk)"""), _ALL_OPP_COLS + ["severity", "severity_score"]),
)
def opportunities(spark, sf_dir):
    """K5: the three opportunity rules together."""
    m, o = zone_tables(spark, sf_dir)
    return numbered(D.in_order(D.detect_opportunities(m, o), D.OPPORTUNITY_ORDER), "rank")
