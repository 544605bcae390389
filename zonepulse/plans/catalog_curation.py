"""Registered queries K6 and L1–L8 with oracle SQL.

The oracle nests each detector's SQL as a sub-CTE, builds the insight texts
from its own literals, and reproduces curation with a rank over all findings.
Its de-duplication is the two-pass window form, which agrees with the greedy
rule on detector output and on the planted copies (each copy's altered metric
or summary is unique); the Spark side runs the general greedy rule.
"""

from __future__ import annotations


from zonepulse.functions.ranks import numbered
from zonepulse.operators import curation as C
from zonepulse.plans.catalog_detectors import BODIES
from zonepulse.plans.insights import collect_insights, run_insights
from zonepulse.plans.registry import register
from zonepulse.session import materialize
from zonepulse.sources.adapter import zone_tables
from zonepulse.sources.fixtures import copied_insights, noisy_insights


def _nested(name: str) -> str:
    return f"k_{name} AS (WITH {BODIES[name]}\nSELECT * FROM res)"


OPPORTUNITY_FIELDS = ("orders_growth_pct", "perfect_orders", "country_perfect_orders_median", "lead_penetration",
                      "country_quality_p75", "country_penetration_p25", "gross_profit_ue", "country_gp_top_decile",
                      "turbo_adoption", "country_turbo_median")
UNIFIED = [
    ("insight_id", "VARCHAR"), ("detector_ord", "INTEGER"), ("emit_ord", "BIGINT"), ("category", "VARCHAR"),
    ("title", "VARCHAR"), ("metric", "VARCHAR"), ("country", "VARCHAR"), ("city", "VARCHAR"), ("zone", "VARCHAR"),
    ("severity_score", "DOUBLE"), ("summary", "VARCHAR"), ("recommendation_hint", "VARCHAR"), ("confidence", "VARCHAR"),
    ("affected_zones_count", "BIGINT"), ("direction", "VARCHAR"),
    ("week_1_value", "DOUBLE"), ("week_0_value", "DOUBLE"), ("pct_change", "DOUBLE"), ("baseline_abs", "DOUBLE"),
    ("abs_delta", "DOUBLE"), ("sign_flip", "BOOLEAN"), ("run_length", "BIGINT"), ("start_week", "INTEGER"),
    ("end_week", "INTEGER"), ("start_value", "DOUBLE"), ("end_value", "DOUBLE"), ("net_change_pct", "DOUBLE"),
    ("higher_is_better", "BOOLEAN"), ("zone_value", "DOUBLE"), ("peer_mean", "DOUBLE"), ("gap_pct", "DOUBLE"),
    ("peer_count", "BIGINT"), ("zone_type", "VARCHAR"), ("metric_x", "VARCHAR"), ("metric_y", "VARCHAR"),
    ("correlation", "DOUBLE"), ("sample_size", "BIGINT"),
] + [(f, "DOUBLE") for f in OPPORTUNITY_FIELDS]


_OPP = {
    "title": "CASE rule WHEN 1 THEN 'Growth momentum with quality risk' WHEN 2 THEN 'High quality with low penetration upside' ELSE 'Replication candidate zone' END",
    "metric": "CASE rule WHEN 1 THEN 'Orders + Perfect Orders' WHEN 2 THEN 'Perfect Orders + Lead Penetration' ELSE 'Gross Profit UE + Turbo Adoption' END",
    "summary": "CASE rule WHEN 1 THEN 'Orders are growing quickly in ' || zone || ' while Perfect Orders are below the country median.' "
               "WHEN 2 THEN zone || ' combines strong quality with low penetration, suggesting expansion potential.' "
               "ELSE zone || ' is in the top decile for Gross Profit UE and above median Turbo Adoption in ' || country || '.' END",
    "recommendation_hint": "CASE rule WHEN 1 THEN 'Bring quality up before adding demand.' "
                           "WHEN 2 THEN 'Add shops and customers while quality is high.' ELSE 'Write down how this zone works.' END",
    "affected_zones_count": "1",
}
_OPP.update({f: f for f in OPPORTUNITY_FIELDS})

_SOURCES = [
    ("anomalies", 0, {
        "title": "'Large WoW ' || direction || ' in ' || metric", "metric": "metric",
        "country": "country", "city": "city", "zone": "zone",
        "summary": "metric || ' in ' || zone || ' (' || city || ', ' || country || ') shows a ' || printf('%.2f', pct_change * 100.0)"
                   " || '% week-over-week ' || direction || CASE WHEN sign_flip THEN ' with a sign flip; treat this as high-volatility movement.' ELSE '.' END",
        "recommendation_hint": "CASE WHEN contains(lower(metric), 'gross profit') AND direction = 'deterioration' THEN 'See which cost or discount took the margin.' "
                               "WHEN contains(lower(metric), 'gross profit') THEN 'See which price or cost gave the margin.' "
                               "WHEN contains(lower(metric), 'perfect orders') THEN 'Sort the week''s failed orders by cause.' "
                               "WHEN contains(lower(metric), 'lead penetration') THEN 'Count the shops signed and switched on.' "
                               "WHEN contains(lower(metric), 'adoption') THEN 'Look at availability during the busiest hours.' "
                               "WHEN lower(metric) = 'orders' THEN 'Look for events that moved demand before changing spend.' "
                               "ELSE 'Ask the zone what changed within the week.' END",
        "confidence": "confidence", "affected_zones_count": "1", "direction": "direction",
        **{c: c for c in ("week_1_value", "week_0_value", "pct_change", "baseline_abs", "abs_delta", "sign_flip")},
    }),
    ("trends", 1, {
        "title": "'Concerning deterioration trend in ' || metric", "metric": "metric",
        "country": "country", "city": "city", "zone": "zone",
        "summary": "metric || ' in ' || zone || ' (' || city || ', ' || country || ') has deteriorated for ' || CAST(run_length AS VARCHAR) || ' consecutive weeks.'",
        "recommendation_hint": "'Start from the week in which the decline began.'", "affected_zones_count": "1",
        **{c: c for c in ("run_length", "start_week", "end_week", "start_value", "end_value", "net_change_pct", "higher_is_better")},
    }),
    ("benchmarking", 2, {
        "title": "zone || ' diverges from peers on ' || metric", "metric": "metric",
        "country": "country", "city": "city", "zone": "zone",
        "summary": "zone || ' is ' || printf('%.2f', abs(gap_pct) * 100.0) || '% ' || direction || ' peer average for ' || metric || ' within comparable zones in ' || country || '.'",
        "recommendation_hint": "'Compare this zone with the best of its group.'", "affected_zones_count": "peer_count",
        **{c: c for c in ("zone_value", "peer_mean", "gap_pct", "peer_count", "zone_type")},
    }),
    ("correlations", 3, {
        "title": "metric_x || ' and ' || metric_y || ' show a strong ' || direction || ' relationship'",
        "metric": "metric_x || ' vs ' || metric_y", "country": "country",
        "summary": "'In ' || country || ', ' || metric_x || ' and ' || metric_y || ' are strongly ' || direction || ' across zones (r=' || printf('%.2f', correlation) || ').'",
        "recommendation_hint": "'Watch the two numbers side by side.'", "affected_zones_count": "sample_size",
        **{c: c for c in ("metric_x", "metric_y", "correlation", "sample_size")},
    }),
    ("opportunities", 4, dict(_OPP, country="country", city="city", zone="zone")),
]


_KEYS = {
    "anomalies": "country, city, zone, metric",
    "trends": "country, city, zone, metric",
    "benchmarking": "country, city, zone, metric, zone_type",
    "correlations": "country, CAST(pair AS VARCHAR)",
    "opportunities": "CAST(rule AS VARCHAR), country, city, zone, zone_type",
}


def _branch(category: str, ord_: int, mapping: dict) -> str:
    cols = []
    for name, typ in UNIFIED:
        if name == "insight_id":
            expr = f"md5(concat_ws('|', '{category}', {_KEYS[category]}))"
        elif name == "detector_ord":
            expr = str(ord_)
        elif name == "emit_ord":
            expr = '"rank"'
        elif name == "category":
            expr = f"'{category}'"
        elif name == "severity_score":
            expr = "severity_score"
        else:
            expr = mapping.get(name, "NULL")
        cols.append(f"CAST({expr} AS {typ}) AS {name}")
    return f"SELECT {', '.join(cols)} FROM k_{category}"


FINDINGS_CTE = ",\n".join(_nested(n) for n in ("anomalies", "trends", "benchmarking", "correlations", "opportunities")) + """,
ins AS (
  """ + "\n  UNION ALL\n  ".join(_branch(c, o, m) for c, o, m in _SOURCES) + """
)"""

_NUMBERS = ("coalesce(baseline_abs, abs(coalesce(week_1_value, 0.0)))", "coalesce(abs_delta, coalesce(week_0_value, 0.0) - coalesce(week_1_value, 0.0))")


def _filtered(source: str, name: str) -> str:
    base, change = _NUMBERS
    return f"""{name} AS (
  SELECT * FROM {source}
  WHERE category IN ('anomalies', 'trends', 'benchmarking', 'correlations', 'opportunities')
    AND trim(coalesce(title, '')) <> '' AND trim(coalesce(metric, '')) <> '' AND trim(coalesce(summary, '')) <> ''
    AND NOT (category = 'anomalies' AND (
        lower(coalesce(confidence, '')) = 'low'
     OR (abs({base}) < 0.05 AND abs({change}) < 0.05)
     OR (abs(coalesce(pct_change, 0.0)) > 5.0 AND abs({change}) < 0.2)
     OR abs({change}) < 0.01
     OR (coalesce(sign_flip, false) AND abs({change}) < 0.2)))
)"""


def _ranked_cte(source: str) -> str:
    return f"""scored AS (
  SELECT *, floor((severity_score * 0.75
           + CASE category WHEN 'opportunities' THEN 8.0 WHEN 'trends' THEN 7.0 WHEN 'anomalies' THEN 6.0
                           WHEN 'benchmarking' THEN 5.0 ELSE 4.0 END
           + least(12.0, greatest(1.0, CAST(affected_zones_count AS DOUBLE))) + 3.0) * 100.0 + 0.5) / 100.0 AS priority_score,
         CASE WHEN coalesce(trim(zone), '') <> ''
              THEN lower(trim(coalesce(country, ''))) || '|' || lower(trim(coalesce(city, ''))) || '|' || lower(trim(zone))
              ELSE '' END AS zone_key,
         lower(trim(regexp_replace(metric, '\\s+', ' ', 'g'))) AS metric_key,
         lower(trim(regexp_replace(summary, '\\s+', ' ', 'g'))) AS signature
  FROM {source}
),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY priority_score DESC, severity_score DESC, detector_ord, emit_ord) AS curation_rank
  FROM scored
),
pass1 AS (
  SELECT *, row_number() OVER (PARTITION BY category, zone_key, metric_key ORDER BY curation_rank) AS rn1 FROM ranked
),
pass2 AS (
  SELECT *, row_number() OVER (PARTITION BY category, zone_key, signature ORDER BY curation_rank) AS rn2
  FROM pass1 WHERE zone_key = '' OR rn1 = 1
),
deduped AS (
  SELECT * EXCLUDE (rn1, rn2) FROM pass2 WHERE zone_key = '' OR rn2 = 1
)"""


INSIGHTS_CTE = FINDINGS_CTE + ",\n" + _filtered("ins", "filtered") + ",\n" + _ranked_cte("filtered") + """,
zone_capped AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY zone_key ORDER BY curation_rank) AS zrn FROM deduped)
  WHERE zone_key = '' OR zrn <= 1
),
div_src AS (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY curation_rank) AS cat_rn,
         CASE category WHEN 'anomalies' THEN 0 WHEN 'trends' THEN 1 WHEN 'benchmarking' THEN 2
                       WHEN 'correlations' THEN 3 ELSE 4 END AS cat_ord
  FROM zone_capped
),
diversity AS (
  SELECT *, row_number() OVER (ORDER BY pick_key) AS summary_ord FROM (
    SELECT *, CASE WHEN cat_rn = 1 THEN cat_ord ELSE 5 + curation_rank END AS pick_key
    FROM div_src WHERE cat_rn <= 2 ORDER BY pick_key LIMIT 5)
),
top3 AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY curation_rank) AS category_rank FROM deduped)
  WHERE category_rank <= 3
)"""


def _sql(select: str) -> str:
    return INSIGHTS_CTE + "\n" + select.strip()


@register("insights", _sql("""
SELECT insight_id, detector_ord, category, title, metric, country, city, zone,
       round(severity_score, 6) AS severity_score, summary, recommendation_hint, confidence, affected_zones_count FROM ins"""))
def insights(spark, sf_dir):
    """K6: all detector findings as one insight table (titles, summaries and hints included)."""
    m, o = zone_tables(spark, sf_dir)
    return collect_insights(m, o).select(
        "insight_id", "detector_ord", "category", "title", "metric", "country", "city", "zone",
        "severity_score", "summary", "recommendation_hint", "confidence", "affected_zones_count",
    )


_NOISY_SQL = FINDINGS_CTE + """,
arms AS (SELECT *, substring(insight_id, 1, 1) AS arm FROM ins),
noisy AS (
  SELECT * REPLACE (
    CASE WHEN arm = '0' THEN '  ' ELSE title END AS title,
    CASE WHEN arm = '1' THEN NULL ELSE metric END AS metric,
    CASE WHEN arm = '2' THEN '' ELSE summary END AS summary,
    CASE WHEN arm = '3' THEN 'other' ELSE category END AS category,
    CASE WHEN arm = '4' THEN 'LOW' ELSE confidence END AS confidence,
    CASE WHEN arm = '5' THEN 0.01 WHEN arm = '9' THEN NULL ELSE baseline_abs END AS baseline_abs,
    CASE WHEN arm = '9' THEN 0.02 ELSE week_1_value END AS week_1_value,
    CASE WHEN arm = '6' THEN 9.0 ELSE pct_change END AS pct_change,
    CASE WHEN arm IN ('5', '9') THEN 0.03 WHEN arm = '6' THEN 0.15 WHEN arm = '7' THEN 0.005 WHEN arm = '8' THEN 0.15 ELSE abs_delta END AS abs_delta,
    CASE WHEN arm = '8' THEN true WHEN arm = '6' THEN false ELSE sign_flip END AS sign_flip)
  FROM arms),
""" + _filtered("noisy", "quiet")


@register("noise_filter", _NOISY_SQL + "\nSELECT insight_id, category, metric, zone FROM quiet")
def noise_filter(spark, sf_dir):
    """L1: the findings, some altered so that each rule of the filter meets some, that survive it."""
    m, o = zone_tables(spark, sf_dir)
    return C.filter_noise(noisy_insights(collect_insights(m, o))).select("insight_id", "category", "metric", "zone")


@register("priority_rank", _sql(
    "SELECT insight_id, category, round(priority_score, 6) AS priority_score, CAST(curation_rank AS BIGINT) AS curation_rank FROM ranked"))
def priority_rank(spark, sf_dir):
    """L2 + L3: priority score and rank of the filtered findings."""
    m, o = zone_tables(spark, sf_dir)
    scored = C.with_priority(C.filter_noise(collect_insights(m, o)))
    return numbered(scored.orderBy(*C.rank_order()), "curation_rank").select("insight_id", "category", "priority_score", "curation_rank")


_COPIES_SQL = FINDINGS_CTE + """,
arms AS (SELECT *, substring(insight_id, 2, 1) AS arm FROM ins),
copies AS (
  SELECT * EXCLUDE (arm) FROM arms
  UNION ALL
  SELECT * EXCLUDE (arm) REPLACE (
    insight_id || '-a' AS insight_id, '  ' || upper(metric) || ' ' AS metric, summary || ' Again.' AS summary, severity_score - 1.0 AS severity_score)
  FROM arms WHERE arm IN ('0', '1', '2', '3')
  UNION ALL
  SELECT * EXCLUDE (arm) REPLACE (
    insight_id || '-b' AS insight_id, 'Other ' || metric AS metric, upper(replace(summary, ' ', '  ')) AS summary, severity_score + 1.0 AS severity_score)
  FROM arms WHERE arm IN ('4', '5', '6', '7')
  UNION ALL
  SELECT * EXCLUDE (arm) REPLACE (
    insight_id || '-c' AS insight_id, 'Third ' || metric AS metric, summary || ' Third.' AS summary, severity_score - 1.0 AS severity_score)
  FROM arms WHERE arm IN ('8', '9')),
""" + _ranked_cte("copies")


@register("dedup", _COPIES_SQL + "\nSELECT insight_id, category, zone, metric FROM deduped")
def dedup(spark, sf_dir):
    """L4: the findings with planted copies (same metric, same summary, neither) after de-duplication."""
    m, o = zone_tables(spark, sf_dir)
    scored = C.with_priority(materialize(copied_insights(collect_insights(m, o))))
    return C.deduplicate(scored).select("insight_id", "category", "zone", "metric")


def _run(spark, sf_dir):
    m, o = zone_tables(spark, sf_dir)
    return run_insights(m, o)


@register("zone_cap", _sql("SELECT insight_id, category, zone FROM zone_capped"))
def zone_cap(spark, sf_dir):
    """Executive candidates, at most one per zone."""
    return _run(spark, sf_dir).executive_candidates.select("insight_id", "category", "zone")


@register("diversity", _sql(
    "SELECT insight_id, category, CAST(summary_ord AS INTEGER) AS summary_ord FROM diversity"))
def diversity(spark, sf_dir):
    """The executive summary selection (five findings, category-diverse)."""
    return _run(spark, sf_dir).executive_summary.select("insight_id", "category", "summary_ord")


@register("category_top3", _sql(
    "SELECT insight_id, category, CAST(category_rank AS INTEGER) AS category_rank FROM top3"))
def category_top3(spark, sf_dir):
    """Top three findings per category."""
    return _run(spark, sf_dir).by_category.select("insight_id", "category", "category_rank")


@register("curation_counts", _sql("""
SELECT stage, category, CAST(count(x) AS BIGINT) AS "count" FROM (
  SELECT s.stage, s.category, t.x FROM (VALUES ('raw', ''), ('post_filter', ''), ('post_dedup', ''),
      ('executive_summary', ''), ('by_category', 'anomalies'), ('by_category', 'trends'),
      ('by_category', 'benchmarking'), ('by_category', 'correlations'), ('by_category', 'opportunities')) s(stage, category)
  LEFT JOIN (
    SELECT 'raw' AS stage, '' AS category, 1 AS x FROM ins
    UNION ALL SELECT 'post_filter', '', 1 FROM filtered
    UNION ALL SELECT 'post_dedup', '', 1 FROM deduped
    UNION ALL SELECT 'executive_summary', '', 1 FROM diversity
    UNION ALL SELECT 'by_category', category, 1 FROM top3) t
  ON s.stage = t.stage AND s.category = t.category) GROUP BY stage, category"""))
def curation_counts(spark, sf_dir):
    """Counts per curation stage and per category section."""
    return _run(spark, sf_dir).counts
